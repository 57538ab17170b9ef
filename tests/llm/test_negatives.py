"""op11 against every pair."""

import math
import random

import numpy as np
import pytest
from ledgerline.llm import negatives as h

SCHEMA = "vec_id long, label int, embedding array<float>, score int"


def plain(rows, positives=5, negatives=10):
    one = {}
    for vec, label, v, *_ in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [max(-h.BOUND, min(h.BOUND, math.floor(256 * float(np.float32(c))))) for c in v]
        r = ((label + 1) % 10 if vec % 7 == 0 else label, x)
        one[vec] = min(one.get(vec, r), r)
    out = set()
    for anchor in [k for k in one if k % 100 == 0]:
        label, a = one[anchor]
        scored = sorted(((sum(p * q for p, q in zip(a, x)), k, own) for k, (own, x) in one.items() if k != anchor), key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [t for t in scored if t[2] == label][:positives]:
            inside = [(s, k) for s, k, own in scored if own != label and 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out |= {(anchor, p, n + 1, k, ps, s) for n, (s, k) in enumerate(inside)}
    return out


def result(spark, rows, **how):
    got = [tuple(r) for r in h.hard_negatives(spark.createDataFrame(rows, SCHEMA), **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("block", "chunk"), [(8192, 1024), (60, 2)])
def test_equals_every_pair(spark, monkeypatch, block, chunk):
    """Clustered vectors with many ties, in one block and in many."""
    monkeypatch.setattr(h, "BLOCK_ROWS", block)
    monkeypatch.setattr(h, "CHUNK_ROWS", chunk)
    rng = random.Random(block)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, rng.randrange(4), [round(c + rng.choice([0, 0, 0.125, -0.25]), 2) for c in rng.choice(centres)], 1) for k in range(700)]
    want = plain(rows)
    assert len(want) > 200 and result(spark, rows) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], 0), (0, 1, [1.0, 0.5], 0), (0, 2, [3.0, 3.0], 0), (1, 1, [1.0, 1.0], 0), (2, 1, [0.5], 0), (3, 2, [0.7, 0.1], 0), (4, 2, [], 0), (5, 2, None, 0), (6, None, [1.0, 1.0], 0), (8, 2, [nan, 1.0], 0)]
    rows += [(9, 2, [inf, 1.0], 0), (10, 2, [None, 1.0], 0), (None, 2, [0.7, 0.1], 0), (11, 3, [0.3, 0.3], 0), (12, 3, [3e38, -3e38], 0), (100, 5, [-1.0, -1.0], 0), (101, 5, [1.0, 1.0], 0), (200, 8, [1.0], 0), (300, 6, [0.0, 0.0], 0), (301, 6, [1.0, 1.0], 0)]
    want = plain(rows)
    assert want and result(spark, rows) == want
    assert h.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sorted_access_stops_early():
    """Where a few rows stand out, few rows of a block are scored."""
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (5000, 4))
    x[:12] = 900 + np.arange(12)[:, None]
    lists = h.Lists(np.arange(5000), np.zeros(5000, np.int64), x)
    (found,) = lists.best(np.array([3, 1, 2, 5]), lambda r: r >= 0, [h.ALL], 10)
    assert [i for _, i in found] == list(range(11, 1, -1)) and lists.met < 200
