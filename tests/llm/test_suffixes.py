"""op13 against every string of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from ledgerline.llm import suffixes as x

SCHEMA = "doc_id long, text string, sha string, n_bytes int"


def plain(rows, width=200):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(raw[p : p + width] for raw in raws for p in range(len(raw) - width + 1))
    out = []
    for (doc, *_), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone), strict=False))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in x.remove_repeated_bytes(docs, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def corpus(seed):
    """Texts with shared passages of about 200 bytes, copies, near copies, periods and many bytes a letter."""
    r = random.Random(seed)
    letters = "abcdefgh ñ日🙂"
    make = lambda n: "".join(r.choices(letters, k=n))
    passages = [make(n) for n in (120, 150, 170, 199, 200, 201, 260, 500)]
    rows = [(None, None), (None, ""), (1, "short"), (1, "short")]
    for k in range(60):
        parts = [make(r.randint(0, 300)) for _ in range(r.randint(1, 4))] + r.choices(passages, k=r.randint(0, 2))
        r.shuffle(parts)
        rows.append((r.choice([k, k, None]), "".join(parts)))
    base = make(900)
    rows += [(100 + k, base) for k in range(4)] + [(200 + k, base[: 100 * k] + make(1) + base[100 * k :]) for k in range(9)]
    rows += [(300, "ab" * 400), (301, "a" * 700), (302, "xyz" + "ab" * 150), (303, "a" * 199), (304, "b" * 200), (305, make(150) + "a" * 201), (306, base + base), (307, base + base)]
    once = make(300)
    rows += [(400, once + make(50) + once), (401, make(10) + "日" * 80), (402, "日" * 66 + "x" + "本" * 67)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_string(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert sum(r[2] for r in want) > 10_000 and result(spark, rows) == want


def test_small_parts_and_hot_names(spark, monkeypatch):
    """Texts cut into overlapping parts, small sorts, names with few fragments dealt out by strings: the same rows."""
    monkeypatch.setattr(x, "PART_BYTES", 700)
    monkeypatch.setattr(x, "SORT_BYTES", 1000)
    monkeypatch.setattr(x, "HOT", 2)
    rows = corpus(3)
    assert result(spark, rows) == plain(rows)


def test_no_names_by_hash_alone(spark):
    """The Thue-Morse word and its complement, whose polynomial hashes agree modulo 2^64, are not taken for one another."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other + "z"), (3, word[:2048] + "q" + other[:2048])]
    assert result(spark, rows) == plain(rows)


def test_edges(spark):
    assert result(spark, []) == Counter()
    rows = [(1, "y" * 3_000_000), (2, "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=1_500_000)))]
    got = sorted(result(spark, rows))
    assert got[0][:4] == (1, 3_000_000, 3_000_000, 1) and got[1][2:4] == (0, 0)


def test_deep_shallow_sort():
    """The order of the suffixes: words first, tries below, ties together."""
    r = random.Random(2)
    stem = bytes(r.choices(b"ab", k=60))
    texts = [stem[: r.randint(0, 60)] + bytes(r.choices(b"ab\0\xff", k=80)) for _ in range(500)] + [stem + bytes(80)] * 3
    texts = [t[:64] for t in texts]
    buf = b"".join(texts) + bytes(8)
    place = np.arange(len(texts)) * 64
    words = np.ndarray(len(buf) - 7, ">u8", buf, strides=(1,)).astype(np.uint64)
    groups = np.repeat([0, 1], [200, len(texts) - 200])
    order, edge = x.quicksort(words, place, groups, 2)
    heads = [*np.flatnonzero(edge).tolist(), len(order)]
    done = []
    for a, b in zip(heads, heads[1:], strict=False):
        own = order[a:b].tolist()
        for same in x.blind_trie([texts[k] for k in own]):
            done += [(k, len(same)) for k in (own[i] for i in same)]
    assert [texts[k] for k, _ in done[:200]] == sorted(texts[:200]) and [texts[k] for k, _ in done[200:]] == sorted(texts[200:])
    assert all(n == Counter(texts[:200] if k < 200 else texts[200:])[texts[k]] for k, n in done)
