"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt out to blocks of about BLOCK_ROWS; a block keeps, for each dimension, its rows sorted by that component. For an
anchor, sorted access goes down each list from the end that its component's sign prefers, all lists in step; each row met is
scored as a whole (random access), in integers. The scores of rows not met yet are at most the threshold, the score of the values
the lists have come to. A block is left as soon as the threshold is strictly below the k-th score of each window, or below
the window; rows that tie at the k-th place are then all known, so ties by id are right.

Two passes: the best rows of the anchor's own label give its positives, their scores the windows of the second pass. Anchors go
to blocks packed in chunks; every step between works on the few best rows of a block. Anchors against all rows are the stated query
set; no pair of rows is ever a row of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS, CHUNK_ROWS = 8192, 1024
#: Components are held within this bound, so that 100 times a sum over 2^13 dimensions stays exact in 64 bits.
BOUND = 1 << 21
#: Sorted access goes down so many places at first, then twice as far each time.
FIRST_DEPTH = 16


def usable(rows: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (integer components) of the rows that take part, one for each vec_id: the least by label and vector."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    v = F.transform("embedding", lambda x: F.floor(F.least(F.lit(float(BOUND)), F.greatest(F.lit(float(-BOUND)), x.cast("double") * 256))).cast("int"))
    one = rows.filter(ok).filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), v.alias("v")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def matrix(vectors: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width or 0, int(sizes.max(initial=0)))), np.int64)
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Lists:
    """A block's rows, and for each dimension their order by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(x, self.order.T, axis=0)
        self.met = 0

    def rows_met(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows newly met, their scores, threshold), in steps of sorted access; the threshold is None once no row is left."""
        n = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, at, depth = np.zeros(n, bool), 0, FIRST_DEPTH
        while True:
            to = min(n, depth)
            near = np.zeros(n, bool)
            near[self.order[up, n - to : n - at].ravel()] = True
            near[self.order[down, at:to].ravel()] = True
            if to == n:
                near[:] = True  # lists of zero components hold the rest
            new = np.flatnonzero(near & ~seen)
            seen[new] = True
            self.met += len(new)
            last = to == n
            threshold = None if last else int(self.sorted[n - to, up] @ a[up] + self.sorted[to - 1, down] @ a[down])
            yield new, self.x[new] @ a, threshold
            if last:
                return
            at, depth = to, depth * 2

    def best(self, a: np.ndarray, keep, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (100 * score from low to high), the k first (score, id) of the rows that keep accepts."""
        scores, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for new, s, threshold in self.rows_met(a):
            ok = keep(new)
            scores, rows = np.concatenate([scores, s[ok]]), np.concatenate([rows, new[ok]])
            if threshold is not None and not all(self._settled(scores, w, threshold, k) for w in windows):
                continue
            break
        out = []
        for low, high in windows:
            inside = (100 * scores >= low) & (100 * scores <= high)
            s, ids = scores[inside], self.ids[rows[inside]]
            first = np.lexsort((ids, -s))[:k]
            out.append(list(zip(s[first].tolist(), ids[first].tolist(), strict=True)))
        return out

    @staticmethod
    def _settled(scores: np.ndarray, window: tuple[int, int], threshold: int, k: int) -> bool:
        low, high = window
        if low > high or 100 * threshold < low:
            return True
        inside = scores[(100 * scores >= low) & (100 * scores <= high)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


#: Wider than any score; times 100 it still fits.
ALL = (-(1 << 63), (1 << 63) - 1)


def _pack(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Anchors in chunks of about CHUNK_ROWS, a row each, and the number of chunks."""
    chunks = max(1, math.ceil(rows.count() / CHUNK_ROWS))
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(chunks).cast("long")).alias("chunk")).agg(F.collect_list(F.struct(*columns)).alias("a")), chunks


def _against_blocks(rows: DataFrame, blocks: int, anchors: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(block as a Table, anchors as a Table) for each block of rows with each chunk of anchors."""
    packed, chunks = _pack(anchors, columns)
    sides = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return sides.groupBy("block", "chunk").cogroup(packed.groupBy("block", "chunk")).applyInArrow(run, schema)


def _both(left: pa.Table, right: pa.Table) -> tuple[Lists, pa.Array, np.ndarray] | None:
    if not left.num_rows or not right.num_rows:
        return None
    anchors = right.column("a").combine_chunks().flatten()
    a, x = matrix(anchors.field("v")), matrix(left.column("v"))
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    return Lists(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), x), anchors, a


def _positives(k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("other", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if both := _both(left, right):
            lists, anchors, a = both
            for i, (own, label) in enumerate(zip(anchors.field("vec_id").to_pylist(), anchors.field("label").to_pylist(), strict=True)):
                (found,) = lists.best(a[i], lambda r: (lists.labels[r] == label) & (lists.ids[r] != own), [ALL], k)  # noqa: B023
                for s, other in found:
                    for column, x in zip(out, (own, s, other), strict=True):
                        column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def _negatives(k: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "positive_score", "score", "other"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[] for _ in names]
        if both := _both(left, right):
            lists, anchors, a = both
            for i, (own, label, p) in enumerate(zip(anchors.field("vec_id").to_pylist(), anchors.field("label").to_pylist(), anchors.field("p").to_pylist(), strict=True)):
                windows = [(low * x["score"], high * x["score"]) for x in p]
                for x, found in zip(p, lists.best(a[i], lambda r: lists.labels[r] != label, windows, k), strict=True):  # noqa: B023
                    for s, other in found:
                        for column, value in zip(out, (own, x["other"], x["score"], s, other), strict=True):
                            column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, embedding): for each
    anchor and positive the first rows of another label whose score lies within low and high percent of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that share an id the least by
    label and vector takes part. Vectors of unequal length count as filled up with zeros; an empty one scores 0. Components
    beyond 2^21 count as 2^21. A positive with a negative score has an empty window, one with score 0 the rows of score 0. Anchors
    without positives, positives without negatives and empty tables give no rows; further columns are not looked at."""
    found = materialize(usable(rows), "vectors")
    blocks = max(1, math.ceil(found.count() / BLOCK_ROWS))
    anchors = found.filter(F.col("vec_id") % every == 0)
    near = _against_blocks(found, blocks, anchors, ["vec_id", "label", "v"], _positives(positives), "anchor_id long, score long, other long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other")
    near = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    pairs = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("score", "other")).alias("p"))
    asked = materialize(anchors.join(pairs, "vec_id"), "anchors")
    hard = _against_blocks(found, blocks, asked, ["vec_id", "label", "v", "p"], _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, score long, other long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
