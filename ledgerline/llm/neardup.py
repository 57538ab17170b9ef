"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Sketch: coordinates fill in rounds. In each of the first T rounds every shingle falls into one hashed bin with a hashed
value; round T + i puts all shingles into bin i, so that every coordinate fills whatever the set's size. A coordinate
keeps the first round's least value; two sets agree in it with a chance of their Jaccard similarity, and the bins make
the number of agreements concentrate as for independent draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize
from .graph import components
from .textnum import U, chunks, hash_words, mix, powers, shingles, sums, times

BANDS, ROWS = 36, 5
T = BANDS * ROWS
#: About so many sets meet one copy of their centre's text.
PAIRS = 512
#: Bits of a set's parities.
PARITY = 512


def sketch(g: np.ndarray, offsets: np.ndarray, t: int = T) -> np.ndarray:
    """(texts, t) array of coordinate values; a text without shingles has none filled (all ones)."""
    empty = U(0xFFFFFFFFFFFFFFFF)
    sizes = np.diff(offsets)
    out = np.full((len(sizes), t), empty, U)
    live = np.flatnonzero(sizes > 0)
    x, doc = g, np.repeat(np.arange(len(sizes)), sizes)
    for r in range(2 * t):
        if not len(live):
            break
        y = mix(x + times(0xA24BAED4963EE407, r + 1))
        bins = ((y >> U(32)) * U(t) >> U(32)).astype(np.int64) if r < t else np.full(len(x), r - t)
        value = (U(r) << U(48)) | (mix(y) >> U(16))
        np.minimum.at(out.reshape(-1), doc * t + bins, value)
        open_ = (out[live] == empty).any(axis=1)
        if not open_.all():
            live = live[open_]
            keep = np.zeros(len(sizes), bool)
            keep[live] = True
            some = keep[doc]
            x, doc = x[some], doc[some]
    return out


def signatures(docs: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """key, n (number of distinct shingles), s (64-bit name of the set), bands. Keys pass as they are, whatever their type."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            for a, b, raws in chunks(batch.column("text").to_pylist()):
                g, offsets = shingles(*hash_words(raws, lower=True), width)
                n = np.diff(offsets)
                coordinates = sketch(g, offsets)
                banded = (mix(coordinates).reshape(len(n), BANDS, ROWS) * powers(ROWS)).sum(axis=2, dtype=U)
                banded = mix(banded + np.arange(1, BANDS + 1, dtype=U) * U(0x9FB21C651E98DF25)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(banded[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(set_name(g, offsets)), bands], [key, "n", "s", "bands"])

    return docs.select(key, "text").mapInArrow(sign, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, s long, bands array<long>")


def set_name(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set of shingles, from two sums over its elements and its size."""
    return mix(sums(mix(g), offsets) + mix(sums(mix(g ^ U(0x5851F42D4C957F2D)), offsets)) + np.diff(offsets).astype(U)).view(np.int64)


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked, apart, n, more, less, added, lost, by_lost, parity) of pairs (a, b, multi): linked tells whether
    100 * intersection >= percent * union of the full sets.

    The rest is for multi pairs, null for others: what could tell of links between b and the other sets that are compared
    with a. Be a the centre, x and y sets with A and R what they have and lack against it, |x - y| their symmetric
    difference, f = (100 - percent) / (100 + percent), and excess(x) = |A(x)| + |R(x)| - f (|x| + |a|), positive if x is
    apart from a. x and y are linked if |x - y| <= f (|x| + |y|). Counting A and R apart, a link needs
    2 |A(x) & A(y)| >= excess(x) + (1 - f) (|y| - |a|) and 2 |R(x) & R(y)| >= excess(x) + (1 + f) (|a| - |y|).
    So a set apart shares an added element with each set that it is linked to, unless that one is smaller than a by
    excess(x) / (1 - f) or more, and then it shares a lost one. As linked sets have sizes alike, each set needs only show
    the first of its added elements, in hash order, as many as it has less the number it must share, plus one.

    n: size of b; more, less: |A(b)|, |R(b)|; by_lost: b is apart and could be linked with so small a set; parity: bits, each
    the parity of how many of b's elements fall on it, so two sets differ in as many elements as bits or more."""
    f, least = (100 - percent) / (100 + percent), percent / 100

    def first(tokens: np.ndarray, shared: float) -> np.ndarray:
        return np.sort(tokens)[: len(tokens) - max(int(np.ceil(shared - 1e-6)), 1) + 1].view(np.int64)

    def tell(x: np.ndarray, y: np.ndarray, linked: bool) -> tuple:
        added, lost = mix(np.setdiff1d(y, x, assume_unique=True)), mix(np.setdiff1d(x, y, assume_unique=True))
        excess = len(added) + len(lost) - f * (len(x) + len(y))
        smaller = max(0.0, len(x) - least * len(y))  # than a by so much, at most, is a set linked with b
        by_lost = not linked and excess <= (1 - f) * smaller + 1e-6
        shown = first(lost, min(excess if not linked else np.inf, (1 + f) * (len(x) - len(y)) if len(y) < len(x) else np.inf) / 2) if by_lost or len(y) < len(x) else lost[:0].view(np.int64)
        parity = np.packbits(np.bincount((y & U(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64)
        return not linked, len(y), len(added), len(lost), first(added, (excess - (1 - f) * smaller) / 2), shown, by_lost, parity

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [x for pair in zip(pdf["x"], pdf["y"], strict=True) for x in pair]
            multi, linked, told = pdf["multi"].to_numpy(), [], []
            for a, b, raws in _even(both):
                g, offsets = shingles(*hash_words(raws, lower=True), width)
                for k in range(0, b - a, 2):
                    x, y = g[offsets[k] : offsets[k + 1]], g[offsets[k + 1] : offsets[k + 2]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(bool(100 * common >= percent * (len(x) + len(y) - common)))
                    told.append(tell(x, y, linked[-1]) if multi[len(told)] else (not linked[-1], len(y), 0, 0, None, None, False, None))
            yield pdf[["a", "b"]].assign(linked=linked, **{c: [t[k] for t in told] for k, c in enumerate(("apart", "n", "more", "less", "added", "lost", "by_lost", "parity"))})

    fan = pairs.groupBy("a").agg((F.count("*") / PAIRS).cast("int").alias("_z"))
    some = pairs.join(fan, "a").withColumn("_z", F.pmod(F.xxhash64("b"), F.col("_z") + 1).cast("int"))
    centres = texts.select(F.col("s").alias("a"), F.col("text").alias("x")).join(fan, "a").withColumn("_z", F.explode(F.sequence(F.lit(0), F.col("_z"))))
    kinds = "a long, b long, linked boolean, apart boolean, n long, more long, less long, added array<long>, lost array<long>, by_lost boolean, parity array<long>"
    met = some.join(texts.select(F.col("s").alias("b"), F.col("text").alias("y")), "b").join(centres, ["a", "_z"])
    return met.select("a", "b", "multi", "x", "y").mapInPandas(check, kinds)


def _even(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """chunks() that never part the two texts of a pair."""
    first, raws, size = 0, [], 0
    for k in range(0, len(texts), 2):
        two = [texts[k].encode(), texts[k + 1].encode()]
        raws, size = raws + two, size + len(two[0]) + len(two[1])
        if size > 1 << 20 or k + 2 == len(texts):
            yield first, k + 2, raws
            first, raws, size = k + 2, [], 0


def texts_of(docs: DataFrame, nodes: DataFrame, width: int, key: str) -> DataFrame:
    """(s, text) of the nodes (s, id): one text for each set."""

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, raws in chunks(pdf["text"].tolist()):
                part = pdf.iloc[a:b]
                yield part.loc[part["s"].to_numpy() == set_name(*shingles(*hash_words(raws, lower=True), width)), ["s", "text"]]

    wanted = nodes.select("s", F.col("id").alias(key))
    return docs.select(key, "text").join(wanted, key).select("s", "text").mapInPandas(same, "s long, text string")


def near_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, key: str) -> DataFrame:
    """Edges (u, v) between sets that connect exactly the sets which true links connect.

    All sets of a bucket are compared with its centre, the one that shares most buckets with most others: as many pairs
    as the bucket has members. Those linked with it are one component. A set apart from it can be linked with another of
    the bucket only if both differ from the centre in a common element; compare() shows those elements. The sets that
    show the same one are first compared with one of them, again as many pairs as sets, which joins those that belong
    together; what is left, sets of different components whose counts and parities allow a link, is compared pair by pair."""
    members = nodes.select("s", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.min("s").alias("_a"), F.max("s").alias("_b"), F.count("*").alias("n")).filter("_a < _b").select("band", "n")
    members = materialize(members.join(sizes, "band"), "buckets")
    fame = members.groupBy("s").agg(F.sum("n").alias("fame"))
    centre = members.join(fame, "s").groupBy("band").agg(F.max(F.struct("fame", "s"))["s"].alias("a"))
    pairs = members.join(centre, "band").filter("s != a").groupBy("a", F.col("s").alias("b")).agg((F.max("n") > 2).alias("multi"))
    wanted = fame.select("s").join(nodes.select("s", "id"), "s")
    texts = materialize(texts_of(docs, wanted, width, key).dropDuplicates(["s"]), "texts")
    told = materialize(compare(pairs, texts, width, percent), "compared")
    edge = lambda df: df.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = edge(told)

    shown = lambda c, lost: F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda t: F.struct(F.lit(lost).alias("lost"), t.alias("t")))
    tokens = told.filter("added is not null").select("a", F.col("b").alias("s"), "apart", "n", "more", "less", "by_lost", F.explode(F.concat(shown(F.col("added"), False), shown(F.col("lost"), True))).alias("x"))
    tokens = tokens.select("a", "x.lost", "x.t", "s", "apart", "n", "more", "less", "by_lost")
    shared = tokens.groupBy("a", "lost", "t").agg(F.min("s").alias("_c"), F.max("s").alias("_d"), F.max("apart").alias("_any")).filter("_c < _d and _any").select("a", "lost", "t", F.col("_c").alias("c"))
    tokens = materialize(tokens.join(shared, ["a", "lost", "t"]), "tokens")
    roots = materialize(components(edges), "roots")
    leads = _with_roots(tokens.select("s", "c").distinct().filter("s != c"), roots).join(roots.select(F.col("node").alias("c"), F.col("root").alias("_q")), "c", "left")
    leads = leads.filter(F.col("root") != F.coalesce("_q", "c")).select(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b")).distinct().withColumn("multi", F.lit(False))
    second = materialize(compare(leads, texts, width, percent), "compared")
    edges = edges.unionByName(edge(second))

    mine = _with_roots(tokens.drop("c"), materialize(components(edges), "roots"))
    mixed = mine.groupBy("a", "lost", "t").agg(F.min("root").alias("_r"), F.max("root").alias("_q")).filter("_r < _q").select("a", "lost", "t")
    parity = told.filter("parity is not null").select(F.col("b").alias("s"), *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY // 64)]).dropDuplicates(["s"])
    mine = materialize(mine.join(mixed, ["a", "lost", "t"]).join(parity, "s"), "mixed")
    x, y, f = mine.filter("apart and (not lost or by_lost)").alias("x"), mine.alias("y"), (100 - percent) / (100 + percent)
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    could = 2 * (F.least(*of("more")) + F.least(*of("less"))) >= F.col("x.more") + F.col("x.less") + F.col("y.more") + F.col("y.less") - f * (F.col("x.n") + F.col("y.n")) - 1e-6
    size = F.col("x.n") - F.col("x.more") + F.col("x.less")  # of the centre
    small = ~F.col("x.lost") | (F.col("x.more") + F.col("x.less") - f * (F.col("x.n") + size) <= (1 - f) * (size - F.col("y.n")) + 1e-6)
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.lost") == F.col("y.lost")) & (F.col("x.t") == F.col("y.t"))
    bits = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITY // 64)), F.lit(0))
    near = bits <= f * (F.col("x.n") + F.col("y.n")) + 1e-6
    more = x.join(y, same & (F.col("x.root") != F.col("y.root")) & could & small & near).select(F.least(*of("s")).alias("a"), F.greatest(*of("s")).alias("b")).distinct()
    more = more.join(second.select("a", "b"), ["a", "b"], "left_anti").withColumn("multi", F.lit(False))
    return materialize(edges.unionByName(edge(compare(more, texts, width, percent))), "links")


def _with_roots(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df (s, ..) with root, the set itself where it has no link."""
    return df.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of docs (key, text).

    A document's set: distinct shingles of width words, A-Z lower-cased; with fewer words its whole sequence. Documents
    with 100 * intersection >= percent * union are linked; component_id is the smallest key reachable over links.

    Null and empty texts have no set and are linked with nothing; rows with an equal key and different texts take part
    with each text; a null key takes part only through sets that other rows share, and where no row of its component has
    a key, component_id is null and the row is kept; an empty table gives no rows."""
    signed = materialize(signatures(docs, width, key), "signed")
    sets = signed.filter((F.col("n") > 0) & F.col(key).isNotNull())
    nodes = sets.groupBy("s").agg(F.min(F.struct(F.col(key).alias("id"), "bands")).alias("x")).select("s", "x.id", "x.bands")
    nodes = materialize(nodes, "nodes")
    edges = near_links(docs, nodes, width, percent, key)
    roots = components(edges).withColumnRenamed("node", "s")
    named = nodes.select("s", "id").join(roots, "s")
    lowest = named.groupBy("root").agg(F.min("id").alias("low"))
    low = nodes.select("s", "id").join(named.select("s", "root"), "s", "left").join(lowest, "root", "left").select("s", F.coalesce("low", "id").alias("low"))
    out = signed.select(key, "n", "s").join(low, "s", "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col(key))
    return out.select(key, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col(key) == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component of rows the one with the least key, null last; see
    near_duplicates(). Rows count each for itself, whether keys repeat or are null; those without a set stay."""
    row = free_name(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(row, "text"), row, width, percent).select(F.col(row).alias("_row"), "component_id")
    found = materialize(found.join(rows.select(F.col(row).alias("_row"), F.col(key).alias("_k")), "_row"), "found")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_row"))["_row"].alias(row))
    return rows.join(kept.select(row), row, "left_semi").select([f"`{c}`" for c in docs.columns])
