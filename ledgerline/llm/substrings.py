"""Removal of word runs that repeat across documents, found by locally consistent renaming (recompression).

Words get 64-bit names. A round renames each short run of equal symbols, then each adjacent pair whose first symbol
falls into the left and whose second into the right half of the names; both depend on nothing but the symbols
themselves, so equal substrings get equal interior symbols in all documents, whichever task works on them: a name is a
hash of what it stands for and needs no dictionary. After ROUNDS rounds Q consecutive symbols form a high-level symbol.

Why no repeat is missed: in round r a symbol spans CAP(r) = 2^r words at most. Near either end of a window, renaming can
depend on what lies outside: a run step leaves at most CAP(r) words in doubt and a pair step CAP(r) - 1. What lies more
than MARGIN words inside a window is named equally wherever the window occurs, and there is always a high-level symbol
there (checked below). Of those each window takes the one with the least name, so two occurrences of a window take the
same symbol. Windows whose symbol occurs in several documents are candidates and are verified as a whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textnum import U, chunks, hash_words, mix, powers, sums, times, windows

ROUNDS, Q = 2, 4
MARGIN = sum(2 ** (r + 1) - 1 for r in range(1, ROUNDS + 1))
SPAN = 2**ROUNDS
#: Occurrences of a window are dealt out to so many parts by their document.
PARTS = 32


def rename(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, word after the last, text) of the symbols after all rounds."""
    start = np.arange(len(ids))
    span = np.ones(len(ids), np.int64)
    for r in range(1, ROUNDS + 1):
        cap = 2**r
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(ids)))
        width = np.add.reduceat(span, head) if len(head) else head
        run = (count > 1) & (width <= cap)
        keep = new | ~np.repeat(run, count)
        ids, span = ids.copy(), span.copy()
        ids[head[run]] = mix(ids[head[run]] * U(0x9FB21C651E98DF25) + count[run].astype(U))
        span[head[run]] = width[run]
        ids, span, start, doc = ids[keep], span[keep], start[keep], doc[keep]
        left = (mix(ids + times(0xA24BAED4963EE407, r)) >> U(63)).astype(bool)
        pair = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]) & (span[1:] + span[:-1] <= cap)
        at = np.flatnonzero(pair)
        ids[at] = mix(ids[at] * U(0xD1342543DE82EF95) + mix(ids[at + 1]) + U(r))
        span[at] += span[at + 1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, span, start, doc = ids[keep], span[keep], start[keep], doc[keep]
    return ids, start, start + span, doc


def window_symbols(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the high-level symbol that each window takes, where the window starts) for all windows of width words."""
    if 2 * MARGIN + SPAN - 1 + Q * SPAN > width:
        raise ValueError(f"windows of {width} words are too short for {ROUNDS} rounds")
    at = np.arange(len(h))
    sizes = np.diff(offsets)
    at = at[np.repeat(offsets[1:], sizes) - at >= width]
    if not len(at):
        return np.zeros(0, U), at
    ids, start, end, _ = rename(h, np.repeat(np.arange(len(sizes)), sizes))
    name = np.zeros(len(ids) - Q + 1, U)
    for j in range(Q):
        name = name * U(0x9E3779B97F4A7C15) + ids[j : len(ids) - Q + 1 + j]
    name = mix(name)
    a = np.searchsorted(start, at + MARGIN)
    b = np.searchsorted(end, at + width - MARGIN, side="right") - Q + 1  # the symbols from a to before b lie inside
    level = np.frexp((b - a).astype(float))[1] - 1
    out, least = np.zeros(len(at), U), name
    for k in range(int(level.max()) + 1):
        some = level == k
        out[some] = np.minimum(least[a[some]], least[b[some] - 2**k])
        least = np.minimum(least[: -(2**k)], least[2**k :]) if len(least) > 2**k else least
    return out, at


def _describe(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, n_words, words_a, words_b (names of the word sequence), kept_sha256 (of all words), symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            for a, b, raws in chunks(batch.column("text").to_pylist()):
                h, offsets = hash_words(raws)
                place = powers(len(h))
                first = np.repeat(offsets[:-1], np.diff(offsets))
                other, _ = hash_words(raws, seed=1)
                one, two = sums(h * place[np.arange(len(h)) - first], offsets), sums(mix(other) * mix(place)[np.arange(len(h)) - first], offsets)
                symbol, at = window_symbols(h, offsets, width)
                doc = np.searchsorted(offsets, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])  # neighbours mostly take the same
                own = [np.unique(x).view(np.int64) for x in np.split(symbol[new], np.searchsorted(doc[new], np.arange(1, b - a)))]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64)), pa.array([hashlib.sha256(b" ".join(r.split())).digest() for r in raws], pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                    [key, "n_words", "words_a", "words_b", "kept_sha256", "symbols"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, words_a long, words_b long, kept_sha256 binary, symbols array<long>")


def _windows(found: DataFrame, key: str, width: int) -> DataFrame:
    """(w, v, key, at): two hashes, of 64 and of 26 bits, and the start of the windows of found (key, text, symbols) whose symbol
    is one of symbols. They are built on independent hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, symbols = batch.column(key), batch.column("symbols").to_pylist()
            for a, b, raws in chunks(batch.column("text").to_pylist()):
                h, offsets = hash_words(raws)
                symbol, at = window_symbols(h, offsets, width)
                w, _ = windows(h, offsets, width)
                v, _ = windows(hash_words(raws, seed=1)[0], offsets, width)
                cuts = np.searchsorted(at, offsets)
                hit = np.zeros(len(at), bool)
                for k in range(b - a):
                    part = slice(cuts[k], cuts[k + 1])
                    hit[part] = np.isin(symbol[part].view(np.int64), np.asarray(symbols[a + k], np.int64))
                doc = np.searchsorted(offsets, at[hit], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[hit].view(np.int64)), pa.array((v[hit] >> U(38)).astype(np.int32)), keys.take(pa.array(a + doc)), pa.array((at[hit] - offsets[doc]).astype(np.int32))], ["w", "v", key, "at"]
                )

    return found.select(key, "text", "symbols").mapInArrow(run, f"w long, v int, `{key}` {found.schema[key].dataType.simpleString()}, at int")


def _cut(found: DataFrame, key: str, width: int) -> DataFrame:
    """(key, words_a, n_removed, cut_sha256, kept_text) for found (key, text, starts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, starts in zip(pdf[key], pdf["text"], pdf["starts"], strict=True):
                raw = (text or "").encode()
                own = raw.split()
                h, offsets = hash_words([raw])
                starts = np.asarray(starts, np.int64)
                starts = starts[starts + width <= len(own)]
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                keep = np.cumsum(edge)[:-1] == 0
                kept = b" ".join(x for x, yes in zip(own, keep, strict=True) if yes)
                rows.append((k, int(mix(sums(h * powers(len(h)), offsets)).view(np.int64)[0]), int((~keep).sum()), hashlib.sha256(kept).digest(), kept.decode()))
            yield pd.DataFrame(rows, columns=[key, "words_a", "n_removed", "cut_sha256", "kept_text"])

    return found.mapInPandas(run, f"{key} {found.schema[key].dataType.simpleString()}, words_a long, n_removed long, cut_sha256 binary, kept_text string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", width: int = 50, with_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 for each row of docs (key, text); with_text adds kept_text, the kept words
    where any were removed, else null.

    A word goes if it lies in a window of width words whose words also start in a document with a smaller key; windows
    are judged on the input. A document whose whole word sequence a smaller one has goes whole if it has a window.

    Null texts have no words; rows with an equal key are no smaller than each other, and with different texts each is
    judged for itself; rows with a null key keep all, as no key is smaller, and no other row is held against them; no
    rows give no rows. Windows are candidates by their high-level symbol and equal if two hashes of their words are: 90 bits.

    The least key of a window is aggregated before the shuffle, and its occurrences meet it in PARTS parts, so a passage that
    very many documents share is spread."""
    told = materialize(_describe(docs, key, width), "told")
    first = told.filter(F.col(key).isNotNull()).groupBy("words_a", "words_b").agg(F.min(key).alias("_first"))
    told = told.join(first, ["words_a", "words_b"], "left").withColumn("copy", F.coalesce(F.col("_first") < F.col(key), F.lit(False)) & (F.col("n_words") >= width))
    own = told.filter(~F.col("copy") & F.col(key).isNotNull()).select(key, F.explode("symbols").alias("symbol"))
    shared = own.groupBy("symbol").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).filter("_a < _b").select("symbol")
    wanted = own.join(shared, "symbol", "left_semi").groupBy(key).agg(F.collect_set("symbol").alias("symbols"))
    found = materialize(docs.select(key, "text").join(wanted, key), "found")
    at = _windows(found, key, width)
    at = at.select("w", (F.col("v") * PARTS + F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).alias("vz"), key, "at")
    least = at.groupBy("w", F.expr(f"vz div {PARTS}").alias("v")).agg(F.min(key).alias("_a"), F.max(key).alias("_b"), F.expr(f"bit_or(shiftleft(1L, vz % {PARTS}))").alias("_m")).filter("_a < _b")
    parts = F.expr(f"filter(sequence(0, {PARTS - 1}), z -> getbit(_m, z) = 1)")
    least = least.select("w", "_a", "v", F.explode(parts).alias("_z")).select("w", "_a", (F.col("v") * PARTS + F.col("_z")).cast("int").alias("vz"))
    starts = at.join(least, ["w", "vz"]).filter(F.col("_a") < F.col(key)).groupBy(key).agg(F.collect_set("at").alias("starts"))
    cut = _cut(found.select(key, "text").join(starts, key), key, width)
    cut = cut if with_text else cut.drop("kept_text")
    out = told.select(key, "n_words", "words_a", "copy", F.col("kept_sha256").alias("_all")).join(cut.dropDuplicates([key, "words_a"]), [key, "words_a"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("cut_sha256", "_all"))))
    text = [F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    return out.select(key, "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), *text)
