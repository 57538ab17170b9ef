"""Mixing sources to target weights: documents in hash order, prefix sums within each source, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, materialize, text_of, words

#: About so many documents of a source share one range of keys.
RANGE_ROWS = 2_000
#: Rows of a source meet its target in so many parts.
PARTS = 32


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, n_docs, target. sizes: (source, size) rows.

    Sources in code point order, null last, get the weights in turn and share the total size; a target stops at cap
    times its source's size and the excess goes to the others by weight. That is one water level: a source is full if
    even the level left after all sources fuller than it would lift it above its cap. One row a source, so the two
    windows over all sources read no documents."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn % len(weights)))
    by = by.withColumn("_cap", cap * F.col("source_size").cast("double"))
    fullest = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_cap").over(fullest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(fullest.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("_all", F.sum("source_size").over(every).cast("double")).withColumn("_full", F.col("_cap") * left <= F.col("_w") * (F.col("_all") - before))
    level = F.try_divide(F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every), F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every))
    return by.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.coalesce(F.col("_w") * level, F.lit(0.0)))).select("source", "source_size", "n_docs", "target")


def hash_key(key: Column, seed: str) -> Column:
    """60 bits of md5 over seed and key as a long; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(sizes: DataFrame, key: str = "doc_id", seed: str = "mix:", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, rows_by: tuple[str, ...] = ()) -> DataFrame:
    """key, size, source_size, target, taken for each row of sizes (key, source, size), and rows_by, which tell rows apart.

    A source's budget is its target rounded to words: so many whole epochs as fit, then its documents in hash order
    until the budget is used up; the document at the cut gives the words that are missing. Each source's key space is
    split into equal ranges of about RANGE_ROWS documents, however large it is: documents are sorted within a range, and
    only the ranges' sums are added up over the source.

    Rows with an equal key tie and go by size and rows_by; a null key counts as empty text, a null source is a source of its own;
    an empty table gives no rows; a source without words takes none."""
    rows = materialize(sizes.select(F.col(key).alias("_k"), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), hash_key(F.col(key), seed).alias("_h"), *rows_by), "mix")
    share = targets(rows, weights, cap).withColumn("_n", F.ceil(F.col("n_docs") / RANGE_ROWS)).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_z", F.col("source").isNull())
    share = share.withColumn("_budget", F.round("target").cast("long")).drop("source", "n_docs")
    share = share.withColumn("_epochs", F.coalesce(F.expr("try_divide(_budget, source_size)").cast("long"), F.lit(0).cast("long")))
    share = share.withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    rows = rows.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_z", F.col("source").isNull()).drop("source")
    share = share.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    ranged = rows.withColumn("_p", F.pmod(F.col("_h"), F.lit(PARTS)).cast("int")).join(share, ["_s", "_z", "_p"]).withColumn("_r", F.floor(F.col("_h") / F.lit(float(1 << 60)) * F.col("_n")))
    place = ["_s", "_z", "_r"]
    sums = ranged.groupBy(*place).agg(F.sum("size").alias("_in"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_in").over(W.partitionBy("_s", "_z").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    within = F.coalesce(F.sum("size").over(W.partitionBy(*place).orderBy("_h", F.col("_k").asc_nulls_last(), "size", *rows_by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = ranged.withColumn("_before", within).join(starts, place)
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_start")))
    return cut.select(F.col("_k").alias(key), "size", "source_size", "target", (F.col("_epochs") * F.col("size") + partial).cast("long").alias("taken"), *rows_by)


def document_sizes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, "source", F.size(words(text_of())).cast("long").alias("size"))


def mixed_texts(docs: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs as often as taken (key, size, taken) says: whole copies, then one cut to its first words. Columns of docs may
    have any names."""
    t = taken.groupBy(F.col(key).alias("_k")).agg(F.max("size").alias("_size"), F.max("taken").alias("_taken")).filter((F.col("_taken") > 0) & (F.col("_size") > 0))
    whole, rest = F.expr("_taken div _size").cast("int"), F.expr("_taken % _size").cast("int")
    lengths = F.array_compact(F.concat(F.array_repeat(F.lit(-1), whole), F.array(F.when(rest > 0, rest))))
    packed = docs.select(F.col(key).alias("_d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    some = packed.join(t, F.col("_d").eqNullSafe(F.col("_k"))).withColumn("_cut", F.explode(lengths))
    text = F.when(F.col("_cut") < 0, F.col("_doc.text")).otherwise(F.array_join(F.slice(words(text_of("_doc.text")), 1, F.greatest(F.col("_cut"), F.lit(1))), " "))
    some = some.withColumn("_new", text)
    put = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return some.select([put.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def mixed_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs mixed to the sources' weights, row by row: rows that share a key, or have none, are each taken as often as
    their own part of the budget says."""
    row = free_name(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = rows.select(F.col(key).alias("_id"), "source", F.size(words(text_of())).cast("long").alias("size"), F.xxhash64("text").alias("_text"), F.col(row).alias("_row"))
    return mixed_texts(rows, mix(sizes, "_id", rows_by=("_text", "_row")).withColumnRenamed("_row", row), row).select([f"`{c}`" for c in docs.columns])
