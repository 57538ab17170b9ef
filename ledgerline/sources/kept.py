"""Tables that are changed in part. Rows live in files by ranges of their key's hash; a manifest, itself a numbered table, has a row
for each range: how many bits of the hash it fixes, which, where its rows are and how many. A merge reads and writes the ranges
that its batch touches and nothing else, then writes the next manifest, whose completion is the commit. Ranges that grow beyond
a size are split by further bits as they are written, so a key always has one small range."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .sinks import _versions, write_table

#: A range of more rows is split when it is next written.
RANGE_ROWS = 1_000_000
MANIFEST = "depth int, slot long, folder string, rows long, schema string"


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_of(spark: SparkSession, path: str) -> int:
    """The number of the last complete manifest, 0 without one."""
    return max((n for n, whole in _versions(spark, f"{path}/manifest").items() if whole), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = version or version_of(spark, path)
    if not version:
        return spark.createDataFrame([(0, 0, None, 0, None)], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v-{version:08}")


def _slot(key: str | Column, depth: int | Column) -> Column:
    bits = F.expr(f"shiftleft(1L, {depth}) - 1") if isinstance(depth, int) else F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1
    return F.xxhash64(key).bitwiseAND(bits)


def _ranges(found: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(depth, slot, folder, rows, schema, more): the ranges of the manifest that rows of batch fall into, and how many do."""
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]
    hashes = batch.select(F.xxhash64(key).alias("h"))  # counted by range at once: hashes need not meet
    places = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("h").bitwiseAND((1 << d) - 1).alias("slot")) for d in depths])
    more = hashes.select(F.explode(places).alias("at")).groupBy("at.depth", "at.slot").agg(F.count("*").alias("more"))
    return found.join(more, ["depth", "slot"])


def _rows_of(spark: SparkSession, path: str, ranges: list) -> DataFrame:
    """The rows of ranges; the schema is that of the last range written, which knows all columns."""
    full = [r for r in ranges if r["folder"] and r["rows"]]
    kinds = sorted({r["schema"] for r in ranges if r["schema"]}, key=len)
    schema = T.StructType.fromDDL(kinds[-1]) if kinds else T.StructType([])
    return spark.read.schema(schema).parquet(*[f"{path}/{r['folder']}" for r in full]) if full else spark.createDataFrame([], schema)


def read_kept(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str | None = None, version: int | None = None) -> DataFrame:
    """The table, or its rows whose key is in keys: then only the ranges of those keys are read."""
    found = manifest(spark, path, version)
    if keys is None:
        return _rows_of(spark, path, found.collect())
    some = _rows_of(spark, path, _ranges(found, keys, key).collect())
    return some.join(keys.select(key).distinct(), key, "left_semi") if some.columns else some


def lookup_kept(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key: one file of RANGE_ROWS rows at most is read, however large the table is."""
    one = spark.createDataFrame([(value,)], f"`{key}` {'long' if isinstance(value, int) else 'string'}")
    some = _rows_of(spark, path, _ranges(manifest(spark, path), one, key).collect())
    return some.filter(F.col(key) == F.lit(value)) if some.columns else some


def merge_kept(batch: DataFrame, path: str, key: str, merge: Callable[[DataFrame | None], DataFrame], over: bool = False) -> int:
    """Commits merge(rows of the ranges that keys of batch fall into) in place of these rows, and returns the new version. merge gets None
    for a table that was never written, and what it returns must have keys of these ranges only. Rows that merge adds may have new columns. One writer at a time: a commit that
    finds another version than it began with is refused. With over, merge returns new rows alone, one a key: they take the place of the rows of
    their keys, and the others stay; rows of both are then told apart where they are written, without a shuffle of their own. Nothing that stands is changed, so a merge that breaks off at any step
    leaves the version before it current, and may be put again."""
    spark, base = batch.sparkSession, version_of(batch.sparkSession, path)
    found = manifest(spark, path, base)
    touched = _ranges(found, batch, key).collect()
    if not touched and base:
        return base
    old = _rows_of(spark, path, touched)
    new = merge(old if old.columns else None)
    over = over and bool(old.columns)
    if over:
        new = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    split = [(r["depth"], r["slot"], r["depth"] + max(0, math.ceil(math.log2(max(1, (r["rows"] + r["more"]) / RANGE_ROWS))))) for r in touched]
    deepest = max((d for d, _, _ in split), default=0)
    finest = spark.createDataFrame(split, "depth int, slot long, _depth int").select(
        "_depth", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {deepest} - depth) - 1")), lambda k: F.col("slot") + F.call_function("shiftleft", k, F.col("depth")))).alias("_at")
    )
    # a row for each finest range: rows find theirs where they are, and are shuffled once, to be written
    rows = new.withColumn("_at", _slot(key, deepest)).join(F.broadcast(finest), "_at").withColumn("_slot", _slot(key, F.col("_depth"))).drop("_at")
    folder = f"data/after-{base:08}-{uuid.uuid4().hex}"
    rows = rows.repartition("_depth", "_slot")
    if over:  # a key's rows have met with those of its range
        first = F.row_number().over(W.partitionBy("_depth", "_slot", key).orderBy(F.desc("_new")))
        rows, new = rows.withColumn("_first", first).filter("_first = 1").drop("_first", "_new"), new.drop("_new")
    rows.write.option("compression", "zstd").partitionBy("_depth", "_slot").parquet(f"{path}/{folder}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    told = spark.read.schema(T.StructType([*new.schema.fields, T.StructField("_depth", T.IntegerType()), T.StructField("_slot", T.LongType())])).parquet(f"{path}/{folder}").groupBy("_depth", "_slot").agg(F.count("*").alias("rows"))
    where = F.concat(F.lit(f"{folder}/_depth="), F.col("_depth"), F.lit("/_slot="), F.col("_slot"))
    mine = [(d + e, s + (k << d)) for d, s, to in split for e in [to - d] for k in range(1 << e)]
    each = spark.createDataFrame(mine, "_depth int, _slot long").join(told, ["_depth", "_slot"], "left")
    each = each.select(F.col("_depth").alias("depth"), F.col("_slot").alias("slot"), F.when(F.col("rows") > 0, where).alias("folder"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.lit(ddl).alias("schema"))
    gone = spark.createDataFrame([r[:2] for r in split], "depth int, slot long")
    if version_of(spark, path) != base:
        raise RuntimeError(f"{path} has changed since version {base}")
    write_table(found.join(gone, ["depth", "slot"], "left_anti").select(each.columns).unionByName(each).coalesce(1), f"{path}/manifest")
    return version_of(spark, path)


@contextmanager
def held(spark: SparkSession, path: str) -> Iterator[int]:
    """The current version, which clean_up leaves in place as long as this is open: a mark in the table's folder says so."""
    version = version_of(spark, path)
    mark, fs = _path(spark, f"{path}/readers/{version:08}-{uuid.uuid4().hex}")
    fs.create(mark).close()
    try:
        yield version
    finally:
        fs.delete(mark, False)


def clear(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables."""
    folder, fs = _path(spark, path)
    fs.delete(folder, True)


def clean_up(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes what no reader can need: manifests before the last keep complete ones that no mark holds, then folders of rows that no
    remaining manifest names and that no merge still under way can have written. Returns the folders removed."""
    whole = sorted(n for n, complete in _versions(spark, f"{path}/manifest").items() if complete)
    if not whole:
        return []
    names = lambda sub: [s.getPath().getName() for s in _path(spark, f"{path}/{sub}")[1].listStatus(_path(spark, f"{path}/{sub}")[0])] if _path(spark, f"{path}/{sub}")[1].exists(_path(spark, f"{path}/{sub}")[0]) else []
    marked = {int(n[:8]) for n in names("readers")}
    stay = [n for n in whole if n in whole[-keep:] or n in marked]
    used = {r["folder"].split("/")[1] for n in stay for r in manifest(spark, path, n).filter("folder IS NOT NULL").select(F.substring_index("folder", "/", 2).alias("folder")).distinct().collect()}
    gone = [f"manifest/v-{n:08}" for n in _versions(spark, f"{path}/manifest") if n not in stay and n < whole[-1]]
    gone += [f"data/{n}" for n in names("data") if n not in used and int(n.split("-")[1]) < whole[-1]]
    for sub in gone:
        folder, fs = _path(spark, f"{path}/{sub}")
        fs.delete(folder, True)
    return gone
