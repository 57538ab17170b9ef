"""What the operators of this subpackage share: tables, words, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of words; at most the first and the last piece of the split are empty."""
    return F.array_remove(F.split(text, SPACES), "")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors and the driver see. Only where it is unset and all tasks run within the
    driver (tests), a folder of this machine; on a cluster without it no folder is known to be shared."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/ledgerline"
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them from there: it cuts the lineage, and a lost executor
    costs no more than reading again. Each call has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from df's columns in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
