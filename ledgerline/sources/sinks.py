"""Writers: versioned tables, JSON rows, markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the front matter and their names in it, in its order; columns that hold lists.
FRONT = (
    ("key", "key"), ("summary", "summary"), ("status", "status"), ("type", "type"), ("size", "size"), ("priority", "priority"), ("assignee", "assignee"), ("reporter", "reporter"), ("fix_version", "fix_version"),
    ("labels", "labels"), ("components", "components"), ("parent_key", "parent"), ("team", "team"), ("product_manager", "product_manager"), ("activity_type", "activity_type"), ("release_note_text", "release_note"),
    ("release_note_type", "release_note_type"), ("release_type", "release_type"), ("product_documentation_required", "product_docs"), ("due_date", "due"), ("target_version", "target_version"), ("resolution", "resolution"),
    ("created", "created"), ("updated", "updated"), ("resolved", "resolved"),
)
LISTS = ("labels", "components", "fix_version")


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The numbers of a table's versions, and whether each is complete: its writer's last step is the file _SUCCESS."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n[2:]): fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) for n in names if n.startswith("v-")}


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Writes the next version of a table. Versions are numbered and nothing that stands is touched: a write that does not
    come to its end leaves an incomplete version that no reader takes, and the one before stays current."""
    version = f"v-{max(_versions(df.sparkSession, path), default=0) + 1:08}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{version}")
    return version


def has_table(spark: SparkSession, path: str) -> bool:
    return any(_versions(spark, path).values())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version."""
    complete = [n for n, whole in _versions(spark, path).items() if whole]
    if not complete:
        raise FileNotFoundError(f"no complete version of a table in {path}")
    return spark.read.parquet(f"{path}/v-{max(complete):08}")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json_rows(df: DataFrame, path: str) -> None:
    json_rows(df).write.text(path)


def _cell(df: DataFrame, c: str) -> Column:
    """A value as front matter spells it, null if it is empty: lists in brackets, dates without time, others in quotes unless
    all their characters are plain."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")))
    text = F.nullif(F.date_format(c, "yyyy-MM-dd") if kind.startswith(("timestamp", "date")) else F.col(c).cast("string"), F.lit(""))
    if c in LISTS:
        items = F.coalesce(F.from_json(text, "array<string>"), F.transform(F.split(text, ","), lambda x: F.trim(x)))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    text = F.when((F.length(text) > 10) & text.rlike(r"^.{4}-.{2}-"), F.substring(text, 1, 10)).otherwise(text)
    return F.when(text.rlike(r"^[A-Za-z0-9\-_.]*$"), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')))


def export_markdown_docs(issues: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(key, doc): front matter of the fields that are filled, then the summary as title, the description, the status
    summary under its heading, and the comments in the order of their time, an empty line after each block."""
    have = set(issues.columns)
    lines = [F.concat(F.lit(f"{name}: "), _cell(issues, c)) for c, name in FRONT if c in have]
    text = lambda c: F.nullif(F.rtrim(c, F.lit("\n")), F.lit(""))
    blocks = [F.array_join(F.array_compact(F.array(F.lit("---"), *lines, F.lit("---"))), "\n"), F.concat(F.lit("# "), F.nullif(F.col("summary"), F.lit("")))]
    if "description" in have:
        blocks.append(text(F.col("description")))
    if "status_summary" in have:
        said = F.ltrim(F.btrim("status_summary", F.lit(" \n\t\r")), F.lit(": \n"))
        blocks.append(F.concat(F.lit("## Status Summary\n\n"), text(said)))
    df = issues
    if comments is not None:
        one = F.concat(F.lit("**"), F.coalesce("author", F.lit("")), F.lit("** · "), F.coalesce(F.col("created").cast("string"), F.lit("")), F.lit("\n\n"), F.coalesce(text(F.col("body")), F.lit("")))
        by = comments.groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("created", "id", one.alias("t")))).alias("_c"))
        df = issues.join(by, issues.key == by.issue_key, "left")
        blocks.append(F.concat(F.lit("---\n\n## Comments ("), F.size("_c"), F.lit(")\n\n"), F.array_join(F.transform("_c", lambda x: x["t"]), "\n\n")))
    return df.select("key", F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n")).alias("doc"))
