"""Incremental merge by key, deletions, and bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def incremental_filter(df: DataFrame, meta: DataFrame, source: str) -> DataFrame:
    """Rows updated since the source's watermark, cut to the minute; all without one. The watermark is one row of a
    control table; as a literal it reaches the scan."""
    row = meta.filter(F.col("project") == source).select(F.coalesce("last_issue_updated", "last_sync_time").alias("w")).first()
    if not row or row["w"] is None:
        return df
    return df.filter(F.col("updated") >= F.lit(row["w"].replace(second=0, microsecond=0)).cast("timestamp_ntz"))


def classify_changes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with change: new, unchanged or updated, by the stored updated."""
    old = current.select("key", F.col("updated").alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("updated"), "unchanged").otherwise("updated")
    return incoming.join(old, "key", "left").withColumn("change", change).drop("_old")


def latest_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first in this order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert_by_key(current: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """incoming's row for its keys (the first in order), current's for the rest."""
    batch = latest_of(incoming, key, order)
    return current.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def replace_children(current: DataFrame, incoming: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """All child rows of the touched parents go, incoming takes their place."""
    return current.join(parents.select(parent_key), parent_key, "left_anti").unionByName(incoming)


def insert_ignore(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current and the rows of incoming whose key it lacks, one for each."""
    return current.unionByName(incoming.dropDuplicates([key]).join(current.select(key), key, "left_anti"))


def detect_deletions(local: DataFrame, remote_keys: DataFrame, project: str, allow_empty: bool = False) -> DataFrame:
    """(key) of local rows of a project that the remote side no longer has. An empty remote side is taken for a failed
    read unless allow_empty says that it is not."""
    mine = local.filter(F.col("project") == project).select("key")
    if not allow_empty and remote_keys.isEmpty():
        return mine.limit(0)
    return mine.join(remote_keys.select("key"), "key", "left_anti")


def sync_stats(classified: DataFrame, by: str = "project") -> DataFrame:
    """Per source: total, new, updated, and the last updated over all rows seen."""
    return classified.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "updated").alias("updated_rows"), F.max("updated").alias("last_issue_updated"))


#: Columns of a control row and their types.
META = {"last_sync_time": "timestamp_ntz", "issues_total": "bigint", "issues_synced": "bigint", "last_sync_duration": "double", "last_sync_error": "string", "last_issue_updated": "timestamp_ntz", "last_full_sync": "timestamp_ntz", "resume_cursor": "string"}


def _control(meta: DataFrame) -> DataFrame:
    """meta with all columns of control rows; those that it lacks are null."""
    return meta.select("project", *[(F.col(c) if c in meta.columns else F.lit(None)).cast(k).alias(c) for c, k in META.items()])


def merge_sync_meta(meta: DataFrame, stats: DataFrame, now: Column, duration: float | None = None, error: str | None = None, full: bool = False) -> DataFrame:
    """Control rows after a run over the sources of stats (see sync_stats): its time, counts, duration and error, and for a
    full run the time of the last one. A watermark never goes back and stays where a run has none; rows of other
    sources stay as they are. A run that came to its end has no resume cursor."""
    run = stats.select("project", F.lit(True).alias("_run"), "total", (F.col("new") + F.col("updated_rows")).alias("_synced"), F.col("last_issue_updated").alias("_last"))
    df = _control(meta).join(run, "project", "full_outer")
    told = {
        "last_sync_time": now, "issues_total": F.col("total"), "issues_synced": F.col("_synced"), "last_sync_duration": F.lit(duration), "last_sync_error": F.nullif(F.lit(error), F.lit("")),
        "last_issue_updated": F.greatest("last_issue_updated", "_last"), "last_full_sync": now if full else F.col("last_full_sync"), "resume_cursor": F.col("resume_cursor") if error else F.lit(None),
    }
    return df.select("project", *[F.when(F.col("_run"), v).otherwise(F.col(c)).cast(META[c]).alias(c) for c, v in told.items()])


def set_resume_cursor(meta: DataFrame, source: str, cursor: str | None) -> DataFrame:
    """Control rows with a source's place to go on from; a new row if it has none."""
    rows = _control(meta)
    new = meta.sparkSession.createDataFrame([(source,)], "project string").join(rows.select("project"), "project", "left_anti")
    rows = rows.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("resume_cursor", F.when(F.col("project") == source, F.lit(cursor)).otherwise(F.col("resume_cursor")))


def advance_cursors(meta: DataFrame, batch: DataFrame) -> DataFrame:
    """Control rows after a batch of a full run (project, updated): the cursors of its sources go to the latest update seen, never back.
    Rows without a source or a time move nothing."""
    seen = batch.filter("project IS NOT NULL AND updated IS NOT NULL").groupBy("project").agg(F.max("updated").cast("timestamp_ntz").alias("_seen"))
    old = F.col("resume_cursor").try_cast("timestamp_ntz")
    later = F.col("_seen").isNotNull() & (old.isNull() | (F.col("_seen") > old))
    rows = _control(meta).join(seen, "project", "full_outer")
    return rows.withColumn("resume_cursor", F.when(later, F.date_format("_seen", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("resume_cursor"))).drop("_seen")


def resume_filter(df: DataFrame, meta: DataFrame) -> DataFrame:
    """What is left of a full run that was cut off: of a source with a cursor the rows updated since, cut to the minute, so rows of that
    minute come again; all rows of other sources, of a cursor that is no time, and without a time of update."""
    known = _control(meta).select("project", F.substring("resume_cursor", 1, 16).try_cast("timestamp_ntz").alias("_from")).filter("_from IS NOT NULL")
    left = F.col("_from").isNull() | F.col("updated").isNull() | (F.col("updated") >= F.col("_from"))
    return df.join(known, "project", "left").filter(left).select(df.columns)


def full_run(df: DataFrame, meta: DataFrame, take: Callable[[DataFrame], None], save: Callable[[DataFrame], DataFrame], steps: int = 16, resume: bool = False) -> DataFrame:
    """Takes df (project, updated, ...) in steps by time of update and saves the cursors after each, so that a run cut off goes on with
    resume where it stopped. take stores a batch and bears rows that come again; save stores control rows and gives them back as read.
    Without resume, old cursors of these sources go first; a run that came to its end leaves none. The driver holds
    the bounds of the steps, which are quantiles, and no rows."""
    sources = df.select("project").distinct()
    cleared = lambda m: _control(m).join(sources.withColumn("_s", F.lit(True)), "project", "left").withColumn("resume_cursor", F.when(F.col("_s").isNull(), F.col("resume_cursor"))).drop("_s")
    if resume:
        df = resume_filter(df, meta)
    else:
        meta = save(cleared(meta))
    second = F.unix_seconds(F.col("updated").cast("timestamp"))
    bounds = sorted(set(df.select(second.cast("double").alias("s")).approxQuantile("s", [k / steps for k in range(1, steps)], 0.01)))
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        under = F.lit(True) if high is None else second < high
        batch = df.filter((F.coalesce(under, F.lit(True)) if low is None else F.coalesce(under & (second >= low), F.lit(False))))
        take(batch)
        meta = save(advance_cursors(meta, batch))
    return save(cleared(meta))


def changelog_candidates(issues: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """(key) of issues whose history was never read or that changed since, of these projects, by key."""
    stale = F.col("changelog_synced_at").isNull() | (F.col("updated") > F.col("changelog_synced_at"))
    of = F.col("project").isin(projects) if projects else F.lit(True)
    return issues.filter(stale & of).select("key").orderBy("key")


def stamp_processed(issues: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    marked = keys.select("key").distinct().withColumn("_m", F.lit(True))
    return issues.join(marked, "key", "left").withColumn("changelog_synced_at", F.when(F.col("_m"), now).otherwise(F.col("changelog_synced_at"))).drop("_m")


def split_by_id_presence(candidates: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with a known numeric id, and the rest."""
    known = issues.filter("id is not null and id != ''").select("key")
    return candidates.join(known, "key", "left_semi"), candidates.join(known, "key", "left_anti")


def stale_sources(sources: DataFrame, meta: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Sources never synced, or not within the interval."""
    late = F.col("last_sync_time").isNull() | (F.col("last_sync_time") < now - F.make_interval(mins=F.lit(minutes)))
    return sources.join(meta.select("project", "last_sync_time"), "project", "left").filter(late).select("project", "last_sync_time")


def sync_status_report(issues: DataFrame, meta: DataFrame, pending: DataFrame, changelog: DataFrame) -> DataFrame:
    """(metric, name, value) of all the status figures; those of a source are null where it has none."""
    meta = _control(meta)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    fact = lambda df, metric, name=None: df.select(F.lit(metric).alias("metric"), (F.col(name) if name else F.lit("")).alias("name"), F.col("n").cast("string").alias("value"))
    out = fact(issues.agg(F.count("*").alias("n")), "issues").unionByName(fact(issues.groupBy("project").agg(F.count("*").alias("n")), "project_issues", "project"))
    of_source = {"data_through": F.date_format("last_issue_updated", "yyyy-MM-dd"), "last_sync": stamp("last_sync_time"), "last_full_sync": stamp("last_full_sync"), "sync_duration": F.round("last_sync_duration", 1), "sync_error": F.col("last_sync_error")}
    for metric, value in of_source.items():
        out = out.unionByName(fact(meta.withColumn("n", value), metric, "project"))
    out = out.unionByName(fact(pending.filter("synced_at is null").agg(F.count("*").alias("n")), "pending"))
    return out.unionByName(fact(changelog.agg(F.count("*").alias("n")), "changelog"))
