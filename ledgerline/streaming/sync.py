"""The poll loop as streams: pages in, tables up to date; history once; running time in status."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.flatten import denormalize_issues, explode_changelog, extract_comments, extract_custom_fields, extract_links, rollup_comments_text
from ..operators.merge import insert_ignore, latest_of, replace_children, upsert_by_key
from ..sources.issues import histories_of
from ..sources.kept import clean_up, clear, merge_kept, read_kept, version_of


def _or_none(old: DataFrame | None, like: DataFrame) -> DataFrame:
    return like.limit(0) if old is None else old


def stream_sync(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, every: str | None = None, catalog: DataFrame | None = None, keep: int | None = 2) -> StreamingQuery:
    """Reads new page files (a JSON page a line) and brings the tables up to date: issues at out_dir, with the catalog's
    custom fields and comments_text, and below it comments, issue_links and changelog. Without every it ends when all
    present files are read; a restart goes on after the last batch that was written, and a batch may be put twice.

    The tables are read with read_kept. Each is kept in ranges of the issue's key, so a batch reads and writes only the ranges of
    the issues in it, in all four; comments and history rows belong to one issue for good. Versions before the last keep that no
    reader holds are removed after each batch; None removes none. A batch's issues are stored below out_dir/batch until its end."""

    tables = (out_dir, *(f"{out_dir}/{n}" for n in ("comments", "issue_links", "changelog")))

    def put(batch: DataFrame, batch_id: int) -> None:
        for path in tables:  # only the first batch of a checkpoint may find none
            if batch_id and not version_of(spark, path):
                raise FileNotFoundError(f"no complete version of a table in {path}")
        pages = batch.select(F.explode(F.from_json("value", "struct<issues: array<string>>")["issues"]).alias("raw"))
        folder = f"{out_dir}/batch/{batch_id:08}-{uuid.uuid4().hex}"

        def stored(df: DataFrame, name: str) -> DataFrame:
            """Columns in a compressed file, not rows in memory and on disk; its size tells the planner what is short enough to be sent around."""
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        seen = stored(denormalize_issues(pages), "seen")
        twice = stored(seen.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
        # only issues that a batch has more than once are shuffled to find the latest
        last_of = stored(latest_of(seen.join(twice, "key", "left_semi"), "key", [F.col("updated").desc_nulls_last(), F.col("raw_json").desc()]), "last")
        new = seen.join(twice, "key", "left_anti").unionByName(last_of)
        parents = new.select(F.col("key").alias("issue_key"))

        said, order = extract_comments(seen, "raw_json"), [F.col("created").desc_nulls_last(), F.col("body").desc_nulls_last()]
        last = extract_comments(new, "raw_json")
        merge_kept(parents, f"{out_dir}/comments", "issue_key", lambda old: upsert_by_key(upsert_by_key(_or_none(old, said), said, "id", order), last, "id", order))
        text = stored(rollup_comments_text(read_kept(spark, f"{out_dir}/comments", parents, "issue_key")).withColumnRenamed("issue_key", "key"), "text")

        links = extract_links(new, "raw_json")
        merge_kept(parents, f"{out_dir}/issue_links", "issue_key", lambda old: replace_children(_or_none(old, links), links, parents, "issue_key"))

        changes = explode_changelog(histories_of(seen, "raw_json")).withColumnRenamed("ref", "issue_key")
        merge_kept(parents, f"{out_dir}/changelog", "issue_key", lambda old: insert_ignore(_or_none(old, changes), changes, "id"))

        rows = new.join(text, "key", "left")
        if catalog is not None:
            rows = extract_custom_fields(rows, catalog, "raw_json", rows.columns)
        merge_kept(new, out_dir, "key", lambda old: rows, True)
        clear(spark, f"{out_dir}/batch")
        if keep:
            for path in tables:
                clean_up(spark, path, keep)

    writer = spark.readStream.text(in_dir).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_changelog_dedup(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """History rows, each id once; rows later than the delay may be dropped with the state that would know them."""
    return stream.withWatermark("changed_at", delay).dropDuplicatesWithinWatermark(["id"])


STAY = "issue_key string, id string, status string, since timestamp, seconds double, correction boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stays(StatefulProcessor):
    """Of one issue: the changes that a later row may still fall among, in order. A new change ends the stay before it and is ended by
    the one after it; what was given out for a stay whose end has moved is put right by the difference."""

    def __init__(self, late_ms: int | None) -> None:
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", "at long, id string, status string")

    @staticmethod
    def _ends(changes: list[tuple]) -> dict[tuple, int]:
        return {c[:2]: after[0] for c, after in zip(changes, changes[1:], strict=False)}

    def _kept(self, changes: list[tuple], watermark_ms: int) -> list[tuple]:
        """Without the changes before the last one that no row can come before any more."""
        closed = [k for k, c in enumerate(changes) if c[0] < watermark_ms * 1000]
        return changes[closed[-1] :] if closed else changes

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        old = [tuple(r) for r in self.changes.get()]
        known = {c[:2]: c for c in old}
        for frame in rows:
            for at, ident, status in zip(frame["at"], frame["id"], frame["status"], strict=True):
                known.setdefault((int(at), ident), (int(at), ident, status))
        new = sorted(known.values(), key=lambda c: (c[0], c[1] is not None, c[1] or ""))
        before, after = self._ends(old), self._ends(new)
        out = []
        for at, ident, status in new:
            end, was = after.get((at, ident)), before.get((at, ident))
            if status is not None and end is not None and end != was:
                out.append((key[0], ident, status, pd.Timestamp(at, unit="us"), (end - (at if was is None else was)) / 1e6, was is not None))
        if self.late_ms is not None:
            new = self._kept(new, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(new[-1][0] // 1000 + self.late_ms)
        self.changes.put(new)
        if out:
            yield pd.DataFrame(out, columns=["issue_key", "id", "status", "since", "seconds", "correction"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """An issue that has been still for as long as rows may be late needs its last change alone."""
        self.changes.put(self._kept([tuple(r) for r in self.changes.get()], timerValues.getCurrentWatermarkInMs()))
        yield from ()

    def close(self) -> None:
        pass


def stream_status_durations(stream: DataFrame, out_dir: str, checkpoint: str, every: str | None = None, late: str | None = "30 days") -> StreamingQuery:
    """Appends rows (see STAY) to out_dir/stays as changes (id, issue_key, to_string, changed_at) arrive, a folder a batch; a batch may be
    put twice. The seconds of an issue's status sum up to what time_in_status gives for all changes read so far, in whatever
    order they came: a change that falls into a stay already given out brings a correction, which may be negative.

    Rows may be late by late (None: by any time); later ones are dropped. State is kept in RocksDB for each issue: a batch reads and
    writes that of the issues it has, and changes that no row can come before any more go, for still issues by a timer. Repeated
    rows (same id and time) count once, rows without a time not at all; a stay of a null status is not given out."""
    spark = stream.sparkSession
    rows = stream.select("issue_key", "id", F.col("to_string").alias("status"), "changed_at").filter("changed_at IS NOT NULL")
    rows = rows.withWatermark("changed_at", late) if late else rows
    late_ms = None if late is None else spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {late})").first()[0]
    rows = rows.withColumn("at", F.unix_micros("changed_at"))
    stays = rows.groupBy("issue_key").transformWithStateInPandas(Stays(late_ms), outputStructType=STAY, outputMode="Append", timeMode="EventTime" if late else "None")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/stays/batch={batch_id}")

    writer = stays.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # a query takes the session's settings as it starts
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
