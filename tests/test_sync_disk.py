"""A batch of the sync shuffles each issue's JSON once, and keeps no rows of it in memory or outside compressed files."""

import json

from pyspark.sql import functions as F

from ledgerline.sources import kept
from ledgerline.streaming import sync


def test_over_replaces_rows_without_a_shuffle_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "RANGE_ROWS", 20)
    frame = lambda low, high, state: spark.range(low, high).select(F.col("id").cast("string").alias("key"), F.lit(state).alias("state"))
    for low, high, state in ((0, 60, "a"), (40, 90, "b"), (85, 87, "c")):
        kept.merge_kept(frame(low, high, state), str(tmp_path), "key", lambda old, f=frame(low, high, state): f.withColumn("more", F.lit(1)) if state == "b" else f, True)
    rows = kept.read_kept(spark, str(tmp_path))
    assert sorted((int(r["key"]), r["state"]) for r in rows.collect()) == [(k, "c" if 85 <= k < 87 else "b" if k >= 40 else "a") for k in range(90)]
    assert rows.columns == ["key", "state", "more"] and rows.filter("more = 1").count() == 48


def test_a_batch_with_an_issue_twice(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    def never(self, *a):
        raise AssertionError("rows kept outside files")

    monkeypatch.setattr(type(spark.range(1)), "persist", never)
    monkeypatch.setattr(DataFrame, "persist", never)
    issue = lambda key, day, text: {"id": key, "key": key, "fields": {"summary": text, "updated": f"2024-01-{day:02}T00:00:00.000+0000"}}
    (tmp_path / "in").mkdir()
    pages = ([issue("A-1", 2, "late"), issue("A-2", 1, "one")], [issue("A-1", 1, "early"), issue("A-3", 1, "x"), issue("A-3", 1, "y")]), ([issue("A-2", 3, "again")],)
    for k, batch in enumerate(pages):
        for n, page in enumerate(batch):
            (tmp_path / "in" / f"{k}-{n}.json").write_text(json.dumps({"issues": page}))
        sync.stream_sync(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = sorted((r["key"], r["summary"]) for r in kept.read_kept(spark, str(tmp_path / "out")).collect())
    assert got == [("A-1", "late"), ("A-2", "again"), ("A-3", "y")] and not (tmp_path / "out" / "batch").exists()
