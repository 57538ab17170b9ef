"""Tables changed in part: equal to a whole rewrite, small writes, any step may fail."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.merge import upsert_by_key
from ledgerline.sources import kept, sinks
from ledgerline.sources import issues as src
from ledgerline.streaming import sync


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows(spark, items):
    return spark.createDataFrame(items, "key string, n long, tag string")


def upsert(spark, path, items):
    batch = rows(spark, items)
    return kept.merge_kept(batch, path, "key", lambda old: upsert_by_key(batch.limit(0) if old is None else old, batch, "key", [F.desc("n")]))


def content(spark, path, **how):
    return sorted(tuple(r) for r in kept.read_kept(spark, path, **how).select("key", "n", "tag").collect())


def test_merges_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "RANGE_ROWS", 40)
    path, rng, want = str(tmp_path / "t"), random.Random(4), {}
    for turn in range(6):
        items = [(f"K-{rng.randrange(600)}", turn * 1000 + i, rng.choice("ab")) for i in range(rng.choice([3, 150]))]
        assert upsert(spark, path, items) == turn + 1
        for k, n, tag in items:
            want[k] = (k, n, tag)
        assert content(spark, path) == sorted(want.values())
    ranges = kept.manifest(spark, path).collect()
    assert len(ranges) > 8 and max(r["rows"] for r in ranges) <= 80
    assert sum(2.0 ** -r["depth"] for r in ranges) == 1.0  # each key has exactly one range
    some = rows(spark, [("K-1", 0, ""), ("K-77", 0, ""), ("none", 0, "")])
    assert content(spark, path, keys=some, key="key") == sorted(v for k, v in want.items() if k in ("K-1", "K-77"))
    for k in ("K-5", "none"):
        assert [tuple(r) for r in kept.lookup_kept(spark, path, "key", k).collect()] == ([want[k]] if k in want else [])


def test_bytes_written_follow_the_batch(spark, tmp_path, monkeypatch):
    """A batch of five rows writes about as much into a table of 16,000 rows as into one of 2,000."""
    monkeypatch.setattr(kept, "RANGE_ROWS", 200)
    written, read = [], []
    for n in (2_000, 16_000):
        path = str(tmp_path / f"t{n}")
        upsert(spark, path, [(f"K-{k}", k, f"{k * 2654435761 % 2**32:x}" * 8) for k in range(n)])
        before = size(f"{path}/data")
        upsert(spark, path, [(f"K-{k * 7}", 10**6, "new") for k in range(5)])
        written.append(size(f"{path}/data") - before)
        assert written[-1] < before / 2
        read.append(len(kept.lookup_kept(spark, path, "key", "K-7").inputFiles()))
        assert kept.lookup_kept(spark, path, "key", "K-7").collect()[0]["n"] == 10**6
    assert written[1] < 2 * written[0] and read == [1, 1]


def test_deleted_ranges_and_new_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "RANGE_ROWS", 5)
    path = str(tmp_path / "t")
    upsert(spark, path, [(f"K-{k}", k, "a") for k in range(60)] + [(None, 1, "null key")])
    everything = kept.read_kept(spark, path)
    kept.merge_kept(everything, path, "key", lambda old: old.filter("n % 2 = 0"))
    assert len(content(spark, path)) == 30
    kept.merge_kept(everything, path, "key", lambda old: old.limit(0))
    assert content(spark, path) == []
    upsert(spark, path, [("K-3", 3, "back")])
    wide = rows(spark, [("K-3", 4, "wide")]).withColumn("points", F.lit(1.5))
    kept.merge_kept(wide, path, "key", lambda old: upsert_by_key(old, wide, "key", [F.desc("n")]))
    upsert(spark, path, [("K-9", 9, "narrow")])
    assert {tuple(r) for r in kept.read_kept(spark, path).select("key", "tag", "points").collect()} == {("K-3", "wide", 1.5), ("K-9", "narrow", None)}


@pytest.mark.parametrize("step", ["_rows_of", "write_table", "version_of"])
def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    upsert(spark, path, [("a", 1, "x"), ("b", 1, "x")])
    old, calls = content(spark, path), []

    def broken(*a, real=getattr(kept, step), **b):
        calls.append(1)
        if step != "version_of" or len(calls) == 2:
            raise OSError("lost")
        return real(*a, **b)

    with monkeypatch.context() as m:
        m.setattr(kept, step, broken)
        with pytest.raises(OSError):
            upsert(spark, path, [("b", 2, "y"), ("c", 2, "y")])
    assert content(spark, path) == old
    upsert(spark, path, [("b", 2, "y"), ("c", 2, "y")])
    assert content(spark, path) == [("a", 1, "x"), ("b", 2, "y"), ("c", 2, "y")]


def test_clean_up_leaves_what_readers_hold(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark, path, [("a", 1, "x")])
    with kept.held(spark, path) as version:
        for n in range(2, 6):
            upsert(spark, path, [("a", n, "x")])
        os.makedirs(f"{path}/data/after-00000005-late")  # of a merge still under way
        assert kept.clean_up(spark, path, keep=1)
        assert content(spark, path, version=version) == [("a", 1, "x")] and content(spark, path) == [("a", 5, "x")]
        assert len(os.listdir(f"{path}/data")) == 3 and kept.clean_up(spark, path, keep=1) == []
    gone = kept.clean_up(spark, path, keep=1)
    assert len(gone) == 2 and content(spark, path) == [("a", 5, "x")] and os.listdir(f"{path}/readers") in ([], [f for f in os.listdir(f"{path}/readers") if f.endswith(".crc")])


def page(spark, d, path, part, status):
    issues = src.issues_view(spark, d).filter(part)
    raw = src.raw_issues(issues.withColumn("status", F.lit(status)) if status else issues)
    raw.agg(F.collect_list("raw").alias("issues")).select(F.to_json(F.struct("issues")).alias("value")).coalesce(1).write.mode("append").text(path)


@pytest.mark.parametrize("after", [1, 3])
def test_sync_put_again_after_each_table(spark, tmp_path, monkeypatch, after):
    """The stream dies after so many of the batch's four tables; the restart ends where an undisturbed run does."""
    monkeypatch.setattr(kept, "RANGE_ROWS", 20)
    d, calls = "/root/testdata/sf0.001", []
    run = lambda out: sync.stream_sync(spark, str(tmp_path / "in"), str(tmp_path / out), str(tmp_path / f"{out}-log")).awaitTermination()
    page(spark, d, str(tmp_path / "in"), "id % 9 = 0", "old")
    run("whole"), run("torn")
    page(spark, d, str(tmp_path / "in"), "id % 18 = 0", None)

    def broken(*a, real=sync.merge_kept):
        calls.append(1)
        if len(calls) > after:
            raise OSError("lost")
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(sync, "merge_kept", broken)
        with pytest.raises(Exception, match="lost"):
            run("torn")
    run("whole"), run("torn")
    for table in ("", "/comments", "/issue_links", "/changelog"):
        a, b = (sorted(str(r) for r in kept.read_kept(spark, str(tmp_path / out) + table).drop("synced_at").collect()) for out in ("whole", "torn"))
        assert a == b and (a or table)
    assert sinks._versions(spark, str(tmp_path / "whole/manifest")) == {1: True, 2: True}
