"""Running stays: any order of arrival ends at the same sums."""

import datetime as dt
import random
from collections import defaultdict

from ledgerline.streaming import sync

SCHEMA = "id string, issue_key string, to_string string, changed_at timestamp"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, batches, **how):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sync.stream_status_durations(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log"), **how).awaitTermination()
    return [r.asDict() for r in spark.read.parquet(str(tmp_path / "out/stays")).collect()]


def sums(rows):
    found = defaultdict(float)
    for r in rows:
        found[r["issue_key"], r["status"]] += r["seconds"]
    return {k: round(v, 6) for k, v in found.items()}


def plain(rows):
    """Sums of the stays of all changes at once."""
    own, found = defaultdict(dict), defaultdict(float)
    for ident, key, status, when in rows:
        if when is not None:
            own[key].setdefault((when, ident), status)
    for key, changes in own.items():
        listed = sorted(changes.items())
        for ((when, _), status), ((until, _), _) in zip(listed, listed[1:]):
            if status is not None:
                found[key, status] += (until - when).total_seconds()
    return {k: round(v, 6) for k, v in found.items()}


def test_shuffled_and_repeated_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(str(k), rng.choice(["A", "B", "C", None]), rng.choice(["x", "y", "z", None]), at(rng.randrange(2000))) for k in range(300)]
    rows += rng.sample(rows, 40) + [("n", "A", "x", None)]
    rng.shuffle(rows)
    got = feed(spark, tmp_path, [rows[k::4] for k in range(4)], late=None)
    assert sums(got) == plain(rows)
    assert any(r["correction"] and r["seconds"] < 0 for r in got)


def test_late_row_corrects_what_was_given(spark, tmp_path):
    """x from 1 to 9 is given out; then y at 5 shortens it."""
    got = feed(spark, tmp_path, [[("1", "A", "x", at(1)), ("2", "A", "z", at(9))], [("3", "A", "y", at(5))]])
    assert sorted((r["status"], r["seconds"], r["correction"]) for r in got) == [("x", -4.0, True), ("x", 8.0, False), ("y", 4.0, False)]


def test_old_changes_go_and_too_late_rows_are_dropped(spark, tmp_path):
    """The horizon is a minute: of a still issue the last change stays, and its stay is ended by the next one, whenever that comes."""
    batches = [[("1", "A", "x", at(0)), ("2", "A", "y", at(10))], [("3", "B", "x", at(500))], [("4", "B", "y", at(900)), ("5", "A", "late", at(5))], [("6", "A", "z", at(1000))], [("7", "A", "x", at(990))]]
    got = feed(spark, tmp_path, batches, late="1 minute")
    assert sums(got) == {("A", "x"): 20.0, ("A", "y"): 980.0, ("B", "x"): 400.0}


def test_old_changes_leave_the_state():
    keep = sync.Stays(60_000)._kept
    changes = [(1_000_000, "1", "x"), (2_000_000, "2", "y"), (9_000_000, "3", "z")]
    assert keep(changes, 5_000) == changes[1:] and keep(changes, 0) == changes and keep(changes, 100_000) == changes[2:]
