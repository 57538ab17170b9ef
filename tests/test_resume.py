"""Full runs that are cut off, and search over the columns of issues."""

import datetime as dt
from itertools import count

import pytest

from ledgerline.operators import matching, merge, search

AT = dt.datetime(2024, 1, 1)


def test_a_run_cut_off_goes_on(spark, tmp_path):
    rows = [(f"K{k}", "AB"[k % 2], AT + dt.timedelta(hours=k)) for k in range(100)] + [("N1", "A", None), ("N2", None, AT), ("C1", "C", AT + dt.timedelta(hours=50))]
    df = spark.createDataFrame(rows, "key string, project string, updated timestamp_ntz")
    number = count()

    def save(meta):
        path = str(tmp_path / f"meta{next(number)}")
        meta.write.parquet(path)
        saved.append(path)
        return spark.read.parquet(path)

    def take(batch):
        if len(taken) == fail_at:
            raise RuntimeError("cut off")
        taken.append([r["key"] for r in batch.collect()])

    meta = merge.set_resume_cursor(spark.createDataFrame([("Z",), ("A",)], "project string"), "Z", "2020-01-01 00:00:00")
    meta = merge.set_resume_cursor(meta, "A", "2030-01-01 00:00:00")  # of an older run, which a fresh one forgets
    saved, taken, fail_at = [], [], 4
    with pytest.raises(RuntimeError):
        merge.full_run(df, meta, take, save, steps=8)
    first = [k for b in taken for k in b]
    kept = spark.read.parquet(saved[-1])
    cursors = {r["project"]: r["resume_cursor"] for r in kept.collect()}
    last = {p: max((u for k, q, u in rows if q == p and u and k in first), default=None) for p in "ABC"}
    assert {p: cursors.get(p) for p in "ABC"} == {p: u and str(u) for p, u in last.items()} and cursors["Z"] == "2020-01-01 00:00:00"
    saved, taken, fail_at = [], [], None
    done = merge.full_run(df, kept, take, save, steps=8, resume=True)
    again = [k for b in taken for k in b]
    assert sorted({*first, *again}) == sorted(r[0] for r in rows) and len(again) == len(set(again)) and len(first) == len(set(first))
    assert set(first) & set(again) == {k for k, p, u in rows if k in first and (p is None or u is None or u == last[p])}
    assert {r["project"]: r["resume_cursor"] for r in done.collect() if r["resume_cursor"]} == {"Z": "2020-01-01 00:00:00"}
    taken = []
    merge.full_run(df.limit(0), kept, take, save, steps=8)
    assert not any(taken)


def test_search_over_the_columns_of_issues(spark):
    issues = spark.createDataFrame([("A", "red fox", "blue whale", ["slow", "red"]), ("B", "blue", None, None), ("C", None, "fox red", [])], "key string, summary string, description string, labels array<string>")
    index = search.build_text_index(search.issue_texts(issues), "key", search.ISSUE_COLUMNS, False)
    found = lambda c: {r["key"] for r in matching.search(*index, c, 20, False).collect()}
    assert found(matching.all_of("red", "fox")) == {"A", "C"} and found(matching.in_columns(["labels"], matching.all_of("red"))) == {"A"}
    assert found(matching.all_of("blue")) == {"A", "B"} and found(matching.phrase("fox blue")) == set()
    assert {r["key"]: r["len"] for r in index[1].collect()} == {"A": 6, "B": 1, "C": 2}
