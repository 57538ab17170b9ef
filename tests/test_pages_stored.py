"""read_pages with a folder: files are read once, and the rows are those that it gives without one."""

import json

from ledgerline.sources import issues as src


def test_stored_pages_equal_those_read_again(spark, tmp_path):
    issue = lambda k: {"id": str(k), "key": f"A-{k}", "fields": {"summary": "s\nt"}}
    folder = tmp_path / "in"
    folder.mkdir()
    pages = lambda *ks: {"issues": [issue(k) for k in ks]}
    (folder / "lines.json").write_text("\n".join(json.dumps(pages(k)) for k in range(20)) + "\n\nno json\n{}\n")
    (folder / "wide.json").write_text(json.dumps({"issues": [issue(30), {"id": "5"}, 17, None, {"key": 3, "fields": []}]}, indent=2))
    (folder / "two.json").write_text("\n".join(json.dumps(pages(k, k + 1), indent=1) for k in (40, 50)))
    (folder / "torn.json").write_text(json.dumps(pages(60)) + '\n{"issues": [{"key":\n')
    (folder / "cut.json").write_text('{"issues": [\n{"key": "A-9"}\n}\n')
    (folder / "told.json").write_text(json.dumps({"errorMessages": ["no", "way"]}, indent=1))
    (folder / "empty.json").write_text('{"issues": []}\n[\n]\n')
    (folder / "other.json").write_text('{"total": 0}')
    (folder / "log.json").write_text("started\nended\n")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    stored, again = src.read_pages(spark, str(folder), str(tmp_path / "s")), src.read_pages(spark, str(folder))
    assert [rows(df) for df in stored] == [rows(df) for df in again]
    assert len(rows(stored[0])) >= 26 and {r["reason"] for r in stored[1].collect()} >= {"no key", "no object", "no text", "no JSON", "no issues in page", "no; way"}
    assert not any("Scan text" in df._jdf.queryExecution().executedPlan().toString() for df in stored)


def test_pages_are_written_without_a_shuffle_of_their_json(spark, monkeypatch):
    from ledgerline import queries

    monkeypatch.setattr(queries, "RAW_ROWS", 500)
    issues = queries.issues_of(spark, "/root/testdata/sf0.001")
    made = queries.pages_of(spark, issues)
    plan = made._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "collect_list" in above and above.count("Exchange") == 1  # the shuffle of the issues' few columns is the last one
    assert made.selectExpr("sum(size(r))").first()[0] == issues.count()


def test_an_issue_is_parsed_once_to_be_judged(spark):
    from ledgerline.operators.flatten import undecodable_reason

    df = spark.createDataFrame([('{"key": "A-1"}',), ("3",)], "raw string").select(undecodable_reason("raw").alias("r"))
    # with its type once, and for its key alone where that gives none
    assert df._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0].count("from_json(") == 2
    assert [r["r"] for r in df.collect()] == [None, "no object"]
