"""Operators do the whole job: no text cut, no row left out, no value lost."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from ledgerline import queries as q
from ledgerline.operators import edits
from ledgerline.sources import issues as src
from ledgerline.sources import kept, sinks
from ledgerline.streaming import sync

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_rich_text_of_whole_documents(spark):
    want = {k: t.replace("\n", "\n\n").strip() for k, t in texts(spark).items()}
    assert any(t.count("\n\n") > 1 for t in want.values())
    assert dict(q.rich_text_to_plaintext(spark, SF).collect()) == want
    assert dict(q.rich_text_to_markdown(spark, SF).collect()) == want


def test_highlight_of_whole_documents(spark):
    want = {k: re.sub(r"(?i)(?<![^\W_])(the|and)(?![^\W_])", r"[\1]", t) for k, t in texts(spark).items()}
    assert any(t.count("[the]") > 1 for t in want.values())
    assert dict(q.highlight(spark, SF).collect()) == want


def test_stemmed_search_against_plain_python(spark):
    import collections
    import math

    from ledgerline.functions.stem import stem
    from ledgerline.operators import search

    docs = {k: collections.Counter(stem(w) for w in re.findall(r"[^\W_]+", t.lower().translate(str.maketrans(search.MARKED, search.PLAIN)))) for k, t in texts(spark).items()}
    average = sum(d.total() for d in docs.values()) / len(docs)
    scores = collections.Counter()
    for term in (stem("nations"), stem("licensed")):
        having = [k for k, d in docs.items() if d[term]]
        idf = max(math.log((len(docs) - len(having) + 0.5) / (len(having) + 0.5)), 1e-6)
        for k in having:
            scores[k] += idf * docs[k][term] * 2.2 / (docs[k][term] + 1.2 * (0.25 + 0.75 * docs[k].total() / average))
    want = sorted(((-round(s, 6), k) for k, s in scores.items()))[:20]
    got = [(-r["score"], r["key"]) for r in q.search_stemmed(spark, SF).collect()]
    assert want and [k for _, k in got] == [k for _, k in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want, strict=True))


def test_queue_changes_every_column(spark):
    at = dt.datetime(2024, 1, 1)
    issue = "key string, summary string, type string, status string, team string, story_points double, due_date timestamp_ntz, labels array<string>, fix_version array<string>"
    issues = spark.createDataFrame([("A-1", "s", "Bug", "To Do", "x", 1.0, at, ["a"], ["v1"]), ("A-2", "t", "Bug", "To Do", "y", 2.0, at, None, None)], issue)
    rows = [
        ("A-1", "set_field", {"field": "summary", "value": "new"}), ("A-1", "set_field", {"field": "issuetype", "value": {"name": "Task"}}), ("A-1", "set_field", {"field": "customfield_1", "value": {"value": "z"}}),
        ("A-1", "set_field", {"field": "customfield_2", "value": 5}), ("A-1", "set_field", {"field": "duedate", "value": "2024-02-03"}), ("A-1", "update_field", {"field": "fixVersions", "op": "add", "value": {"name": "v2"}}),
        ("A-1", "update_field", {"field": "labels", "op": "add", "value": "b"}), ("A-1", "update_field", {"field": "labels", "action": "remove", "value": "a"}), ("A-2", "set_field", {"field": "labels", "value": ["p", "q"]}),
        ("A-2", "set_field", {"field": "team", "value": None}), ("A-1", "add_comment", {"body": "hello"}), ("A-2", "transition", {"status": "Done"}),
        ("A-1", "set_field", {"field": "votes", "value": "x"}), ("A-1", "set_field", {"field": "key", "value": "B-1"}), ("A-1", "set_field", {"field": "story_points", "value": "many"}), ("A-1", "update_field", {"field": "summary", "op": "add", "value": "x"}),
        ("A-2", "update_field", {"field": "labels", "value": "x"}), ("A-2", "transition", {"transition_id": "31"}), ("A-2", "add_comment", {}), ("A-9", "set_field", {"field": "summary", "value": "x"}),
    ]
    queue = spark.createDataFrame([(n, k, o, json.dumps(p), at, None, 0, None) for n, (k, o, p) in enumerate(rows)], "id long, issue_key string, operation string, payload string, created_at timestamp_ntz, synced_at timestamp_ntz, retry_count int, last_error string")
    out, results, comments = edits.apply_pending(issues, queue, src.catalog(spark))
    one, two = (tuple(r) for r in out.orderBy("key").collect())
    assert one == ("A-1", "new", "Task", "To Do", "z", 5.0, dt.datetime(2024, 2, 3), ["b"], ["v1", "v2"])
    assert two == ("A-2", "t", "Bug", "Done", None, 2.0, at, ["p", "q"], None)
    errors = [r["error"] for r in results.orderBy("id").collect()]
    assert errors == [None] * 12 + ["field cannot be set: votes", "field cannot be set: key", "value cannot be read: many", "field holds one value: summary", "unknown op: ", "transition without a status", "comment without a body", "unknown issue: A-9"]
    assert [r["synced_at"] is None for r in edits.record_outcomes(queue, results, F.lit(at)).orderBy("id").collect()] == [False] * 12 + [True] * 8
    stored, told = edits.append_comments(comments.limit(0), issues, comments, F.lit(at))
    assert [(r["issue_key"], r["body"]) for r in stored.collect()] == [("A-1", "hello")] and told.filter("key = 'A-1'").first()["comments_text"] == "hello"


def test_sort_of_all_rows(spark):
    want = sorted((r["id"], r["key"]) for r in src.issues_view(spark, SF).select("id", "key").collect())[::-1]
    assert len(want) > 100
    assert [(r["id"], r["key"]) for r in q.sort_as_text(spark, SF).collect()] == want


def test_numbers_within_groups(spark, tmp_path):
    from pyspark.sql import Window as W

    from ledgerline.operators import reports

    hour = lambda n: None if n % 11 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n * 7 % 60)
    df = spark.createDataFrame([(f"A-{n:03}", None if n % 13 == 0 else ["x", "x", "y"][n % 3], hour(n)) for n in range(200)], "key string, team string, updated timestamp_ntz")
    for desc in (False, True):
        by = W.partitionBy("team").orderBy(F.desc("updated") if desc else F.asc("updated"), "key")
        want = sorted(tuple(r) for r in df.withColumn("n", F.row_number().over(by)).select("key", "n").collect())
        assert sorted(tuple(r) for r in reports.numbered(df, "team", "updated", "key", "n", desc).select("key", "n").collect()) == want
        assert sorted(tuple(r) for r in reports.numbered(df, "team", "updated", "key", "n", desc, f"{tmp_path}/{desc}").select("key", "n").collect()) == want
    assert reports.numbered(df.limit(0), "team", "updated", "key", "n").collect() == []
    assert reports.numbered(df.limit(0), "team", "updated", "key", "n", folder=f"{tmp_path}/none").collect() == []


def test_numbers_of_one_group_at_one_time(spark, tmp_path):
    """All rows of one day, and all without a time, are spread over ranges of about equal size."""
    from ledgerline.operators import reports

    df = spark.range(20_000).select(F.format_string("A-%05d", "id").alias("key"), F.when(F.col("id") < 9_000, "x").alias("team"), F.when(F.col("id") % 2 == 0, F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz").alias("updated"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so few rows would make one partition
    got = reports.staleness_rank(df, folder=f"{tmp_path}/r")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == [*df.columns, "rank"]
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/r/ranges").groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4
    want = {}
    for n in sorted(range(20_000), key=lambda n: (n < 9_000, n % 2 == 0, n)):
        want[n] = len(want) + 1 - 11_000 * (n < 9_000)
    assert {int(r["key"][2:]): r["rank"] for r in got.collect()} == want


def test_headers_of_groups(spark):
    from ledgerline.operators import profile

    df = spark.createDataFrame([("A-3", "P-1"), ("A-2", "P-1"), ("A-5", None), ("A-4", ""), ("A-1", "P-2")], "key string, parent_key string")
    got = sorted(tuple(r) for r in profile.group_with_headers(df, "parent_key", ["key"]).collect())
    assert got == [("A-1", "P-2", True, 1), ("A-2", "P-1", True, 2), ("A-3", "P-1", False, 2), ("A-4", "(no parent)", True, 2), ("A-5", "(no parent)", False, 2)]


def test_clone_copies_every_field(spark):
    text = lambda t: {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": t}]}]}
    fields = {
        "summary": "old text", "project": {"key": "A", "id": "1"}, "issuetype": {"name": "Bug"}, "priority": {"name": "Low"}, "parent": {"key": "A-0"}, "assignee": {"accountId": "u1", "displayName": "U"}, "labels": ["x"],
        "components": [{"name": "c", "id": "7"}], "fixVersions": [{"name": "v1"}, {"name": "v2"}], "description": text("old content"), "status": {"name": "Done"}, "customfield_1": {"value": "Team", "id": 3},
        "customfield_2": 2.5, "customfield_3": None, "customfield_4": ["a", {"b": [1, None]}], "customfield_5": "0|i0", "customfield_77": True, "customfield_78": "7",
    }
    catalog = src.catalog(spark).select("jira_id", "jira_name", "name").unionByName(spark.createDataFrame([("customfield_5", "Rank", "rank")], "jira_id string, jira_name string, name string"))
    raw = spark.createDataFrame([("A-1", json.dumps({"key": "A-1", "fields": fields})), ("A-2", json.dumps({"key": "A-2", "fields": {"summary": "s", "description": "old", "labels": None}}))], "key string, raw string")
    got = {r["key"]: json.loads(r["payload"])["fields"] for r in edits.clone_payloads(raw, catalog, {"fix-version": "v9", "story_points": "8"}, [("old", "new"), ("content", "words")]).collect()}
    kept = {k: fields[k] for k in ("issuetype", "priority", "parent", "labels", "customfield_1", "customfield_4", "customfield_77", "customfield_78")}
    assert got["A-1"] == kept | {"summary": "new text", "project": {"key": "A"}, "assignee": {"accountId": "u1"}, "components": [{"name": "c"}], "fixVersions": [{"name": "v9"}], "description": text("new words"), "customfield_2": 8}
    assert got["A-2"] == {"summary": "s", "description": "new", "fixVersions": [{"name": "v9"}], "customfield_2": 8}


def test_clone_payloads_are_complete(spark):
    raw = q.raws(spark, SF)
    want = {}
    for r in raw.collect():
        f = json.loads(r["raw"])["fields"]
        own = {n: f[n] for n in ("summary", "description") if n in f} | {**{n: {k: f[n][k]} for n, k in (("project", "key"), ("issuetype", "name"), ("priority", "name"), ("parent", "key")) if n in f}}
        want[r["key"]] = own | {n: f[n] for n in ("labels", "components", "fixVersions")} | {n: v for n, v in f.items() if n.startswith("customfield_")}
    assert {r["key"]: json.loads(r["payload"])["fields"] for r in edits.clone_payloads(raw, src.catalog(spark)).collect()} == want


def test_stream_keeps_children_and_custom_fields(spark, tmp_path):
    def issue(key, day, comments, links, changes):
        link = lambda n: {"id": str(n), "type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}, "outwardIssue": {"key": f"B-{n}"}}
        fields = {"summary": key, "updated": f"2024-01-{day:02}T00:00:00.000+0000", "customfield_1": {"value": f"team {day}"}, "comment": {"comments": [{"id": i, "author": {"displayName": "a"}, "body": b, "created": f"2024-01-01T00:00:{i:0>2}.000+0000"} for i, b in comments]}, "issuelinks": [link(n) for n in links]}
        histories = [{"id": i, "author": {"displayName": "a"}, "created": f"2024-01-{day:02}T00:00:00.000+0000", "items": [{"field": "status", "fromString": "x", "toString": t}]} for i, t in changes]
        return {"id": key, "key": key, "fields": fields, "changelog": {"histories": histories}}

    batches = [
        [issue("A-1", 1, [("1", "one"), ("2", "two")], [1, 2], [("h1", "y")]), issue("A-2", 1, [("3", "three")], [3], [])],
        [issue("A-1", 2, [("2", "TWO"), ("4", "four")], [2, 4], [("h1", "y"), ("h2", "z")])],
    ]
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for k, batch in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"issues": batch}))
        sync.stream_sync(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), catalog=src.catalog(spark)).awaitTermination()
    rows = lambda name, *c: sorted(tuple(r) for r in kept.read_kept(spark, f"{out}/{name}").select(*c).collect())
    assert rows("", "key", "team", "comments_text") == [("A-1", "team 2", "one TWO four"), ("A-2", "team 1", "three")]
    assert rows("comments", "id", "issue_key", "body") == [("1", "A-1", "one"), ("2", "A-1", "TWO"), ("3", "A-2", "three"), ("4", "A-1", "four")]
    assert rows("issue_links", "id", "issue_key") == [("2_out", "A-1"), ("3_out", "A-2"), ("4_out", "A-1")]
    assert rows("changelog", "id", "issue_key", "to_string") == [("h1_0", "A-1", "y"), ("h2_0", "A-1", "z")]


def test_stream_durations_over_batches(spark, tmp_path):
    schema = "id string, issue_key string, to_string string, changed_at timestamp"
    event = lambda i, k, s, n: (i, k, s, dt.datetime(2024, 1, 1, 0, 0, n))
    for batch in ([event("2", "A", "y", 5), event("1", "A", "x", 1), event("3", "B", "x", 2)], [event("4", "A", "z", 9)], [event("5", "B", "y", 30), event("6", "A", "x", 10)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        sync.stream_status_durations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/stays")).select("issue_key", "status", "seconds").collect()
    assert sorted(map(tuple, got)) == [("A", "x", 4.0), ("A", "y", 4.0), ("A", "z", 1.0), ("B", "x", 28.0)]


def test_a_write_that_breaks_off_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert not sinks.has_table(spark, path)
    first = sinks.write_table(frame(1, 2), path)
    (tmp_path / "table" / "v-00000002").mkdir()  # as if the writer had died in it
    (tmp_path / "table" / "v-00000002" / "part-0.parquet").write_bytes(b"half")
    assert sorted(r["id"] for r in sinks.read_table(spark, path).collect()) == [1, 2]
    old = sinks.read_table(spark, path)
    assert (first, sinks.write_table(frame(3).unionByName(old), path)) == ("v-00000001", "v-00000003")
    assert sorted(r["id"] for r in sinks.read_table(spark, path).collect()) == [1, 2, 3] and old.count() == 2


def test_a_stream_never_starts_over_an_incomplete_table(spark, tmp_path):
    import pytest

    page = lambda key: json.dumps({"issues": [{"id": key, "key": key, "fields": {"summary": key, "updated": "2024-01-01"}}]})
    (tmp_path / "in").mkdir()
    run = lambda: sync.stream_sync(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    (tmp_path / "in" / "0.json").write_text(page("A-1"))
    run()
    (tmp_path / "out" / "manifest" / "v-00000001" / "_SUCCESS").unlink()
    (tmp_path / "in" / "1.json").write_text(page("A-2"))
    with pytest.raises(Exception, match="no complete version"):
        run()


def test_deep_trees_and_markdown(spark):
    text = lambda t, *marks: {"type": "text", "text": t, "marks": [{"type": m} for m in marks]}
    node = lambda kind, *content, **attrs: {"type": kind, "content": list(content), "attrs": attrs}
    deep = text("core")
    for _ in range(3_000):
        deep = node("blockquote" if _ % 50 == 0 else "x", deep)
    para = lambda *c: node("paragraph", *c)
    doc = node(
        "doc", node("heading", text("Top"), level=3), para(text("a", "strong", "em"), text("b", "code", "strong"), {"type": "mention", "content": [text("@bo")]}, {"type": "embedCard", "attrs": {"url": "http://u"}}, {"type": "emoji", "attrs": {"text": "!"}}),
        node("orderedList", node("listItem", para(text("x")), node("bulletList", node("listItem", para(text("y")))), para(text("z"))), node("listItem", para(text("w")))), node("codeBlock", text("c"), language="go"),
        node("blockquote", para(text("q"))), node("table", node("tableRow", node("tableHeader", para(text("h"))), node("tableHeader", para(text("i")))), node("tableRow", node("tableCell", para(text("1"))))), node("mediaSingle", {"type": "media"}),
    )
    rows = [(0, json.dumps(doc)), (1, '"just text"'), (2, "{broken"), (3, None)]
    df = spark.createDataFrame(rows, "id long, body string")
    from ledgerline.functions import richtext

    want = "### Top\n\n***a***`b`@@bohttp://u!\n\n1. x\n  - y\n   z\n2. w\n\n```go\nc\n```\n\n> q\n\n| h | i |\n| --- | --- |\n| 1 |  |\n\n[attachment]"
    assert [r["markdown"] for r in richtext.rich_text_to_markdown(df, "body").orderBy("id").collect()] == [want, "just text", "", ""]
    tree = json.dumps(deep)
    told = spark.createDataFrame([(tree,)], "body string")
    assert richtext.rich_text_to_plaintext(told, "body").first()["plain"] == "core" and richtext.rich_text_to_markdown(told, "body").first()["markdown"].endswith("core")
    kept = spark.createDataFrame([(rows[0][1],), ("plain {",), ('{"a": 1} and "type"',), (None,)], "b string").select(richtext.plain_text(F.col("b")).alias("b")).collect()
    assert kept[0]["b"].startswith("Top\n\nab@bo!"[:6]) and [r["b"] for r in kept[1:]] == ["plain {", '{"a": 1} and "type"', None]


def test_queue_outcomes_and_transitions(spark):
    at = dt.datetime(2024, 1, 1)
    issues = spark.createDataFrame([("A-1", "To Do")], "key string, status string")
    rows = [(1, "A-1", "transition", '{"transition_id":"31"}', 0, None), (2, "A-1", "transition", '{"transition_id":"99"}', 0, None), (3, "A-1", "transition", '{"transition_id":"31"}', 5, "no network")]
    queue = spark.createDataFrame([(i, k, o, p, at, None, n, e) for i, k, o, p, n, e in rows], "id long, issue_key string, operation string, payload string, created_at timestamp_ntz, synced_at timestamp_ntz, retry_count int, last_error string")
    table = spark.createDataFrame([("31", "Done"), ("31", "Open"), (None, "None"), ("32", "Closed")], "id string, status string")
    one, other = (edits.apply_pending(issues, queue, transitions=x) for x in ({"31": "Done"}, table))
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns for a, b in zip(one, other, strict=True))
    out, results, _ = edits.apply_pending(issues, queue, transitions={"31": "Done"})
    assert out.first()["status"] == "Done"
    assert [(r["ok"], r["error"]) for r in results.orderBy("id").collect()] == [(True, None), (False, "transition without a status"), (False, "too many retries: no network")]
    for _ in range(2):
        queue = edits.record_outcomes(queue, results, F.lit(at))
    assert [(r["retry_count"], r["last_error"]) for r in queue.orderBy("id").collect()] == [(0, None), (2, "transition without a status"), (5, "no network")]


def test_refresh_keeps_what_raw_issues_lack(spark):
    issues = spark.createDataFrame([("A-1", "old", "team x", "said"), ("A-2", "two", "team y", None)], "key string, summary string, team string, comments_text string").withColumn("updated", F.lit(None).cast("timestamp_ntz"))
    raw = spark.createDataFrame([("A-1", json.dumps({"key": "A-1", "fields": {"summary": "new", "customfield_1": {"value": "team z"}}}))], "key string, raw string")
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "summary", "team", "comments_text").collect())
    assert rows(edits.refresh_issues(issues, raw)) == [("A-1", "new", "team x", "said"), ("A-2", "two", "team y", None)]
    assert rows(edits.refresh_issues(issues, raw, src.catalog(spark))) == [("A-1", "new", "team z", "said"), ("A-2", "two", "team y", None)]


def test_highlight_takes_terms_as_they_are(spark):
    from ledgerline.operators import search

    df = spark.createDataFrame([("C++ and cat, licensing a.b",)], "t string")
    assert search.highlight(df, "t", ["c++", "a.b"]).first()["highlighted"] == "[C++] and cat, licensing [a.b]"
    assert search.highlight(df, "t", ["licensed"], stemmed=True).first()["highlighted"] == "C++ and cat, [licensing] a.b"
