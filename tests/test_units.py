"""Cases with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import richtext
from ledgerline.functions.stem import stem
from ledgerline.operators import edits, flatten, merge, profile, search
from ledgerline.plans import query
from ledgerline.sources import issues as src
from ledgerline.sources import sinks

NOW = dt.datetime(2024, 7, 17, 12)


def test_calendar():
    c = query.calendar(NOW)
    assert c == {"today": "2024-07-17", "yesterday": "2024-07-16", "week_ago": "2024-07-10", "month_ago": "2024-06-17", "quarter_ago": "2024-04-18", "this_week": "2024-07-15", "this_month": "2024-07-01", "this_quarter": "2024-07-01"}


def test_calendar_frame_agrees(spark):
    row = query.calendar_frame(spark, NOW).first().asDict()
    assert {k: v.isoformat() for k, v in row.items()} == query.calendar(NOW)


@pytest.mark.parametrize("text,want", [("{{days_ago:14}}", "2024-07-03"), ("{{weeks_ago:4}}", "2024-06-19"), ("{{months_ago:3}}", "2024-04-17"), ("{{other}}", "{{other}}"), ("{{me}}", "ann")])
def test_variables(text, want):
    assert query.expand_template(text, query.QueryConfig(me="ann"), NOW) == want


@pytest.mark.parametrize("clause,want", [("PROJECT = ROX", "'ROX'"), ("project in (ROX, OTHER)", "'ROX','OTHER'"), ("project = ROX AND status != Done", "'ROX'"), ('project = "ROX" ORDER BY rank', "'ROX'"), ("status = Done", "")])
def test_projects(clause, want):
    assert query.project_clause(query.QueryConfig(source_filter=clause)) == want
    assert query.project_clause(query.QueryConfig(projects=("X",), source_filter=clause)) == "'X'"


def test_months_clamp():
    assert query.months_before(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)


def test_snippets():
    c = query.QueryConfig(snippets={"a": "x {{b}}", "b": "{{today}}", "today": "no", "l": "{{l}}", "p": "{{q}}", "q": "{{p}}"})
    assert query.expand_template("{{a}}", c, NOW) == "x 2024-07-17"
    for name in ("l", "p"):
        with pytest.raises(ValueError, match="circular snippet reference"):
            query.expand_template("{{" + name + "}}", c, NOW)


@pytest.mark.parametrize("sql", ["DROP TABLE x", "WITH a AS (SELECT 1) DELETE FROM x", "insert into x values (1)"])
def test_read_only(spark, sql):
    with pytest.raises(ValueError):
        query.run_query(spark, sql, query.QueryConfig(), NOW)


def test_query_args(spark):
    assert query.run_query(spark, "-- note\nSELECT :a AS a", query.QueryConfig(), NOW, {"a": 3}).first()["a"] == 3


def test_suggest(spark):
    names = ["status", "summary", "assignee", "priority", "team"]
    df = spark.createDataFrame([(x,) for x in ("statuss", "teem", "pririty", "xyz_totally_wrong")], "input string")
    got = dict(profile.suggest_closest(df, names).collect())
    assert got == {"statuss": "status", "teem": "team", "pririty": "priority", "xyz_totally_wrong": ""}


def test_suggest_from_many(spark, tmp_path):
    """Against all pairs, with short, empty, null, repeated and equally near names."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = ["", "q", "zz", *[word(rng.randrange(1, 12)) for _ in range(60)], "status", "summary", "story_points", "étage"]
    asked = ["", "w", "xyz", "x" * 4, "stats", "sumary", "storypoint", "etage", "far away", *[word(rng.randrange(0, 14)) for _ in range(80)]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def plain(a, some):
        best = min(((distance(a, c), k, c) for k, c in some), default=(9, 0, ""))
        return best[2] if best[0] <= 3 else ""

    for k, some in enumerate(([*enumerate(names), (99, "q")], list(enumerate(names))[3:], [])):
        df = spark.createDataFrame([*[(c, p) for p, c in some], (None, 0)], "name string, place int")
        got = profile.suggest_from(spark.createDataFrame([(x,) for x in [*asked, "stats", None]], "input string"), df, f"{tmp_path}/{k}").collect()
        assert len(got) == len({*asked, None}) and {r["input"]: r["suggestion"] for r in got} == {None: "", **{a: plain(a, some) for a in asked}}


def test_suggest_from_broadcasts_no_strings_left_out(spark, tmp_path):
    """The strings left out of names are a thousand times the names; no plan may send them to all tasks by the names' size."""
    names = spark.range(300).select(F.concat(F.lit("Name number "), "id").alias("name"), F.col("id").alias("place"))
    plans = []
    kind = type(names)
    write = kind.write.fget
    try:
        kind.write = property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
        got = profile.suggest_from(names.select(F.concat("name", F.lit("xy")).alias("input")), names, str(tmp_path / "s"))
    finally:
        kind.write = property(write)
    assert {r["suggestion"] for r in got.filter("input = 'Name number 7xy'").collect()} == {"Name number 7"}
    strings = [p for p in plans if "Join [_s#" in p]
    assert len(strings) == 3 and all("SortMergeJoin [_s#" in p for p in strings)


@pytest.mark.parametrize("current,adds,removes,want", [(["a", "b"], ["c"], [], ["a", "b", "c"]), (["a", "b", "a"], [], ["a"], ["b"]), (["a", "a"], ["a"], [], ["a", "a"]), (None, ["x", "x"], [], ["x"]), (["a"], [], ["a"], []), (["a"], ["a"], ["a"], ["a"])])
def test_array_edits(spark, current, adds, removes, want):
    df = spark.createDataFrame([("k", current)], "key string, labels array<string>")
    assert edits.array_add_remove(df, "labels", adds, removes).first()["labels"] == want


def test_object_fallback(spark):
    raw = [json.dumps({"key": str(k), "fields": {"f": v}}) for k, v in enumerate(({"id": 1, "name": "n", "isShared": True}, {"id": 1, "value": "v"}, {"self": "s", "displayName": "d"}, {"id": 1, "title": "t"}, {"name": "", "title": "t2"}, "plain", None))]
    catalog = spark.createDataFrame([("f", "F", "f", "string", True, True)], "jira_id string, jira_name string, name string, type string, is_custom boolean, is_column boolean")
    df = spark.createDataFrame([(str(k), r) for k, r in enumerate(raw)], "key string, raw string")
    assert [r["f"] for r in flatten.extract_custom_fields(df, catalog).orderBy("key").collect()] == ["n", "v", "d", "t", "t2", "plain", None]


def test_bad_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"issues":[{"id":"1","key":"A-1","fields":{}}]}\n{"errorMessages":["no access"]}\nnot json\n\n')
    got = [tuple(r) for r in src.scan_issue_pages(spark, str(tmp_path)).select("key", "error").collect()]
    assert sorted(got, key=str) == sorted([("A-1", None), (None, "no access"), (None, "no issues in page")], key=str)


def test_undecodable_rows_go(spark):
    df = spark.createDataFrame([("x",), ('{"key":"A-1","fields":{"summary":"s","updated":"2026-01-01T10:00:00.000+0530"}}',), (None,)], "raw string")
    row = flatten.denormalize_issues(df).collect()
    assert [r["key"] for r in row] == ["A-1"] and row[0]["updated"] == dt.datetime(2026, 1, 1, 4, 30)


def test_candidates_respect_projects(spark):
    d = dt.datetime
    rows = [("a", "P", d(2026, 6, 1), d(2026, 6, 2)), ("b", "P", d(2026, 6, 2), d(2026, 6, 1)), ("c", "P", d(2026, 6, 1), None), ("d", "Q", d(2026, 6, 1), None)]
    df = spark.createDataFrame(rows, "key string, project string, updated timestamp_ntz, changelog_synced_at timestamp_ntz")
    assert [r["key"] for r in merge.changelog_candidates(df, ["P"]).collect()] == ["b", "c"]


def test_duplicate_history(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r["id"] for r in merge.insert_ignore(ids("1_0", "2_0"), ids("1_0", "3_0", "3_0"), "id").collect()) == ["1_0", "2_0", "3_0"]


def test_deletion_guard(spark):
    local = spark.createDataFrame([("T-1", "T"), ("T-2", "T")], "key string, project string")
    none = local.select("key").limit(0)
    assert merge.detect_deletions(local, none, "T").count() == 0
    assert merge.detect_deletions(local, none, "T", allow_empty=True).count() == 2
    assert [r["key"] for r in merge.detect_deletions(local, local.filter("key = 'T-1'"), "T").collect()] == ["T-2"]


def test_slugs(spark):
    rows = [("customfield_1", "Story  Points!", 1), ("customfield_2", "story points", 2), ("customfield_3", "3rd", 3), ("customfield_4", "***", 4)]
    df = spark.createDataFrame(rows, "id string, name string, ordinal long")
    got = dict(flatten.infer_field_names(df, overrides={"customfield_4": "rank"}).collect())
    assert got == {"customfield_1": "story_points", "customfield_2": "story_points_2", "customfield_3": "_3rd", "customfield_4": "rank"}


def test_bulk_set_errors(spark):
    df = spark.createDataFrame([("a", "x")], "key string, team string")
    with pytest.raises(ValueError, match="no key column"):
        edits.bulk_set(df, df.select("team"), "team", "y", F.lit(None))
    with pytest.raises(ValueError, match="no rows"):
        edits.bulk_set(df, df.limit(0), "team", "y", F.lit(None))


def test_parent_chain_stops_at_cycles(spark):
    rows = [("a", "b", ""), ("b", "a", ""), ("c", "x", ""), *((f"n{k}", f"n{k - 1}" if k else None, "") for k in range(9))]
    df = spark.createDataFrame(rows, "key string, parent_key string, summary string")
    got = {r["key"]: r["chain"] for r in profile.parent_chain(df).collect()}
    assert got["a"] == ["b"] and got["c"] == [] and got["n8"] == ["n3", "n4", "n5", "n6", "n7"]


def test_spans():
    assert profile.span_seconds("28d") == 28 * 86400 and profile.span_seconds("1h30m") == 5400 and profile.span_seconds("soon") is None


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("conditional", "condit"), ("adjustable", "adjust"), ("rate", "rate"), ("sky", "sky"), ("happy", "happi"), ("été", "été")])
def test_stem(word, want):
    assert stem(word) == want


def doc(*content):
    return json.dumps({"type": "doc", "content": list(content)})


def text(t, *marks):
    return {"type": "text", "text": t, **({"marks": [{"type": m} for m in marks]} if marks else {})}


def test_rich_text(spark):
    para = {"type": "paragraph", "content": [text("Hello, "), text("world!", "strong")]}
    item = lambda *c: {"type": "listItem", "content": list(c)}
    nested = {"type": "bulletList", "content": [item({"type": "paragraph", "content": [text("a")]}, {"type": "orderedList", "content": [item({"type": "paragraph", "content": [text("b")]})]})]}
    rows = [(1, doc(para)), (2, '"plain text"'), (3, None), (4, "{broken"), (5, doc({"type": "heading", "attrs": {"level": 2}, "content": [text("T")]}, nested))]
    df = spark.createDataFrame(rows, "id int, body string")
    assert [r["plain"] for r in richtext.rich_text_to_plaintext(df, "body").orderBy("id").collect()][:4] == ["Hello, world!", "plain text", "", ""]
    md = [r["markdown"] for r in richtext.rich_text_to_markdown(df, "body").orderBy("id").collect()]
    assert md[0] == "Hello, **world!**" and md[4] == "## T\n\n- a\n  1. b"


def test_search_forms(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "apple red"), (3, "green Äpple"), (4, None)], "id int, t string")
    p, n = search.build_text_index(df, "id", ["t"], False)
    keys = lambda q, **k: [r["key"] for r in search.search_ranked(p, n, q, **k).orderBy("key").collect()]
    assert keys("red apple") == [1, 2] and keys("red apple", mode="phrase") == [1] and keys("apple red", mode="not") == [3]
    assert keys("gre pi", mode="prefix") == [] and keys("re pi", mode="prefix") == [1] and keys("gr", mode="prefix") == [3] and keys("pie green", mode="any") == [1, 3]


def test_table_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "P")], "key string, project string")
    sinks.write_table(df, path, "project")
    sinks.write_table(sinks.read_table(spark, path).select("key", "project").unionByName(df), path, "project")
    assert sinks.read_table(spark, path).count() == 2
