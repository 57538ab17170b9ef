"""Trees of any height, pages in any layout, what does not decode."""

import json
import random

from pyspark.sql import functions as F

from ledgerline.operators import flatten, profile
from ledgerline.sources import issues as src

SCHEMA = "key string, parent_key string, status_category string, story_points double"


def plain(parents):
    out = {}
    for key in parents:
        chain, at = [], key
        while (up := parents.get(at)) in parents and up is not None and up not in (key, *chain) and up != at:
            chain.append(up)
            at = up
        out[key] = chain
    return out


def test_depth_1000_in_ten_rounds(spark, tmp_path):
    rows = [(f"K{k}", f"K{k - 1}" if k else None, "Done", 1.0) for k in range(1001)]
    up = profile.ancestors(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    assert up.count() == 1001 * 1000 // 2 and up.agg({"distance": "max"}).first()[0] == 1000
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("pairs-")]) - 2 <= 10  # the first and the one that finds no more


def test_random_trees_with_cycles(spark, tmp_path):
    rng = random.Random(7)
    parents = {f"K{k}": rng.choice([None, "gone", f"K{rng.randrange(60)}", f"K{rng.randrange(60)}"]) for k in range(60)}
    parents |= {"A": "B", "B": "C", "C": "A", "D": "A", "E": "E", "F": "E"}
    rows = [(k, p, random.Random(k).choice(["Done", "To Do", None]), float(len(k))) for k, p in parents.items()]
    issues, want = spark.createDataFrame(rows, SCHEMA), plain(parents)
    got = {r["key"]: (r["depth"], r["chain"]) for r in profile.whole_chain(issues, str(tmp_path / "c")).collect()}
    assert got == {k: (len(c), c[::-1]) for k, c in want.items()}
    told = {r["key"]: (r["height"], r["issues"], r["done"], r["points"]) for r in profile.subtree_rollup(issues, str(tmp_path / "s")).collect()}
    below: dict = {}
    for k, c in want.items():
        for d, up in enumerate(c, 1):
            below.setdefault(up, []).append((d, k))
    kinds = {r[0]: r[2] for r in rows}
    assert told == {up: (max(d for d, _ in ks), len(ks), sum(kinds[k] == "Done" for _, k in ks), float(sum(len(k) for _, k in ks))) for up, ks in below.items()}


def test_no_rows_and_no_candidates(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert profile.ancestors(empty, str(tmp_path / "e")).count() == 0
    got = profile.suggest_closest(spark.createDataFrame([("x",), (None,)], "input string"), []).collect()
    assert [tuple(r) for r in got] == [("x", ""), (None, "")]


def test_pages_in_any_layout(spark, tmp_path):
    issue = lambda k: {"id": str(k), "key": f"A-{k}", "fields": {"summary": "s\nt"}}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "lines.json").write_text("\n".join(json.dumps({"issues": [issue(k)]}) for k in (1, 2)) + "\n\n")
    (folder / "wide.json").write_text(json.dumps({"issues": [issue(3), issue(4), {"id": "5"}, 17, None]}, indent=2))
    (folder / "torn.json").write_text(json.dumps({"issues": [issue(6)]}) + '\n{"issues": [{"key":\n')
    (folder / "told.json").write_text(json.dumps({"errorMessages": ["no", "way"]}, indent=1))
    (folder / "other.json").write_text('{"total": 0}')
    good, bad = src.read_pages(spark, str(folder))
    name = lambda r: (r["path"].rsplit("/", 1)[1], r["position"])
    assert sorted((*name(r), json.loads(r["raw"])["key"]) for r in good.collect()) == [("lines.json", 0, "A-1"), ("lines.json", 0, "A-2"), ("torn.json", 0, "A-6"), ("wide.json", 0, "A-3"), ("wide.json", 1, "A-4")]
    assert sorted((*name(r), r["reason"]) for r in bad.filter("position is not null").collect()) == [("wide.json", 2, "no key"), ("wide.json", 3, "no object"), ("wide.json", 4, "no text")]
    assert sorted((name(r)[0], r["reason"]) for r in bad.filter("position is null").collect()) == [("other.json", "no issues in page"), ("told.json", "no; way"), ("torn.json", "no JSON")]
    rows = src.scan_issue_pages(spark, str(folder)).collect()
    assert sorted(r["key"] for r in rows if r["key"]) == ["A-1", "A-2", "A-3", "A-4", "A-6"] and sorted(r["error"] for r in rows if r["error"]) == ["no issues in page", "no issues in page", "no; way"]
    raw = spark.createDataFrame([(json.dumps(issue(1)),), ("[]",), ("{",), (None,), ('{"fields": 3, "key": "X"}',)], "raw string")
    assert flatten.denormalize_issues(raw).count() + flatten.undecodable_issues(raw).count() == 5


def test_trees_are_summed_up_without_pairs(spark, tmp_path):
    """No table of a chain's or a subtree's rounds has more rows than there are keys; cycles and repeated keys beside a tree stay right."""
    rows = [(f"k{n}", f"k{n // 2}" if n > 1 else None, "Done" if n % 3 else "To Do", float(n)) for n in range(1, 64)]
    rows += [("c1", "c2", "Done", 1.0), ("c2", "c1", "Done", 2.0), ("c3", "c2", None, None), ("k5", "k2", "To Do", 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["key"]: r for r in profile.subtree_rollup(df, str(tmp_path / "s")).collect()}
    below = [n for n in range(2, 64)]
    assert (got["k1"]["height"], got["k1"]["issues"], got["k1"]["points"]) == (5, 63, sum(below) + 5.0) and "k63" not in got
    assert [tuple(got["c1"])[1:3], tuple(got["c2"])[1:3]] == [(2, 2), (1, 2)] and "c3" not in got and got["c2"]["points"] == 1.0
    chain = {r["key"]: r["chain"] for r in profile.whole_chain(df, str(tmp_path / "w")).collect()}
    assert chain["k63"] == ["k1", "k3", "k7", "k15", "k31"] and chain["k1"] == [] and chain["c3"] == ["c1", "c2"] and chain["c1"] == ["c2"]
    written = list(tmp_path.glob("[sw]/*-*"))
    assert written and all(spark.read.parquet(str(part)).count() <= 66 for part in written)


def test_large_files_of_pages_are_read_by_lines(spark, tmp_path):
    """No plan reads a file in one piece, whatever the files' form; a page over many lines, cut by splits, comes out whole."""
    issue = lambda k: {"id": str(k), "key": f"A-{k}", "fields": {"summary": "x" * 50}}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"issues": [issue(k)]}) for k in range(300)))
    (tmp_path / "wide.json").write_text(json.dumps({"issues": [issue(k) for k in range(300, 600)]}, indent=1))
    (tmp_path / "two.json").write_text("\n".join(json.dumps({"issues": [issue(k)]}, indent=1) for k in (700, 701)))
    (tmp_path / "log.json").write_text("started\nended\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        good, bad = src.read_pages(spark, str(tmp_path))
        assert sorted(json.loads(r["raw"])["id"] for r in good.collect()) == sorted(map(str, [*range(600), 700, 701]))
        lost = [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()]
        assert lost == [("log.json", "no JSON")] * 2
        assert "wholetext" not in good._jdf.queryExecution().toString() and max(len(r["value"]) for r in src._pages(spark, str(tmp_path)).filter("path LIKE '%lines.json'").collect()) < 200
        assert max(p["n"] for p in src._pages(spark, str(tmp_path)).filter("path LIKE '%lines.json'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_objects_in_arrays(spark):
    catalog = spark.createDataFrame([("customfield_1", "watchers", "array", True, True)], "jira_id string, name string, type string, is_custom boolean, is_column boolean")
    fields = {"customfield_1": ["a", {"value": "b"}, {"name": "c"}, {"displayName": "Ann"}, {"value": "d", "name": "e"}]}
    raw = spark.createDataFrame([("K", json.dumps({"key": "K", "fields": fields}))], "key string, raw string")
    assert flatten.extract_custom_fields(raw, catalog).first()["watchers"] == ["a", "b", "c", "d"]
