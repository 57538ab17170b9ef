"""Readers of tracker dumps, and views that present the star schema and event tables as tracker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TABLES = ("issues", "comments", "changelog", "issue_links", "field_map", "projects", "pending_changes", "sync_metadata")
ITEM = "field string, fieldtype string, from string, fromString string, to string, toString string"
HISTORY = f"id string, author struct<displayName: string>, created string, items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>"
STAMP = "yyyy-MM-dd'T'HH:mm:ss'.000+0000'"


PAGE = "struct<issues: array<string>, errorMessages: array<string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, _start, _at, value, p, _page): the lines of all files with their places, and those that are pages."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    named = F.col("value").contains("issues") | F.col("value").contains("errorMessages") | F.col("value").contains("\\u")  # most printed lines need no parser
    lines = read.filter(F.trim("value") != "").withColumn("p", F.when(named, F.from_json("value", PAGE)))
    return lines.withColumn("_page", F.coalesce((F.col("p.issues").isNotNull() | F.col("p.errorMessages").isNotNull()) & F.try_parse_json(F.when(named, F.col("value"))).isNotNull(), F.lit(False)))


def _ends() -> Column:
    """Whether the lines of a file have a bracket at either end."""
    place = F.struct("_start", "_at")
    return F.min_by("value", place).rlike(r"^\s*[\[{]") & F.max_by("value", place).rlike(r"[\]}]\s*$")


def _together(own: DataFrame) -> DataFrame:
    """(path, value): the lines of each file put together again as pages; where that gives no JSON they stay lines."""
    own = own.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_at", "value"))), lambda x: x["value"]).alias("all"))
    each = F.split(F.array_join("all", "\n"), r"(?<=\})\s*\n\s*(?=\{)")  # within JSON a comma would stand there, so pages are told apart
    whole = F.flatten(F.transform(each, lambda x: F.when(F.try_parse_json(x).isNotNull(), F.array(x)).otherwise(F.split(x, "\n"))))
    torn = F.exists("all", lambda x: F.try_parse_json(x).isNull())
    return own.select("path", F.explode(F.when(torn, whole).otherwise(F.col("all"))).alias("value"))


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, p): the pages of all files. A file has a page a line, or pages printed over many lines. Only lines that are no page
    are looked at together: those of a file without a page, with lines that are no JSON and with a bracket at either end, are put
    together again, and where that gives no JSON they stay lines. No file is read in one piece, so files of pages may be of any size."""
    lines = _lines(spark, path)
    cut = lines.select("path", "_start", "_at", "_page", F.when(~F.col("_page"), F.col("value")).alias("value"))
    bare = cut.groupBy("path").agg(F.bool_or("_page").alias("page"), _ends().alias("ends")).filter("NOT page AND ends").select("path")
    if bare.isEmpty():
        return lines.select("path", "value", "p")
    loose = lines.filter(~F.col("_page"))
    joined = _together(loose.join(bare, "path", "left_semi"))
    rest = loose.join(bare, "path", "left_anti").select("path", "value", "p")
    return lines.filter("_page").select("path", "value", "p").unionByName(rest).unionByName(joined.withColumn("p", F.from_json("value", PAGE)))


def scan_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, key, raw, error) rows of pages {"issues": [...], "nextPageToken"}, a line each or one over all lines of a file. A page
    with errorMessages, or one that is no JSON, gives one row with the error and no issue."""
    error = F.when(F.col("p.errorMessages").isNotNull(), F.array_join("p.errorMessages", "; ")).when(F.col("p.issues").isNull(), "no issues in page")
    df = _pages(spark, path).withColumn("error", error).select("error", F.explode_outer(F.when(F.col("error").isNull(), F.col("p.issues"))).alias("raw")).filter(F.col("raw").isNotNull() | F.col("error").isNotNull())
    return df.select(F.get_json_object("raw", "$.id").alias("id"), F.get_json_object("raw", "$.key").alias("key"), "raw", "error")


ROW = "array<struct<position: int, raw: string, reason: string>>"


def _rows(parsed: Column) -> Column:
    """What a page (value, p) gives: a row with a reason for the page as a whole, and a row for each issue."""
    reason = F.when(F.col("p.errorMessages").isNotNull(), F.array_join("p.errorMessages", "; ")).when(~parsed, "no JSON").when(F.col("p.issues").isNull(), "no issues in page")
    row = lambda position, raw, reason: F.struct(position.cast("int").alias("position"), raw.alias("raw"), reason.cast("string").alias("reason"))
    whole = F.when(reason.isNotNull(), F.array(row(F.lit(None), F.col("value"), reason)))
    each = F.when(F.col("p.errorMessages").isNull(), F.transform("p.issues", lambda x, k: row(k, x, F.lit(None))))
    return F.concat(*[F.coalesce(x.cast(ROW), F.array().cast(ROW)) for x in (whole, each)])


def _judged(df: DataFrame) -> DataFrame:
    """df (.., position, raw, reason) with the reasons of issues, too: each is judged by itself."""
    from ..operators.flatten import undecodable_reason

    return df.withColumn("reason", F.when(F.col("position").isNotNull(), undecodable_reason("raw")).otherwise(F.col("reason")))


def read_pages(spark: SparkSession, path: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues (path, position, raw) that decode, and what does not: (path, position, raw, reason), position being an issue's place in
    its page, null for a page as a whole. Good and bad rows are all issues and all pages without issues.

    With a folder, what is read is stored below it: files are read and pages parsed once, for good and bad rows alike, and the lines of files
    without a page are gathered from there. The paths of these files, fewer than the reader's list of files, are sent around."""
    if folder is None:
        rows = _pages(spark, path).select("path", F.explode(_rows(F.try_parse_json("value").isNotNull())).alias("x")).select("path", "x.*")
        judged = _judged(rows)
        return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    line = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.col("value").alias("raw"), F.lit(None).cast("string").alias("reason"))).cast(ROW)
    lines = _lines(spark, path).select("path", "_start", "_at", "_page", F.explode_outer(F.when(F.col("_page"), _rows(F.lit(True))).otherwise(line)).alias("x"))
    first = stored(_judged(lines.select("path", "_start", "_at", "_page", "x.*")), "lines")
    loose = first.filter("NOT _page").select("path", "_start", "_at", F.col("raw").alias("value"))
    bare = stored(loose.groupBy("path").agg(_ends().alias("ends")).filter("ends").select("path").join(first.filter("_page").select("path").distinct(), "path", "left_anti"), "bare")
    rest = loose.join(F.broadcast(bare), "path", "left_anti").select("path", "value")
    pages = _together(loose.join(F.broadcast(bare), "path", "left_semi")).unionByName(rest).withColumn("p", F.from_json("value", PAGE))
    rows = pages.select("path", F.explode(_rows(F.try_parse_json("value").isNotNull())).alias("x")).select("path", "x.*")
    put = first.filter("_page AND (position IS NOT NULL OR reason IS NOT NULL)").select("path", "position", "raw", "reason").unionByName(stored(_judged(rows), "together"))
    return put.filter("reason IS NULL").drop("reason"), put.filter("reason IS NOT NULL")


def scan_changelog_pages(spark: SparkSession, path: str, form: str = "issue") -> DataFrame:
    """(ref, id, author, created, items): histories by issue key (form "issue": {key, changelog: {histories}}) or by
    numeric issue id (form "bulk": {values: [{id, issueId, ..}]})."""
    fields = HISTORY.replace("id string", "id: string", 1).replace(", author ", ", author: ").replace(", created ", ", created: ").replace(", items ", ", items: ")
    if form == "issue":
        df = spark.read.schema(f"key string, changelog struct<histories: array<struct<{fields}>>>").json(path).select(F.col("key").alias("ref"), F.explode("changelog.histories").alias("h"))
    else:
        df = spark.read.schema(f"values array<struct<issueId: string, {fields}>>").json(path).select(F.explode("values").alias("h")).select(F.col("h.issueId").alias("ref"), "h")
    return df.select("ref", "h.id", F.coalesce("h.author.displayName", F.lit("")).alias("author"), "h.created", "h.items")


def histories_of(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(ref, id, author, created, items): the histories within raw issues, by issue key."""
    fields = HISTORY.replace("id string", "id: string", 1).replace(", author ", ", author: ").replace(", created ", ", created: ").replace(", items ", ", items: ")
    df = raw.select(F.from_json(column, f"struct<key: string, changelog: struct<histories: array<struct<{fields}>>>>").alias("i")).select(F.col("i.key").alias("ref"), F.explode("i.changelog.histories").alias("h"))
    return df.select("ref", "h.id", F.coalesce("h.author.displayName", F.lit("")).alias("author"), "h.created", "h.items")


def scan_field_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, custom, type, items, ordinal) of field metadata; fields without a schema are dropped."""
    df = spark.read.schema("id string, name string, custom boolean, schema struct<type: string, items: string>, ordinal long").json(path)
    return df.filter(F.col("schema").isNotNull()).select("id", "name", F.coalesce("custom", F.lit(False)).alias("custom"), "schema.type", "schema.items", "ordinal")


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """Makes the tables of a folder queryable by name."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    return list(names)


def project_issue_columns(raw: DataFrame, columns: list[str], column: str = "raw") -> DataFrame:
    """The chosen columns straight from raw issues; unknown ones are null, labels are joined, issuetype is type."""
    paths = {
        "key": "key", "id": "id", "summary": "fields.summary", "type": "fields.issuetype.name", "issuetype": "fields.issuetype.name", "project": "fields.project.key",
        "status": "fields.status.name", "status_category": "fields.status.statusCategory.name", "priority": "fields.priority.name", "assignee": "fields.assignee.displayName",
        "reporter": "fields.reporter.displayName", "created": "fields.created", "updated": "fields.updated", "parent_key": "fields.parent.key", "labels": "fields.labels",
    }
    named = "struct<name: string>"
    schema = (
        f"struct<id: string, key: string, fields: struct<summary: string, issuetype: {named}, project: struct<key: string>, status: struct<name: string, statusCategory: {named}>, priority: {named}, "
        "assignee: struct<displayName: string>, reporter: struct<displayName: string>, created: string, updated: string, parent: struct<key: string>, labels: array<string>>>"
    )
    one = lambda c: F.array_join(f"_i.{paths[c]}", ", ") if c == "labels" else F.col(f"_i.{paths[c]}") if c in paths else F.lit(None).cast("string")
    return raw.select(F.from_json(column, schema).alias("_i")).select(*[one(c).alias(c) for c in columns])


# --- views over the test tables ---------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues. Line items are summed up before they meet orders; customers are joined on their key."""
    o, c, l = (_table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    lines = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.array_sort(F.collect_set("l_returnflag")).alias("labels"))
    n = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "To Do").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Done")
    updated = F.greatest("o_orderdate", "last")
    df = o.join(c, o.o_custkey == c.c_custkey).join(lines, n == F.col("l_orderkey"), "left")
    return df.select(
        n.cast("string").alias("id"), F.concat(F.lit("ORD-"), n).alias("key"), F.concat(F.lit("P"), F.col("c_nationkey")).alias("project"),
        F.get(F.array(*[F.lit(x) for x in ("Bug", "Story", "Task", "Epic")]), n % 4).alias("type"), F.concat(F.lit("Order "), n, F.lit(" "), F.col("c_name")).alias("summary"),
        status.alias("status"), status.alias("status_category"), F.substring("o_orderpriority", 3, 20).alias("priority"), F.col("c_name").alias("assignee"), F.col("c_mktsegment").alias("team"),
        F.col("o_orderdate").alias("created"), updated.alias("updated"), F.when(F.col("o_orderstatus") == "F", updated).alias("resolved"), F.col("o_totalprice").alias("story_points"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.when(n > 0, F.concat(F.lit("ORD-"), F.expr("o_orderkey div 2"))).alias("parent_key"),
    )


def changelog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes of users."""
    e = _table(spark, sf_dir, "events")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.concat(F.col("event_id"), F.lit("_0")).alias("id"), F.concat(F.lit("U-"), F.col("user_id")).alias("issue_key"), F.concat(F.lit("a"), F.col("user_id") % 10).alias("author"),
        F.lit("status").alias("field"), before.alias("from_string"), F.col("event_type").alias("to_string"), F.col("ts").alias("changed_at"),
    )


def comments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as comments."""
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("issue_key"), F.col("role").alias("author"), F.concat(F.col("role"), F.lit("@x")).alias("author_email"), F.col("text").alias("body"), F.col("turn").alias("created"))


def raw_issues(issues: DataFrame, *more: str) -> DataFrame:
    """(id, key, raw): issues as a tracker writes them, and more of their columns as they are."""
    n = F.col("id").cast("long")
    named = lambda c: F.struct(F.col(c).alias("name"))
    person = F.struct(F.col("assignee").alias("displayName"), F.concat(F.lower("assignee"), F.lit("@x.org")).alias("emailAddress"))
    other = lambda k: F.struct(F.concat(F.lit("ORD-"), n + k).alias("key"))
    link = F.struct(
        (n * 10).cast("string").alias("id"), F.struct(F.lit("Blocks").alias("name"), F.lit("is blocked by").alias("inward"), F.lit("blocks").alias("outward")).alias("type"),
        F.when(n % 5 == 0, other(1)).alias("outwardIssue"), F.when(n % 7 == 0, other(2)).alias("inwardIssue"),
    )
    para = lambda *texts: F.struct(F.lit("paragraph").alias("type"), F.array(*[F.struct(F.lit("text").alias("type"), x.alias("text")) for x in texts]).alias("content"))
    doc = lambda *paras: F.parse_json(F.to_json(F.struct(F.lit("doc").alias("type"), F.array(*paras).alias("content"))))
    body = F.when(n % 2 == 0, doc(para(F.lit("first of "), n.cast("string")), para(F.col("summary")))).when(n % 3 == 0, F.concat(F.lit("plain "), n).cast("variant"))
    severity = F.when(n % 2 == 0, F.to_variant_object(F.struct(F.lit("").alias("name"), F.col("priority").alias("title")))).when(n % 3 == 0, doc(para(F.concat(F.lit("rich "), n))))
    fields = F.struct(
        "summary", body.alias("description"), named("type").alias("issuetype"), F.struct(F.col("project").alias("key")).alias("project"),
        F.struct(F.col("status").alias("name"), F.struct(F.col("status_category").alias("name")).alias("statusCategory")).alias("status"), named("priority").alias("priority"), person.alias("assignee"),
        F.struct(F.col("team").alias("displayName")).alias("reporter"), F.date_format("created", STAMP).alias("created"), F.date_format("updated", STAMP).alias("updated"), F.date_format("resolved", STAMP).alias("resolutiondate"),
        "labels", F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("components"), F.array(F.struct(F.concat(F.lit("v"), n % 3).alias("name"))).alias("fixVersions"),
        F.when(F.col("parent_key").isNotNull(), F.struct(F.col("parent_key").alias("key"))).alias("parent"), F.when((n % 5 == 0) | (n % 7 == 0), F.array(link)).alias("issuelinks"),
        F.struct(F.col("team").alias("value")).alias("customfield_1"), F.col("story_points").alias("customfield_2"), severity.alias("customfield_3"),
        F.col("labels").alias("customfield_4"),
    )
    return issues.select("id", "key", F.to_json(F.struct("id", "key", fields.alias("fields"))).alias("raw"), *more)


def raw_conversations(comments: DataFrame) -> DataFrame:
    """(key, raw): issues that hold comments."""
    day = lambda m, s: F.concat(F.lit(f"2024-{m}-01T00:00:"), s, F.lit(".000+0000"))
    text = F.struct(F.lit("text").alias("type"), F.col("body").alias("text"))
    tree = F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(text).alias("content"))).alias("content"))
    one = F.struct("created", F.struct(F.col("id"), F.struct(F.col("author").alias("displayName"), F.col("author_email").alias("emailAddress")).alias("author"), tree.alias("body"), day("01", F.lpad((F.col("created") % 60).cast("string"), 2, "0")).alias("created"), F.when(F.col("created") % 3 != 0, day("02", F.lit("00"))).alias("updated")).alias("c"))
    by = comments.groupBy(F.col("issue_key").alias("key")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("comments"))
    return by.select("key", F.to_json(F.struct("key", F.struct(F.struct("comments").alias("comment")).alias("fields"))).alias("raw"))


def raw_histories(changelog: DataFrame) -> DataFrame:
    """(ref, id, author, created, items) with one item a history, and ref the issue's number."""
    item = F.struct("field", F.lit("jira").alias("fieldtype"), F.lit(None).cast("string").alias("from"), F.col("from_string").alias("fromString"), F.lit(None).cast("string").alias("to"), F.col("to_string").alias("toString"))
    return changelog.select(F.substring_index("issue_key", "-", -1).alias("ref"), F.substring_index("id", "_", 1).alias("id"), "author", F.date_format("changed_at", STAMP).alias("created"), F.array(item).alias("items"))


CATALOG = (
    ("customfield_1", "Team", "option", True, True), ("customfield_2", "Story Points", "number", True, True), ("customfield_3", "Severity", "string", True, True),
    ("customfield_4", "Tags", "array", True, True), ("customfield_9", "Hidden", "string", True, False),
)


def catalog(spark: SparkSession) -> DataFrame:
    """A field catalog that fits raw_issues()."""
    rows = [(i, n, n.lower().replace(" ", "_"), t, c, u, False, t in ("string", "array")) for i, n, t, c, u in CATALOG]
    return spark.createDataFrame(rows, T.StructType.fromDDL("jira_id string, jira_name string, name string, type string, is_custom boolean, is_column boolean, user_override boolean, searchable boolean"))
