"""Raw tracker JSON to typed columns and child rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.richtext import plain_text

NAME = "struct<name: string>"
FIELDS = (
    f"summary string, description string, issuetype {NAME}, project struct<key: string>, status struct<name: string, statusCategory: {NAME}>, priority {NAME}, "
    f"assignee struct<displayName: string, emailAddress: string>, reporter struct<displayName: string>, created string, updated string, resolutiondate string, duedate string, resolution {NAME}, "
    f"labels array<string>, components array<{NAME}>, fixVersions array<{NAME}>, subtasks array<struct<key: string>>, parent struct<key: string>, "
    "timeoriginalestimate bigint, timespent bigint, timeestimate bigint"
)
ISSUE = "struct<id: string, key: string, fields: struct<" + FIELDS.replace(" string", ": string").replace(" struct<", ": struct<").replace(" array<", ": array<").replace(" bigint", ": bigint").replace("::", ":") + ">>"
# The tracker's field types and the logical ones.
LOGICAL = {"string": "text", "number": "number", "date": "date", "datetime": "datetime", "option": "option", "user": "user", "array": "array"}
FALLBACK = ("name", "value", "displayName", "title")


def normalize_timestamp(c: Column) -> Column:
    """UTC timestamp without zone, to the second; empty and unknown formats are null."""
    return F.date_trunc("second", F.try_to_timestamp(F.nullif(c, F.lit("")))).cast("timestamp_ntz")


def denormalize_issues(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The fixed columns of raw issues; rows that are no JSON object with a key are left out. A description that is a tree
    becomes its text. epic_key is no field of the tracker's own: it is null until a catalog's field fills it."""
    one = F.filter(F.array(F.from_json(column, ISSUE)), lambda i: i["key"].isNotNull())  # a filter of rows would parse them twice
    df = raw.select(F.col(column), F.explode(one).alias("_i"))
    f = lambda p: F.col(f"_i.fields.{p}")
    names = lambda p, k="name": F.transform(f(p), lambda x: x[k])
    return df.select(
        "_i.id", "_i.key", f("project.key").alias("project"), f("issuetype.name").alias("type"), f("summary").alias("summary"), plain_text(f("description")).alias("description"), f("status.name").alias("status"), f("status.statusCategory.name").alias("status_category"),
        f("priority.name").alias("priority"), f("assignee.displayName").alias("assignee"), f("assignee.emailAddress").alias("assignee_email"), f("reporter.displayName").alias("reporter"), f("resolution.name").alias("resolution"),
        normalize_timestamp(f("created")).alias("created"), normalize_timestamp(f("updated")).alias("updated"), normalize_timestamp(f("resolutiondate")).alias("resolved"), normalize_timestamp(f("duedate")).alias("due_date"),
        f("labels").alias("labels"), names("components").alias("components"), names("fixVersions").alias("fix_version"), names("subtasks", "key").alias("subtask_keys"), f("parent.key").alias("parent_key"), F.lit(None).cast("string").alias("epic_key"),
        f("timeoriginalestimate").alias("original_estimate"), f("timespent").alias("time_spent"), f("timeestimate").alias("remaining_estimate"), F.col(column).alias("raw_json"),
    )


def undecodable_reason(column: str = "raw") -> Column:
    """Why denormalize_issues leaves a row out, null where it does not."""
    found = F.from_json(column, ISSUE)
    shape = F.from_json(column, "struct<key: string>")
    reason = F.when(F.col(column).isNull(), "no text").when(F.try_parse_json(column).isNull(), "no JSON").when(~F.ltrim(column).startswith("{"), "no object").when(shape["key"].isNull(), "no key").otherwise("fields of other types")
    return F.when(found["key"].isNull(), reason)  # so it is if nothing was found, and a second test would parse the row again


def undecodable_issues(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The rows of raw that denormalize_issues leaves out, with reason: with its rows they are all."""
    return raw.withColumn("reason", undecodable_reason(column)).filter("reason IS NOT NULL")


def extract_custom_fields(raw: DataFrame, catalog: DataFrame, column: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """key, or the columns to keep but those of the catalog's names, and one typed column for each catalog row that is custom and a column. The catalog is small metadata; it only
    shapes the select list. A row is parsed once. Trees in text fields become their text, other objects the first non-empty
    of name, value, displayName, title. Of objects in arrays value or name counts, others count as nothing."""
    wanted = catalog.filter("is_custom and is_column").select("jira_id", "name", "type").orderBy("name").collect()
    keep = [c for c in keep or ["key"] if c not in {r["name"] for r in wanted}]
    if not wanted:
        return raw.select(keep)
    fields = ", ".join(f"`{r['jira_id']}`: string" for r in wanted)
    known = ", ".join(f"{k}: string" for k in FALLBACK)

    def one(v: Column, kind: str) -> Column:
        if kind == "number":
            return v.try_cast("double")
        if kind == "array":
            item = lambda x: F.when(x.startswith("{"), F.coalesce(F.from_json(x, f"struct<{known}>")["value"], F.from_json(x, f"struct<{known}>")["name"])).otherwise(x)
            return F.filter(F.transform(F.from_json(v, "array<string>"), item), lambda x: x.isNotNull())
        own = F.from_json(v, f"struct<{known}>")
        first = {"option": "value", "user": "displayName"}.get(kind)
        keys = ([first] if first else []) + [k for k in FALLBACK if k != first]
        inner = F.coalesce(*[F.nullif(own[k], F.lit("")) for k in keys])
        tree = v.rlike(r'"type"\s*:\s*"doc"') if kind in ("text", "string") else F.lit(False)
        return F.when(v.startswith("{"), F.when(tree, F.nullif(plain_text(v), F.lit(""))).otherwise(inner)).otherwise(v)

    parsed = raw.select(*keep, F.from_json(column, f"struct<fields: struct<{fields}>>")["fields"].alias("_f"))
    return parsed.select(*keep, *[one(F.col("_f")[r["jira_id"]], r["type"]).alias(r["name"]) for r in wanted])


def evolve_schema(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of both with the columns of both; what a side lacks is null."""
    return table.unionByName(batch, allowMissingColumns=True)


def extract_comments(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(id, issue_key, author, author_email, body, created, updated) of the comments within issues; bodies are plain text."""
    schema = "struct<key: string, fields: struct<comment: struct<comments: array<struct<id: string, author: struct<displayName: string, emailAddress: string>, body: string, created: string, updated: string>>>>>"
    df = raw.select(F.from_json(column, schema).alias("i")).select("i.key", F.explode("i.fields.comment.comments").alias("c"))
    return df.select("c.id", F.col("key").alias("issue_key"), F.col("c.author.displayName").alias("author"), F.col("c.author.emailAddress").alias("author_email"), plain_text(F.col("c.body")).alias("body"), normalize_timestamp(F.col("c.created")).alias("created"), normalize_timestamp(F.col("c.updated")).alias("updated"))


def rollup_comments_text(comments: DataFrame, order: tuple[str, ...] = ("created", "id")) -> DataFrame:
    """(issue_key, comments_text): bodies in order, joined by a space."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "body")))
    return comments.filter(F.col("body").isNotNull()).groupBy("issue_key").agg(F.array_join(F.transform(rows, lambda x: x["body"]), " ").alias("comments_text"))


def extract_links(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(id, issue_key, link_type, direction, linked_key): a row for each stored direction of a link."""
    schema = "struct<key: string, fields: struct<issuelinks: array<struct<id: string, type: struct<name: string, inward: string, outward: string>, inwardIssue: struct<key: string>, outwardIssue: struct<key: string>>>>>"
    df = raw.select(F.from_json(column, schema).alias("i")).select("i.key", F.explode("i.fields.issuelinks").alias("l"))
    way = lambda d: F.struct(F.concat(F.col("l.id"), F.lit("_" + d[:-4])).alias("id"), F.col(f"l.type.{d}").alias("link_type"), F.lit(d).alias("direction"), F.col(f"l.{d}Issue.key").alias("linked_key"))
    both = F.filter(F.array(way("inward"), way("outward")), lambda x: x["linked_key"].isNotNull())
    return df.select("key", F.explode(both).alias("x")).select("x.id", F.col("key").alias("issue_key"), "x.link_type", "x.direction", "x.linked_key")


def explode_changelog(histories: DataFrame) -> DataFrame:
    """(id, ref, author, field, field_type, from_string, to_string, changed_at); id is history and item position."""
    df = histories.select("ref", "id", "author", "created", F.posexplode("items").alias("pos", "item"))
    return df.select(
        F.concat_ws("_", "id", "pos").alias("id"), "ref", F.coalesce("author", F.lit("")).alias("author"), "item.field", F.col("item.fieldtype").alias("field_type"),
        F.col("item.fromString").alias("from_string"), F.col("item.toString").alias("to_string"), normalize_timestamp(F.col("created")).alias("changed_at"),
    )


def resolve_changelog_keys(bulk: DataFrame, issues: DataFrame) -> DataFrame:
    """bulk (ref, ..) with issue_key instead of the numeric ref; unknown ids are dropped."""
    ids = issues.filter("id is not null and id != ''").select(F.col("id").alias("ref"), F.col("key").alias("issue_key"))
    return bulk.join(ids, "ref").drop("ref")


def slug(name: Column, jira_id: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", F.lower(jira_id)).otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def infer_field_names(meta: DataFrame, existing: DataFrame | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """(id, name) for meta (id, name, ordinal): the stored name, else an override, else a slug; of equal names the stored
    one and then the first keeps it, others get the id's number appended."""
    df = meta.select("id", F.col("name").alias("label"), "ordinal")
    df = df.join(existing.select("id", F.col("name").alias("stored")), "id", "left") if existing is not None else df.withColumn("stored", F.lit(None).cast("string"))
    given = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else None
    other = F.try_element_at(given, F.col("id")) if given is not None else F.lit(None).cast("string")
    df = df.withColumn("n", F.coalesce("stored", other, slug(F.col("label"), F.col("id"))))
    rank = F.row_number().over(W.partitionBy("n").orderBy(F.col("stored").isNull(), "ordinal", "id"))
    return df.select("id", F.when(rank > 1, F.concat("n", F.lit("_"), F.regexp_replace("id", "^customfield_", ""))).otherwise(F.col("n")).alias("name"))


def classify_field_types(meta: DataFrame) -> DataFrame:
    """(id, type, searchable): the logical type, text if unknown; text and array are searchable."""
    kind = F.lit("text")
    for tracker, logical in LOGICAL.items():
        kind = F.when(F.col("type") == tracker, logical).otherwise(kind)
    return meta.select("id", kind.alias("type"), kind.isin("text", "array").alias("searchable"))


def merge_field_catalog(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by jira_id; an overridden name stays, and so do searchable, is_column and user_override."""
    e, i = existing.alias("e"), incoming.alias("i")
    both = lambda c: F.coalesce(F.col(f"i.{c}"), F.col(f"e.{c}"))
    stored = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(f"i.{c}"))
    name = F.when(F.coalesce(F.col("e.user_override"), F.lit(False)), F.col("e.name")).otherwise(both("name"))
    return e.join(i, F.col("e.jira_id") == F.col("i.jira_id"), "full_outer").select(
        both("jira_id").alias("jira_id"), both("jira_name").alias("jira_name"), name.alias("name"), both("type").alias("type"), both("is_custom").alias("is_custom"),
        stored("is_column").alias("is_column"), stored("user_override").alias("user_override"), stored("searchable").alias("searchable"),
    )


def csv_to_array(df: DataFrame, column: str) -> DataFrame:
    """Text `a, b` or a JSON array to an array of strings; empty to an empty array."""
    c = F.col(column)
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(column, F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(parts))


def extract_project_keys(df: DataFrame, column: str) -> DataFrame:
    """df with project_keys: those of a `project = X` or `project in (X, Y)` clause of a filter text."""
    bare = F.regexp_replace(column, r"(?i)\s+order\s+by\s.*$", "")
    several = F.regexp_extract(bare, r"(?i)\bproject\s+in\s*\(([^)]*)\)", 1)
    single = F.regexp_extract(bare, r"(?i)\bproject\s*=\s*(\"[^\"]*\"|'[^']*'|\w+)", 1)
    found = F.when(several != "", several).otherwise(single)
    return df.withColumn("project_keys", F.array_distinct(F.filter(F.transform(F.split(found, ","), lambda x: F.btrim(x, F.lit(" \"'"))), lambda x: x != "")))


def project_dimension(issues: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name) of the projects of issues; a project without a name has its key."""
    keys = issues.filter("project is not null and project != ''").select(F.col("project").alias("key")).distinct()
    return keys.join(names.select("key", F.col("name").alias("_n")), "key", "left").select("key", F.coalesce(F.nullif("_n", F.lit("")), "key").alias("name"))
