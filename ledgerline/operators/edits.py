"""Edits as data: array edits, bulk changes, a queue of pending changes and its fold onto the rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import richtext
from .flatten import denormalize_issues, extract_custom_fields, normalize_timestamp, rollup_comments_text
from .merge import upsert_by_key

MAX_RETRIES = 5
# The tracker's ids of columns with another name, columns that no edit sets, and what names an object.
TRACKER = {"issuetype": "type", "fixVersions": "fix_version", "parent": "parent_key", "duedate": "due_date", "resolutiondate": "resolved", "timeoriginalestimate": "original_estimate", "timespent": "time_spent", "timeestimate": "remaining_estimate"}
FIXED, NAMES = ("id", "key", "comments_text", "raw_json", "synced_at"), ("name", "accountId", "value", "displayName", "key")
NAMED, ACCOUNT = ("priority", "components", "fixVersions"), ("assignee", "reporter")
COPIED = (("project", "project.key", "key"), ("issuetype", "issuetype.name", "name"), ("priority", "priority.name", "name"), ("parent", "parent.key", "key"), ("assignee", "assignee.accountId", "accountId"))
SAME = {"type": "issuetype", "fix-version": "fixVersions", "fixversion": "fixVersions", "fixversions": "fixVersions", **{n: n for n in ("summary", "description", "project", "issuetype", "priority", "parent", "assignee", "labels", "components")}}


def _edited(current: Column, adds: Column, removes: Column) -> Column:
    kept = F.filter(F.coalesce(current, F.array().cast("array<string>")), lambda x: ~F.array_contains(removes, x))
    return F.concat(kept, F.filter(F.array_distinct(adds), lambda x: ~F.array_contains(kept, x)))


def array_add_remove(df: DataFrame, column: str, adds: list[str], removes: list[str]) -> DataFrame:
    """Removes all copies of values, then appends those that are not there yet; order and old duplicates stay."""
    of = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.withColumn(column, _edited(F.col(column), of(adds), of(removes)))


def bulk_set(issues: DataFrame, keys: DataFrame, column: str, value: str, now: Column) -> DataFrame:
    """issues with column set where keys has the key; keys needs a column named key in any case and at least one row."""
    name = next((c for c in keys.columns if c.lower() == "key"), None)
    if name is None:
        raise ValueError("the query has no key column")
    wanted = keys.select(F.col(name).alias("key")).filter("key is not null").distinct()
    if wanted.isEmpty():
        raise ValueError("the query gives no rows")
    df = issues.join(wanted.withColumn("_hit", F.lit(True)), "key", "left")
    old = lambda c: F.col(c) if c in issues.columns else F.lit(None)
    return df.withColumns({column: F.when(F.col("_hit"), F.lit(value)).otherwise(old(column)), "synced_at": F.when(F.col("_hit"), now).otherwise(old("synced_at"))}).drop("_hit")


def enqueue_changes(keys: DataFrame, field: str, op: str, value: str, now: Column) -> DataFrame:
    """(issue_key, operation, payload, created_at) of a set, add or remove of a field on each key."""
    v = F.struct(F.lit(value).alias("name")) if field in NAMED else F.struct(F.lit(value).alias("accountId")) if field in ACCOUNT else F.lit(value)
    shape = [F.lit(field).alias("field")] + ([F.lit(op).alias("op")] if op != "set" else []) + [v.alias("value")]
    return keys.select(F.col("key").alias("issue_key"), F.lit("set_field" if op == "set" else "update_field").alias("operation"), F.to_json(F.struct(*shape)).alias("payload"), now.alias("created_at"))


def pending_queue(changes: DataFrame) -> DataFrame:
    return changes.filter("synced_at is null").orderBy("created_at", "id")


def _text(v: Column) -> Column:
    """A value of the tracker as text: what names an object, else the value itself."""
    at = lambda p: F.try_variant_get(v, p, "string")
    return F.coalesce(*[at(f"$.{k}") for k in NAMES], at("$"))


def _typed(text: Column, kind: str) -> Column:
    return text if kind == "string" else normalize_timestamp(text).cast(kind) if kind.startswith("timestamp") else text.try_cast(kind)


def apply_pending(issues: DataFrame, changes: DataFrame, catalog: DataFrame | None = None, transitions: dict[str, str] | DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues after the queue's changes in order, (id, ok, error) of each change, and the queue's comments, for
    append_comments. Any column but FIXED can be set, by its name or the tracker's id (catalog has those of custom
    fields); what cannot be applied is an error. transitions: the status that each id of a transition leads to, as
    a short map or a table (id, status), the least status of an id given twice; the queue names ids only, and an id that is not
    known is an error. Changes of one issue and field are folded in order; a queue entry holds
    one value, so a fold holds what one field was ever given."""
    kinds = {c: k for c, k in issues.dtypes if c not in FIXED and (k == "array<string>" or not k.startswith(("array", "struct", "map", "variant")))}
    arrays = [c for c, k in kinds.items() if k == "array<string>"]
    ids = TRACKER | ({r["jira_id"]: r["name"] for r in catalog.select("jira_id", "name").collect()} if catalog is not None else {})
    names = {i: c for i, c in ids.items() if c in kinds} | {c: c for c in kinds}
    op, at = F.col("operation"), lambda p: F.try_variant_get("p", p, "string")
    pending = changes.filter("synced_at is null").withColumn("p", F.try_parse_json("payload"))
    if isinstance(transitions, DataFrame):
        to = transitions.groupBy(F.col("id").alias("_transition")).agg(F.min("status").alias("_leads"))
        pending = pending.join(to, (op == "transition") & (at("$.transition_id") == F.col("_transition")), "left")
        led = F.col("_leads")
    else:
        led = F.try_element_at(F.create_map(*[F.lit(x) for pair in transitions.items() for x in pair]), at("$.transition_id")) if transitions else F.lit(None).cast("string")
    value = F.when(op == "transition", F.coalesce(led.cast("variant"), F.try_variant_get("p", "$.status", "variant"))).otherwise(F.try_variant_get("p", "$.value", "variant"))
    todo = pending.withColumns({"value": value, "field": F.when(op == "transition", "status").otherwise(at("$.field")), "action": F.when(op == "update_field", F.coalesce(at("$.op"), at("$.action"))).otherwise("set"), "body": at("$.body")})
    column = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("field"))
    values = F.coalesce(F.transform(F.try_variant_get("value", "$", "array<variant>"), _text), F.array(_text(F.col("value"))))
    todo = todo.withColumns({"column": column, "values": values}).join(issues.select(F.col("key").alias("_key")).distinct(), F.col("issue_key") == F.col("_key"), "left")
    edit, one, first = op != "add_comment", ~F.col("column").isin(arrays), F.get("values", F.lit(0))
    unreadable = F.lit(False)
    for c, k in kinds.items():
        if c not in arrays:
            unreadable |= (F.col("column") == c) & first.isNotNull() & _typed(first, k).isNull()
    wrong = [
        (F.col("retry_count") >= MAX_RETRIES, F.concat(F.lit("too many retries: "), F.coalesce("last_error", F.lit("")))),
        (~op.isin("set_field", "update_field", "add_comment", "transition"), F.concat(F.lit("unknown operation: "), op)),
        (F.col("p").isNull(), F.lit("payload is no JSON")),
        (F.col("_key").isNull(), F.concat(F.lit("unknown issue: "), F.coalesce("issue_key", F.lit("")))),
        (~edit & F.col("body").isNull(), F.lit("comment without a body")),
        ((op == "transition") & first.isNull(), F.lit("transition without a status")),
        (edit & F.col("column").isNull(), F.concat(F.lit("field cannot be set: "), F.coalesce("field", F.lit("")))),
        (edit & ~F.coalesce("action", F.lit("")).isin("set", "add", "remove"), F.concat(F.lit("unknown op: "), F.coalesce("action", F.lit("")))),
        (edit & one & ((F.col("action") != "set") | (F.size("values") > 1)), F.concat(F.lit("field holds one value: "), F.col("field"))),
        (edit & unreadable, F.concat(F.lit("value cannot be read: "), first)),
    ]
    todo = todo.withColumn("error", F.coalesce(*[F.when(test, text) for test, text in wrong]))
    results = todo.select("id", F.col("error").isNull().alias("ok"), "error")
    comments = todo.filter("error is null and operation = 'add_comment'").select(F.concat(F.lit("local_"), F.col("id")).alias("id"), "issue_key", F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("author_email"), "body", F.col("created_at").alias("created"))
    good = todo.filter("error is null and operation != 'add_comment'").select("issue_key", "column", F.struct("created_at", "id", "action", "values").alias("x"))
    folded = good.groupBy("issue_key", "column").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    none = F.array().cast("array<string>")
    step = lambda acc, v: F.when(v["action"] == "set", F.array_compact(v["values"])).when(v["action"] == "add", _edited(acc, F.array_compact(v["values"]), none)).otherwise(_edited(acc, none, F.array_compact(v["values"])))
    wide = folded.groupBy(F.col("issue_key").alias("_issue")).agg(*[F.max(F.when(F.col("column") == c, F.col("xs"))).alias(f"_to_{c}") for c in kinds])
    df = issues.join(wide, issues.key == wide._issue, "left")
    for c, k in kinds.items():
        xs = F.col(f"_to_{c}")
        after = F.aggregate(xs, F.coalesce(F.col(c), none), step) if c in arrays else _typed(F.get(F.element_at(xs, -1)["values"], F.lit(0)), k)
        df = df.withColumn(c, F.when(xs.isNull(), F.col(c)).otherwise(after))
    return df.select(issues.columns), results, comments


def record_outcomes(changes: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Success stamps a change, failure counts and keeps the error. Changes past the retry limit are reported by
    apply_pending() and stay as they are."""
    df = changes.join(results.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_error")), "id", "left")
    bad = (F.col("_ok") == F.lit(False)) & (F.col("retry_count") < MAX_RETRIES)
    return df.withColumns({"synced_at": F.when(F.col("_ok"), now).otherwise(F.col("synced_at")), "retry_count": F.when(bad, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "last_error": F.when(bad, F.col("_error")).otherwise(F.col("last_error"))}).drop("_ok", "_error")


def clone_payloads(raw: DataFrame, catalog: DataFrame, overrides: dict[str, str] | None = None, replacements: list[tuple[str, str]] | None = None, column: str = "raw") -> DataFrame:
    """(key, payload): what would create a copy of each issue, with every custom field but Rank as it is. Overrides by
    field name; find and replace, in order, on the summary and on the text of the description. The catalog is small
    metadata that shapes the payload."""
    given, replacements = {SAME.get(n.lower(), n): v for n, v in (overrides or {}).items()}, replacements or []
    get = lambda path, kind="string": F.try_variant_get("_v", f"$.fields.{path}", kind)
    parts: dict[str, Column] = {}

    summary = get("summary")
    for find, put in replacements:
        summary = F.replace(summary, F.lit(find), F.lit(put))
    parts["summary"] = (F.lit(given.pop("summary")) if "summary" in given else summary).cast("variant")
    parts["description"] = F.lit(given.pop("description")).cast("variant") if "description" in given else F.try_parse_json(richtext.replaced_in_text(F.get_json_object(column, "$.fields.description"), replacements)) if replacements else get("description", "variant")
    for name, path, inner in COPIED:
        v = F.lit(given.pop(name)) if name in given else get(path)
        parts[name] = F.when(v.isNotNull(), F.to_variant_object(F.struct(v.alias(inner))))
    for name in ("labels", "components", "fixVersions"):
        listed = name != "fixVersions"
        texts = F.array(*[F.lit(x.strip()) for x in (given[name].split(",") if listed else [given[name]]) if x.strip()]).cast("array<string>") if name in given else get(name, "array<string>") if name == "labels" else F.transform(get(name, "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
        given.pop(name, None)
        parts[name] = F.to_variant_object(texts if name == "labels" else F.transform(texts, lambda x: F.struct(x.alias("name"))))

    rows = catalog.select("jira_id", "jira_name", "name").orderBy("jira_id").collect()
    ids = {r["jira_name"]: r["jira_id"] for r in rows} | {r["name"]: r["jira_id"] for r in rows} | {r["jira_id"]: r["jira_id"] for r in rows}
    for name, value in given.items():
        if name not in ids:
            raise ValueError(f"unknown field: {name}")
        try:
            json.loads(value)
        except ValueError:
            value = json.dumps(value)
        parts[ids[name]] = F.parse_json(F.lit(value))
    left_out = [r["jira_id"] for r in rows if r["jira_name"] == "Rank"] + list(parts)
    custom = F.map_filter(F.try_variant_get("_v", "$.fields", "map<string,variant>"), lambda k, v: k.startswith("customfield_") & ~k.isin(left_out) & v.isNotNull() & ~F.is_variant_null(v))
    own = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts.items()]), lambda x: x["value"].isNotNull() & ~F.is_variant_null(x["value"]))
    fields = F.map_concat(F.map_from_entries(own), F.coalesce(custom, F.map_from_entries(F.filter(own, lambda x: F.lit(False)))))
    return raw.withColumn("_v", F.try_parse_json(column)).select("key", F.to_json(F.struct(fields.alias("fields"))).alias("payload"))


def resolve_by_name(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, id, outcome): ok, ambiguous or unknown. names: (name), catalog: (id, name)."""
    c = catalog.select("id", F.lower("name").alias("_n"))
    found = names.select("name").distinct().join(c, F.lower("name") == F.col("_n"), "left").groupBy("name").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    return found.select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("outcome"))


def append_comments(comments: DataFrame, issues: DataFrame, new_rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Comments with new_rows, and issues with the touched ones' comments_text and synced_at brought up to date."""
    rows = new_rows.withColumn("id", F.coalesce("id", F.concat(F.lit("local_"), F.sha2(F.concat_ws("|", "issue_key", "author", "body").cast("binary"), 256).substr(1, 12))))
    all_ = comments.unionByName(rows, allowMissingColumns=True)
    touched = rows.select("issue_key").distinct()
    text = rollup_comments_text(all_.join(touched, "issue_key", "left_semi")).withColumnRenamed("comments_text", "_text")
    df = issues.join(text, issues.key == text.issue_key, "left").drop("issue_key")
    hit = F.col("_text").isNotNull()
    old = lambda c: F.col(c) if c in issues.columns else F.lit(None)
    return all_, df.withColumns({"comments_text": F.when(hit, F.col("_text")).otherwise(old("comments_text")), "synced_at": F.when(hit, now).otherwise(old("synced_at"))}).drop("_text")


def refresh_issues(issues: DataFrame, raw: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """issues with the rows that raw has anew, flattened, with the catalog's custom fields. What raw issues do not hold, as
    comments_text, or custom fields without a catalog, stays as it was; a new issue has null there."""
    fresh = denormalize_issues(raw)
    if catalog is not None:
        custom = extract_custom_fields(fresh, catalog, "raw_json")
        fresh = fresh.drop(*[c for c in custom.columns if c != "key"]).join(custom, "key", "left")
    fresh = fresh.select([c for c in fresh.columns if c in issues.columns])
    kept = [c for c in issues.columns if c not in fresh.columns]
    return upsert_by_key(issues, fresh.join(issues.select("key", *kept), "key", "left"), "key", [F.col("updated").desc()])
