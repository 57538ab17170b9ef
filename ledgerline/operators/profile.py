"""Profiling of columns, classification of rows, parents and groups."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
HIDDEN = ("raw_json", "comments_text", "synced_at")


def _safe(column: str) -> str:
    if not SAFE.fullmatch(column):
        raise ValueError(f"no column name: {column}")
    return column


def distinct_values(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    c = F.col(_safe(column)).cast("string")
    return df.select(c.alias("value")).filter("value is not null and value != ''").distinct().orderBy("value").limit(limit)


def distinct_values_like(df: DataFrame, column: str, text: str, limit: int = 50) -> DataFrame:
    return distinct_values(df.filter(F.col(_safe(column)).ilike(f"%{text}%")), column, limit)


def field_population(df: DataFrame, columns: list[str], project: str | None = None) -> DataFrame:
    """(field, filled, total, percent, sample) of all columns in one pass; the sample is the least value, cut."""
    df = df.filter(F.col("project") == project) if project else df
    text = lambda c: F.nullif(F.col(_safe(c)).cast("string"), F.lit(""))
    one = df.agg(F.count("*").alias("_total"), *[F.count(text(c)).alias(f"n_{c}") for c in columns], *[F.min(text(c)).alias(f"s_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("filled"), F.col(f"s_{c}").alias("s")) for c in columns])
    out = one.select("_total", F.explode(rows).alias("x"))
    sample = F.when(F.length("x.s") > 60, F.concat(F.substring("x.s", 1, 60), F.lit("..."))).otherwise(F.col("x.s"))
    return out.select("x.field", "x.filled", F.col("_total").alias("total"), F.round(F.try_divide(F.col("x.filled") * F.lit(100.0), F.col("_total")), 1).alias("percent"), sample.alias("sample"))


def suggest_closest(inputs: DataFrame, candidates: list[str], most: int = 3) -> DataFrame:
    """(input, suggestion): the first of the nearest candidates within a distance, else empty. candidates: names of
    columns or fields, a short list that travels with the expression."""
    if not candidates:
        return inputs.select("input", F.lit("").alias("suggestion"))
    each = F.array(*[F.struct(F.levenshtein(F.col("input"), F.lit(c), most).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(candidates)])
    best = F.array_min(F.filter(each, lambda x: x["d"] >= 0))
    return inputs.select("input", F.coalesce(best["c"], F.lit("")).alias("suggestion"))


def _left_out(text: Column, most: int) -> Column:
    """All strings that text becomes with up to so many characters left out, the empty one excepted."""
    out = step = F.array(text)
    for _ in range(most):
        # a position for each character; sequence(1, 0) would count down
        one = lambda s: F.transform(F.when(F.length(s) > 1, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        step = F.array_distinct(F.flatten(F.transform(step, one)))
        out = F.concat(out, step)
    return F.filter(out, lambda s: s != "")


def _left_out_hashes(text: Column, most: int) -> Column:
    return F.array_distinct(F.transform(_left_out(text, most), lambda s: F.xxhash64(s)))


#: Names are cut in two where there are so many to one first half on average, and so many first halves at most: each input meets those near to its own.
SHARED, HEADS = 8, 100


class _Halves:
    """Names of more than SHORT characters, cut in the middle, for a search by halves. An input near to a name has a cut too, so that the edits
    of both halves are those of the whole. First halves that many names share are compared once; the second halves then have what edits are left, and
    become few strings. Where the ends of names are shared rather than their beginnings, all is read backwards."""

    def __init__(self, names: DataFrame, most: int, stored) -> None:
        self.short, self.stored = 4 * most, stored
        long = names.filter(F.length("name") > self.short)
        half = F.floor(F.length("name") / 2).cast("int")
        first = lambda c: F.substring(c, F.lit(1), half)
        n, ahead, back = long.agg(F.count("*"), F.approx_count_distinct(first(F.col("name"))), F.approx_count_distinct(first(F.reverse("name")))).first()
        self.used = 0 < min(ahead, back) <= min(HEADS, n / SHARED)
        self.way = F.reverse if back < ahead else lambda c: c
        if self.used:
            whole = self.way(F.col("name"))
            self.names = long.select(F.xxhash64("name").alias("_n"), first(whole).alias("_first"), F.substring(whole, half + 1, F.length("name")).alias("_second"))
            self.heads = stored(self.names.select("_first").distinct(), "heads")

    def strings(self, left: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """(_i, _s) of inputs and (_n, _s) of names: hashes that those have in common who are within d edits."""
        size, least = F.length("input"), self.short + 1
        low = F.floor(F.greatest(F.lit(least), size - d) / 2) - d
        high = F.least(size, F.floor((size + d) / 2) + d)
        cuts = left.filter(size >= least - d).select(F.xxhash64("input").alias("_i"), self.way(F.col("input")).alias("_x"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("_m"))
        cuts = cuts.select("_i", F.substring("_x", F.lit(1), F.col("_m")).alias("_head"), F.substring("_x", F.col("_m") + 1, F.length("_x")).alias("_rest"))
        own = cuts.select("_head").distinct().select("_head", F.explode(_left_out_hashes(F.col("_head"), d)).alias("_h"))
        theirs = self.heads.select("_first", F.explode(_left_out_hashes(F.col("_first"), d)).alias("_h"))
        pairs = own.join(theirs.hint("merge"), "_h").select("_head", "_first").distinct()
        near = self.stored(pairs.withColumn("_a", F.levenshtein("_head", "_first", d)).filter("_a >= 0").select("_head", "_first", (d - F.col("_a")).alias("_b")), f"heads-{d}")
        some = lambda c: F.coalesce(*[F.when(F.col("_b") == k, _left_out(F.col(c), k)) for k in range(d + 1)])
        hashes = lambda c: F.explode(F.array_distinct(F.transform(some(c), lambda s: F.xxhash64(F.col("_first"), s)))).alias("_s")
        most = near.groupBy("_first").agg(F.max("_b").alias("_b"))
        return cuts.join(near, "_head").select("_i", hashes("_rest")), self.names.join(most, "_first").select("_n", hashes("_second"))


def suggest_from(inputs: DataFrame, candidates: DataFrame, folder: str, most: int = 3) -> DataFrame:
    """(input, suggestion): as suggest_closest(), for candidates (name, place) in any number; of equally near ones the one of
    the least place, then name, counts.

    Strings within d edits of each other share a string that both become with at most d characters left out. Distances
    are tried in turn, 0 first, and only inputs without a suggestion go on, so that a pair far apart is looked at only
    where there is none nearer; a step is an equi-join of hashes and what it found is stored below folder; distances are computed of the names. Strings without a common
    character differ by the longer one's length: for these the first candidate of each length up to most suffices. The
    strings left out of a name of n characters are about n ** d / d! at distance d; names of more than 4 * most characters that share halves
    are searched by halves (_Halves), which leaves a name about (n / 2) ** e / e!, e being the edits that the nearest first half leaves.

    Inputs are distinct in the result; null and what has no near candidate get the empty suggestion, null inputs as null;
    null names are no candidates; the empty input is near to names of up to most characters; no candidates, no suggestions."""
    spark = inputs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    asked = stored(inputs.select(F.col("input").cast("string")).distinct(), "asked")
    names = stored(candidates.filter("name IS NOT NULL").groupBy("name").agg(F.min("place").alias("place")), "names")
    left, found = asked.filter("input IS NOT NULL"), []
    short = names.filter(F.length("name") <= most).groupBy(F.length("name").alias("_l")).agg(F.min(F.struct("place", "name")).alias("_c"))
    halves = _Halves(names, most, stored)
    for d in range(most + 1):
        if d == 0:
            pairs = left.join(names.withColumnRenamed("name", "input"), "input").select("input", "place", F.col("input").alias("name"))
        else:
            few = left.filter(F.length("input") <= d).select("input", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_l")).join(short, "_l").select("input", "_c.place", "_c.name")
            own, theirs = (left, names) if not halves.used else (left.filter(F.length("input") <= halves.short + d), names.filter(F.length("name") <= halves.short))
            # only hashes meet, in a shuffle: the planner's sizes know nothing of the many strings a name becomes, so it would broadcast them
            own = own.select(F.xxhash64("input").alias("_i"), F.explode(_left_out_hashes(F.col("input"), d)).alias("_s"))
            theirs = theirs.select(F.xxhash64("name").alias("_n"), F.explode(_left_out_hashes(F.col("name"), d)).alias("_s"))
            if halves.used:
                own, theirs = (a.unionByName(b) for a, b in zip((own, theirs), halves.strings(left, d), strict=True))
            met = stored(own.join(theirs.hint("merge"), "_s").select("_i", "_n").distinct(), f"met-{d}")
            pairs = met.join(left.select(F.xxhash64("input").alias("_i"), "input").hint("merge"), "_i").join(names.withColumn("_n", F.xxhash64("name")).hint("merge"), "_n").select("input", "place", "name").unionByName(few)
        near = pairs.filter(F.levenshtein("input", "name", d) >= 0)
        found.append(stored(near.groupBy("input").agg(F.min(F.struct("place", "name")).alias("_c")).select("input", F.col("_c.name").alias("suggestion")), f"found-{d}"))
        left = left.join(found[-1], "input", "left_anti")
    told = found[0]
    for f in found[1:]:
        told = told.unionByName(f)
    return asked.join(told, "input", "left").select("input", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def describe_table(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """(ordinal, column, type, display_name, is_custom) of a table's columns."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema) if f.name not in HIDDEN]
    columns = df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string")
    c = catalog.select(F.col("name").alias("column"), F.col("jira_name").alias("display_name"), "is_custom")
    return columns.join(c, "column", "left").select("ordinal", "column", "type", "display_name", F.coalesce("is_custom", F.lit(False)).alias("is_custom"))


def search_catalog(catalog: DataFrame, text: str) -> DataFrame:
    t = text.lower()
    return catalog.filter(F.lower("name").contains(t) | F.lower("jira_name").contains(t)).orderBy("name")


def status_summary(df: DataFrame) -> DataFrame:
    """(status, n, place): non-empty statuses in the order To Do, In Progress, Done, the rest by name."""
    status = F.coalesce(F.nullif("status_category", F.lit("")), "status")
    by = df.groupBy(status.alias("status")).agg(F.count("*").alias("n")).filter("status is not null and status != ''")
    place = F.when(F.col("status") == "To Do", 0).when(F.col("status") == "In Progress", 1).when(F.col("status") == "Done", 2).otherwise(3)
    return by.withColumn("place", place).orderBy("place", "status")


def span_seconds(text: str) -> float | None:
    """Seconds of `28d` or of a duration like 1h30m; None if it is neither."""
    if m := re.fullmatch(r"(\d+)d", text):
        return int(m[1]) * 86_400.0
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    return sum(float(n) * units[u] for n, u in parts) if parts and "".join(n + u for n, u in parts) == text else None


def default_status_class() -> Column:
    s = F.lower("status")
    return F.when(s.isin("done", "closed", "resolved"), "done").when(s.contains("progress"), "in_progress").when(s.contains("block"), "blocked").otherwise("")


def classify_rows(df: DataFrame, rules: list[dict[str, Any]], now: Column) -> DataFrame:
    """df with class: the first rule that fits, else the default of the status. A rule: field, one of equals,
    not_equals, contains, in, older_than, and class. A missing field or a time that cannot be read does not fit."""
    out = None
    for r in rules:
        if r["field"] not in df.columns:
            continue
        c = F.col(r["field"])
        t = F.lower(c.cast("string"))
        if "equals" in r:
            fits = t == r["equals"].lower()
        elif "not_equals" in r:
            fits = t != r["not_equals"].lower()
        elif "contains" in r:
            fits = t.contains(r["contains"].lower())
        elif "in" in r:
            fits = t.isin([x.lower() for x in r["in"]])
        else:
            seconds = span_seconds(r["older_than"])
            if seconds is None:
                continue
            fits = F.expr(f"try_cast({r['field']} as timestamp_ntz)") < now - F.make_interval(secs=F.lit(seconds))
        out = F.when(fits, r["class"]) if out is None else out.when(fits, r["class"])
    return df.withColumn("class", out.otherwise(default_status_class()) if out is not None else default_status_class())


def sort_as_text(df: DataFrame, column: str, desc: bool = False, tie: str = "key") -> DataFrame:
    c = F.col(column).cast("string")
    return df.orderBy(c.desc() if desc else c.asc(), tie)


def group_with_headers(df: DataFrame, group: str, columns: list[str], order: str = "key") -> DataFrame:
    """columns, label, is_header, group_size: the row of a group with the least order, which tells rows apart, is marked.
    Groups are summed up before they meet their rows, so that the rows without a parent need not fit into one task."""
    label = F.when(F.coalesce(F.col(group), F.lit("")) == "", "(no parent)").otherwise(F.col(group))
    rows = df.withColumn("label", label)
    groups = rows.groupBy("label").agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
    return rows.join(groups, "label").select(*columns, "label", F.col(order).eqNullSafe(F.col("_first")).alias("is_header"), "group_size")


def parent_chain(issues: DataFrame, max_depth: int = 5) -> DataFrame:
    """(key, chain, summaries): ancestors, the root first, at most max_depth, up to a missing parent or a key seen
    before. A step is a join of two narrow columns, whatever the number of issues."""
    tree = issues.select(F.col("key").alias("_p"), F.col("parent_key").alias("_up"), F.col("summary").alias("_s"))
    df = issues.select("key", F.col("parent_key").alias("_next"), F.array().cast("array<string>").alias("chain"), F.array().cast("array<string>").alias("summaries"), F.array("key").alias("_seen"))
    for _ in range(max_depth):
        wanted = F.when(~F.array_contains("_seen", F.col("_next")), F.col("_next"))
        df = df.withColumn("_want", wanted).join(tree, F.col("_want") == F.col("_p"), "left")
        found = F.col("_p").isNotNull()
        put = lambda c, v: F.when(found, F.concat(F.array(v), F.col(c))).otherwise(F.col(c)).alias(c)
        df = df.select("key", F.when(found, F.col("_up")).alias("_next"), put("chain", F.col("_p")), put("summaries", F.col("_s")), put("_seen", F.col("_p")))
    return df.select("key", "chain", "summaries")


def breadcrumb(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """(key, path): project › ancestors › key."""
    names = projects.select(F.col("key").alias("project"), F.col("name").alias("_n"))
    df = issues.select("key", "project").join(parent_chain(issues).select("key", "chain"), "key").join(names, "project", "left")
    return df.select("key", F.concat_ws(" › ", F.coalesce(F.nullif("_n", F.lit("")), "project"), "chain", "key").alias("path"))


def children_rollup(issues: DataFrame) -> DataFrame:
    """(parent_key, children, done, in_progress, to_do, points) of parents that exist."""
    c = issues.filter("parent_key is not null").join(issues.select(F.col("key").alias("parent_key")), "parent_key", "left_semi")
    n = lambda s: F.count_if(F.col("status_category") == s)
    return c.groupBy("parent_key").agg(F.count("*").alias("children"), n("Done").alias("done"), n("In Progress").alias("in_progress"), n("To Do").alias("to_do"), F.round(F.sum("story_points"), 2).alias("points"))


def ancestors(issues: DataFrame, folder: str) -> DataFrame:
    """(key, ancestor, distance) of every issue and every issue above it, however high the tree. Pointer doubling: a round joins the
    pairs known so far with jumps twice as long as in the round before, so a tree of depth d takes about log2(d) rounds, each
    stored below folder. A parent that is no issue ends a chain, and so does a key seen before: of a cycle each key has the
    others as ancestors, not itself. Issues without a parent, and jumps that end at one, take part in no join.

    A null key has no ancestors; of rows that share a key the least parent counts."""

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    one = issues.filter("key IS NOT NULL").groupBy("key").agg(F.min("parent_key").alias("to"))
    edges = one.filter("to IS NOT NULL AND to <> key").join(one.select(F.col("key").alias("to")), "to", "left_semi").select("key", "to")
    jumps = stored(edges, "jumps-0")
    known, n, k = stored(jumps.select("key", F.col("to").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "pairs-0"), -1, 0
    while (now := known.count()) > n:
        n = now
        going_on = jumps.join(edges.select(F.col("key").alias("to")), "to", "left_semi")
        further = going_on.join(known.select(F.col("key").alias("to"), "ancestor", "distance"), "to").select("key", "ancestor", (F.col("distance") + (1 << k)).alias("distance"))
        both = known.unionByName(further.filter("key <> ancestor")).groupBy("key", "ancestor").agg(F.min("distance").alias("distance"))
        known = stored(both, f"pairs-{k + 1}")
        jumps = stored(going_on.join(jumps.select(F.col("key").alias("to"), F.col("to").alias("next")), "to").select("key", F.col("next").alias("to")), f"jumps-{k + 1}")
        k += 1
    return known


def _kept_in(folder: str, df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _jumps(issues: DataFrame) -> DataFrame:
    """(key, to): each key and its parent, null if that is no issue or the key itself; of rows that share a key the least parent counts."""
    one = issues.filter("key IS NOT NULL").groupBy("key").agg(F.min("parent_key").alias("to"))
    edges = one.filter("to IS NOT NULL AND to <> key").join(one.select(F.col("key").alias("to")), "to", "left_semi").select("key", "to")
    return one.select("key").join(edges, "key", "left")


def _doubled(state: DataFrame, folder: str, step) -> tuple[DataFrame, DataFrame | None]:
    """Applies step(state, k) until no jump (column to) is left: (state, None). Jumps of 2 ** k keys that are left when no chain can be so
    long lead into a cycle: (state, keys of these jumps). No key above or below such a one is without."""
    state, k = _kept_in(folder, state, "up-0"), 0
    total = state.count()
    while state.filter("to IS NOT NULL").count():
        if 1 << k > total:
            return state, state.filter("to IS NOT NULL").select("key")
        state = _kept_in(folder, step(state, k), f"up-{k + 1}")
        k += 1
    return state, None


def whole_chain(issues: DataFrame, folder: str) -> DataFrame:
    """(key, depth, chain): all ancestors, the root first; what counts as one: ancestors(). A round puts behind each key's chain that of the
    key at its end, so a row a key is shuffled, and a chain is written once for each doubling of its length."""

    def step(state: DataFrame, k: int) -> DataFrame:
        above = state.select(F.col("key").alias("to"), F.col("to").alias("_next"), F.col("chain").alias("_more"))
        longer = state.filter("to IS NOT NULL").join(above, "to").select("key", F.col("_next").alias("to"), F.concat("chain", "_more").alias("chain"))
        return state.filter("to IS NULL").unionByName(longer)

    none = F.array().cast("array<string>")
    up, cyclic = _doubled(_jumps(issues).withColumn("chain", F.when(F.col("to").isNotNull(), F.array("to")).otherwise(none)), folder, step)
    up = up.select("key", F.reverse("chain").alias("chain"))
    if cyclic is not None:
        far = ancestors(issues.join(cyclic, "key", "left_semi"), f"{folder}/cyclic").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("_a"))
        up = up.join(cyclic, "key", "left_anti").unionByName(far.select("key", F.transform("_a", lambda x: x["ancestor"]).alias("chain")))
    return issues.select("key").join(up, "key", "left").select("key", F.coalesce(F.size("chain"), F.lit(0)).alias("depth"), F.coalesce("chain", none).alias("chain"))


def subtree_rollup(issues: DataFrame, folder: str) -> DataFrame:
    """(key, height, issues, done, in_progress, to_do, points) over all issues below each issue that has any. A round adds to each key's
    sums over the keys less than 2 ** k below it those of the keys that are 2 ** k below, so a row a key is shuffled, however high the tree.
    Keys that lead into a cycle are summed up over ancestors()."""
    n = lambda s: F.count_if(F.col("status_category") == s)
    sums = [F.count("*").alias("issues"), n("Done").alias("done"), n("In Progress").alias("in_progress"), n("To Do").alias("to_do"), F.sum("story_points").alias("points")]
    own = issues.filter("key IS NOT NULL").groupBy("key").agg(*sums)
    names, kinds = [c for c in own.columns if c != "key"], dict(own.dtypes)
    plus = lambda a, b, c: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b)).cast(kinds[c])

    def step(state: DataFrame, k: int) -> DataFrame:
        going = state.filter("to IS NOT NULL")
        gains = [F.sum(plus(c, f"below_{c}", c)).cast(kinds[c]).alias(f"more_{c}") for c in names]
        more = going.groupBy(F.col("to").alias("key")).agg(*gains, (F.max("height") + (1 << k)).alias("_height"))
        far = going.select("key", "to").join(going.select(F.col("key").alias("to"), F.col("to").alias("_next")), "to").select("key", "_next")
        out = state.join(more, "key", "left").join(far, "key", "left")
        return out.select("key", F.col("_next").alias("to"), F.greatest("height", "_height").alias("height"), *names, *[plus(f"below_{c}", f"more_{c}", c).alias(f"below_{c}") for c in names])

    start = own.join(_jumps(issues), "key").select("key", "to", F.lit(0).cast("long").alias("height"), *names, *[(F.lit(None) if c == "points" else F.lit(0)).cast(kinds[c]).alias(f"below_{c}") for c in names])
    state, cyclic = _doubled(start, folder, step)
    out = state.filter("below_issues > 0").select("key", "height", *[F.col(f"below_{c}").alias(c) for c in names])
    if cyclic is not None:
        some = issues.join(cyclic, "key", "left_semi")
        below = ancestors(some, f"{folder}/cyclic").join(some.select("key", "status_category", "story_points"), "key")
        far = below.groupBy(F.col("ancestor").alias("key")).agg(F.max("distance").alias("height"), *sums)
        out = out.join(cyclic, "key", "left_anti").unionByName(far)
    return out.withColumn("points", F.round("points", 2))
