"""Questions over issues and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def week_label(c: Column) -> Column:
    """Year and week of the year; weeks start on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7).cast("string")
    return F.concat(F.year(c).cast("string"), F.lit("-"), F.lpad(week, 2, "0"))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def age_days(c: Column, now: Column) -> Column:
    seconds = lambda x: F.unix_micros(x.cast("timestamp"))
    return (seconds(now) - seconds(c)) / 86_400e6


def filter_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).ilike(pattern))


def point_lookup(issues: DataFrame, key: str, comments: DataFrame | None = None) -> DataFrame:
    one = issues.filter(F.col("key") == key)
    if comments is None:
        return one
    c = comments.filter(F.col("issue_key") == key).select("issue_key", F.col("id").alias("comment_id"), "author", "body", F.col("created").alias("commented"))
    return one.join(c, one.key == c.issue_key, "left").drop("issue_key").orderBy("commented")


def weekly_velocity(issues: DataFrame, type_: str, done: str = "Done") -> DataFrame:
    """(week, opened, closed, net) of issues of a type; weeks in which none was opened do not appear."""
    mine = issues.filter(F.col("type") == type_)
    opened = mine.groupBy(week_label(F.col("created")).alias("week")).agg(F.count("*").alias("opened"))
    closed = mine.filter((F.col("status") == done) & F.col("resolved").isNotNull()).groupBy(week_label(F.col("resolved")).alias("week")).agg(F.count("*").alias("closed"))
    both = opened.join(closed, "week", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    return both.select("week", "opened", "closed", (F.col("opened") - F.col("closed")).alias("net")).orderBy("week")


def stale_items(issues: DataFrame, now: Column, days: int) -> DataFrame:
    late = (F.col("status") == "In Progress") & (F.col("updated") < now - F.make_interval(days=F.lit(days)))
    return issues.filter(late).orderBy("updated", "key")


def numbered(df: DataFrame, by: str, at: str, tie: str, name: str, desc: bool = False, folder: str | None = None) -> DataFrame:
    """df with row_number() over (partition by by, order by at, tie) for few groups that hold many rows each; nulls stand
    first, last if desc. Rows with all three equal are numbered in any order.

    With a folder, any distribution is split: rows are range-sorted over group, at and tie by splits that Spark samples,
    stored there with the number of their range, so that both steps below see the same ranges, and numbered within their
    range; rows of a group in the ranges before are counts, one for each range. Also a group whose rows have one time,
    or none, is spread over tasks.
    Without a folder, at is a time and rows are numbered within a day of their group: a task sorts one day of a group."""
    way = lambda c: F.desc(c) if desc else F.asc(c)
    part, place = "_day", F.col(at).cast("date")
    if folder:
        part, place = "_range", F.col("_range")
        path = f"{folder}/ranges"
        ranged = df.repartitionByRange(F.asc(by), way(at), F.asc(tie)).withColumn(part, F.spark_partition_id())
        ranged.write.parquet(path)
        df = df.sparkSession.read.schema(ranged.schema).parquet(path)
    rows = df.withColumn("_k", F.struct(F.col(by), place.alias(part)))  # a struct is never null, so null groups and days meet
    order = F.asc(f"_k.{part}") if folder else way(f"_k.{part}")
    before = W.partitionBy(F.col("_k")[by]).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_k").agg(F.count("*").alias("_n")).select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_k").orderBy(way(at), tie))
    return rows.join(parts, "_k").withColumn(name, within + F.col("_before")).drop("_k", "_before", "_range")


def staleness_rank(issues: DataFrame, by: str = "team", folder: str | None = None) -> DataFrame:
    """issues with rank: 1 is the one of its group that was updated longest ago. See numbered()."""
    return numbered(issues, by, "updated", "key", "rank", folder=folder)


def monthly_completion(changelog: DataFrame, issues: DataFrame, status: str, column: str, pattern: str) -> DataFrame:
    """(month, n): changes into a status per month, of issues whose column matches."""
    into = changelog.filter((F.col("field") == "status") & (F.col("to_string") == status))
    some = issues.filter(F.col(column).ilike(pattern)).select(F.col("key").alias("issue_key"))
    return into.join(some, "issue_key", "left_semi").groupBy(month_label(F.col("changed_at")).alias("month")).agg(F.count("*").alias("n"))


def entered_status(changelog: DataFrame, status: str, first: bool = False) -> DataFrame:
    into = changelog.filter((F.col("field") == "status") & (F.col("to_string") == status))
    if first:
        return into.groupBy("issue_key").agg(F.min("changed_at").alias("changed_at"), F.min_by("author", F.struct("changed_at", "id")).alias("author"))
    return into.select("issue_key", "changed_at", "author")


def time_in_status(changelog: DataFrame, now: Column) -> DataFrame:
    """(issue_key, status, seconds): from each change to the next one of its issue, the last one to now."""
    by = W.partitionBy("issue_key").orderBy("changed_at", "id")
    at = lambda x: F.unix_micros(x.cast("timestamp"))
    spans = changelog.filter("field = 'status'").withColumn("until", F.coalesce(F.lead("changed_at").over(by), now))
    seconds = (at(F.col("until")) - at(F.col("changed_at"))) / 1e6
    return spans.groupBy("issue_key", F.col("to_string").alias("status")).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("visits"))


def recent_changes(changelog: DataFrame, issues: DataFrame, since: Column, by: tuple[str, ...]) -> DataFrame:
    recent = changelog.filter(F.col("changed_at") >= since)
    return recent.join(issues.select(F.col("key").alias("issue_key"), *[c for c in by if c not in changelog.columns]), "issue_key").groupBy(*by).agg(F.count("*").alias("changes"), F.max("changed_at").alias("last"))


def release_plan(issues: DataFrame, version: str, column: str = "fix_version") -> DataFrame:
    """(team, status, n, points) of the open issues of a release."""
    mine = issues.filter(F.array_contains(column, version) & (F.col("status") != "Done"))
    return mine.groupBy("team", "status").agg(F.count("*").alias("n"), F.round(F.sum("story_points"), 2).alias("points"))
