"""SQL with date variables, snippets and saved views, run by Spark."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPET_DEPTH = 10
_NAME = re.compile(r"\{\{\s*(\w+)(?::(\d+))?\s*\}\}")


@dataclass
class QueryConfig:
    me: str = ""
    team: str = ""
    projects: tuple[str, ...] = ()
    source_filter: str = ""
    snippets: dict[str, str] = field(default_factory=dict)
    views: dict[str, dict[str, Any]] = field(default_factory=dict)


# The views that a new setup has, by name: what they choose, filter, sort by, show and are grouped by.
VIEWS = {
    "my-work": ("key, summary, status, priority, updated", "assignee_email = '{{me}}' AND status_category != 'Done'", "priority DESC, updated DESC", None, ["key", "summary", "status", "priority"], None),
    "recent-updates": ("key, summary, status, assignee, updated", None, "updated DESC", 100, ["key", "summary", "status", "assignee", "updated"], None),
    "team-board": ("key, summary, status, assignee, priority", "status_category != 'Done'", "status, priority DESC", None, ["key", "summary", "status", "assignee"], "status"),
    "stale-issues": ("key, summary, status, assignee, updated", "status_category = 'In Progress' AND updated < '{{days_ago:28}}'", "updated ASC", None, ["key", "summary", "status", "assignee", "updated"], None),
}


def starter_views() -> dict[str, dict[str, Any]]:
    """The four views that a new setup has; ties go by key."""

    def text(chosen: str, where: str | None, order: str, limit: int | None) -> str:
        return f"SELECT {chosen} FROM issues" + (f" WHERE {where}" if where else "") + f" ORDER BY {order}, key" + (f" LIMIT {limit}" if limit else "")

    return {name: {"query": text(*parts), "columns": shown, **({"group_by": group} if group else {})} for name, (*parts, shown, group) in VIEWS.items()}


def calendar(now: dt.datetime) -> dict[str, str]:
    day = now.date()
    ago = lambda n: (day - dt.timedelta(days=n)).isoformat()
    return {
        "today": ago(0), "yesterday": ago(1), "week_ago": ago(7), "month_ago": ago(30), "quarter_ago": ago(90),
        "this_week": ago(day.weekday()), "this_month": day.replace(day=1).isoformat(), "this_quarter": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1).isoformat(),
    }


def months_before(day: dt.date, n: int) -> dt.date:
    """The same day n months earlier, or that month's last day if it is shorter."""
    year, month = divmod(day.year * 12 + day.month - 1 - n, 12)
    for d in range(day.day, 27, -1):
        try:
            return dt.date(year, month + 1, d)
        except ValueError:
            continue
    return dt.date(year, month + 1, day.day)


def project_clause(config: QueryConfig) -> str:
    """Quoted keys of {{projects}}: those listed, else those of the source's filter text."""
    keys = list(config.projects)
    if not keys:
        bare = re.split(r"(?i)\s+order\s+by\s", config.source_filter)[0]
        if m := re.search(r"(?i)\bproject\s+in\s*\(([^)]*)\)", bare):
            keys = [x.strip(" \"'") for x in m[1].split(",")]
        elif m := re.search(r"(?i)\bproject\s*=\s*(\"[^\"]*\"|'[^']*'|\w+)", bare):
            keys = [m[1].strip("\"'")]
    return ",".join(f"'{k}'" for k in dict.fromkeys(keys) if k)


def expand_template(sql: str, config: QueryConfig, now: dt.datetime) -> str:
    """The text with snippets, then variables, put in; unknown names stay. A snippet named like a variable is ignored, one
    that contains itself is an error."""
    fixed = {"me": config.me, "team": config.team, "projects": project_clause(config)} | calendar(now)
    ago = {"days_ago": lambda n: now.date() - dt.timedelta(days=n), "weeks_ago": lambda n: now.date() - dt.timedelta(weeks=n), "months_ago": lambda n: months_before(now.date(), n)}

    def snippets(text: str, open_: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            name = m[1]
            if m[2] or name in fixed or name in ago or name not in config.snippets:
                return m[0]
            if name in open_:
                raise ValueError(f"circular snippet reference: {name}")
            if len(open_) >= SNIPPET_DEPTH:
                raise ValueError(f"snippets nest deeper than {SNIPPET_DEPTH}")
            return snippets(config.snippets[name], (*open_, name))

        return _NAME.sub(put, text)

    def variable(m: re.Match) -> str:
        if m[2]:
            return ago[m[1]](int(m[2])).isoformat() if m[1] in ago else m[0]
        return fixed.get(m[1], m[0])

    return _NAME.sub(variable, snippets(sql, ()))


def calendar_frame(spark: SparkSession, now: dt.datetime) -> DataFrame:
    """The date variables as one row of dates, computed by Spark."""
    d = F.lit(now.date())
    return spark.range(1).select(
        d.alias("today"), F.date_sub(d, 1).alias("yesterday"), F.date_sub(d, 7).alias("week_ago"), F.date_sub(d, 30).alias("month_ago"), F.date_sub(d, 90).alias("quarter_ago"),
        F.trunc(d, "week").alias("this_week"), F.trunc(d, "month").alias("this_month"), F.trunc(d, "quarter").alias("this_quarter"),
    )


def run_query(spark: SparkSession, sql: str, config: QueryConfig, now: dt.datetime, args: dict[str, Any] | None = None) -> DataFrame:
    """The result of a SELECT or WITH query; anything else is refused before Spark sees it."""
    text = expand_template(sql, config, now)
    first = re.sub(r"^(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", text, flags=re.S)[:7].upper()
    if not re.match(r"(SELECT|WITH)\b", first) or (first.startswith("WITH") and re.search(r"\)\s*(DELETE|UPDATE|INSERT|MERGE)\b", text, re.I)):
        raise ValueError("only SELECT and WITH queries are allowed")
    return spark.sql(text, args=args)


def run_view(spark: SparkSession, name: str, config: QueryConfig, now: dt.datetime) -> DataFrame:
    view = config.views[name]
    return select_columns(run_query(spark, view["query"], config, now), view.get("columns", []), "requested")


def select_columns(df: DataFrame, names: list[str], order: str = "source") -> DataFrame:
    """The named columns that exist, in the order of df or as requested; all if none is named."""
    if not names:
        return df
    return df.select([c for c in df.columns if c in names] if order == "source" else [c for c in names if c in df.columns])
