"""Log queries: a value object, its predicate, and how it runs on a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

#: The dashboard's ranges.
RANGES = {"5m": timedelta(minutes=5), "15m": timedelta(minutes=15), "1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(hours=24)}


@dataclass(frozen=True)
class LogQuery:
    host: str = ""
    source: str = ""
    level: str = ""
    start: datetime | None = None
    end: datetime | None = None
    search: str = ""
    limit: int = 0

    def normalised(self) -> LogQuery:
        """Trimmed texts, upper level, limit between 1 and the maximum (100 if not positive)."""
        limit = S.QUERY_LIMIT if self.limit <= 0 else min(self.limit, S.QUERY_LIMIT_MAX)
        return replace(
            self, host=self.host.strip(), source=self.source.strip(), level=self.level.strip().upper(), search=self.search.strip(), limit=limit
        )

    def predicate(self, columns: list[str], ts: str = "timestamp") -> Column:
        """Cheap tests first; partition columns are bounded where the table has them."""
        q, tests = self.normalised(), []
        if q.start is not None and S.DATE in columns:
            tests.append(F.col(S.DATE) >= F.lit(q.start.date()))
        if q.end is not None and S.DATE in columns:
            tests.append(F.col(S.DATE) <= F.lit(q.end.date()))
        if q.start and q.end and q.start.date() == q.end.date() and S.HOUR in columns:
            tests.append(F.col(S.HOUR).between(q.start.hour, q.end.hour))
        for name in ("host", "source"):
            value = getattr(q, name)
            if value:
                stored = f"{name}_lc"  # a lower-cased copy lets the test reach the scan
                tests.append((F.col(stored) if stored in columns else F.lower(name)) == value.lower())
        if q.level:
            tests.append(F.upper("level") == q.level)
        if q.start is not None:
            tests.append(F.col(ts) >= F.lit(q.start))
        if q.end is not None:
            tests.append(F.col(ts) <= F.lit(q.end))
        if q.search:
            tests.append(search_predicate(q.search, "fields" in columns))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def contains_text(column: Column, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def search_predicate(text: str, fields: bool, extra: tuple[str, ...] = ()) -> Column:
    """A substring, in any letter case, of the message, a field's key or value, or one of ``extra``."""
    out = reduce(lambda a, b: a | b, (contains_text(F.col(c), text) for c in ("message", *extra)))
    if fields:
        hit = F.exists(F.map_entries("fields"), lambda e: contains_text(e["key"], text) | contains_text(e["value"], text))
        out = out | F.coalesce(hit, F.lit(False))
    return out


def dashboard_filter(columns: list[str], level: str = "", host: str = "", source: str = "", search: str = "") -> Column:
    """The dashboard's test: exact level, the rest as substrings; the search looks at host and source, too."""
    tests = [F.upper(F.coalesce("level", F.lit("INFO"))) == level.strip().upper()] if level.strip() else []
    tests += [contains_text(F.col(c), v.strip()) for c, v in (("host", host), ("source", source)) if v.strip()]
    if search.strip():
        tests.append(search_predicate(search.strip(), "fields" in columns, ("host", "source")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def newest_first(df: DataFrame) -> list[Column]:
    """Newest segment first, inside it the last arrival first."""
    return [F.col(c).desc() for c in (S.DATE, S.HOUR, S.SEQ) if c in df.columns]


def run(logs: DataFrame, query: LogQuery, ts: str = "timestamp", order: str = "arrival") -> DataFrame:
    """The page of a query.  ``order='timestamp'`` sorts by time instead of arrival."""
    q = query.normalised()
    found = logs.where(q.predicate(logs.columns, ts))
    keys = [F.col(ts).desc(), *newest_first(logs)] if order == "timestamp" else newest_first(logs)
    return found.orderBy(*keys).limit(q.limit)


def run_newest_segments(logs: DataFrame, query: LogQuery, segments: list[tuple], ts: str = "timestamp") -> DataFrame:
    """The page, read segment by segment from the newest until it is full.

    ``segments`` are (date, hour) pairs, e.g. of the table's partitions.  Worth it when pages are small and
    segments are many; each step is a small job.
    """
    q, spark = query.normalised(), logs.sparkSession
    found, left = spark.createDataFrame([], logs.schema), q.limit
    step, at, ordered = 1, 0, sorted(segments, reverse=True)
    while at < len(ordered) and left > 0:
        part = ordered[at : at + step]
        test = reduce(lambda a, b: a | b, ((F.col(S.DATE) == d) & (F.col(S.HOUR) == h) for d, h in part))
        page = run(logs.where(test), replace(q, limit=left), ts)
        found, left = found.unionByName(page), left - page.count()
        at, step = at + step, step * 2
    return found


def from_params(params: Mapping[str, str]) -> LogQuery:
    """A query from request parameters; what can't be read is ignored."""

    def when(name: str) -> datetime | None:
        try:
            t = datetime.fromisoformat(params.get(name, ""))
            return t.astimezone(timezone.utc) if t.tzinfo else None
        except ValueError:
            return None

    try:
        limit = int(params.get("limit", ""))
    except ValueError:
        limit = 0
    text = {k: params.get(k, "") for k in ("host", "source", "level", "search")}
    return LogQuery(**text, start=when("start"), end=when("end"), limit=limit)


def since(now: datetime, name: str) -> LogQuery:
    """The query of one of the dashboard's ranges."""
    return LogQuery(start=now - RANGES[name], end=now, limit=S.DASHBOARD_HISTORY)


def response(page: DataFrame) -> DataFrame:
    """One row: the page as the service answers it, ``total`` being the page's length."""
    names = [c for c in S.ENTRY_COLUMNS if c in page.columns]
    blank = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "level" else F.col(c) for c in names]
    keys = [c for c in (S.DATE, S.HOUR, S.SEQ) if c in page.columns]
    # Maps can't be sorted: the entries are texts already when they are put in order.
    rows = page.select(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(keys)], F.to_json(F.struct(*blank)).alias("e")).alias("r"))
    logs = F.array_join(F.transform(F.sort_array(F.collect_list("r"), asc=False), lambda r: r["e"]), ",")
    text = F.concat(F.lit('{"total":'), F.count("*").cast("string"), F.lit(',"logs":['), logs, F.lit("]}"))
    return rows.agg(text.alias("response"))
