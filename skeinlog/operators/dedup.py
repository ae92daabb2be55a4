"""Deduplication by id with a window that starts at the first sight and isn't moved by duplicates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def first_of_each(df: DataFrame, key: str = "id", order: str = S.SEQ) -> DataFrame:
    """The first arrival of each id; rows without an id all stay.  Right for loads shorter than the window."""
    marked = mark_first(df, key, order)
    return marked.where(~F.col("_duplicate")).drop("_duplicate")


def mark_first(df: DataFrame, key: str = "id", order: str = S.SEQ) -> DataFrame:
    # An aggregate, not a window: partial minima leave one row an id and task, however busy the id.
    least = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    joined = df.join(least, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("_duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_k", "_first")


def mark_accepted(checked: DataFrame, key: str = "id", order: str = S.SEQ) -> DataFrame:
    """``_duplicate`` among the rows that passed the checks (``_error`` is null): a rejected entry doesn't use up its id."""
    passed = F.when(F.col("_error").isNull(), F.col(key))
    return mark_first(checked.withColumn("_passed", passed), "_passed", order).drop("_passed")


def within_window(df: DataFrame, key: str = "id", arrival: str = S.ARRIVAL, order: str = S.SEQ, window: timedelta = S.DEDUP_WINDOW) -> DataFrame:
    """Rows that aren't duplicates: an id is new if unseen or last *accepted* more than ``window`` ago.

    Two accepted arrivals of an id lie more than a window apart, so a fixed slice of time one window wide has at
    most one.  Slices before the first possible repeat need no look at each other: an id's arrivals are cut into
    sessions wherever a gap exceeds the window (a session's first arrival is accepted whatever came before), and
    the fold runs inside sessions.
    """
    micros = int(window.total_seconds() * 1_000_000)
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    rows = df.where(has).select(F.col(key).alias("_k"), at.alias("_t"), F.col(order).alias("_s"))
    by_time = Window.partitionBy("_k").orderBy("_t", "_s")
    rows = rows.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(by_time) > micros).cast("int"), F.lit(1)))
    rows = rows.withColumn("_session", F.sum("_new").over(by_time))
    seen = F.array_sort(F.collect_list(F.struct("_t", "_s")))
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("kept"))

    def step(acc, x):
        fresh = acc["anchor"].isNull() | (x["_t"] - acc["anchor"] > micros)
        taken = F.struct(x["_t"].alias("anchor"), F.concat(acc["kept"], F.array(x["_s"])).alias("kept"))
        return F.when(fresh, taken).otherwise(acc)

    kept = rows.groupBy("_k", "_session").agg(seen.alias("seen")).select("_k", F.explode(F.aggregate("seen", start, step, lambda a: a["kept"])).alias("_s"))
    joined = df.join(kept, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_s")), "left_semi")
    return joined.union(df.where(~has))
