"""Checks of incoming entries: defaults, validation, batch gates, the summary of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

_TRIM = r"(?U)^\s+|\s+\z"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def new_level(level: Column) -> Column:
    """Level of an entry made here: trimmed and upper, INFO if nothing is left."""
    t = F.upper(trimmed(F.coalesce(level, F.lit(""))))
    return F.when(t == "", "INFO").otherwise(t)


def received_level(level: Column) -> Column:
    """Level of an entry received: INFO only if absent; blanks alone become empty."""
    given = F.coalesce(level, F.lit(""))
    return F.when(given == "", "INFO").otherwise(F.upper(trimmed(given)))


def normalise(df: DataFrame, now: Column, new_id: Column | None = None) -> DataFrame:
    """Entries made here: trimmed host and source, level, id, timestamp."""
    return df.withColumns(
        {
            "host": trimmed(F.col("host")),
            "source": trimmed(F.col("source")),
            "level": new_level(F.col("level")),
            "timestamp": F.coalesce(F.col("timestamp"), now),
            "id": new_id if new_id is not None else F.expr("uuid()"),
        }
    )


def default_host(df: DataFrame, agent: Column) -> DataFrame:
    """An empty host becomes the agent's id; a blank one doesn't."""
    host = F.coalesce(F.col("host"), F.lit(""))
    return df.withColumn("host", F.when((host == "") & (F.coalesce(agent, F.lit("")) != ""), agent).otherwise(host))


def error_of(max_message_bytes: int = S.MAX_MESSAGE_BYTES) -> Column:
    """The first rule that an entry breaks, or NULL."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        F.when(trimmed(text("host")) == "", S.ERROR_MISSING_HOST)
        .when(trimmed(text("source")) == "", S.ERROR_MISSING_SOURCE)
        .when(text("message") == "", S.ERROR_MISSING_MESSAGE)
        .when(F.octet_length(text("message")) > max_message_bytes, S.ERROR_MESSAGE_TOO_LARGE)
    )


def validate(df: DataFrame, now: Column, max_message_bytes: int = S.MAX_MESSAGE_BYTES, new_id: Column | None = None) -> DataFrame:
    """Ids and timestamps filled, levels as received, and ``_error``."""
    blank = trimmed(F.coalesce(F.col("id"), F.lit(""))) == ""
    made = new_id if new_id is not None else F.expr("uuid()")
    out = df.withColumns({"id": F.when(blank, made).otherwise(F.col("id")), "timestamp": F.coalesce(F.col("timestamp"), now)})
    out = out.withColumn("_error", error_of(max_message_bytes))
    return out.withColumn("level", F.when(F.col("_error").isNull(), received_level(F.col("level"))).otherwise(F.col("level")))


def explode_requests(requests: DataFrame, max_events: int = S.MAX_BATCH_EVENTS) -> tuple[DataFrame, DataFrame]:
    """Entries of the requests in order, and the requests that hold too many events."""
    sized = requests.withColumn("_n", F.coalesce(F.size("events"), F.lit(0)))
    fine = sized.where(F.col("_n") <= max_events)
    rest = [c for c in requests.columns if c != "events"]
    entries = fine.select(*rest, F.posexplode("events").alias("_pos", "_e")).select(*rest, "_pos", "_e.*")
    return entries, sized.where(F.col("_n") > max_events).select(*rest, F.col("_n").alias("events"))


def summary(checked: DataFrame, by: list[str], duplicate: str = "_duplicate") -> DataFrame:
    """Per request: accepted, duplicates, errors and their texts."""
    dup, bad = F.coalesce(F.col(duplicate), F.lit(False)), F.col("_error").isNotNull()
    return checked.groupBy(*by).agg(
        F.count_if(~dup & ~bad).alias("accepted"),
        F.count_if(dup & ~bad).alias("duplicates"),
        F.count_if(bad).alias("errors"),
        F.array_join(F.array_sort(F.collect_set("_error")), "; ").alias("error_texts"),
    )


def response(summaries: DataFrame) -> DataFrame:
    """Summaries as the service answers them: a JSON text, zero counts and absent errors left out."""
    body = F.struct(
        F.lit("ok").alias("status"), "accepted", F.nullif(F.col("duplicates"), F.lit(0)).alias("duplicates"),
        F.when(F.col("error_texts") != "", F.split("error_texts", "; ")).alias("errors"),
    )
    return summaries.withColumn("response", F.to_json(body))
