"""Sample tables as log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

_STATUS = "case when event_type = 'error' then 500 when event_type = 'purchase' then 404 else 200 end"


def _columns(get_k: str) -> str:
    return f"""
    concat('evt-', lpad(cast(event_id as varchar(20)), 8, '0')) as id,
    ts,
    concat('Node-', lpad(cast(user_id % 10 as varchar(20)), 2, '0')) as host,
    concat('svc-', cast(event_id % 7 as varchar(20))) as source,
    case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'click' then 'DEBUG' else 'INFO' end as level,
    {_STATUS} as status,
    {get_k} as k,
    concat('HTTP ', cast({_STATUS} as varchar(20)), ' /', event_type, ' in ', cast(cast(round(value) as bigint) as varchar(20)), 'ms') as message,
    event_id as seq, user_id, event_type, value
"""


#: The adapter for DuckDB, as the head of a query.
LOGS_SQL = f"with logs as (select *, cast(ts as date) as dt, hour(ts) as hr from (select {_columns("json_extract_string(props, '$.k')")} from events)) "


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as entries: the entry's columns plus status, k, user_id and the engine's own."""
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = events.selectExpr(*_split(_columns("get_json_object(props, '$.k')")))
    fields = F.create_map(F.lit("k"), F.col("k"), F.lit("user_id"), F.col("user_id").cast("string"))
    return out.withColumns({"fields": fields, "dt": F.to_date("ts"), "hr": F.hour("ts"), "_seq": F.col("seq")})


def _split(columns: str) -> list[str]:
    """Top-level parts of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]
