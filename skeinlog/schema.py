"""The log entry, its envelopes, and the limits of the service."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import types as T

FIELDS_TYPE = T.MapType(T.StringType(), T.StringType())

LOG_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("host", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", FIELDS_TYPE),
    ]
)
INGEST_REQUEST = T.StructType([T.StructField("agent_id", T.StringType()), T.StructField("events", T.ArrayType(LOG_ENTRY))])
SPOOL_BATCH = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("events", T.ArrayType(LOG_ENTRY))]
)
ENTRY_COLUMNS = tuple(LOG_ENTRY.names)
#: Columns that the engine adds: order of arrival, time of arrival, partition keys.
SEQ, ARRIVAL, DATE, HOUR = "_seq", "_arrival", "dt", "hr"

# Fixed values.
MAX_MESSAGE_BYTES = 1 << 20
QUERY_LIMIT, QUERY_LIMIT_MAX = 100, 10_000
DEDUP_WINDOW, DEDUP_CAPACITY = timedelta(minutes=5), 50_000
MAX_BATCH_EVENTS = 500
RING_CAPACITY, RING_CAPACITY_LIBRARY, REPLAY = 10_000, 1_000, 100
CLIENT_BUFFER, MAX_CLIENTS = 256, 100
RETENTION_AGE, RETENTION_BYTES, RETENTION_INTERVAL = timedelta(hours=168), 10 << 30, timedelta(minutes=10)
FLUSH_EVENTS, FLUSH_INTERVAL, QUEUE_EVENTS = 500, timedelta(seconds=1), 5_000
SPOOL_MEGABYTES = 1_024
BACKOFF_INITIAL, BACKOFF_MAX, BACKOFF_FACTOR = timedelta(seconds=1), timedelta(seconds=30), 2.0
TAIL_POLL, TAIL_MAX_LINE, TAIL_CHANNEL = timedelta(milliseconds=50), 1 << 20, 128
DASHBOARD_ROWS, DASHBOARD_HISTORY, ROLLING_WINDOW = 1_000, 500, timedelta(seconds=60)
ERROR_MISSING_HOST = "log entry missing host"
ERROR_MISSING_SOURCE = "log entry missing source"
ERROR_MISSING_MESSAGE = "log entry missing message"
ERROR_MESSAGE_TOO_LARGE = "log message exceeds maximum size"
