"""The log table: partitioned by date and hour of the entry's time in UTC."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


def with_partitions(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({S.DATE: F.to_date(ts), S.HOUR: F.hour(ts), "host_lc": F.lower("host"), "source_lc": F.lower("source")})

#: Times in JSON Lines segments keep their microseconds.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: The innermost partition key: which load wrote a file.
LOAD = "load"


class LogStore:
    """Append, read, list and prune.  ``path`` may be anything that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame, load: str = "") -> None:
        """One file a segment and task; a busy segment is spread by a salt, so it isn't one task.

        ``load`` names what is appended (a batch of a stream): what an earlier attempt at the same load wrote goes first.
        """
        if load:
            self.forget(load)
        parts = with_partitions(entries).withColumn(LOAD, F.lit(load or uuid.uuid4().hex))
        salt = F.pmod(F.xxhash64("id"), F.lit(8))
        parts.repartition(S.DATE, S.HOUR, salt).write.mode("append").partitionBy(S.DATE, S.HOUR, LOAD).parquet(self.path)

    def forget(self, load: str) -> None:
        """Drop what a load wrote; a listing by name, no data is read."""
        fs, path = self._fs()
        for found in fs.globStatus(path(f"{self.path}/{S.DATE}=*/{S.HOUR}=*/{LOAD}={load}")) or []:
            fs.delete(found.getPath(), True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(LOAD)

    def query(self, query) -> DataFrame:
        from .query import run

        return run(self.read(), query)

    def hosts(self) -> DataFrame:
        from .aggregates import distinct_values

        return distinct_values(self.read(), "host")

    def sources(self) -> DataFrame:
        from .aggregates import distinct_values

        return distinct_values(self.read(), "source")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def segments(self) -> list[tuple[str, str, int]]:
        """(date, hour, bytes) of all segments, oldest first: a listing, no data is read."""
        fs, path = self._fs()
        out = []
        for d in fs.listStatus(path(self.path)):
            if d.getPath().getName().startswith(f"{S.DATE}="):
                for h in fs.listStatus(d.getPath()):
                    out.append((d.getPath().getName()[3:], h.getPath().getName()[3:], fs.getContentSummary(h.getPath()).getLength()))
        return sorted(out, key=lambda s: (s[0], int(s[1])))

    def disk_usage(self) -> int:
        return sum(s[2] for s in self.segments())

    def prune(self, now: datetime, max_age: timedelta = S.RETENTION_AGE, max_bytes: int = S.RETENTION_BYTES) -> tuple[int, int]:
        """Drop segments past the age, then the oldest until the rest fits; gives segments and bytes dropped."""
        fs, path = self._fs()
        dropped, freed, left = 0, 0, self.disk_usage()
        for date, hour, size in self.segments():
            end = datetime.fromisoformat(date) + timedelta(hours=int(hour) + 1)
            if end < now.replace(tzinfo=None) - max_age or left > max_bytes:
                fs.delete(path(f"{self.path}/{S.DATE}={date}/{S.HOUR}={hour}"), True)
                dropped, freed, left = dropped + 1, freed + size, left - size
        return dropped, freed

    def retention(self, max_age: timedelta = S.RETENTION_AGE, max_bytes: int = S.RETENTION_BYTES, every: timedelta = S.RETENTION_INTERVAL) -> Callable:
        """A function to call as often as one likes with the time: it prunes once ``every`` so much, the first time at once."""
        last: list[datetime] = []

        def tick(now: datetime) -> tuple[int, int] | None:
            if last and now - last[0] < every:
                return None
            last[:] = [now]
            return self.prune(now, max_age, max_bytes)

        return tick

    def export_json(self, path: str) -> None:
        """JSON Lines by segment."""
        names = [F.col(c) for c in S.ENTRY_COLUMNS]
        self.read().select(*names, S.DATE, S.HOUR).write.partitionBy(S.DATE, S.HOUR).option("timestampFormat", JSON_TIME).json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines segments; lines that can't be read are skipped."""
    return spark.read.schema(S.LOG_ENTRY).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def segment_counts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per segment: entries and bytes of their messages."""
    return df.groupBy(F.to_date(ts).alias(S.DATE), F.hour(ts).alias(S.HOUR)).agg(
        F.count("*").alias("entries"), F.sum(F.octet_length("message")).cast("long").alias("bytes")
    )


def prune_plan(segments: DataFrame, keep_bytes: int | None = None, oldest: Column | None = None) -> DataFrame:
    """``segments`` (dt, hr, bytes: a row a segment) with ``dropped``: too old, or beyond the budget counted from the newest."""
    newest = Window.orderBy(F.col(S.DATE).desc(), F.col(S.HOUR).desc())
    test = F.lit(False)
    if oldest is not None:
        test = test | (F.col(S.DATE) < oldest)
    if keep_bytes is not None:
        test = test | (F.sum("bytes").over(newest) > keep_bytes)
    return segments.withColumn("dropped", test)
