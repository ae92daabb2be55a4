"""The spool: batches kept while the server can't be reached, first in first out."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


class Spool:
    """Files of one batch each, named so that their order is that of their making; an agent's local folder."""

    def __init__(self, folder: str, max_bytes: int = S.SPOOL_MEGABYTES << 20):
        self.folder, self.max_bytes = folder, max_bytes
        os.makedirs(folder, exist_ok=True)

    def files(self) -> list[str]:
        return sorted(f for f in os.listdir(self.folder) if f.startswith("spool_") and f.endswith(".json"))

    def size(self) -> tuple[int, int]:
        """Bytes, events."""
        paths = [os.path.join(self.folder, f) for f in self.files()]
        return sum(map(os.path.getsize, paths)), sum(len(json.load(open(p))["events"]) for p in paths)

    def push(self, events: list[dict]) -> None:
        """Written aside, then renamed; the oldest batches go if the spool is too large."""
        if not events:
            return
        batch = str(uuid.uuid4())
        name = os.path.join(self.folder, f"spool_{time.time_ns():020d}_{batch}.json")
        with open(name + ".tmp", "w") as f:
            json.dump({"id": batch, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "events": events}, f)
        os.replace(name + ".tmp", name)
        files = self.files()
        while len(files) > 1 and sum(os.path.getsize(os.path.join(self.folder, f)) for f in files) > self.max_bytes:
            os.remove(os.path.join(self.folder, files.pop(0)))

    def peek(self) -> tuple[str, list[dict]] | None:
        """The oldest batch; files that can't be read go."""
        for f in self.files():
            path = os.path.join(self.folder, f)
            try:
                with open(path) as x:
                    return path, json.load(x)["events"]
            except (ValueError, KeyError):
                os.remove(path)
        return None

    def pop(self) -> list[dict] | None:
        found = self.peek()
        if not found:
            return None
        self.done(found[0])
        return found[1]

    @staticmethod
    def done(path: str) -> None:
        """Forget a batch; called after its delivery, so that a crash repeats it instead of losing it."""
        os.remove(path)


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Spool files as rows in order: name, id, timestamp, events."""
    files = spark.read.schema(S.SPOOL_BATCH).option("mode", "DROPMALFORMED").option("wholetext", True).json(f"{path}/spool_*.json")
    return files.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("name")


def batches(df: DataFrame, size: int = S.MAX_BATCH_EVENTS, order: str = S.SEQ) -> DataFrame:
    """``df`` with ``batch``: consecutive arrivals by ``size``; ``order`` counts from 0 without holes."""
    return df.withColumn("batch", F.floor(F.col(order) / size))


def capped(batch_sizes: DataFrame, max_bytes: int) -> DataFrame:
    """``batch_sizes`` (batch, bytes) with ``kept``: the newest that fit, as the spool's cap leaves them."""
    newest = Window.orderBy(F.col("batch").desc())
    return batch_sizes.withColumn("kept", (F.sum("bytes").over(newest) <= max_bytes) | (F.row_number().over(newest) == 1))
