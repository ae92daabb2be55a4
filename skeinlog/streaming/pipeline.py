"""The ingest stream: lines to entries to the store, the ring and the subscribers."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import dedup, ingest
from ..operators.parse import Context, line_id, parse_lines
from ..operators.store import LogStore
from .dedup import mark_within_window
from .metrics import Registry


def entries(lines: DataFrame, fmt: str, ctx: Context, now: Column, pattern: str = "") -> DataFrame:
    """Entries of tailed lines; ids come from where a line stands, so a repeated task repeats them."""
    out = parse_lines(lines, fmt, ctx, now, pattern)
    named = out.withColumn("id", line_id(F.lit(ctx.host), F.col("_path"), F.col("_inode"), F.col("_offset")))
    # Offsets alone say nothing across files; a renamed file's rest comes before what took its place.
    order = F.struct(F.current_timestamp().alias("arrival"), F.col("_path").alias("path"), F.col("_turn").alias("turn"), F.col("_offset").alias("offset"))
    return named.select(*S.ENTRY_COLUMNS, F.current_timestamp().alias(S.ARRIVAL), order.alias(S.SEQ))


def checked(stream: DataFrame, max_message_bytes: int = S.MAX_MESSAGE_BYTES, window: timedelta = S.DEDUP_WINDOW, expire: bool = True) -> DataFrame:
    """The stream's entries after the checks, marked where they repeat an entry of this batch or an earlier one."""
    return mark_within_window(ingest.validate(stream, F.current_timestamp(), max_message_bytes), window=window, expire=expire)


class Ring:
    """The newest entries by arrival."""

    def __init__(self, capacity: int = S.RING_CAPACITY):
        self.held: deque = deque(maxlen=capacity if capacity > 0 else S.RING_CAPACITY_LIBRARY)

    def add(self, rows) -> None:
        self.held.extend(rows)

    def snapshot(self, limit: int = 0) -> list:
        n = len(self.held)
        k = n if limit <= 0 else min(limit, n)
        return list(self.held)[n - k :]

    def __len__(self) -> int:
        return len(self.held)


class Hub:
    """Live subscribers with bounded buffers; one that falls behind is let go."""

    def __init__(self, ring: Ring, max_clients: int = S.MAX_CLIENTS, buffer: int = S.CLIENT_BUFFER):
        self.ring, self.max_clients, self.buffer = ring, max_clients, buffer
        self.clients: dict[int, deque] = {}
        self.gone: dict[int, str] = {}
        self._next = 0

    def subscribe(self) -> int:
        if len(self.clients) >= self.max_clients:
            raise RuntimeError("too many clients")
        self._next += 1
        recent = self.ring.snapshot(S.REPLAY)
        self.clients[self._next] = deque([envelope("recent_batch", recent)] if recent else [])
        return self._next

    def unsubscribe(self, client: int, reason: str = "closed") -> None:
        if self.clients.pop(client, None) is not None:
            self.gone[client] = reason

    def broadcast(self, rows: list) -> None:
        self.ring.add(rows)
        for row in rows:
            message = envelope("log", row)
            for client, held in list(self.clients.items()):
                if len(held) >= self.buffer:
                    self.unsubscribe(client, "buffer_overflow")
                else:
                    held.append(message)

    def frame(self, client: int) -> str:
        """All that waits for a client, as one frame of lines."""
        held = self.clients[client]
        out = "\n".join(held)
        held.clear()
        return out


def envelope(kind: str, data) -> str:
    return json.dumps({"type": kind, "data": data}, default=str, separators=(",", ":"))


def envelopes(df: DataFrame) -> DataFrame:
    """The same as a column, for sinks that write messages."""
    return df.select(F.to_json(F.struct(F.lit("log").alias("type"), F.struct(*S.ENTRY_COLUMNS).alias("data"))).alias("value"))


def writer(
    store: LogStore, hub: Hub | None = None, max_message_bytes: int = S.MAX_MESSAGE_BYTES, on_summary: Callable | None = None,
    name: str = "stream", retention: Callable | None = None, figures: Registry | None = None,
):
    """A ``foreachBatch`` function: check, drop repeats, append, count, publish, prune when it is time.

    Entries that come out of ``checked`` are taken as marked there; others are checked here, and repeats are those
    of the batch alone.  A batch that is tried again replaces what its first attempt wrote: ``name`` and the
    batch's number name the load.  ``figures`` counts what comes in and what is stored.
    """

    def run(batch: DataFrame, number: int) -> None:
        if "_duplicate" not in batch.columns:
            batch = dedup.mark_accepted(ingest.validate(batch, F.current_timestamp(), max_message_bytes, F.lit(None).cast("string")))
        marked = batch.persist()
        good = marked.where(F.col("_error").isNull() & ~F.col("_duplicate"))
        store.append(good.select(*S.ENTRY_COLUMNS, S.ARRIVAL, S.SEQ), f"{name}-{number}")
        if on_summary or figures:
            row = ingest.summary(marked.withColumn("batch", F.lit(number)), ["batch"]).first()
            if on_summary and row:
                on_summary(number, row)
            if figures and row:
                for kind, name_of in (("accepted", "ingested"), ("duplicates", "duplicate"), ("errors", "rejected")):
                    figures.add(f"{name_of}_events_total", row[kind])
        if hub is not None:
            # A subscriber can't hold more than its buffer; the newest fill the ring.
            newest = good.orderBy(F.col(S.SEQ).desc()).limit(S.RING_CAPACITY).select(*S.ENTRY_COLUMNS).collect()
            hub.broadcast([r.asDict(recursive=True) for r in reversed(newest)])
        marked.unpersist()
        if retention:
            retention(datetime.now(timezone.utc).replace(tzinfo=None))

    return run
