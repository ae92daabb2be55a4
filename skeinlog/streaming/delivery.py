"""Delivery to a server: retry or give up, back off, send, spool."""

from __future__ import annotations

import json
import random
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import timedelta

from .. import schema as S
from ..operators.spool import Spool


class Permanent(Exception):
    """The server won't take this batch."""


class Temporary(Exception):
    """Worth trying again."""


def classify(status: int) -> type[Exception] | None:
    if status in (200, 202):
        return None
    return Temporary if status == 429 or status >= 500 else Permanent


def is_retryable(error: BaseException) -> bool:
    return isinstance(error, Temporary | OSError) and not isinstance(error, Permanent)


def backoff(
    attempt: int, initial: timedelta = S.BACKOFF_INITIAL, most: timedelta = S.BACKOFF_MAX, factor: float = S.BACKOFF_FACTOR, rng: random.Random | None = None
) -> timedelta:
    """Exponential with jitter from half to one and a half, never above ``most`` nor below half of ``initial``."""
    initial = initial if initial > timedelta(0) else S.BACKOFF_INITIAL
    most = most if most > timedelta(0) else S.BACKOFF_MAX
    factor = factor if factor > 1 else S.BACKOFF_FACTOR
    base = min(most.total_seconds(), initial.total_seconds() * factor ** min(max(attempt, 0), 64))
    jittered = base * (rng or random).uniform(0.5, 1.5)
    return timedelta(seconds=max(min(jittered, most.total_seconds()), initial.total_seconds() / 2))


class Sender:
    """POSTs batches; ``post`` can be replaced in tests."""

    def __init__(self, url: str, token: str = "", timeout: timedelta = timedelta(seconds=10), post: Callable[[bytes], tuple[int, bytes]] | None = None):
        self.url, self.token, self.timeout = url, token, timeout
        self.post = post or self._post

    def _post(self, body: bytes) -> tuple[int, bytes]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout.total_seconds()) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def send(self, agent: str, events: list[dict]) -> dict:
        status, body = self.post(json.dumps({"agent_id": agent, "events": events}, default=str).encode())
        if kind := classify(status):
            raise kind(f"status {status}")
        try:
            return json.loads(body or b"{}")
        except ValueError:
            return {}


def deliver(sender: Sender, spool: Spool | None, agent: str, events: list[dict]) -> str:
    """``sent``, ``spooled`` or ``dropped``."""
    try:
        sender.send(agent, events)
        return "sent"
    except Exception as e:  # noqa: BLE001
        if not is_retryable(e):
            return "dropped"
        if spool is None:
            raise
        spool.push(events)
        return "spooled"


def drain(sender: Sender, spool: Spool, agent: str) -> int:
    """Sends spooled batches, oldest first, until one can't go; batches leave the spool once delivered."""
    sent = 0
    while found := spool.peek():
        path, events = found
        try:
            sender.send(agent, events)
        except Exception as e:  # noqa: BLE001
            if is_retryable(e):
                return sent
        spool.done(path)
        sent += 1
    return sent


def batch_writer(sender: Sender, spool: Spool | None, agent: str, size: int = S.FLUSH_EVENTS):
    """A ``foreachBatch`` function that sends a micro-batch in requests of ``size`` events, one partition at a time."""

    def run(batch, _number: int) -> None:
        held: list[dict] = []
        for row in batch.toLocalIterator():
            held.append({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
            if len(held) >= size:
                deliver(sender, spool, agent, held)
                held = []
        if held:
            deliver(sender, spool, agent, held)

    return run
