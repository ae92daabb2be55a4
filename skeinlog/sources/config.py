"""Configuration files: YAML with ``${NAME}`` and ``${NAME:-default}``, defaults, checks."""

from __future__ import annotations

import os
import re
import socket
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import timedelta

from .. import schema as S

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)")
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


class ConfigError(ValueError):
    pass


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """Variables by their values; unset or empty ones by their default, else by nothing."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)


def duration(text: str | int | float | timedelta) -> timedelta:
    """``1h30m``, ``500ms``; plain numbers are seconds."""
    if isinstance(text, timedelta):
        return text
    if isinstance(text, int | float):
        return timedelta(seconds=text)
    if _DURATION.sub("", text.strip()):
        raise ConfigError(f"not a duration: {text!r}")
    return timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in _DURATION.findall(text)))


@dataclass(frozen=True)
class Source:
    name: str = ""
    path: str = ""
    format: str = "auto"
    pattern: str = ""
    start_position: str = "end"
    tags: dict[str, str] = field(default_factory=dict)

    def checked(self, number: int) -> Source:
        out = replace(self, format=self.format.strip().lower() or "auto", start_position=self.start_position.strip().lower() or "end")
        if not out.name.strip():
            raise ConfigError(f"source {number} has no name")
        if not out.path.strip():
            raise ConfigError(f"source {out.name!r} has no path")
        if out.format not in ("auto", "text", "json", "regexp"):
            raise ConfigError(f"source {out.name!r} has unsupported format {self.format!r}")
        if out.format == "regexp" and not out.pattern.strip():
            raise ConfigError(f"source {out.name!r} needs a pattern")
        if out.start_position not in ("beginning", "end"):
            raise ConfigError(f"source {out.name!r} starts at 'beginning' or 'end'")
        return out


@dataclass(frozen=True)
class Agent:
    id: str = field(default_factory=socket.gethostname)
    host: str = field(default_factory=socket.gethostname)
    server_url: str = "http://localhost:8080"
    timeout: timedelta = timedelta(seconds=10)
    max_events: int = S.FLUSH_EVENTS
    flush_interval: timedelta = S.FLUSH_INTERVAL
    max_queue_events: int = S.QUEUE_EVENTS
    initial_backoff: timedelta = S.BACKOFF_INITIAL
    max_backoff: timedelta = S.BACKOFF_MAX
    backoff_multiplier: float = S.BACKOFF_FACTOR
    spool_enabled: bool = True
    spool_directory: str = "./data/agent-spool"
    spool_max_size_mb: int = S.SPOOL_MEGABYTES
    sources: tuple[Source, ...] = ()

    def checked(self) -> Agent:
        if not self.id.strip():
            raise ConfigError("the agent has no id")
        if not self.server_url.strip():
            raise ConfigError("the agent has no server")
        if self.spool_enabled and not self.spool_directory.strip():
            raise ConfigError("the spool has no directory")
        base = Agent()
        positive = ("max_events", "max_queue_events", "flush_interval", "initial_backoff", "max_backoff", "spool_max_size_mb")
        fixed = {n: getattr(base, n) for n in positive if not getattr(self, n) > type(getattr(self, n))(0)}
        if self.backoff_multiplier <= 1:
            fixed["backoff_multiplier"] = S.BACKOFF_FACTOR
        return replace(self, host=self.host.strip() or self.id, sources=tuple(s.checked(i) for i, s in enumerate(self.sources)), **fixed)


@dataclass(frozen=True)
class Server:
    address: str = ":8080"
    directory: str = "./data/logs"
    auth_enabled: bool = False
    auth_tokens: tuple[str, ...] = ()
    tls_enabled: bool = False
    tls_cert_file: str = ""
    tls_key_file: str = ""
    max_batch_events: int = S.MAX_BATCH_EVENTS
    max_message_bytes: int = S.MAX_MESSAGE_BYTES
    dedup_window: timedelta = S.DEDUP_WINDOW
    recent_events: int = S.RING_CAPACITY
    max_clients: int = S.MAX_CLIENTS
    client_buffer_size: int = S.CLIENT_BUFFER
    retention_enabled: bool = True
    max_size_gb: int = 10
    max_age_hours: int = 168
    check_interval: timedelta = S.RETENTION_INTERVAL

    def checked(self) -> Server:
        if not self.address.strip():
            raise ConfigError("the server has no address")
        if not self.directory.strip():
            raise ConfigError("the storage has no directory")
        if self.auth_enabled and not self.auth_tokens:
            raise ConfigError("auth is enabled but has no tokens")
        if self.tls_enabled and not (self.tls_cert_file and self.tls_key_file):
            raise ConfigError("tls needs a certificate and a key")
        base = Server()
        names = ("max_batch_events", "max_message_bytes", "recent_events", "max_clients")
        return replace(self, **{n: getattr(base, n) for n in names if getattr(self, n) <= 0})


def _flat(raw: Mapping, prefix: str = "") -> dict:
    out = {}
    for k, v in raw.items():
        if isinstance(v, Mapping) and k != "tags":
            out |= _flat(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


#: Where file keys are named otherwise than the settings.
_NAMES = {
    "agent.id": "id", "agent.host": "host", "server.url": "server_url", "server.timeout": "timeout", "spool.enabled": "spool_enabled",
    "spool.directory": "spool_directory", "spool.max_size_mb": "spool_max_size_mb", "server.address": "address", "storage.directory": "directory",
    "auth.enabled": "auth_enabled", "auth.tokens": "auth_tokens", "tls.enabled": "tls_enabled", "tls.cert_file": "tls_cert_file",
    "tls.key_file": "tls_key_file", "retention.enabled": "retention_enabled",
}


def load(text: str, kind: type, env: Mapping[str, str] | None = None):
    """An ``Agent`` or ``Server`` from YAML text; unknown keys are ignored."""
    import yaml

    raw = _flat(yaml.safe_load(expand(text, env)) or {})
    known = {f.name: f for f in fields(kind)}
    found = {}
    for key, value in raw.items():
        name = _NAMES.get(key, key.rpartition(".")[2])
        if name not in known or value is None:
            continue
        if name == "sources":
            value = tuple(Source(**{k: v for k, v in s.items() if k in {f.name for f in fields(Source)}}) for s in value)
        elif "timedelta" in str(known[name].type):
            value = duration(value)
        elif isinstance(value, list):
            value = tuple(map(str, value))
        found[name] = value
    out = kind(**found)
    assert is_dataclass(out)
    return out.checked()
