"""Counters, gauges and histograms in the text format that scrapers read, fed by streaming progress."""

from __future__ import annotations

from bisect import bisect_left

from ..operators.aggregates import BUCKETS

# Names and kinds.
AGENT = {
    "events_read_total": "counter", "events_parsed_total": "counter", "parse_errors_total": "counter", "events_sent_total": "counter",
    "send_errors_total": "counter", "queue_size": "gauge", "spool_bytes": "gauge", "spool_events": "gauge", "reconnects_total": "counter",
}
SERVER = {
    "ingested_events_total": "counter", "duplicate_events_total": "counter", "rejected_events_total": "counter", "storage_bytes": "gauge",
    "active_agents": "gauge", "active_clients": "gauge", "dropped_clients_total": "counter", "ingest_duration_seconds": "histogram",
    "query_duration_seconds": "histogram",
}


class Registry:
    def __init__(self, prefix: str, kinds: dict[str, str]):
        self.prefix, self.kinds = prefix, kinds
        self.values: dict[tuple[str, tuple], float] = {}
        self.durations: dict[str, list] = {n: [[0] * (len(BUCKETS) + 1), 0.0] for n, k in kinds.items() if k == "histogram"}

    def add(self, name: str, by: float = 1, **labels: str) -> None:
        key = (name, tuple(sorted(labels.items())))
        self.values[key] = self.values.get(key, 0) + by

    def set(self, name: str, value: float, **labels: str) -> None:
        self.values[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, seconds: float) -> None:
        counts, total = self.durations[name]
        counts[bisect_left(BUCKETS, seconds)] += 1
        self.durations[name][1] = total + seconds

    def render(self) -> str:
        out = []
        for name, kind in self.kinds.items():
            full = f"{self.prefix}_{name}"
            out.append(f"# TYPE {full} {kind}")
            if kind == "histogram":
                counts, total = self.durations[name]
                n = 0
                for bound, c in zip([*map(str, BUCKETS), "+Inf"], counts, strict=True):
                    n += c
                    out.append(f'{full}_bucket{{le="{bound}"}} {n}')
                out += [f"{full}_sum {total:g}", f"{full}_count {n}"]
                continue
            found = [(labels, v) for (n, labels), v in sorted(self.values.items()) if n == name] or [((), 0)]
            for labels, v in found:
                inner = ",".join(f'{k}="{x}"' for k, x in labels)
                out.append(f"{full}{'{' + inner + '}' if inner else ''} {v:g}")
        return "\n".join(out) + "\n"
