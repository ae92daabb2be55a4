"""Removal of repeated byte strings with suffix arrays, built by linear grouping.

A string of ``WINDOW`` bytes counts as repeated where the same bytes start earlier: in a document with a
smaller id, or in the same one further left.  Every byte that a repeated string covers goes.

*Bringing equal strings together.*  Each window of ``WINDOW`` bytes has a minimiser, the smallest hash of
the ``GRAM``-byte strings inside it; equal windows have equal minimisers.  Neighbouring windows with one
minimiser form a run, so a document is cut into runs of some forty windows, and each window is in exactly
one run.  Runs meet by minimiser.  Equal runs are decided at once: all but the earliest are repeats (this
happens inside the map task first, so that thousands of copies send a row a task).  Runs that share a
minimiser but differ, or hold their minimiser twice, can still share windows: their bytes go, a minimiser
at a time, into a suffix array, in which equal windows are neighbours.

*The suffix array* follows the grouping principle: suffixes are put into groups by their Lyndon prefixes.
Groups are taken in descending order; each suffix of a group points to the nearest one before it that is
in a smaller group; those pointed to move to a new group right above their own, further up the more
pointers they got.  At the end each group holds one Lyndon prefix, and a single pass from the smallest
suffix on emits every group's order: a suffix comes next in its group when what follows its Lyndon prefix
is emitted.  Nothing is renamed and there is no recursion.

A minimiser with more than ``CROWD`` differing runs (a very common line with different neighbours) would
make one large task; its windows travel alone, by a 128-bit digest of their bytes.

Defined results: null and empty texts lose nothing; texts shorter than ``WINDOW`` bytes neither; rows with
equal ids count as one document, so of two rows equal in id and text neither is earlier and windows at
equal starts stay; null ids come before all others; an empty table gives an empty one; ids are integers;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, staged
from .shingles import mix

WINDOW, GRAM = 100, 24
CROWD = 1500
LONGEST_RUN, PIECE = 4096, 1 << 20
GATHER = 1_500_000
_U = np.uint64
_NULL = np.iinfo(np.int64).min
FIELDS = (("m", _U), ("c", _U), ("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("n", np.uint16), ("self", np.uint8))


def suffix_array(text: bytes) -> list[int]:
    """Starts of all suffixes in ascending order, by grouping.  A suffix's end is smaller than any byte."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: i for i, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length, size = [1] * len(symbols), list(map(len, members))
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    smaller, closed = list(range(-1, n - 1)), bytearray(n)
    lowest, now = (0 if symbols else -1), len(symbols) - 1

    def raise_(old: int, moved: list[int], times: int, by: int) -> None:
        """Put suffixes of a group into a new one right above it; a group that moves as a whole only grows its prefix."""
        if size[old] == len(moved):
            length[old] += times * by
            members[old] = moved
            return
        new, up = len(length), above[old]
        length.append(length[old] + times * by)
        size[old] -= len(moved)
        size.append(len(moved))
        members.append(moved)
        below.append(old)
        above.append(up)
        above[old] = new
        if up >= 0:
            below[up] = new
        for p in moved:
            group[p] = new

    while now >= 0:
        mine = members[now]
        if size[now] != len(mine):
            mine = members[now] = [s for s in mine if group[s] == now]
        if len(mine) == 1:
            s = mine[0]
            closed[s] = 1
            p = smaller[s]
            while p >= 0 and closed[p]:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                raise_(group[p], [p], 1, length[now])
            now = below[now]
            continue
        for s in mine:
            closed[s] = 1
        pointers: dict[int, int] = {}
        for s in mine:
            p = smaller[s]
            while p >= 0 and closed[p]:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if pointers:
            moving: dict[tuple[int, int], list[int]] = {}
            for p, times in pointers.items():
                moving.setdefault((-times, group[p]), []).append(p)
            for times, old in sorted(moving):
                moved = moving[times, old]
                moved.sort()
                raise_(old, moved, -times, length[now])
        now = below[now]
    # Where each group starts, and which suffixes wait for which.
    free, at, g = [0] * len(length), 0, lowest
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    first, chain = [-1] * (n + 1), [-1] * n
    for i, g in enumerate(group):
        end = i + length[g]
        chain[i] = first[end]
        first[end] = i
    out = [0] * n
    i, s = 0, n
    while True:
        j = first[s]
        while j >= 0:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = chain[j]
        if i == n:
            return out
        s = out[i]
        i += 1


def repeated_windows(runs: list[tuple[tuple[int, int], bytes]], window: int = WINDOW) -> list[list[int]]:
    """For each run ((document, start), bytes): offsets of its windows that also start earlier in some run."""
    # Windows whose hash is alone are alone; each run is trimmed to the stretch between its first and last other ones.
    hashes = [[hash(raw[k : k + window]) for k in range(len(raw) - window + 1)] for _, raw in runs]
    often = Counter(h for hs in hashes for h in hs)
    text, owner, offset = bytearray(), [], []
    for k, ((_, raw), hs) in enumerate(zip(runs, hashes, strict=True)):
        at = [i for i, h in enumerate(hs) if often[h] > 1]
        if not at:
            continue
        valid = at[-1] - at[0] + 1
        text += raw[at[0] : at[-1] + window]
        owner += [k] * valid + [-1] * (window - 1)
        offset += range(at[0], at[-1] + window)
        text.append(0)
        owner.append(-1)
        offset.append(0)
    whole = bytes(text)
    out: list[list[int]] = [[] for _ in runs]
    place = lambda p: (runs[owner[p]][0][0], runs[owner[p]][0][1] + offset[p])
    same: list[int] = []

    def settle() -> None:
        if len(same) > 1:
            least = min(map(place, same))
            for p in same:
                if place(p) != least:
                    out[owner[p]].append(offset[p])

    for p in suffix_array(whole):
        if owner[p] < 0:
            continue
        if same and whole[p : p + window] != whole[same[-1] : same[-1] + window]:
            settle()
            same = []
        same.append(p)
    settle()
    return out


_tables: dict = {}


def _made() -> dict:
    if not _tables:
        base = 0xD6E8FEB86659FD93
        up, down = np.ones(PIECE + WINDOW, _U), np.ones(PIECE + WINDOW, _U)
        up[1:], down[1:] = _U(base), _U(pow(base, -1, 1 << 64))
        _tables["up"], _tables["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _tables["code"] = mix(np.arange(1, 257, dtype=_U) * _U(0x9FB21C651E98DF25))
    return _tables


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``w`` neighbours."""
    n, step = len(x) - w + 1, 1
    while 2 * step <= w:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[:n], x[w - step : w - step + n])


def runs_of(raw: bytes) -> tuple[np.ndarray, ...]:
    """Runs of a piece of text: start, windows, minimiser, digest of the bytes, whether the minimiser is there twice."""
    t, n = _made(), len(raw)
    wide, count = WINDOW - GRAM + 1, n - WINDOW + 1
    with np.errstate(over="ignore"):
        padded = raw + b"\0" * 8
        a, b, c = (np.ndarray((n - GRAM + 1,), "<u8", padded, offset=o, strides=(1,)) for o in (0, 8, 16))
        h = a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F) + c * _U(0x165667B19E3779F9)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        least = _slide(h, wide, np.minimum)
        new = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.concatenate([start, [count]]))
        if size.max() > LONGEST_RUN:
            start = np.unique(np.concatenate([start, *[np.arange(s, s + z, LONGEST_RUN) for s, z in zip(start[size > LONGEST_RUN], size[size > LONGEST_RUN], strict=True)]]))
            size = np.diff(np.concatenate([start, [count]]))
        # Places that are the minimum of some window: the largest of the minima around them is their own hash.
        edge = np.concatenate([np.zeros(wide - 1, _U), least, np.zeros(wide - 1, _U)])
        is_min = np.flatnonzero(_slide(edge, wide, np.maximum) == h)
        twice = np.zeros(len(start), np.uint8)
        near = np.flatnonzero((h[is_min[1:]] == h[is_min[:-1]]) & (np.diff(is_min) < wide + LONGEST_RUN))
        for p, q in zip(is_min[near].tolist(), is_min[near + 1].tolist(), strict=True):
            i, j = np.searchsorted(start, (max(0, q - wide + 1), min(p, count - 1)), "right") - 1
            twice[min(i, j) : max(i, j) + 1] = 1
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(t["code"][np.frombuffer(raw, np.uint8)] * t["up"][:n], dtype=_U)])
        stop = start + size + WINDOW - 1
        digest = mix((sums[stop] - sums[start]) * t["down"][start] + size.astype(_U))
    return start, size, least[start], digest, twice


def _all_runs(raw: bytes) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Runs of a whole text, a piece at a time; pieces overlap so that each window is in one."""
    for at in range(0, len(raw) - WINDOW + 1, PIECE):
        yield at, runs_of(raw[at : at + PIECE + WINDOW - 1])


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _merge(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS}


def _leaders(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in order of minimiser, digest and place: the earliest of each digest, and the others."""
    order = np.lexsort((x["start"], x["doc"], x["c"], x["m"]))
    m, c, doc, start = (x[k][order] for k in ("m", "c", "doc", "start"))
    first = np.ones(len(order), bool)
    first[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    # Rows of one id at one start tie: each counts as the earliest.
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
    tie = (doc == doc[head]) & (start == start[head])
    return order[tie], order[~tie]


def _table(x, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(x, types, strict=True)], names=names)


DECIDED = "doc long, tag long, start long, n long, m long, crowd boolean, decided boolean"
_DECIDED_NAMES = ["doc", "tag", "start", "n", "m", "crowd", "decided"]


def _decided(x: dict, at: np.ndarray, decided: bool, crowd: np.ndarray | None = None) -> pa.RecordBatch:
    crowd = np.zeros(len(at), bool) if crowd is None else crowd
    cols = [x["doc"][at], x["tag"][at].astype(np.int64), x["start"][at].astype(np.int64), x["n"][at].astype(np.int64), np.ascontiguousarray(x["m"][at]).view(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(crowd), pa.array(np.full(len(at), decided))], names=_DECIDED_NAMES)


def _meet_by_minimiser(rows: DataFrame, parts: int) -> DataFrame:
    """Runs that are repeats as a whole (decided), and those whose windows have to be compared."""
    spread = 4 * parts
    names = ["part", *[k for k, _ in FIELDS]]

    def emit(parts_: list[dict]) -> pa.RecordBatch:
        x = _merge(parts_)
        lead, rest = _leaders(x)
        out = []
        p = (x["m"][lead] % _U(spread)).astype(np.int64)
        order = lead[np.argsort(p, kind="stable")]
        cut = np.searchsorted(np.sort(p), np.arange(spread + 1))
        for k in range(spread):
            at = order[cut[k] : cut[k + 1]]
            if len(at):
                out.append((k, *[np.ascontiguousarray(x[f][at]).tobytes() for f, _ in FIELDS]))
        if len(rest):  # repeats of a run of this task travel as decided: no minimiser column
            out.append((int(x["doc"][rest[0]] % spread), None, *[np.ascontiguousarray(x[f][rest]).tobytes() for f, _ in FIELDS[1:]]))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in range(1, 1 + len(FIELDS))]], names=names)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = _raw(text.as_py())
                tag = zlib.crc32(raw)
                for at, (start, size, m, c, twice) in _all_runs(raw):
                    k = len(start)
                    held.append({"m": m, "c": c, "doc": np.full(k, _NULL if doc is None else doc), "tag": np.full(k, tag, np.uint32), "start": (start + at).astype(np.uint32), "n": size.astype(np.uint16), "self": twice})
                    n += k
                if n > GATHER:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                x = {f: np.frombuffer(row[f], t) if row[f] is not None else None for f, t in FIELDS}
                if x["m"] is None:
                    x["m"] = np.zeros(len(x["c"]), _U)
                    yield _decided(x, np.arange(len(x["c"])), True)
                else:
                    held.append(x)
        if not held:
            return
        x = _merge(held)
        lead, rest = _leaders(x)
        yield _decided(x, rest, True)
        m = x["m"][lead]
        new = np.ones(len(lead), bool)
        new[1:] = m[1:] != m[:-1]
        where = np.cumsum(new) - 1
        together = np.bincount(where)[where] if len(lead) else where
        twice = np.zeros(int(new.sum()), bool)
        np.logical_or.at(twice, where, x["self"][lead] > 0)
        open_ = (together > 1) | (twice[where] if len(lead) else False)
        yield _decided(x, lead[open_], False, (together > CROWD)[open_])

    sent = rows.mapInArrow(cut_up, "part int, " + ", ".join(f"{k} binary" for k, _ in FIELDS))
    return sent.repartition(parts, "part").mapInArrow(met, DECIDED)


def _with_bytes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs' bytes: m, doc, tag, start, raw; of crowded minimisers each window apart, m its digest."""
    per_doc = runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "m", "crowd")).alias("runs"))
    joined = rows.select(F.coalesce("i_", F.lit(int(_NULL))).alias("d_"), "x_").join(per_doc, F.col("d_") == F.col("doc")).select("doc", "tag", "x_", "runs")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = _raw(row["x_"])
                if zlib.crc32(raw) != row["tag"]:
                    continue  # another row of the same id
                for r in row["runs"]:
                    s, n = r["start"], r["n"]
                    if not r["crowd"]:
                        out.append((r["m"], row["doc"], row["tag"], s, raw[s : s + n + WINDOW - 1], False))
                        continue
                    for k in range(s, s + n):
                        d = hashlib.blake2b(raw[k : k + WINDOW], digest_size=16).digest()
                        out.append((int.from_bytes(d[:8], "little", signed=True), row["doc"], row["tag"], k, d, True))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield _table(cols, ["m", "doc", "tag", "start", "raw", "single"], types)

    return joined.mapInArrow(sliced, "m long, doc long, tag long, start long, raw binary, single boolean")


def _compare(pieces: DataFrame, parts: int) -> DataFrame:
    """Windows that start earlier elsewhere: doc, tag, start, n (neighbouring windows as one row)."""

    def settle(rows: list[dict], out: list) -> None:
        if rows[0]["single"]:
            by: dict[bytes, list[dict]] = {}
            for r in rows:
                by.setdefault(r["raw"], []).append(r)
            for same in by.values():
                least = min((r["doc"], r["start"]) for r in same)
                out += [(r["doc"], r["tag"], r["start"], 1) for r in same if (r["doc"], r["start"]) != least]
            return
        unique: dict[tuple, dict] = {}
        for r in rows:
            unique.setdefault((r["doc"], r["tag"], r["start"]), r)
        rows = sorted(unique.values(), key=lambda r: (r["doc"], r["start"]))
        for r, offsets in zip(rows, repeated_windows([((r["doc"], r["start"]), r["raw"]) for r in rows]), strict=True):
            if offsets:
                o = np.sort(np.array(offsets))
                cut = np.flatnonzero(np.diff(o) != 1) + 1
                for part in np.split(o, cut):
                    out.append((r["doc"], r["tag"], r["start"] + int(part[0]), len(part)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list = []
        names, types = ["doc", "tag", "start", "n"], [pa.int64()] * 4
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["m"], held[0]["single"]) != (row["m"], row["single"]):
                    settle(held, out)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield _table(list(zip(*out, strict=True)), names, types)
                out = []
        if held:
            settle(held, out)
        if out:
            yield _table(list(zip(*out, strict=True)), names, types)

    together = pieces.repartition(parts, "single", "m").sortWithinPartitions("single", "m")
    return together.mapInArrow(compared, "doc long, tag long, start long, n long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated windows as rows (doc, tag, start, n): ``n`` neighbouring starts; ``tag`` is the crc32 of the row's text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(docs, id_col).cast("long").alias("i_"), col(docs, text_col).alias("x_"))
    met = staged(_meet_by_minimiser(rows, parts), "runs")
    more = _compare(_with_bytes(rows, met.where("not decided")), parts)
    return staged(met.where("decided").select("doc", "tag", "start", "n").union(more), "repeats")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes), ``kept_sha256``, ``spans`` (start, stop)."""
    spans = repeated_spans(docs, id_col, text_col)
    per_doc = spans.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    per_doc = per_doc.groupBy("doc").agg(F.collect_list(F.struct("tag", "starts", "ns")).alias("by_tag"))
    rows = docs.select(col(docs, id_col).alias("i_"), F.coalesce(col(docs, id_col).cast("long"), F.lit(int(_NULL))).alias("d_"), col(docs, text_col).alias("x_"))
    joined = rows.join(per_doc, F.col("d_") == F.col("doc"), "left").select("i_", "x_", "by_tag")
    kind = joined.select("i_").schema[0].dataType.simpleString()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, by_tag in zip(batch.column(1), batch.column(2), strict=True):
                raw = _raw(text.as_py())
                found, kept = [], raw
                if by_tag.as_py():
                    tag = zlib.crc32(raw)
                    for x in by_tag.as_py():
                        if x["tag"] == tag:
                            found = _union(np.array(x["starts"]), np.array(x["ns"]))
                    at, pieces = 0, []
                    for s, e in found:
                        pieces.append(raw[at:s])
                        at = e
                    kept = b"".join([*pieces, raw[at:]])
                spans_ = [{"start": s, "stop": e} for s, e in found]
                out.append((len(raw), len(raw) - len(kept), len(found), kept, hashlib.sha256(kept).hexdigest(), spans_))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), span_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    return joined.mapInArrow(applied, schema)


def _union(start: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the windows cover."""
    order = np.argsort(start, kind="stable")
    out: list[list[int]] = []
    for s, k in zip(start[order].tolist(), n[order].tolist(), strict=True):
        e = s + k + WINDOW - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
