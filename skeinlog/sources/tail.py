"""A streaming source that follows growing files: ``spark.readStream.format("skein_tail")``.

Options: ``paths`` (separated by commas), ``startPosition`` (``beginning`` or ``end``, for a file's first
opening), ``maxLineBytes``, ``maxBytesPerBatch`` (what a batch takes of each file, up to the next line end; 0 for no
bound; it holds from the second batch after a start on, when the reader knows where the query is).  Offsets are part of the query's checkpoint: per path the file's device and inode, the
byte up to which complete lines were read.  Every path is a partition of its own.

A rename leaves the old file's rest to be read, then the new file from its start; a file that shrank is read
from its start.  A line is given once its line end is there; the rest of a rotated file counts as a line.
Lines longer than the limit are cut: the piece at the limit is dropped, and what follows is a new line.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .. import schema as S

CHUNK = 32 << 10


def _complete(path: str, start: int, size: int, most: int = 0) -> int:
    """The byte after the last line end in [start, size), or in its first ``most`` bytes (further if no line ends there)."""
    if most and size - start > most:
        for end in range(start + most, size, most):
            if (found := _complete(path, max(start, end - most), end)) > max(start, end - most):
                return found
        return _complete(path, start, size)
    end = size
    with open(path, "rb") as f:
        while end > start:
            at = max(start, end - CHUNK)
            f.seek(at)
            i = f.read(end - at).rfind(b"\n")
            if i >= 0:
                return at + i + 1
            end = at
    return start


def lines_of(path: str, start: int, end: int, max_line: int = S.TAIL_MAX_LINE) -> Iterator[tuple[str, int]]:
    """(line, offset) of a stretch of a file; the last line needs no line end."""
    with open(path, "rb") as f:
        f.seek(start)
        held, at, pos = bytearray(), start, start
        while pos < end:
            chunk = f.read(min(CHUNK, end - pos))
            if not chunk:
                break
            for b in chunk.splitlines(keepends=True) if b"\r" not in chunk else _by_newline(chunk):
                if not held:
                    at = pos
                pos += len(b)
                held += b
                while len(held.rstrip(b"\n")) > max_line:
                    del held[: max_line + 1]
                    at += max_line + 1
                if held.endswith(b"\n"):
                    line = bytes(held[:-1])
                    line = line[:-1] if line.endswith(b"\r") else line
                    if line:
                        yield line.decode("utf-8", "replace"), at
                    held.clear()
        if held:
            yield bytes(held.removesuffix(b"\r")).decode("utf-8", "replace"), at


def _by_newline(chunk: bytes) -> list[bytes]:
    parts = chunk.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class _Stretch(InputPartition):
    def __init__(self, label: str, path: str, inode: int, start: int, end: int, turn: int = 1):
        self.label, self.path, self.inode, self.start, self.end, self.turn = label, path, inode, start, end, turn


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self.from_end = options.get("startposition", options.get("startPosition", "end")) == "end"
        self.max_line = int(options.get("maxlinebytes", options.get("maxLineBytes", S.TAIL_MAX_LINE)))
        self.most = int(options.get("maxbytesperbatch", options.get("maxBytesPerBatch", 0)))
        self._last: dict | None = None
        self._planned = False

    def initialOffset(self) -> dict:
        out = {}
        for p in self.paths:
            s = os.stat(p) if os.path.exists(p) else None
            out[p] = json.dumps([s.st_dev, s.st_ino, s.st_size if self.from_end else 0] if s else [0, 0, 0])
        self._last = self._last or dict(out)
        return out

    def latestOffset(self) -> dict:
        now = {}
        for p in self.paths:
            known = json.loads((self._last or {}).get(p, "[0, 0, 0]"))
            if not os.path.exists(p):
                now[p] = json.dumps(known)
                continue
            s = os.stat(p)
            same = known[:2] == [s.st_dev, s.st_ino]
            start = known[2] if same and s.st_size >= known[2] else 0
            now[p] = json.dumps([s.st_dev, s.st_ino, _complete(p, start, s.st_size, self.most if self._planned else 0)])
        self._last = dict(now)
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._last, self._planned = dict(end), True
        out = []
        for p in self.paths:
            old, new = json.loads(start.get(p, "[0, 0, 0]")), json.loads(end.get(p, "[0, 0, 0]"))
            if old[:2] == new[:2]:
                begin = old[2] if new[2] >= old[2] else 0
                if new[2] > begin:
                    out.append(_Stretch(p, p, new[1], begin, new[2]))
                continue
            if old[1] and (moved := self._find(p, old[1])):
                size = os.path.getsize(moved)
                if size > old[2]:
                    out.append(_Stretch(p, moved, old[1], old[2], size, 0))
            if new[2]:
                out.append(_Stretch(p, p, new[1], 0, new[2]))
        return out

    @staticmethod
    def _find(path: str, inode: int) -> str | None:
        """Where a renamed file went, if it stayed in its folder."""
        folder = os.path.dirname(path) or "."
        return next((e.path for e in os.scandir(folder) if e.is_file() and e.inode() == inode), None)

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        for line, at in lines_of(partition.path, partition.start, partition.end, self.max_line):
            yield line, partition.label, partition.inode, at, partition.turn

    def commit(self, end: dict) -> None:
        self._last = self._last or end

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_tail"

    def schema(self) -> str:
        return "value string, _path string, _inode long, _offset long, _turn int"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
