"""N-gram Jaccard join with a count-vector R-tree.

A document is a set of hashed word shingles.  Hashing the shingles into ``GROUPS`` groups turns the set
into a point, the vector of the groups' counts (more groups for larger sets, folded to compare); two sets share at most the sum of the smaller of each pair
of coordinates.  An R-tree over the points bounds that sum for whole boxes, and pairs that survive are
verified on the sets themselves.

An R-tree alone compares almost every pair of documents of like length: in so many dimensions its boxes
overlap.  Documents are therefore first brought together by their prefixes.  All shingles have one order, those that
few sets have first; a set's prefix are its first ``n - ceil(percent * n / 100) + 1`` shingles, and sets
that are similar enough share a shingle of their prefixes.  How many sets have a shingle is counted over all sets; a
set with as many shingles of its own as its prefix holds has no partner, and passages that many sets share are
in few prefixes, so the passages do not chain unlike sets into one cluster.  Sets that share a
prefix's shingle, directly or over others, form a cluster, and no link leaves a cluster.

Clusters are refined before a set moves: only the points of their sets, made when the texts are first read, go to the
R-trees, one for each band of sizes of a cluster, and sets whose boxes and points leave room for a link stay
together.  The sets of what is left then meet in the same way and are verified.  A cluster beyond ``POINTS`` points or
``BLOCK`` shingles is split into blocks, every pair of blocks a task of its own.

Equal sets are one node from the start, so copies never pair up.  Inside a task, boxes and pairs that are
already connected are skipped: what is kept are links enough to connect what is connected, each of them
verified.

Defined results: null, empty and blank texts have no shingle and link with nothing; a text with fewer
words than a shingle has one, of all its words; equal rows are in one component; rows whose ids are null
take part, and a component's id is its smallest id that is not null; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_staged, fresh, quoted, staged
from .graph import components
from .shingles import mix, shingle_set

#: Fewest groups of a point, and most shingles a group has on average.
GROUPS, PER_GROUP = 128, 6
#: Most shingles of a task's sets; a cluster beyond that is split into blocks.
BLOCK = 2_000_000
#: Most points of a task.
POINTS = 20_000
#: The filter of candidate sets' names has two to this power bits, whatever the input.
FILTER_BITS = 26
LEAF = 48
#: Shingles that a map task gathers before it passes them on, and that a part counts.
GATHER, COUNTED = 3_000_000, 4_000_000
#: Bytes of a shingle's hash beside its part, and of a shared shingle's: equal ones only add candidates.
KEY_BYTES, TOKEN_BYTES = 5, 6
_U = np.uint64


class Levels:
    """Size levels and the number of groups that similar sets of a level need.

    The join brought sets together by these keys before it did by prefixes; its tests still name them.
    """

    def __init__(self, percent: int):
        self.percent, self.first, self.groups = percent, [1], []

    def _upto(self, n: int) -> None:
        while self.first[-1] <= n or len(self.groups) < len(self.first) - 1:
            low = self.first[-1]
            self.first.append(int(low * (100 / self.percent) ** 2) + 1)
            d = 2 * (self.first[-1] - 1) * (100 - self.percent) // (100 + self.percent)
            # As many groups more as the smallest set of the level is likely to leave empty.
            least, spare = max(1.0, low * self.percent / 100), 0
            for _ in range(8 if d else 0):
                k = d + 1 + spare
                spare = math.ceil(k * math.exp(-least / k) + 2 * math.sqrt(k * math.exp(-least / k)))
            self.groups.append((d + 1 + spare, spare))

    def of(self, n: int) -> list[int]:
        """The levels at which a set of ``n`` takes part: its own, and the next if a larger partner may be there."""
        self._upto(n + 1)
        own = int(np.searchsorted(self.first, n, "right")) - 1
        self._upto(self.first[own + 1])
        return [own, own + 1] if 100 * n >= self.percent * self.first[own + 1] else [own]

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set: similar sets share at least one.

        With ``spare`` groups more than differences need, that many of the equal groups may be empty.  A set
        with more empty groups than that is hashed once more by another seed (so is any such partner).
        """
        out = []
        for level in self.of(len(h)):
            k, spare = self.groups[level]
            for turn in range(8):
                g = (mix(h + _U(turn * 0x632BE59BD9B4E019 % (1 << 64))) >> _U(11)) % _U(k)
                g = g.astype(np.int64)
                count = np.bincount(g, minlength=k)
                content = np.zeros(k, _U)
                np.add.at(content, g, mix(h ^ _U(0x2545F4914F6CDD1D)))
                full = count > 0
                last = turn == 7
                use = np.flatnonzero(full) if not last else np.arange(k)
                tag = _U(level * 64 + turn) << _U(40)
                out.append(mix(content[use] + mix(tag + use.astype(_U)) + count[use].astype(_U)))
                if k - full.sum() <= spare:
                    break
        return np.concatenate(out)


def _identity(h: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set."""
    with np.errstate(over="ignore"):
        a = int(np.sum(mix(h + _U(1)), dtype=_U)) ^ len(h) * 0x9E3779B97F4A7C15 % (1 << 64)
        b = int(np.sum(mix(h ^ _U(0xA0761D6478BD642F)), dtype=_U))
    return a, b


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=_U).view(np.int64))


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, node) pairs: links of each node to its key's smallest one, and (key, smallest) of every key."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    hub = node[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else node
    other = node != hub
    links = np.unique(np.stack([node[other], hub[other]], 1), axis=0) if other.any() else np.zeros((0, 2), _U)
    return links[:, 0], links[:, 1], key[new], node[new]


def _cut(order: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has rows, and the places of its rows, in the given order."""
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def _packet_nodes(node: np.ndarray) -> tuple[bytes, bytes]:
    """Different nodes of a packet, and the place of each row's node among them."""
    nodes, place = np.unique(node, return_inverse=True)
    return nodes.tobytes(), place.astype(np.uint16 if len(nodes) <= 1 << 16 else np.uint32).tobytes()


def _unpacked(nodes: bytes, place: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(nodes, _U)[np.frombuffer(place, np.uint16 if len(place) == 2 * rows else np.uint32)]


def _low(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each number."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(_U).ravel()


def shared_tokens(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, level) of the keys that several nodes have, each pair once; level is the logarithm of their number."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    often = np.zeros(len(key), bool)
    often[1:] = same
    often[:-1] |= same
    at = order[often]
    at = at[np.lexsort((node[at], key[at]))]
    key, node = key[at], node[at]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    count = np.diff(np.append(np.flatnonzero(start), len(key)))
    count = np.repeat(count, count)
    several = count > 1
    return key[several], node[several], np.log2(count[several]).astype(np.uint8)


def rarest(node: np.ndarray, level: np.ndarray, token: np.ndarray, names: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the shared tokens are in their sets' prefixes; ``names`` (sorted) and ``sizes`` are of all sets.

    The order of all shingles is by level, then by token; a set's shingles that no other has come first.
    """
    order = np.lexsort((token, level, node))
    of = node[order]
    start = np.ones(len(of), bool)
    start[1:] = of[1:] != of[:-1]
    first = np.flatnonzero(start)
    shared = np.diff(np.append(first, len(of)))
    n = sizes[np.searchsorted(names, of[first])]
    wanted = n - -(-n * percent // 100) + 1 - (n - shared)
    rank = np.arange(len(of)) - np.repeat(first, shared)
    return order[rank < np.repeat(wanted, shared)]


def candidate_links(values: DataFrame, sizes: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Links (a, b) between sets that share a shingle of their prefixes; enough of them to connect all that do.

    ``values`` has the texts, ``sizes`` the sets (set_a, n).
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, nodes, n = set(), [], [], 0

        def flush() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.repeat(np.array(nodes, _U), [len(k) for k in keys])
            part = (key % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            out = [(p, *_packet_nodes(node[at]), _low(key[at] // _U(parts), KEY_BYTES)) for p, at in _cut(np.argsort(part, kind="stable"), part, parts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "nodes", "place", "key"])

        for batch in batches:
            for value in batch.column(0):
                h = shingle_set(value.as_py(), width)
                if not len(h) or (name := _identity(h)[0]) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                keys.append(h)
                nodes.append(name)
                n += len(h)
                if n > GATHER:
                    yield flush()
                    keys, nodes, n = [], [], 0
        if keys:
            yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for p, *packet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(p, []).append(packet)
        while by:
            p, packets = by.popitem()
            key = np.concatenate([_wide(k, KEY_BYTES) for _, _, k in packets])
            node = np.concatenate([_unpacked(a, b, len(k) // KEY_BYTES) for a, b, k in packets])
            del packets
            key, node, level = shared_tokens(key, node)
            token = mix(key * _U(parts) + _U(p))
            part = (mix(node) % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            out = [(q, *_packet_nodes(node[at]), _low(token[at], TOKEN_BYTES), level[at].tobytes(), None) for q, at in _cut(np.argsort(part, kind="stable"), part, parts)]
            yield from replies(out)

    def replies(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=REPLY)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
            part = (mix(node) % _U(parts)).astype(np.int64)
            yield from replies([(q, node[at].tobytes(), None, None, None, n[at].tobytes()) for q, at in _cut(np.argsort(part, kind="stable"), part, parts)])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for p, *packet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(p, []).append(packet)
        while by:
            _, packets = by.popitem()
            names = np.concatenate([np.frombuffer(x[0], _U) for x in packets if x[4] is not None])
            n = np.concatenate([np.frombuffer(x[4], np.int64) for x in packets if x[4] is not None])
            names, first = np.unique(names, return_index=True)
            shared = [(_unpacked(a, b, len(t) // TOKEN_BYTES), np.frombuffer(v, np.uint8), _wide(t, TOKEN_BYTES)) for a, b, t, v, m in packets if m is None]
            if shared:
                node, level, token = (np.concatenate(x) for x in zip(*shared, strict=True))
                at = rarest(node, level, token, names, n[first], percent)
                yield pa.RecordBatch.from_arrays([_signed(token[at]), _signed(node[at])], names=["token", "node"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy().view(_U) for c in batch.columns] for batch in batches]
        if rows:
            a, b, _, _ = _stars(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b)], names=["a", "b"])

    sent = values.mapInArrow(shingled, "part int, nodes binary, place binary, key binary")
    reply = f"part int, {', '.join(f'{c} binary' for c in REPLY[1:])}"
    shared = sent.repartition(parts, "part").mapInArrow(counted, reply)
    known = sizes.where("n > 0").select("set_a", "n").mapInArrow(sized, reply)
    first = shared.union(known).repartition(parts, "part").mapInArrow(prefixes, "token long, node long")
    return first.repartition(parts, "token").mapInArrow(met, "a long, b long")


REPLY = ["part", "nodes", "place", "token", "level", "sizes"]


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class CountTree:
    """R-tree over count vectors, packed top down by the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, at: np.ndarray) -> dict:
        p, s = self.points[at], self.sizes[at]
        node = {"hi": p.max(0), "least": int(s.min()), "most": int(s.max()), "at": at, "kids": None}
        if len(at) > self.leaf:
            if node["most"] - node["least"] > 0.05 * node["most"]:
                order = np.argsort(s, kind="stable")
            else:
                order = np.argsort(p[:, np.argmax(p.max(0) - p.min(0))], kind="stable")
            half = len(at) // 2
            node["kids"] = [self._pack(at[order[:half]]), self._pack(at[order[half:]])]
        return node

    def leaves(self) -> list[dict]:
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if n["kids"]:
                todo += n["kids"][::-1]
            else:
                out.append(n)
        return out


def _may_link(x: dict, y: dict, percent: int) -> bool:
    """Whether the boxes can hold a linked pair: their sizes, and the overlap that their corners allow."""
    if 100 * x["most"] < percent * y["least"] or 100 * y["most"] < percent * x["least"]:
        return False
    return (100 + percent) * int(np.minimum(x["hi"], y["hi"]).sum(dtype=np.int64)) >= percent * (x["least"] + y["least"])


def point_of(h: np.ndarray) -> np.ndarray:
    """The counts of a set's groups, in the narrowest type that holds them.

    Larger sets have more groups, a power of two, so that a group holds a few shingles and the bound stays sharp.
    """
    groups = max(GROUPS, 1 << max(0, (len(h) // PER_GROUP - 1)).bit_length())
    x = np.bincount((h >> _U(7) & _U(groups - 1)).astype(np.int64), minlength=groups)
    return x.astype(np.uint8 if x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.int32)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of one dimension, the least of theirs: groups of a finer point add up to those of a coarser one."""
    least = min(map(len, points))
    points = [p if len(p) == least else p.reshape(-1, least).sum(0) for p in points]
    most = max(int(p.max()) for p in points)
    return np.stack(points).astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32)


def connecting(points: np.ndarray, sizes: np.ndarray, percent: int, sides: np.ndarray | None, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that connect all that ``linked`` connects, of the pairs that points and sizes leave room for.

    ``linked`` is asked about pairs that aren't connected yet; with ``sides``, only about pairs across two sides.
    """
    n = len(sizes)
    if n < 2:
        return []
    tree, union, out = CountTree(points, sizes), Union(n), []

    def one(node: dict) -> int:
        """The component all of a node's sets are in, or -1; remembered once it is one."""
        if node.get("one") is None:
            roots = {union.find(i) for i in node["at"].tolist()}
            if len(roots) > 1:
                return -1
            node["one"] = roots.pop()
        return union.find(node["one"])

    def ask(i: int, j: int) -> None:
        if union.find(i) != union.find(j) and (sides is None or sides[i] != sides[j]) and linked(i, j):
            union.join(i, j)
            out.append((i, j))

    def meet(x: dict, y: dict) -> None:
        same = one(x)
        if same >= 0 and same == one(y):
            return
        a, b = x["at"], y["at"]
        bound = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(2, dtype=np.int64)
        ok = (100 + percent) * bound >= percent * (sizes[a][:, None] + sizes[b][None, :])
        if x is y:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        for k in np.argsort(-bound[i, j], kind="stable").tolist():
            ask(int(a[i[k]]), int(b[j[k]]))

    leaves = tree.leaves()
    for x in leaves:
        meet(x, x)
    for x in leaves:
        todo = [tree.root]
        while todo:
            node = todo.pop()
            if node is x or not _may_link(x, node, percent):
                continue
            same = one(x)
            if same >= 0 and same == one(node):
                continue
            if node["kids"]:
                todo += node["kids"]
            elif node["at"][0] > x["at"][0]:
                meet(x, node)
    return out


def verified_links(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect all sets that links connect; with ``sides``, only links across two sides count."""
    if len(sets) < 2:
        return []
    def linked(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    return connecting(folded([point_of(s) for s in sets]), np.array([len(s) for s in sets]), percent, sides, linked)


def _slots(names: np.ndarray, size: int) -> np.ndarray:
    """Three of a filter's ``size`` bits for each name."""
    h = mix(names.view(_U))
    return (np.stack([h, h >> _U(32), mix(h)]) & _U(size - 1)).astype(np.int64)


def _name_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of ``1 << FILTER_BITS`` bits, made on the executors; only bits reach the driver."""
    size = 1 << FILTER_BITS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(size // 8, np.uint8)
        for batch in batches:
            slots = _slots(batch.column(0).to_numpy(zero_copy_only=False), size).ravel()
            np.bitwise_or.at(x, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in names.coalesce(8).mapInArrow(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def _places(named: DataFrame, clusters: DataFrame, percent: int, weight, block: int) -> DataFrame:
    """(node, root, band, blocks): the bands of its cluster that a set takes part in, and the blocks of each.

    Sizes of linked sets differ by a bounded ratio, so a cluster is cut into bands of that ratio: each set goes to its
    own band's task and, as a smaller partner, to the next one's.
    """
    ratio = math.log(100 / percent) * 1.0001
    sized = clusters.join(named.where("n > 0").select(F.col("set_a").alias("node"), "n").distinct(), "node")
    own = F.floor(F.log("n") / ratio).cast("int")
    banded = staged(sized.select("node", "root", "n", F.explode(F.array(own, own + 1)).alias("band"), own.alias("own")), "banded")
    weights = banded.groupBy("root", "band").agg(
        F.ceil(F.sum(weight) / block).cast("int").alias("blocks"), F.count("*").alias("sets"), F.count_if(F.col("own") == F.col("band")).alias("here")
    )
    # Both sides as tables: a join of two plain scans is one whose busy keys the engine splits.
    weights = staged(weights.where("sets > 1 and here > 0").select("root", "band", "blocks"), "weights")
    places = staged(banded.join(weights, ["root", "band"]).select("node", "root", "band", "blocks"), "places")
    drop_staged(banded)
    drop_staged(weights)
    return places


def _dealt(placed: DataFrame, *columns: str) -> DataFrame:
    """Rows with their pair of blocks (i, j) and their own block, a partition key for each pair."""
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("root", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", *columns)
    # Small clusters are not worth merging into few tasks: their work isn't their size.
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "root", "band", "i", "j").groupBy("root", "band", "i", "j")


def _refined(named: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """Clusters (node, root) of those sets that are connected by pairs for which the points leave room."""
    places = _places(named, clusters, percent, F.lit(1), block)
    points = named.where("n > 0").select(F.col("set_a").alias("node"), "n", "point", "width").join(clusters.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        kinds = {1: np.uint8, 2: np.uint16, 4: np.int32}
        read = [np.frombuffer(x, kinds[w]) for x, w in zip(t.column("point").to_pylist(), t.column("width").to_pylist(), strict=True)]
        sides = None if key[2].as_py() == key[3].as_py() else t.column("mine").to_numpy()
        pairs = connecting(folded(read), t.column("n").to_numpy(), percent, sides, lambda i, j: True)
        return pa.table({"a": pa.array([node[x] for x, _ in pairs], pa.int64()), "b": pa.array([node[y] for _, y in pairs], pa.int64())})

    links = staged(_dealt(points.join(places, "node"), "n", "point", "width").applyInArrow(join, "a long, b long"), "room")
    drop_staged(places)
    out = staged(components(links), "refined")
    drop_staged(links)
    return out


def _true_links(rows: DataFrame, named: DataFrame, clusters: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Verified links (a, b) inside the clusters."""
    spark = rows.sparkSession
    places = _places(named, clusters, percent, F.col("n"), block)
    # Lets the scan drop most other sets where it runs; the join drops the rest.
    wanted = spark.sparkContext.broadcast(_name_filter(places.select("node")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["node", "size", "h"]
        for batch in batches:
            out = []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), width)
                if not len(h):
                    continue
                name = int(np.array([_identity(h)[0]], _U).view(np.int64)[0])
                if name in seen:
                    continue
                slots = _slots(np.array([name], np.int64), 8 * len(wanted.value))
                if not (wanted.value[slots >> 3] >> (slots & 7) & 1).all():
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                out.append((name, len(h), h.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    sets = rows.select("x_").mapInArrow(found, "node long, size long, h binary")

    def link(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        # A set that several scan tasks met is here as often.
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)
        h = t.column("h")
        hs = [np.frombuffer(h[k].as_buffer(), _U) for k in first.tolist()]
        i, j = key[2].as_py(), key[3].as_py()
        sides = None if i == j else t.column("mine").to_numpy()[first]
        pairs = verified_links(hs, percent, sides)
        return pa.table({"a": pa.array([node[x] for x, _ in pairs], pa.int64()), "b": pa.array([node[y] for _, y in pairs], pa.int64())})

    return _dealt(sets.join(places, "node"), "h").applyInArrow(link, "a long, b long")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, block: int = BLOCK
) -> DataFrame:
    """One row a row: id, ``n_shingles``, ``component_id``, and the set's name (``set_a``, ``set_b``).

    Two documents link when ``100 * shared >= percent * united`` of their shingles.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(docs, id_col).alias("i_"), col(docs, text_col).alias("x_"))
    schema = rows.select("i_", *[F.lit(0).cast("long").alias(c) for c in ("n", "set_a", "set_b")], F.lit(None).cast("binary").alias("point"), F.lit(0).cast("int").alias("width")).schema

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, points, widths = [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), width)
                out.append((len(h), *_identity(h)) if len(h) else (0, 0, 0))
                point = point_of(h) if len(h) else None
                points.append(None if point is None else point.tobytes())
                widths.append(0 if point is None else point.itemsize)
            x = np.array(out, object).reshape(-1, 3)
            cols = [pa.array(x[:, 0].astype(np.int64)), _signed(x[:, 1].astype(_U)), _signed(x[:, 2].astype(_U)), pa.array(points, pa.binary()), pa.array(widths, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["i_", "n", "set_a", "set_b", "point", "width"])

    sets = staged(rows.mapInArrow(named, schema), "named")
    total = sets.agg(F.sum("n")).first()[0] or 0
    links = staged(candidate_links(rows.select("x_"), sets, width, percent, max(parts, -(-total // COUNTED))), "candidates")
    clusters = staged(components(links), "clusters")
    drop_staged(links)
    refined = _refined(sets, clusters, percent, POINTS)
    drop_staged(clusters)
    true = components(staged(_true_links(rows, sets, refined, width, percent, block), "links"))
    # Per set the smallest id; per component the smallest of its sets.
    least = sets.where("n > 0").groupBy("set_a").agg(F.min("i_").alias("least")).join(true.withColumnRenamed("node", "set_a"), "set_a", "left")
    least = least.withColumn("root", F.coalesce("root", "set_a"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named_sets = least.join(of_root, "root").select("set_a", "component_id")
    out = sets.join(named_sets, "set_a", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("i_"))
    return out.select(F.col("i_").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "set_a", "set_b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns as they were.

    Rows that repeat both id and text are one document.
    """
    found = staged(similar_documents(docs, id_col, text_col, width, percent, block), "similar")
    gone = found.where(~col(found, id_col).eqNullSafe(F.col("component_id"))).select(col(found, id_col).alias("gone_")).distinct()
    twice = found.groupBy(col(found, id_col).alias("id_")).count().where("count > 1")
    if not twice.isEmpty():
        # Ids that repeat: decide by id and set, and keep one row of each.
        return _one_of_each_set(docs, found, id_col, text_col, width)
    return docs.join(gone, col(docs, id_col).eqNullSafe(gone["gone_"]), "left_anti")


def _one_of_each_set(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    name, rank = fresh(docs, "set_name"), fresh(docs, "set_rank")
    extra = docs.select(*[quoted(c) for c in docs.columns], F.lit(0).cast("long").alias(name))
    at = docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_identity(h)[0] if len(h := shingle_set(t.as_py(), width)) else 0 for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _signed(np.array(ids, _U))], schema=batch.schema)

    rows = extra.mapInArrow(named, extra.schema)
    kept = found.where(col(found, id_col).eqNullSafe(F.col("component_id"))).select(col(found, id_col).alias("k_"), F.col("set_a").alias("s_")).distinct()
    # Of a component that has several sets under its smallest id, one set stays.
    kept = kept.join(found.select(col(found, id_col).alias("k2_"), F.col("set_a").alias("s2_"), "n_shingles", "component_id").distinct(), [F.col("k_").eqNullSafe(F.col("k2_")), F.col("s_") == F.col("s2_")])
    one = kept.groupBy("component_id", F.when(F.col("n_shingles") == 0, F.col("s_"))).agg(F.min("s_").alias("s_"), F.first("k_").alias("k_")).select("k_", "s_")
    joined = rows.join(one, [col(rows, id_col).eqNullSafe(one["k_"]), F.col(name) == one["s_"]], "left_semi")
    from pyspark.sql import Window

    same = Window.partitionBy(id_col, name).orderBy(F.md5(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    return joined.withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1).drop(name, rank)
