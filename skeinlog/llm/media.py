"""Image copies by local descriptors: cropped and edited versions of a picture are found by what they share.

*Descriptors.*  Corners (Harris responses that are the largest around) are found on a pyramid of scales; a
corner's orientation is the direction of the centroid of its patch; 256 comparisons of pixel pairs, rotated by
the orientation, give its descriptor.  Brightness and contrast don't change comparisons.  All corners are kept:
a corner is the strongest within ``APART`` pixels, so their number is bounded by the area and a crop has the
corners that its place has in the whole.

*Tables.*  Each of ``TABLES`` tables draws ``DRAWN`` of a descriptor's bits; the first ``KEY_BITS`` of them, however many
descriptors there are, are its key, and descriptors with equal keys meet.  There the first image by name
leads those whose other drawn bits differ in at most a share of ``CHECK_SHARE``, the first of the rest leads further ones, and so on
until none is left: each image votes for its leader only, so a key that all images have costs one vote an image.
Images of a group of copies meet the same leader again and again.  A pair is a candidate if
``VOTES`` different corners (by number, modulo 64) vote for it with about the same turn.  Copies have
many descriptors, so they meet almost surely, but not for certain (the README has the recall against
consensus of all pairs).

*Consensus.*  A candidate's descriptors match mutually within ``NEAR`` bits, each match proposes a shift, turn and scale,
and the images are linked if the best proposal explains at least ``INLIERS`` matches.  A leader's candidates are
dealt into packets of about ``BLOCK``.  Images of equal pixels are one node from the start.

Defined results: null, empty and undecodable images have no corners and link with nothing; images without
corners link only with images of equal pixels; equal rows are in one component; rows without an id take no
part; ids have to be whole numbers; an empty table gives an empty one; other columns are ignored.  PGM, PPM (8 and 16
bits) and PNG that isn't interlaced (8 and 16 bits, palettes of 1 to 8 bits) are decoded.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_staged, give_back, staged
from .graph import components
from .shingles import mix

APART, LEVELS, SHRINK = 2, 3, 1.5
RADIUS, BITS, WORDS = 9, 256, 4
#: Bits that a table draws, of which the first ones are the key; the others may differ by a share.
TABLES, DRAWN, CHECK_SHARE = 8, 48, 0.15
#: Bits of a key.  The same for every input, so that whether two pictures meet does not depend on how many others there are.
KEY_BITS = 16
VOTES, TURNS = 3, 6
NEAR, INLIERS, TOLERANCE = 48, 6, 3.0
#: Candidates of a packet, keys that a map task gathers and that a task sorts.
BLOCK, GATHER, KEYS = 400, 250_000, 700_000
#: Pictures that a worker draws or describes at a time.
SLICE = 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces; unused memory goes back at the end, since the worker stays."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    give_back()


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a PGM, PPM or 8-bit PNG image, or None."""
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            kind, width, height, most, pixels = raw.split(maxsplit=4) if raw[2:3] != b"\n" else _netpbm(raw)
            depth = 3 if kind == b"P6" else 1
            w, h = int(width), int(height)
            x = np.frombuffer(pixels, np.uint8 if int(most) < 256 else ">u2", w * h * depth).reshape(h, w, depth)
            return x.mean(2) * (255.0 / int(most))
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, struct.error, zlib.error, ZeroDivisionError, IndexError, KeyError):
        return None
    return None


def _netpbm(raw: bytes) -> list[bytes]:
    kind, size, most, pixels = raw.split(b"\n", 3)
    return [kind, *size.split(), most, pixels]


def _png(raw: bytes) -> np.ndarray:
    at, data, header, palette = 8, b"", b"", b""
    while at < len(raw):
        (n,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        if kind == b"IHDR":
            header = raw[at + 8 : at + 8 + n]
        elif kind == b"PLTE":
            palette = raw[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            data += raw[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", header)
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if interlaced or bits not in ((1, 2, 4, 8) if colour in (0, 3) else (8,)) + ((16,) if colour != 3 else ()):
        raise ValueError("unsupported PNG")
    width, step = (w * depth * bits + 7) // 8, max(1, depth * bits // 8)
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + width)
    out = np.zeros((h + 1, width + step), np.int64)
    for y in range(h):
        kind, line, up, now = int(lines[y, 0]), lines[y, 1:].astype(np.int64), out[y], out[y + 1]
        for i in range(width):
            left, above, corner = now[i], up[i + step], up[i]
            p = left + above - corner
            paeth = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2] if kind == 4 else 0
            now[i + step] = (line[i] + (0, left, above, (left + above) // 2, paeth)[kind]) % 256
    x = out[1:, step:].astype(np.uint8)
    if bits < 8:
        x = np.unpackbits(x, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        x = x[:, :w] * (1 if colour == 3 else 255 // (2**bits - 1))
    elif bits == 16:
        x = x.view(">u2") / 257.0
    x = x.reshape(h, w, depth)
    if colour == 3:
        x = np.frombuffer(palette, np.uint8).reshape(-1, 3)[x[:, :, 0]]
    return (x[:, :, :3] if x.shape[2] >= 3 else x[:, :, :1]).mean(2)


def encode_pgm(pixels: np.ndarray) -> bytes:
    x = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def _resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    ys, xs = np.linspace(0, x.shape[0] - 1, h), np.linspace(0, x.shape[1] - 1, w)
    y0, x0 = np.minimum(ys.astype(int), x.shape[0] - 2), np.minimum(xs.astype(int), x.shape[1] - 2)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    a, b, c, d = x[y0][:, x0], x[y0][:, x0 + 1], x[y0 + 1][:, x0], x[y0 + 1][:, x0 + 1]
    return a * (1 - fy) * (1 - fx) + b * (1 - fy) * fx + c * fy * (1 - fx) + d * fy * fx


def _blurred(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], "edge")
        n = x.shape[axis]
        x = sum(w * np.take(p, range(k, k + n), axis) for k, w in enumerate((1, 4, 6, 4, 1))) / 16
    return x


_rng = np.random.default_rng(20)
#: The pairs of points that are compared: drawn once, around the corner.
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_DY, _DX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
#: The bits that each table draws.
_DRAWN = np.stack([np.random.default_rng([20, t]).permutation(BITS)[:DRAWN] for t in range(TABLES)])
_DISC = (_DY**2 + _DX**2 <= RADIUS**2).astype(float)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in pixels of the image, the strongest first, and their descriptors (4 words of 64 bits)."""
    places, words, strengths = [], [], []
    for level in range(LEVELS):
        scale = SHRINK**level
        h, w = round(image.shape[0] / scale), round(image.shape[1] / scale)
        if min(h, w) < 2 * RADIUS + 3:
            break
        x = _blurred(image if not level else _resized(_blurred(image), h, w))
        gy, gx = np.gradient(x)
        a, b, c = _blurred(gx * gx), _blurred(gy * gy), _blurred(gx * gy)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        top = np.pad(strength, APART, constant_values=-np.inf)
        for axis in (0, 1):
            top = np.lib.stride_tricks.sliding_window_view(top, 2 * APART + 1, axis).max(-1)
        peak = (strength >= top) & (strength > 1e-6)
        peak[:RADIUS], peak[h - RADIUS :], peak[:, :RADIUS], peak[:, w - RADIUS :] = False, False, False, False
        ys, xs = np.nonzero(peak)
        if not len(ys):
            continue
        patch = x[ys[:, None, None] + _DY, xs[:, None, None] + _DX] * _DISC
        angle = np.arctan2((patch * _DY).sum((1, 2)), (patch * _DX).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        py = np.rint(ys[:, None, None] + sin * _PAIRS[..., 0] + cos * _PAIRS[..., 1]).astype(int)
        px = np.rint(xs[:, None, None] + cos * _PAIRS[..., 0] - sin * _PAIRS[..., 1]).astype(int)
        v = x[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)]
        bits = (v[:, :, 0] < v[:, :, 1]).astype(np.uint8)
        words.append(np.packbits(bits, axis=1).view("<u8"))
        sy, sx = (image.shape[0] - 1) / max(1, h - 1), (image.shape[1] - 1) / max(1, w - 1)
        places.append(np.stack([xs * sx, ys * sy, np.full(len(xs), scale), angle], 1))
        strengths.append(strength[ys, xs])
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, WORDS), np.uint64)
    order = np.argsort(-np.concatenate(strengths), kind="stable")
    return np.concatenate(places)[order].astype(np.float32), np.concatenate(words)[order]


def drawn_bits(words: np.ndarray) -> np.ndarray:
    """What each table draws of each descriptor: numbers of ``DRAWN`` bits, the key's bits first."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    wide = np.zeros((len(bits), TABLES, 8), np.uint8)
    wide[:, :, 8 - DRAWN // 8 :] = np.packbits(bits[:, _DRAWN], axis=2)
    return wide.view(">u8")[:, :, 0].astype(np.uint64)


def _once(rows: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ``rows``, with their masks joined."""
    order = np.lexsort(rows.T[::-1])
    rows, mask = rows[order], mask[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new], np.bitwise_or.reduceat(mask, np.flatnonzero(new)) if len(rows) else mask


def votes_of(table: np.ndarray, drawn: np.ndarray, node: np.ndarray, corner: np.ndarray, angle: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(image, leader, turn) and a bit for each corner that votes for it.

    Angles are numbers below 256.  There are as many rounds as the key with the most leaders has.
    """
    key = drawn >> np.uint64(DRAWN - bits) | table.astype(np.uint64) << np.uint64(DRAWN)
    check = drawn & np.uint64((1 << DRAWN - bits) - 1)
    most = int((DRAWN - bits) * CHECK_SHARE)
    order = np.lexsort((drawn, node, key))
    key, check, node, corner, angle = (x[order] for x in (key, check, node, corner, angle))
    found, masks = [], []
    while len(key):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        near = np.bitwise_count(check ^ check[lead]) <= most
        votes = np.flatnonzero(near & (node != node[lead]))
        turn = ((angle[votes].astype(np.int64) - angle[lead[votes]]) * TURNS + 128) // 256 % TURNS  # the first around no turn
        found.append(np.stack([node[votes], node[lead[votes]], turn], 1))
        masks.append(np.int64(1) << (corner[votes].astype(np.int64) % 64))
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        rest = ~near & (np.repeat(size, size) > 1)
        key, check, node, corner, angle = (x[rest] for x in (key, check, node, corner, angle))
    if not found:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return _once(np.concatenate(found), np.concatenate(masks))


def candidate_pairs(pictures: DataFrame, parts: int, bits: int = KEY_BITS) -> DataFrame:
    """Candidates (a, leader) of pictures (node, places, words)."""

    def emit(node, drawn, corner, angle):
        part = (mix(drawn >> np.uint64(DRAWN - bits)) % np.uint64(parts)).astype(np.int64)  # the table's number is above the bits
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[p] : cut[p + 1]]
            nodes, place = np.unique(node[at], return_inverse=True)
            kind = np.uint16 if len(nodes) <= 1 << 16 else np.uint32
            seven = np.ascontiguousarray(np.ascontiguousarray(drawn[at]).view(np.uint8).reshape(-1, 8)[:, :7])
            out.append((p, nodes.tobytes(), place.astype(kind).tobytes(), seven.tobytes(), corner[at].tobytes(), angle[at].tobytes()))
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 5], strict=True)], names=PACKET)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        table = np.arange(TABLES, dtype=np.uint64) << np.uint64(DRAWN)
        each = lambda x: np.repeat(x.astype(np.uint8), TABLES)
        for batch in batches:
            for name, places, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                drawn = drawn_bits(np.frombuffer(words, np.uint64).reshape(-1, WORDS))
                n = len(drawn)
                angle = np.frombuffer(places, np.float32).reshape(-1, 4)[:, 3]
                held.append((np.full(n * TABLES, name), (drawn | table).ravel(), each(np.arange(n) % 64), each(np.floor(angle / (2 * np.pi) * 256).astype(np.int64) % 256)))
                size += n * TABLES
                if size >= GATHER:
                    yield emit(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield emit(*map(np.concatenate, zip(*held, strict=True)))
        held, seen = [], set()
        give_back()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for p, nodes, place, seven, corner, angle in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                wide = np.zeros((len(corner), 8), np.uint8)
                wide[:, :7] = np.frombuffer(seven, np.uint8).reshape(-1, 7)
                place = np.frombuffer(place, np.uint16 if len(place) == 2 * len(corner) else np.uint32)
                by.setdefault(p, []).append((wide.view(np.uint64).ravel(), np.frombuffer(nodes, np.int64)[place], np.frombuffer(corner, np.uint8), np.frombuffer(angle, np.uint8)))
        while by:
            drawn, *rest = map(np.concatenate, zip(*by.popitem()[1], strict=True))
            rows, mask = votes_of(drawn >> np.uint64(DRAWN), drawn & np.uint64((1 << DRAWN) - 1), *rest, bits)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(mask)], names=["a", "leader", "turn", "corners"])
            del drawn, rest, rows, mask
        give_back()

    sent = pictures.select("node", "places", "words").mapInArrow(keyed, f"part int, {', '.join(f'{c} binary' for c in PACKET[1:])}")
    votes = sent.repartition(parts, "part").mapInArrow(met, "a long, leader long, turn long, corners long")
    counted = votes.groupBy("a", "leader", "turn").agg(F.bit_or("corners").alias("corners"))
    return counted.where(F.bit_count("corners") >= VOTES).select("a", "leader").distinct()


PACKET = ["part", "nodes", "place", "drawn", "corner", "angle"]


def _nearest(wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``wa`` the first nearest of ``wb`` and its distance, for each of ``wb`` the first nearest of ``wa``."""
    step = max(1, 4_000_000 // len(wb))
    to, far, back, least = [], [], np.zeros(len(wb), np.int64), np.full(len(wb), BITS + 1)
    for at in range(0, len(wa), step):
        d = np.bitwise_count(wa[at : at + step, None, :] ^ wb[None, :, :]).sum(2, dtype=np.int64)
        to.append(d.argmin(1))
        far.append(d.min(1))
        here = d.min(0)
        back = np.where(here < least, at + d.argmin(0), back)
        least = np.minimum(least, here)
    return np.concatenate(to), np.concatenate(far), back


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], enough: float = math.inf) -> int:
    """The most matches of two images that one shift, turn and scale explains; the search ends at ``enough``."""
    (pa_, wa), (pb, wb) = a, b
    if min(len(pa_), len(pb)) < INLIERS:
        return 0
    j, far, back = _nearest(wa, wb)
    i = np.arange(len(wa))
    ok = (far <= NEAR) & (back[j] == i)
    i, j = i[ok], j[ok]
    if len(i) < INLIERS:
        return 0
    p, q = pa_[i].astype(float), pb[j].astype(float)
    best = 0
    zp, zq = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    for k in range(len(i)):
        turn = (q[k, 2] / p[k, 2]) * np.exp(1j * (q[k, 3] - p[k, 3]))
        miss = np.abs(zq - (zq[k] + turn * (zp - zp[k])))
        best = max(best, int((miss <= TOLERANCE * max(1.0, q[k, 2])).sum()))
        if best >= enough:
            break
    return best


def find_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", block: int = BLOCK) -> DataFrame:
    """One row an image: id, ``n_corners``, ``component_id`` (the smallest id of its copies), ``n_copies`` (its component's images)."""
    rows = images.select(col(images, id_col).cast("long").alias("i_"), col(images, image_col).alias("x_")).where("i_ is not null")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for raw in batch.column(1).to_pylist():
                x = decode(bytes(raw) if raw is not None else None)
                if x is None:
                    out.append((0, None, b"", b""))
                    continue
                places, words = describe(x)
                h = hashlib.blake2b(np.rint(x).astype(np.uint8).tobytes() + repr(x.shape).encode(), digest_size=8).digest()
                out.append((len(places), int.from_bytes(h, "little", signed=True), places.tobytes(), words.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["i_", "n", "node", "places", "words"])

    seen = staged(rows.mapInArrow(described, "i_ long, n long, node long, places binary, words binary"), "described")
    described_ = seen.where("node is not null and n > 0")
    corners = described_.agg(F.sum("n")).first()[0] or 0
    parts = max(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corners * TABLES // KEYS))
    pairs = staged(candidate_pairs(described_, parts), "candidates")
    # A leader's candidates in packets, the leader in each of them.
    many = pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("packets"))
    dealt = pairs.join(many, "leader").withColumn("packet", F.pmod(F.xxhash64("a"), F.col("packets")).cast("int"))
    leaders = many.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0), F.col("packets") - 1)).alias("packet"))
    roles = dealt.select(F.col("a").alias("node"), "leader", "packet").union(leaders)
    placed = described_.select("node", "places", "words").join(roles, "node").select("leader", "packet", "node", "places", "words")

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        found = {
            n: (np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(w, np.uint64).reshape(-1, WORDS))
            for n, p, w in zip(*(t.column(c).to_pylist() for c in ("node", "places", "words")), strict=True)
        }
        leader = key[0].as_py()
        good = [n for n in found if n != leader and consensus(found[leader], found[n], INLIERS) >= INLIERS]
        return pa.table({"a": pa.array([leader] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    links = staged(placed.groupBy("leader", "packet").applyInArrow(verify, "a long, b long"), "links")
    drop_staged(pairs)
    true = components(links)
    per = seen.where("node is not null").groupBy("node").agg(F.min("i_").alias("least"), F.count("*").alias("rows"))
    per = per.join(true, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = per.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("n_copies"))
    named = per.join(whole, "root").select("node", "component_id", "n_copies")
    out = seen.select("i_", "n", "node").join(named, "node", "left")
    return out.select(
        F.col("i_").alias(id_col), F.col("n").alias("n_corners"),
        F.coalesce("component_id", "i_").alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


SIDE = 72


def drawn(vector: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A picture of a vector: its components are the weights of waves."""
    n = math.ceil(math.sqrt(len(vector)))
    w = np.zeros(n * n)
    w[: len(vector)] = vector
    t = (np.arange(side) + 0.5) * np.pi / side
    waves = np.cos(np.outer(np.arange(1, n + 1) * 2.2, t))
    x = waves.T @ w.reshape(n, n) @ waves
    return 127.5 + 110 * x / (np.abs(x).max() + 1e-12)


def edited(picture: np.ndarray, number: int) -> np.ndarray:
    """A crop of about three quarters, brighter or darker, with other contrast."""
    h, w = picture.shape
    y, x = number % (h // 8 + 1), number // 7 % (w // 8 + 1)
    return (picture[y : y + h - h // 8, x : x + w - w // 8] - 127.5) * (0.7 + number % 5 * 0.07) + 118 + number % 3 * 8


def pictures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, image): a picture of every vector, and of every tenth an edited copy with the id ``-id - 1``."""
    rows = vectors.select(col(vectors, id_col).cast("long").alias("i"), col(vectors, vector_col).cast("array<double>").alias("v")).where("i is not null")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, images = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fine = v and all(x is not None and math.isfinite(x) for x in v)
                p = drawn(np.array(v)) if fine else None
                ids.append(i)
                images.append(encode_pgm(p) if fine else None)
                if fine and i % 10 == 0:
                    ids.append(-i - 1)
                    images.append(encode_pgm(edited(p, i // 10)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return rows.mapInArrow(draw, "image_id long, image binary")
