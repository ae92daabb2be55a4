"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words where no piece can reach across: before blanks, and between characters that no piece has
side by side (``Model.words``, drawn from the vocabulary).  The distinct words form the lattice: every substring of
two or more characters, up to the longest piece's length, is equi-joined with the piece table, which gives the lattice's
edges; the edges are grouped by word, and a higher-order fold over them finds the word's pieces.

Documents are packed where they are read: each input partition makes a few *groups* of about ``GROUP`` bytes of text.
A group sends the set of its words to the lattice and its rows, compressed, to the task that puts its texts together
again; there the words' cuts come first and the rows stream past them.  Which groups have a word is a bit set of
``SLAB`` groups, so a word that all groups have is one row a slab and a slab's lattice is worked once.

What the fold optimises depends on the model.  For unigram models it is Viterbi: the path of the largest
sum of scores (``viterbi_path``).  The scores of BPE models are merge ranks, and the best sum of ranks is not what such
a model means by its encoding: there the fold takes, again and again, the edge of the best score that
joins exactly two neighbouring pieces, the leftmost of equals (``merge_cuts``), which is the library's result.

The state of the BPE fold is one 64-bit number, a bit a cut, for words of up to ``SHORT`` characters.  Longer
words are merged with a heap by a Python step over the same pieces; so would be a word whose cuts did not arrive
because a lost partition came back in another order.

Defined results: null and empty texts have no pieces; texts are encoded whole; equal rows give equal rows;
characters that no piece has become their UTF-8 bytes' pieces, so decoding gives the text back (U+2581, the
model's sign for a blank, comes back as a blank); an empty table gives an empty one; other columns are
kept or ignored as the function says; a result column whose name a kept column has is called by that name and an underscore.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, give_back, quoted, staged

SHORT = 60
#: Bytes of text in a group, groups in a slab, bytes of text in a packet of rows, words that a worker gathers.
GROUP, SLAB, PACKET, GATHER = 32 << 20, 32, 1 << 20, 80_000
#: Rows of an Arrow batch: a batch of whole texts is in memory on both sides.
ROWS = 1_000
#: The model's sign for a blank; texts are read with blanks in its place.
BLANK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Model:
    """Pieces of a model file: text (blanks as blanks) to (score, id), the byte pieces, and the way back."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = sp.unk_id()
        self.back: list[bytes] = []
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            back = b""
            if sp.is_byte(i):
                self.bytes[int(BYTE.fullmatch(text)[1], 16)] = i
                back = bytes([int(BYTE.fullmatch(text)[1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[text.replace(BLANK, " ")] = (sp.get_score(i), i)
                back = text.replace(BLANK, " ").encode()
            self.back.append(back)
        self.longest = max(map(len, self.pieces))
        self._coded: dict[str, bytes] = {}
        self.words = re.compile(self._pattern()).findall

    def _pattern(self) -> str:
        """A word: characters that pieces connect, with the blanks before them.  Others are words of their own.

        Characters that stand side by side in a piece are of one class, and so are those they are connected with.
        """
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        after_blank = set()
        for p in self.pieces:
            inner = p.lstrip(" ")
            if " " in inner:
                raise ValueError("a piece reaches over a blank")
            if inner and inner != p:
                after_blank.add(inner[0])
            for a, b in zip(inner, inner[1:]):  # noqa: B905
                up[top(a)] = top(b)
        classes: dict[str, list[str]] = {}
        for c in set(up) | after_blank:
            classes.setdefault(top(c), []).append(c)
        ways = []
        for chars in sorted(map(sorted, classes.values()), key=len, reverse=True):
            blanks = " *" if after_blank & set(chars) else ""
            if len(chars) > 1 or blanks:
                ways.append(f"{blanks}[{''.join(map(re.escape, chars))}]+")
        return "|".join([*ways, " +", "(?s:.)"])

    def words_of(self, stretches: list[str], ends: list[str]) -> list[str]:
        """Words of ``stretches``, searched for at once, then of ``ends``, which are blanks only and would run into others.

        The first word of a stretch starts with a blank, the others do not.
        """
        found = self.words(" " + " ".join(stretches)) if stretches else []
        return found + [" " + s for s in ends]

    def ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][1]]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def coded(self, piece: str) -> bytes:
        """Ids of a piece as bytes, remembered for pieces of the table and for characters."""
        found = self._coded.get(piece)
        if found is None:
            found = self._coded[piece] = array("i", self.ids(piece)).tobytes()
        return found

    def cut(self, word: str, mask: int) -> bytes:
        """Ids of a word that is cut where ``mask`` has a bit, as bytes."""
        out, at, coded = [], 0, self.coded
        mask &= -2
        while mask:
            low = mask & -mask
            till = low.bit_length() - 1
            out.append(coded(word[at:till]))
            at, mask = till, mask ^ low
        return b"".join(out)

    def merged(self, word: str) -> list[int]:
        """Ids of a word of any length."""
        return [x for part in self.merges(word)[0] for x in self.ids(part)]

    def merges(self, word: str) -> tuple[list[str], list[float]]:
        """Parts of a word of any length, and the scores of the merges in their order: by score, then place, from a heap."""
        n, scores = len(word), []
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        part, heap = list(word), []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (p := self.pieces.get(part[i] + part[j])):
                heapq.heappush(heap, (-p[0], i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            cost, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or part[i] != a or j < 0 or part[j] != b:
                continue
            scores.append(-cost)
            part[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [part[i] for i in range(n) if alive[i]], scores

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def _model(model: bytes) -> Model:
    """A worker's tasks share a model."""
    return Model(model)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, score, id, rank, late: at most as many rows as the model has pieces, without those that merges never reach.

    Merges inside a piece's span go as in a word of its own, as long as its ends are cuts.  A piece is *late* if one of
    them scores less than the piece itself or as much: only then can it come up after its turn.
    """
    rows = []
    ranks = {x: n for n, x in enumerate(sorted({score for score, _ in model.pieces.values()}, reverse=True))}
    for p, (score, i) in model.pieces.items():
        parts, scores = model.merges(p)
        if len(parts) == 1:
            rows.append((p, score, i, ranks[score], any(x <= score for x in scores[:-1])))
    return spark.createDataFrame(rows, "piece string, score double, id int, rank int, late boolean")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, shortest: int = 2) -> DataFrame:
    """Edges (word, at, till, score, id) of the distinct ``words`` (column ``word``; other columns stay).

    The places of a word's substrings come from a join, too: with a small table of them by the word's length.
    """
    places = [(n, at, till) for n in range(shortest, SHORT + 1) for at in range(n - shortest + 1) for till in range(at + shortest, min(n, at + longest) + 1)]
    places = words.sparkSession.createDataFrame(places, "size int, at int, till int")
    spans = words.withColumn("size", F.length("word")).join(F.broadcast(places), "size").drop("size")
    spans = spans.withColumn("span", F.substring(F.col("word"), F.col("at") + 1, F.col("till") - F.col("at")))
    # Joined by a 64-bit hash of the text, which is quicker to look up, and then by the text itself.
    keyed = pieces.withColumn("h", F.xxhash64("piece"))
    met = spans.withColumn("h", F.xxhash64("span")).join(F.broadcast(keyed), "h")
    return met.where(F.col("piece").startswith(F.col("span")) & (F.octet_length("piece") <= F.octet_length("span"))).drop("h", "span")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _edge(rank: Column, at: Column, till: Column, late: Column) -> Column:
    """An edge as one number that sorts by rank, then place."""
    return rank.cast("long") * 8192 + at * 128 + till * 2 + late.cast("long")


def merge_cuts(edges: Column, size: Column) -> Column:
    """Cuts of a word as bits: the best edge over exactly two neighbours joins them, until there is none.

    ``edges`` is a sorted array of ``_edge`` numbers.
    Without late edges every edge gets its turn once, in order; with one, each turn looks for the best of all.
    """
    one = F.lit(1).cast("long")
    full = _shift(F.lit(2).cast("long"), size) - 1
    at = lambda e: F.shiftright(e, 7).bitwiseAND(63).cast("int")
    till = lambda e: F.shiftright(e, 1).bitwiseAND(63).cast("int")
    inner = lambda e: _shift(one, till(e)) - _shift(one, at(e) + 1)

    def fits(cuts, e):
        ends = F.getbit(cuts, at(e)) + F.getbit(cuts, till(e))
        return (F.bit_count(cuts.bitwiseAND(inner(e))) == 1) & (ends == 2)

    def join(cuts, e):
        return F.when(fits(cuts, e), cuts.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(cuts)

    def best(cuts, _):
        first = F.get(F.filter(edges, lambda e: fits(cuts, e)), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(inner(first))), cuts)

    # Every merge takes a cut away, so there are fewer of them than characters.
    in_turn, at_best = F.aggregate(edges, full, join), F.aggregate(F.sequence(F.lit(2), size), full, best)
    return F.when(F.exists(edges, lambda e: e.bitwiseAND(1) == 1), at_best).otherwise(in_turn)


def viterbi_path(edges: Column, size: Column, unknown: float = -100.0) -> Column:
    """Ends of the pieces on the path with the largest sum of scores; single characters without an edge cost ``unknown``.

    ``edges`` is an array of (till, at, score) sorted by ``till``.  The state holds, for every place, the best sum
    up to there and where its last piece starts.
    """
    kind = "array<struct<sum:double,back:int>>"
    first = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("back"))).cast(kind)

    def step(best, till):
        plain = F.struct((F.element_at(best, till)["sum"] + unknown).alias("sum"), (till - 1).alias("back"))
        here = F.filter(edges, lambda e: e["till"] == till)
        ways = F.transform(here, lambda e: F.struct((F.element_at(best, e["at"] + 1)["sum"] + e["score"]).alias("sum"), e["at"].alias("back")))
        return F.concat(best, F.array(F.array_max(F.concat(F.array(plain), ways)))).cast(kind)

    best = F.aggregate(F.sequence(F.lit(1), size), first, step)

    def back(acc, _):
        at = F.element_at(F.element_at(F.transform(F.array(acc), lambda a: a["best"]), 1), acc["at"] + 1)["back"]
        more = F.when(acc["at"] > 0, F.concat(F.array(acc["at"]), acc["ends"])).otherwise(acc["ends"])
        return F.struct(acc["best"].alias("best"), F.when(acc["at"] > 0, at).otherwise(F.lit(0)).alias("at"), more.alias("ends"))

    start = F.struct(best.alias("best"), size.alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(F.sequence(F.lit(1), size), start, back, lambda acc: acc["ends"])


def word_cuts(words: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """(word, the other columns, cuts): one row a row; the other columns are part of the key."""
    key = words.columns
    edges = lattice(words, piece_table(spark, model), model.longest)
    edge = _edge(*map(F.col, ("rank", "at", "till", "late")))
    grouped = edges.groupBy(*key).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return grouped.select(*key, merge_cuts(F.col("edges"), F.length("word")).alias("cuts"))


def _stretches(text: str) -> list[str]:
    """A text cut at its blanks, one of them taken out at each cut; further blanks stay in front of what follows.

    Few stretches differ, so words are looked for once in each.
    """
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stretches of all texts, and where each text's start; null and empty texts have none."""
    any_ = pc.greater(pc.binary_length(texts), 0).fill_null(False)
    texts, sizes = texts.filter(any_), np.zeros(len(texts), np.int64)
    lists = pc.split_pattern(texts, " ")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(odd):
        theirs = pa.array([_stretches(t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
        place = np.arange(len(lists))
        place[odd] = len(lists) + np.arange(len(odd))
        lists = pa.concat_arrays([lists, theirs]).take(pa.array(place))
    sizes[any_.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists)
    return lists.flatten(), np.cumsum(np.append(0, sizes))


class _Known(dict):
    """Ids of a group's stretches (with a blank before each) as bytes.

    A word that starts with a blank is a stretch itself; other words are kept aside, and so are those that no edge
    joins, up to ``GATHER`` of them.  Stretches of several words are not kept.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.inner, self.rest = model, {}, {}

    def learn(self, words: list[str], cuts: list[int]) -> None:
        cut = self.model.cut
        for w, mask in zip(words, cuts, strict=True):
            if w[0] == " ":
                self[w[1:]] = cut(w, mask)
            else:
                self.inner[w] = cut(w, mask)

    def _slow(self, word: str) -> bytes:
        """A word that no edge joins: its characters."""
        found = self.rest.get(word)
        if found is None:
            if len(self.rest) >= GATHER:
                self.rest.clear()
            found = self.rest[word] = b"".join(map(self.model.coded, self.model.merges(word)[0]))
        return found

    def of(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches; the words of all that are not known as one are searched for at once."""
        made, known, slow = list(map(self.get, stretches)), self.inner.get, self._slow
        open_ = [i for i, x in enumerate(made) if x is None]
        full = [i for i in open_ if stretches[i].strip(" ")]
        ends = [i for i in open_ if not stretches[i].strip(" ")] if len(full) < len(open_) else []
        parts: list[bytes] = []
        for w in self.model.words_of([stretches[i] for i in full], [stretches[i] for i in ends]):
            if w[0] == " ":
                parts.append(self.get(w[1:]) or slow(w))
            else:
                parts[-1] += known(w) or slow(w)
        for i, ids in zip(full + ends, parts, strict=True):
            made[i] = ids
        return made


def _packed(columns: list[pa.Array], names: list[str]) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=6).compress(sink.getvalue())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the piece ids of the text, and whether they decode to it (``decodes``)."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        raw = f.read()
    model = Model(raw)
    shared = spark.sparkContext.broadcast(raw)
    keep = docs.columns if keep is None else keep
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS:
        spark.conf.set(setting, str(ROWS))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = staged(docs, "encode")  # both passes have to see the same partitions
    ids_name, good = fresh(docs.select(*map(quoted, keep)), ids_col), fresh(docs.select(*map(quoted, keep)), "decodes")
    n, parts = len(keep), int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(col(docs, text_col)))).first()[0] or 0
    split = max(1, -(-total // (group * max(1, docs.rdd.getNumPartitions()))))  # groups a partition
    names = [f"c{i}" for i in range(n + 1)]
    kept = [docs[quoted(c)].alias(names[i]) for i, c in enumerate(keep)]
    salt = F.pmod(F.xxhash64(F.length(col(docs, text_col)), *[docs[quoted(c)] for c in keep if c != text_col and not isinstance(docs.schema[c].dataType, T.MapType | T.VariantType)]), F.lit(split))
    g = (F.spark_partition_id().cast("long") * split + salt).alias("g")
    rows = docs.select(g, col(docs, text_col).alias(names[n]), *[c for c, k in zip(kept, keep, strict=True) if k != text_col])
    own = [names[n] if c == text_col else names[i] for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep])
    schema = schema.add(ids_name, T.ArrayType(T.IntegerType())).add(good, T.BooleanType())

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set of words of each group that the lattice has to cut."""
        m, sets, ends, size = _model(shared.value), defaultdict(set), defaultdict(set), 0

        def flush():
            for g in list(sets):
                stretches, words = list(sets.pop(g)), {" " + s for s in ends.pop(g, ())}
                for at in range(0, len(stretches), 10_000):
                    words.update(m.words_of(stretches[at : at + 10_000], []))
                w = pa.array([x for x in words if 1 < len(x) <= SHORT], pa.string())
                for at in range(0, len(w), 10_000):
                    part = w.slice(at, 10_000)
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), g))], names=["word", "g"])

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t := t.as_py():
                    mine, found = sets[g], _stretches(t.replace(BLANK, " "))
                    if not found[-1].strip(" "):
                        ends[g].add(found.pop())
                    size -= len(mine)
                    mine.update(found)
                    size += len(mine)
            if size > GATHER:
                yield from flush()
                sets.clear()
                size = 0
        yield from flush()
        sets.clear()
        give_back()

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group, some ``PACKET`` bytes compressed together."""
        held, sizes = defaultdict(list), defaultdict(int)

        def packet(g: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(g)).combine_chunks()
            sizes[g] = 0
            cargo = _packed([c.chunk(0) for c in t.columns[1:]], t.column_names[1:])
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([cargo], pa.binary())], names=["g", "cargo"])

        for batch in batches:
            step = max(1, PACKET * batch.num_rows // max(1, 4 * batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                gs = part.column(0).to_numpy()
                for g in np.unique(gs).tolist():
                    mine = np.flatnonzero(gs == g)
                    held[g].append(part if len(mine) == len(gs) else part.take(pa.array(mine)))
                    sizes[g] += held[g][-1].nbytes
                    if sizes[g] >= PACKET:
                        yield packet(g)
        for g in list(held):
            yield packet(g)
        give_back()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts of a group's words, then its packets."""
        import zstandard

        m, at, known = _model(shared.value), None, None
        back = pa.array(m.back, pa.binary())
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            gs, words = batch.column(0).to_numpy(), batch.column(1)
            for start in np.flatnonzero(np.diff(gs, prepend=gs[:1] - 1)).tolist():
                till = int(np.searchsorted(gs, gs[start], "right"))
                if gs[start] != at:
                    at, known = gs[start], _Known(m)
                is_cut = words.slice(start, till - start).is_valid().to_numpy(zero_copy_only=False)
                n_cuts = int(is_cut.sum())  # they come first
                learnt = [c.slice(start, n_cuts).to_numpy(zero_copy_only=False).tolist() for c in batch.columns[1:3]]
                known.learn(*learnt)
                for cargo in batch.column(3).slice(start + n_cuts, till - start - n_cuts):
                    for part in pa.ipc.open_stream(unpack.decompress(cargo.as_py())):
                        yield _encoded(part, m, known, back, names[n], own, [*keep, ids_name, good])

    pairs = rows.select("g", names[n]).mapInArrow(gathered, "word string, g long")
    slabs = pairs.groupBy("word", F.floor(F.col("g") / SLAB).alias("slab")).agg(F.bit_or(_shift(F.lit(1).cast("long"), (F.col("g") % SLAB).cast("int"))).alias("has"))
    cuts = word_cuts(slabs, spark, model)
    single = F.array(F.round(F.log2(F.col("has").cast("double"))).cast("int"))
    several = F.filter(F.sequence(F.lit(0), F.lit(SLAB - 1)), lambda b: F.getbit("has", b) == 1)
    places = F.explode(F.when(F.bit_count("has") == 1, single).otherwise(several))
    cuts = cuts.select("word", "cuts", "slab", places.alias("bit")).select((F.col("slab") * SLAB + F.col("bit")).alias("g"), "word", "cuts", F.lit(None).cast("binary").alias("cargo"))
    cargo = rows.mapInArrow(packets, "g long, cargo binary").select("g", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("cuts"), "cargo")
    met = cuts.union(cargo).repartition(parts, "g").sortWithinPartitions("g", F.col("word").isNull())
    return met.mapInArrow(put_together, schema)


def _encoded(part: pa.RecordBatch, m: Model, known: _Known, back: pa.Array, text: str, own: list[str], names: list[str]) -> pa.RecordBatch:
    """A packet's rows with ids and whether they decode.

    Each of the packet's different stretches is looked up once, and its ids are then put in all its places.
    """
    texts = pc.replace_substring(part.column(text), BLANK, " ")
    stretches, starts = _split(texts)
    found = stretches.dictionary_encode()
    made = known.of(found.dictionary.to_numpy(zero_copy_only=False).tolist())
    ends = np.cumsum([0, *map(len, made)], dtype=np.int64) // 4
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids).take(found.indices)
    ends, ids = ids.offsets.to_numpy()[starts], ids.flatten()
    spelled = back.take(ids)
    flat = spelled.buffers()[2] if len(ids) else b""
    till = np.frombuffer(spelled.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    flat = memoryview(flat) if flat else memoryview(b"")
    spans = zip(texts.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ok = [not t or bytes(flat[till[a] : till[b]]).decode("utf-8", "replace") == " " + t for t, a, b in spans]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in own], lists, pa.array(ok, pa.bool_())], names=names)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give null.  Row-wise: no shuffle."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    schema = rows.withColumn(text_col, F.lit("").cast("string")).schema
    order = [c for c in schema.names if c != text_col]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in batches:
            texts = [None if i is None else m.decode(i) for i in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            by = dict(zip(batch.schema.names, batch.columns, strict=True)) | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([by[c] for c in schema.names], names=schema.names)

    assert set(order) <= set(rows.columns)
    return rows.mapInArrow(decoded, schema)
