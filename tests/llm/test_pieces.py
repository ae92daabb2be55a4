import itertools

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skeinlog.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a  b \n\n x\t", "ab" * 5_000, "日本語 é😀 ﬁ", "<s> <0x0A> </s>", " lead", "x\n y", "a▁b"]


def test_ids_are_the_librarys_and_decode(spark, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")).withColumn("g", F.lit(1)).withColumn("word", F.lit("x"))
    out = P.encode(df, PATH).collect()
    assert len(out) == docs.count() + 2 * len(TEXTS)
    for r in out:
        assert r.ids == sp.encode(r.text or "") and r.decodes, r.doc_id
    small = spark.createDataFrame([(i, sp.encode(t or ""), "old") for i, t in enumerate(TEXTS)], "i int, ids array<int>, text string")
    assert [r.text for r in P.decode(small, PATH).orderBy("i").collect()] == [(t or "").replace("▁", " ") for t in TEXTS]
    assert P.encode(df.where("false"), PATH).count() == 0


def test_late_pieces_and_groups(spark):
    """Words with pieces that come up after their turn; many small groups; clashing column names; a shuffled input."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = P.Model(open(PATH, "rb").read())
    late = [r.piece for r in P.piece_table(spark, model).where("late").collect()]
    assert late
    texts = [f"{a}{p}{b} {p}  {p.strip()}{p.strip()}" for p in late for a in ("", "s", "er", "un") for b in ("", "s", "ing", "e")] + TEXTS
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids long, decodes string").repartition(3, "doc_id")
    out = P.encode(df, PATH, group=500)
    assert out.columns == ["doc_id", "text", "ids", "decodes", "ids_", "decodes_"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.ids_ == sp.encode(texts[r.doc_id] or "") and r.decodes_ and r.ids == r.doc_id, r.text


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_a_packet_is_searched_at_once(kind):
    """Stretches of several words do not take a search each; texts of every shape, rows that start inside a batch."""
    sp, m = sentencepiece.SentencePieceProcessor(model_file=PATH), P.Model(open(PATH, "rb").read())
    find, searches = m.words, []
    m.words = lambda text: searches.append(text) or find(text)
    texts = [*TEXTS, "   ", "end ", "end   ", "z" + " " * 90, "▁▁x▁ ", "a  b", "\x00 \x00"] * 2
    texts += [f"x{i}, (y{i})." for i in range(200)]
    part = pa.RecordBatch.from_arrays([pa.array(texts, kind)], names=["t"])
    for rows, wanted in ((part, texts), (part.slice(5), texts[5:]), (part.slice(0, 2), texts[:2])):
        out = P._encoded(rows, m, P._Known(m), pa.array(m.back, pa.binary()), "t", [], ["ids", "decodes"])
        assert out.column(0).to_pylist() == [sp.encode(t or "") for t in wanted] and all(out.column(1).to_pylist())
    assert len(searches) <= 3


def test_viterbi_equals_all_paths(spark):
    table = {"a": -2.0, "b": -3.0, "ab": -3.5, "ba": -1.0, "aba": -5.0, "bb": -2.5, "abab": -4.4}
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)] + ["axb"]
    pieces = spark.createDataFrame([(p, s, i) for i, (p, s) in enumerate(table.items())], "piece string, score double, id int")
    edges = P.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces, 4, 1)
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("till", "at", "score"))).alias("e"))
    found = {r.word: r.ends for r in grouped.select("word", P.viterbi_path(F.col("e"), F.length("word")).alias("ends")).collect()}

    def score(parts):
        return sum(table.get(p, -100.0 if len(p) == 1 else -1e9) for p in parts)

    for w in words:
        ways = [[w[i:j] for i, j in zip((0, *c), (*c, len(w)), strict=True)] for n in range(len(w)) for c in itertools.combinations(range(1, len(w)), n)]
        got = [w[i:j] for i, j in zip([0, *found[w][:-1]], found[w], strict=True)]
        assert abs(score(got) - max(map(score, ways))) < 1e-9
