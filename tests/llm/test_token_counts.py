import public_tokenizers
from tokenizers import Tokenizer

from skeinlog.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a<|endoftext|>b <|endoftext|>", "  x \n\n y\u3000z é ﬁ 😀 don't we'll", "\u0558 ab", "x" * 20_000, "tab\t\tend  ", "Ünï 12 ½ ٣", "\x1c\x85a"]


def test_counts_are_the_librarys(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")
    df = docs.union(extra)
    tok = Tokenizer.from_file(PATH)
    ours = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df, PATH).collect())
    theirs = []
    for r in df.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False))
        theirs.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert ours == sorted(theirs)


def test_cache_may_be_emptied_at_any_time(spark, monkeypatch):
    monkeypatch.setattr(T, "CACHE", 0)
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 1)
    df = spark.createDataFrame([(i, f"word{i} the word{i - 1} café") for i in range(40)], "doc_id long, text string")
    tok = Tokenizer.from_file(PATH)
    for r in T.count_tokens(df, PATH).join(df, "doc_id").collect():
        assert r.n_tokens == len(tok.encode(r.text, add_special_tokens=False))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(df, PATH).count() == 0
