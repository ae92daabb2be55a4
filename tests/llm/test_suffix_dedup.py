import hashlib
import random

import pytest

from skeinlog.llm import suffix_dedup as D


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        t = bytes(rng.choice(b"abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(50)))
        assert D.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_each_window_is_in_one_run():
    rng = random.Random(2)
    for raw in (bytes(rng.choice(b"ab ") for _ in range(3000)), b"Was " * 3000, b"x" * 100):
        start, size, *_ = D.runs_of(raw)
        assert sum(size) == len(raw) - D.WINDOW + 1 and start[0] == 0
        assert all(s + n == t for s, n, t in zip(start, size, start[1:], strict=False))


@pytest.mark.parametrize("crowd", [1, 1500])
def test_removal_equals_brute_force(spark, data, monkeypatch, crowd):
    monkeypatch.setattr(D, "CROWD", crowd)
    extra = [(5000, None), (5001, ""), (5002, "Was " * 400), (5003, "x" * 99), (5004, "x" * 101), (-5, "Was " * 30 + "é" * 200), (-6, "Was " * 30 + "é" * 200)]
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(df).collect()}
    seen = set()
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - D.WINDOW + 1):
            w = raw[i : i + D.WINDOW]
            if w in seen:
                cover[i : i + D.WINDOW] = b"\1" * D.WINDOW
            seen.add(w)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        kept = bytes(c for c, gone in zip(raw, cover, strict=True) if not gone)
        assert got[r.doc_id] == (len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(154))
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long, 0)], "doc_id long, text string, n int")
    out = sorted((str(r.doc_id), r.n_removed) for r in D.remove_repeats(df).collect())
    assert out == [("1", len(long)), ("1", len(long)), ("None", 0)]
    assert D.remove_repeats(df.where("false")).count() == 0
