import random

import pytest

from skeinlog.llm import quality, toxicity
from skeinlog.llm.queries import op2_toxicity, op10_quality


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def held_out(spark, query, label, folder):
    rows = query(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return auc([(r.score, r[label]) for r in rows])


def test_quality_on_the_held_out_fold(spark):
    assert held_out(spark, op10_quality, "quality", "/root/testdata/sf0.01") > 0.97


def test_toxicity_on_the_held_out_fold(spark):
    assert held_out(spark, op2_toxicity, "toxic", "/root/testdata/sf0.1") > 0.8


def test_votes_equal_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["abc", "DEF!!", "x1", "and"]) for _ in range(rng.randrange(3, 60))) for _ in range(80)]
    labels = [int("!!" not in t[:20]) for t in texts]
    m = quality.fit(texts, labels, 16)
    some = [*texts[:20], None, ""]
    got = quality.scores_of(m, some, 7)
    import numpy as np

    for t, s in zip(some, got, strict=True):
        if not t:
            assert s == pytest.approx(sum(labels) / 80)
            continue
        x = np.log1p(quality.term_counts(t)) * m["idf"]
        v = (x / np.linalg.norm(x)) @ m["project"]
        cos = m["vectors"] @ (v / np.linalg.norm(v))
        near = np.argsort(-cos)[:7]
        w = np.maximum(cos[near], 1e-3).astype(float) ** quality.SHARPNESS
        assert s == pytest.approx((w * m["labels"][near]).sum() / w.sum(), abs=2e-2)


def test_skipped_windows_have_no_gain():
    rng = random.Random(3)
    words = ["alpha", "gamma", "delta", "omega", "sigma"]
    ordinary = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    toxic = [t + " grumblefoo snarkzilla" for t in ordinary[:30]]
    m = toxicity.fit(ordinary + toxic, [0] * 60 + [1] * 30)
    g = toxicity.Gains(m["special"], m["base"])
    for t in [*toxic[:5], *ordinary[:5], "", "short"]:
        raw = t.lower().encode()
        gains = g.of(t)
        for i, x in enumerate(gains):
            p = g.lead + raw[i * toxicity.STRIDE : i * toxicity.STRIDE + toxicity.WINDOW]
            assert x == len(g.ordinary.compress(p)) - len(g.toxic.compress(p))


def test_special_word_of_ordinary_parts():
    """Each stretch of ``GRAM`` bytes of the word is somewhere in the ordinary dictionary, the word is not."""
    word, n = "grumblefoosnarkzilla", toxicity.GRAM
    parts = "".join(f"{i:03d}{word[i : i + n]}#" for i in range(len(word) - n + 1))
    g = toxicity.Gains(word.encode(), (parts + "some ordinary text " * 9).encode())
    assert g.of(f"12 {word} 34").max() > 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (3, "x" * 300_000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, label int")
    for module in (quality, toxicity):
        model = module.train(docs, none)
        out = module.score(docs, model, keep=["doc_id"]).collect()
        assert len(out) == 4 and len({r.score for r in out}) == 1
        assert module.score(docs.where("false"), model, keep=["doc_id"]).count() == 0
        clash = module.score(docs.withColumnRenamed("doc_id", "text__"), model)
        assert clash.columns == ["text__", "text", "score", "score_"] and sorted(r.score for r in clash.collect()) == [5, 6, 6, 7]
    assert quality.keep_good(docs, quality.train(docs, none)).columns == docs.columns
