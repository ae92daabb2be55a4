"""Registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, media, mixing, ngram_jaccard, pieces, quality, secret_scan, suffix_dedup, token_counts, toxicity
from .common import fold_of, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds pictures, so each row of ``embeddings`` is drawn, every tenth a second time as an edited crop."""
    return media.find_copies(media.pictures(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs.select("doc_id", "text"), seen)
    return _classified(toxicity.score(docs, model, keep=["doc_id"]), fold_of(F.col("doc_id"), 5) == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their number, and whether they decode to the text."""
    out = pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decodes").alias("round_trip"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _classified(quality.score(docs, quality_model(docs, labels), keep=["doc_id"]), fold_of(F.col("doc_id"), 3) == 1)


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Trained on the labelled rows outside the held-out fold."""
    seen = labels.where(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs.select("doc_id", "text"), seen)


def _classified(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES = {f.__name__: f for f in (op1_media_descriptors, op2_toxicity, op3_mix_sources, op4_ngram_jaccard, op5_ann, op6_token_counts, op7_suffix_dedup, op8_secret_scan, op9_sentencepiece, op10_quality)}
