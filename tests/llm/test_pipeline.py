import corpus_pipeline
from compare import same_rows
from pyspark.sql import functions as F

from skeinlog.llm import mixing, oracle, queries


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns[: len(columns)] == columns
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    assert docs.where("not decodes").count() == 0
    # The mix takes one and a half times the words of what reached it, but for a document a source.
    before, after = (spark.read.parquet(str(tmp_path / k)).select(mixing.n_words(F.col("text")).alias("n")) for k in "23")
    (words, longest), (taken, _) = (x.agg(F.sum("n"), F.max("n")).first() for x in (before, after))
    sources = spark.read.parquet(str(tmp_path / "2")).select("source").distinct().count()
    assert 1.5 * words - sources * longest < taken <= 1.5 * words
    assert seen[5] == seen[4] > seen[3]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = spark.read.parquet(str(tmp_path / "0")).join(labels.where("quality = 1"), "doc_id").count()
    assert good >= 0.97 * labels.where("quality = 1").count()


def test_registered_sql(spark, data):
    for name in ("op3_mix_sources", "op8_secret_scan"):
        same_rows(queries.QUERIES[name](spark, data), oracle.ORACLE[name], data)
