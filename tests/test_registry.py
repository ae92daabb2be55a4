import pytest
from compare import same_rows

from skeinlog.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, data, name):
    same_rows(registry.QUERIES[name](spark, data), registry.ORACLE[name], data)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_time_bounds_prune_partitions(spark, data, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from skeinlog.operators.query import LogQuery, run_newest_segments
    from skeinlog.operators.store import LogStore
    from skeinlog.plans.adapter import logs

    entries = logs(spark, data).withColumn("timestamp", F.col("ts").cast("timestamp"))
    store = LogStore(spark, str(tmp_path / "logs"))
    store.append(entries.select("id", "timestamp", "host", "source", "level", "message", "fields", "_seq"))
    page = store.query(LogQuery(host="node-03", start=datetime(2024, 1, 10), end=datetime(2024, 1, 10, 20)))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(host_lc,node-03)" in plan
    assert store.read().count() == entries.count()
    assert store.disk_usage() == sum(s[2] for s in store.segments()) > 0
    from datetime import date

    parts = [(date.fromisoformat(d), int(h)) for d, h, _ in store.segments()]
    q = LogQuery(level="error", limit=7)
    assert [r.id for r in run_newest_segments(store.read(), q, parts).collect()] == [r.id for r in store.query(q).collect()]
    dropped, freed = store.prune(datetime(2030, 1, 1), max_bytes=1 << 40)
    assert dropped == len(parts) and freed > 0 and store.segments() == []


def test_epoch_of_every_event(spark):
    folder = "/root/testdata/sf0.1"
    out = registry.QUERIES["q_parse_epoch"](spark, folder)
    assert out.count() == spark.read.parquet(f"{folder}/events.parquet").count() == 100_000
    same_rows(out, registry.ORACLE["q_parse_epoch"], folder)


def test_json_lines_that_fail(spark, data):
    """Every line, the malformed ones with default values."""
    out = registry.QUERIES["q_parse_json"](spark, data).collect()
    failed = [r for r in out if r.failed]
    assert (len(out), len(failed)) == (1000, 91)
    assert {(r.micros, r.host, r.source, r.level, r.extra, r.env) for r in failed} == {(1706745600000000, "edge-1", "app", "INFO", None, None)}
    assert all(r.message.endswith("} x") for r in failed)


def test_new_entries_of_every_event(spark, data):
    out = registry.QUERIES["q_new_entries"](spark, data)
    assert out.count() == 1000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("layout", ["out of order", "ties", "folder"])
def test_stream_of_any_layout_matches_sql(spark, data, tmp_path, monkeypatch, layout):
    """Ids over several frames whose rows aren't in the order of time, arrivals at one moment, a table of several files."""
    import duckdb

    from skeinlog.streaming import dedup

    copies = 2 if layout == "ties" else 1
    rows = f"select event_id + 1000 * k as event_id, ts, user_id, event_type, value, props from '{data}/events.parquet', range({copies}) r(k) order by hash(event_id), k"
    (tmp_path / "sql").mkdir()
    duckdb.execute(f"copy ({rows}) to '{tmp_path}/sql/events.parquet' (format parquet)")
    folder = f"{tmp_path}/sql"
    if layout == "folder":
        folder = f"{tmp_path}/several"
        spark.read.parquet(f"{tmp_path}/sql/events.parquet").repartition(3).write.parquet(f"{folder}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if layout == "out of order":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        monkeypatch.setattr(dedup, "HELD_BYTES", 1)
    try:
        for name in ("q_stream_dedup", "q_stream_ingest"):
            same_rows(registry.QUERIES[name](spark, folder), registry.ORACLE[name], f"{tmp_path}/sql")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
