import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlog.operators.parse import Context
from skeinlog.operators.spool import Spool, read_spool
from skeinlog.operators.store import LogStore
from skeinlog.sources import config, tail
from skeinlog.sources.lines import read_lines
from skeinlog.streaming import delivery, metrics, pipeline


def test_spool_is_fifo_and_capped(spark, tmp_path):
    s = Spool(str(tmp_path / "spool"))
    s.push([{"message": "cast off"}, {"message": "slow ahead"}])
    s.push([{"message": "hard to port"}])
    assert [r.name for r in read_spool(spark, s.folder).collect()] == s.files()
    assert [len(s.pop()), s.pop()[0]["message"], s.pop()] == [2, "hard to port", None]
    small = Spool(str(tmp_path / "small"), 650)
    for name in "ABC":
        small.push([{"message": name * 200}])
    assert small.pop()[0]["message"][0] == "B"


def test_ring_and_hub():
    ring = pipeline.Ring(3)
    ring.add([1, 2, 3, 4])
    assert ring.snapshot() == [2, 3, 4] and ring.snapshot(2) == [3, 4]
    hub = pipeline.Hub(ring, max_clients=1, buffer=3)
    c = hub.subscribe()
    assert json.loads(hub.frame(c)) == {"type": "recent_batch", "data": [2, 3, 4]}
    hub.broadcast([{"m": 1}, {"m": 2}])
    assert hub.frame(c).count("\n") == 1
    hub.broadcast([{"m": i} for i in range(9)])
    assert hub.gone == {c: "buffer_overflow"}


def test_delivery(tmp_path):
    assert [delivery.classify(x) for x in (200, 202)] == [None, None]
    assert all(delivery.classify(x) is delivery.Temporary for x in (429, 500, 502, 503))
    assert all(delivery.classify(x) is delivery.Permanent for x in (400, 401, 403, 404, 422))
    rng = random.Random(1)
    for n in range(10):
        assert timedelta(milliseconds=50) <= delivery.backoff(n, timedelta(milliseconds=100), timedelta(seconds=2), rng=rng) <= timedelta(seconds=2)
    spool, answers = Spool(str(tmp_path)), [503, 200, 400]
    sender = delivery.Sender("http://x", post=lambda body: (answers.pop(0), b"{}"))
    assert delivery.deliver(sender, spool, "a", [{"m": 1}]) == "spooled"
    assert delivery.drain(sender, spool, "a") == 1 and spool.pop() is None
    assert delivery.deliver(sender, spool, "a", [{"m": 1}]) == "dropped"


def test_config():
    env = {"PORT": "", "SET": "v"}
    assert config.expand("${SET} ${NONE:-8080} ${MISSING} ${PORT:-9}", env) == "v 8080  9"
    text = "agent: {id: a1}\nserver: {url: 'http://${SET}'}\nbatch: {flush_interval: 1m30s, max_events: 0}\nsources: [{name: s, path: /x, format: ' JSON ', tags: {a: b}}]"
    a = config.load(text, config.Agent, env)
    assert (a.id, a.server_url, a.max_events, a.flush_interval) == ("a1", "http://v", 500, timedelta(seconds=90))
    assert (a.sources[0].format, a.sources[0].start_position, a.sources[0].tags) == ("json", "end", {"a": "b"})
    for bad in ("sources: [{name: s, path: p, format: xml}]", "sources: [{name: s, path: p, format: regexp}]", "sources: [{path: p}]", "agent: {id: ' '}"):
        with pytest.raises(config.ConfigError):
            config.load(bad, config.Agent)
    with pytest.raises(config.ConfigError):
        config.load("auth: {enabled: true}", config.Server)


def test_metrics():
    r = metrics.Registry("agent", metrics.AGENT)
    r.add("events_read_total", 3, source="x")
    assert 'agent_events_read_total{source="x"} 3' in r.render()
    s = metrics.Registry("server", metrics.SERVER)
    s.observe("ingest_duration_seconds", 0.02)
    assert 'server_ingest_duration_seconds_bucket{le="0.025"} 1' in s.render() and 'le="0.01"} 0' in s.render()


def test_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\n" + b"x" * 50 + b"\ntwo")
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "*.log"), 20).collect()) == ["one", "two"]


def test_tail_reader(tmp_path):
    p = tmp_path / "app.log"
    p.write_text("bell\nbuoy\nfo")
    reader = tail.TailReader({"paths": str(p), "startPosition": "beginning"})

    def batch(start):
        end = reader.latestOffset()
        lines = [row[0] for part in reader.partitions(start, end) for row in reader.read(part)]
        return lines, end

    lines, at = batch(reader.initialOffset())
    assert lines == ["bell", "buoy"]
    with p.open("a") as f:
        f.write("ghorn twice\n")
    lines, at = batch(at)
    assert lines == ["foghorn twice"]
    with p.open("a") as f:
        f.write("last\nwords")
    os.rename(p, tmp_path / "app.log.1")
    p.write_text("first\n")
    lines, at = batch(at)
    assert lines == ["last", "words", "first"]
    p.write_text("x\n")
    os.truncate(p, 0)
    with p.open("a") as f:
        f.write("fr\n")
    lines, at = batch(at)
    assert lines == ["fr"]
    p.write_text("old lines\n")
    late = tail.TailReader({"paths": str(p), "startPosition": "end"})
    assert [x for part in late.partitions(late.initialOffset(), late.latestOffset()) for x in late.read(part)] == []
    assert [x for x, _ in tail.lines_of(str(p), 0, 10, 4)] == ["ines"]


def test_admission(tmp_path):
    p = tmp_path / "app.log"
    p.write_text("one\n")
    reader = tail.TailReader({"paths": str(p), "startPosition": "beginning", "maxBytesPerBatch": "8"})
    at = reader.latestOffset()
    reader.partitions(reader.initialOffset(), at)
    with p.open("a") as f:
        f.write("aa\nbb\ncc\n" + "d" * 30 + "\nee\n")
    seen = []
    for _ in range(4):
        end = reader.latestOffset()
        seen.append([row[0] for part in reader.partitions(at, end) for row in reader.read(part)])
        at = end
    assert seen == [["aa", "bb"], ["cc"], ["d" * 30], ["ee"]]


def test_order_over_rotated_files(spark, tmp_path):
    lines = spark.createDataFrame([("rest", "a.log", 1, 900, 0), ("fresh", "a.log", 2, 0, 1), ("other", "b.log", 3, 40, 1)], "value string, _path string, _inode long, _offset long, _turn int")
    out = pipeline.entries(lines, "text", Context("h", "s"), F.current_timestamp())
    assert [r.message for r in out.orderBy("_seq").collect()] == ["rest", "fresh", "other"]
    assert out.select("id").distinct().count() == 3


def test_a_batch_tried_again(spark, tmp_path):
    """The second attempt replaces the first one's rows; other batches and loads stay."""
    rows = [(str(i), datetime(2025, 3, 9, 6 + i % 2), "h", "s", "INFO", f"m{i}", None, datetime(2025, 3, 9), i) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, host string, source string, level string, message string, fields map<string,string>, _arrival timestamp, _seq long")
    store, figures = LogStore(spark, str(tmp_path / "store")), metrics.Registry("server", metrics.SERVER)
    pruned = []
    run = pipeline.writer(store, figures=figures, retention=lambda now: pruned.append(now))
    run(df.where("_seq < 4"), 0)
    run(df.where("_seq >= 4"), 1)
    run(df.where("_seq >= 4"), 1)
    store.append(df.where("_seq = 0").drop("_arrival"))
    assert sorted(r.message for r in store.read().collect()) == ["m0", "m0", "m1", "m2", "m3", "m4", "m5"]
    assert "load" not in store.read().columns and len(pruned) == 3
    assert "server_ingested_events_total 8" in figures.render()
    tick = store.retention(timedelta(days=1), 1 << 40, timedelta(minutes=10))
    now = datetime(2025, 3, 20)
    assert tick(now)[0] == 2 and tick(now + timedelta(minutes=9)) is None and tick(now + timedelta(minutes=10)) == (0, 0)


def test_stream_from_tail_to_store(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    p = tmp_path / "app.log"
    p.write_text('{"level":"warn","message":"a"}\nERROR b\n')
    store, seen = LogStore(spark, str(tmp_path / "store")), []
    hub = pipeline.Hub(pipeline.Ring())

    def start():
        lines = spark.readStream.format("skein_tail").option("paths", str(p)).option("startPosition", "beginning").load()
        stream = pipeline.checked(pipeline.entries(lines, "auto", Context("h", "s"), F.current_timestamp()))
        run = pipeline.writer(store, hub, on_summary=lambda n, row: seen.append(row))
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).start()

    def until(q, n):
        end = time.time() + 60
        try:
            while sum(r["accepted"] for r in seen) < n and time.time() < end and q.exception() is None:
                time.sleep(0.5)
        finally:
            q.stop()

    until(start(), 2)
    assert sum(r["accepted"] for r in seen) == 2
    assert sorted((r.level, r.message) for r in store.read().collect()) == [("ERROR", "ERROR b"), ("WARN", "a")]
    assert [e["level"] for e in hub.ring.snapshot()] == ["WARN", "ERROR"]
    with p.open("a") as f:  # a new start goes on where the checkpoint is
        f.write("info c\n")
    until(start(), 3)
    assert sorted(r.message for r in store.read().collect()) == ["ERROR b", "a", "info c"]


def test_stream_marks_repeats_of_earlier_batches(spark, tmp_path):
    """Entries that were rejected leave their id; later batches know what earlier ones took."""
    schema = "id string, timestamp timestamp, host string, source string, level string, message string, fields map<string,string>, _arrival timestamp, _seq long"
    t = datetime(2025, 3, 9)
    for n, rows in enumerate([[("x", "", 0), ("x", "one", 1), ("y", "two", 2)], [("x", "again", 3), ("z", "three", 4)]]):
        df = spark.createDataFrame([(i, t, "h", "s", "INFO", m, {"k": m}, t, q) for i, m, q in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = pipeline.checked(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), expire=False)
        store = LogStore(spark, str(tmp_path / "store"))
        q = stream.writeStream.foreachBatch(pipeline.writer(store)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.id, r.message, r.fields["k"]) for r in store.read().collect()) == [("x", "one", "one"), ("y", "two", "two"), ("z", "three", "three")]
