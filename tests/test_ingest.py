from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skeinlog import schema as S
from skeinlog.operators import dedup, ingest
from skeinlog.operators.query import LogQuery, dashboard_filter, from_params

T0 = datetime(2025, 3, 9, 6, 30)


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, timestamp timestamp, host string, source string, level string, message string, fields map<string,string>")


def test_validate(spark):
    rows = [("1", T0, "h", "s", "  ", "ok", None), ("2", T0, " ", "s", None, "x", None), ("3", T0, "h", "", None, "x", None), ("4", T0, "h", "s", None, "", None), ("5", None, "h", "s", "warn ", "é" * 6, None)]
    out = {r.id: r for r in ingest.validate(entries(spark, rows), F.lit(T0), 10).collect()}
    assert [out[k]._error for k in "12345"] == [None, S.ERROR_MISSING_HOST, S.ERROR_MISSING_SOURCE, S.ERROR_MISSING_MESSAGE, S.ERROR_MESSAGE_TOO_LARGE]
    assert out["1"].level == "" and out["5"].timestamp == T0


def test_default_host_and_batches(spark):
    df = spark.createDataFrame([("a", [("1", T0, "", "s", None, "m", None), ("2", T0, " ", "s", None, "m", None)]), ("b", [("3", T0, "h", "s", None, "m", None)] * 3), ("c", [])], S.INGEST_REQUEST)
    fine, large = ingest.explode_requests(df, 2)
    hosts = {r.id: r.host for r in ingest.default_host(fine, F.col("agent_id")).collect()}
    assert hosts == {"1": "a", "2": " "} and [r.agent_id for r in large.collect()] == ["b"]


def test_window_is_anchored(spark):
    minute = timedelta(minutes=5)
    at = [T0, T0 + timedelta(minutes=3), T0 + minute, T0 + minute + timedelta(microseconds=1), T0 + timedelta(minutes=9), T0 + timedelta(minutes=40)]
    df = spark.createDataFrame([("x", t, i) for i, t in enumerate(at)] + [("", T0, 10), (None, T0, 11), ("y", T0, 12)], "id string, _arrival timestamp, _seq long")
    assert sorted(r._seq for r in dedup.within_window(df).collect()) == [0, 3, 5, 10, 11, 12]
    assert sorted(r._seq for r in dedup.first_of_each(df).collect()) == [0, 10, 11, 12]


def test_match(spark):
    df = entries(spark, [("1", T0, "Pier-9", "Winch", "ERROR", "Brake pad worn on drum", {"Shift": "night-B"})])
    cases = {
        LogQuery(): True, LogQuery(host="pier-9"): True, LogQuery(host="pier"): False, LogQuery(source=" WINCH "): True, LogQuery(source="crane"): False,
        LogQuery(level=" Error"): True, LogQuery(level="err"): False, LogQuery(start=T0, end=T0): True, LogQuery(start=T0 + timedelta(seconds=1)): False,
        LogQuery(end=T0 - timedelta(microseconds=1)): False, LogQuery(search="PAD WORN"): True, LogQuery(search="NIGHT"): True, LogQuery(search="shift"): True,
        LogQuery(search="day"): False, LogQuery(host="PIER-9", level="error", search="drum"): True, LogQuery(host="PIER-9", search="day"): False,
    }
    for q, expected in cases.items():
        assert (df.where(q.predicate(df.columns)).count() == 1) is expected, q
    assert df.where(dashboard_filter(df.columns, host="ER-9", search="winch")).count() == 1


def test_rejected_entries_leave_their_id(spark):
    df = spark.createDataFrame([("a", 1, "bad"), ("a", 2, None), ("a", 3, None), ("", 4, None), ("", 5, None), (None, 6, None)], "id string, _seq long, _error string")
    assert {r._seq: r._duplicate for r in dedup.mark_accepted(df).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_limits_and_params():
    assert [LogQuery(limit=n).normalised().limit for n in (0, -1, 10_001, 7)] == [100, 100, 10_000, 7]
    q = from_params({"host": "a", "limit": "x", "start": "2025-03-09T06:30:00Z", "end": "never"})
    assert (q.host, q.limit, q.start.hour, q.end) == ("a", 0, 6, None)
