import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skeinlog.functions.strict_json import read_object
from skeinlog.functions.timestamps import parse_epoch, parse_timestamp
from skeinlog.operators import parse
from skeinlog.operators.parse import Context

CTX = Context("quay-4", "harbour", {"zone": "north"})
NOW = datetime(2026, 1, 1)


def run(spark, fmt, lines, pattern="", strict=False, ctx=CTX):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    e = parse.parser(fmt, ctx, F.lit(NOW), pattern, strict)(F.col("value"))
    return [r.e for r in df.select("i", e.alias("e")).orderBy("i").collect()]


def test_text(spark):
    lines = ["03:15 info - crane 7 parked", "ballast tank three is nearly full (Warning)", "fatal! rudder does not answer\r\n", ""]
    a, b, c, d = run(spark, "text", lines)
    assert (a.level, a.message, a.host, a.source, a.fields) == ("INFO", lines[0], "quay-4", "harbour", {"zone": "north"})
    assert (b.level, c.level, c.message) == ("WARN", "FATAL", "fatal! rudder does not answer")
    assert d.error


@pytest.mark.parametrize("strict", [False, True])
def test_json(spark, strict):
    lines = [
        '{"datetime":"2025-03-09T06:30:00Z","lvl":"error","log":"tide gauge silent","gauge":"G-12"}',
        '{"@timestamp":1741501800,"Severity":"warn","text":"mooring line slack"}',
        '{"hostname":"pier-2","app":"winch","msg":"reel turned"}',
        "{anchor: up",
        "null",
        '{"status":"500","level":"warn"}',
        '{"a":1,"a":2,"level":"","time":"yesterday"}',
    ]
    a, b, c, d, e, f, g = run(spark, "json", lines, strict=strict)
    assert (a.level, a.timestamp, a.fields) == ("ERROR", datetime(2025, 3, 9, 6, 30), {"zone": "north", "gauge": "G-12"})
    assert (b.level, b.message, b.timestamp.year) == ("WARN", "mooring line slack", 2025)
    assert (c.level, c.host, c.source) == ("INFO", "pier-2", "winch")
    assert d.error and not e.error and e.message == "null"
    assert (f.level, f.message) == ("WARN", lines[5])
    assert (g.level, g.timestamp, g.fields) == ("INFO", NOW, {"zone": "north", "a": "2"})


def test_strict_json_spelling():
    assert read_object('{"x":1} junk') is None and read_object("[1]") is None and read_object('{"x":NaN}') is None
    assert read_object('{"a":1.0,"b":1e3,"c":true,"d":null,"e":{"z":1,"y":"<b>"},"f":"1.0","g":0.1}') == {
        "a": "1", "b": "1000", "c": "true", "d": None, "e": '{"y":"\\u003cb\\u003e","z":1}', "f": "1.0", "g": "0.1",
    }


def test_nested_numbers():
    found = read_object('{"n":[1.0,2.50,1e21,1e-7,0.000001,-0.0,123456789012345680000],"o":{"b":{"z":10,"a":false},"a":null}}')
    assert found == {"n": "[1,2.5,1e+21,1e-7,0.000001,-0,123456789012345680000]", "o": '{"a":null,"b":{"a":false,"z":10}}'}


def test_lines_are_read_once(spark):
    df = spark.createDataFrame([("x",)], "value string")
    for fmt in ("json", "auto"):
        plan = parse.parse_lines(df, fmt, CTX, F.lit(NOW))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("jsontostructs") + plan.count("from_json") == 1, plan


def test_regexp(spark):
    pattern = r"^(?P<timestamp>\S+) <(?P<level>\S+)> (?P<message>.*)$"
    a, b = run(spark, "regexp", ["2025-03-09T06:30:00Z <error> lighthouse lamp out", "fog"], pattern)
    assert (a.level, a.message, a.timestamp) == ("ERROR", "lighthouse lamp out", datetime(2025, 3, 9, 6, 30))
    assert b.error == parse.NO_MATCH
    assert parse.translate_pattern(r"(a)\((?P<x_y>[[:alpha:](]+)(?:b)")[1] == {2: "x_y"}
    with pytest.raises(ValueError):
        parse.translate_pattern("(?U)a")


def test_auto_and_fallback(spark):
    a, b, c, d = run(spark, "auto", ['{"lvl":"warn","msg":"gate half open"}', "Error: no pilot aboard", '{"draught: 4', "  "])
    assert (a.level, b.level, b.message, c.message) == ("WARN", "ERROR", "Error: no pilot aboard", '{"draught: 4')
    assert d.error
    df = spark.createDataFrame([("  ",), ("x",)], "value string")
    rows = parse.parse_lines(df, "auto", CTX, F.lit(NOW)).collect()
    assert [(r.message, r.level, r.fields, r._parse_error) for r in rows] == [("  ", "INFO", None, True), ("x", "INFO", {"zone": "north"}, False)]
    with pytest.raises(ValueError):
        parse.parser("xml", CTX, F.lit(NOW))


def test_never_raises(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('{}[]":,\\ \n\ttsx09é') for _ in range(rng.randrange(30))) for _ in range(300)]
    lines += ["}{", "{}", '{"lvl": null, "msg": 7.50}', "", '{"time":99999999999999999999}']
    for fmt in ("text", "json", "auto"):
        for strict in (False, True):
            assert len(run(spark, fmt, lines, strict=strict)) == len(lines)
    assert len(run(spark, "regexp", lines, r"(?P<ts>\d+)x?(?P<level>.)")) == len(lines)


def test_epoch_units(spark):
    cases = {10**11: 10**17, 10**11 + 1: (10**11 + 1) * 1000, 10**14 - 1: (10**14 - 1) * 1000, 10**14: 10**14, 10**17 - 1: 10**17 - 1, 10**17: 10**14, -1: -10**6, 0: 0}
    df = spark.createDataFrame([(n,) for n in cases], "n long").select("n", F.unix_micros(parse_epoch(F.col("n"))).alias("m"))
    assert {r.n: r.m for r in df.collect()} == cases


def test_timestamp_layouts(spark):
    at = datetime(2025, 3, 9, 6, 30, tzinfo=timezone.utc).timestamp()
    good = ["2025-03-09T06:30:00Z", "2025-03-09T08:30:00+02:00", "2025-03-09 06:30:00", "Sun, 09 Mar 2025 06:30:00 GMT", "Sun, 09 Mar 2025 08:30:00 +0200", str(int(at))]
    bad = ["2025-03-09", "2025-03-09T06:30:00", " 5 ", "x", ""]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", F.unix_seconds(parse_timestamp(F.col("x"))).alias("t"))
    found = {r.x: r.t for r in df.collect()}
    assert [found[x] for x in good] == [int(at)] * len(good) and all(found[x] is None for x in bad)
