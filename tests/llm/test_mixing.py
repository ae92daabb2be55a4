import pytest
from pyspark.sql import functions as F

from skeinlog.llm import mixing as M


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = M.SHARE * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= M.MOST * sizes[s]]
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = M.MOST * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_targets_and_taken(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "w " * (i * 37 % 90 + (400 if i % 7 == 2 else 0))) for i in range(900)]
    rows += [(1000, "s1", None), (1001, "s1", ""), (3, "s3", rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    out = M.mix_sources(df).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.src] and abs(r.target - target[r.src]) < 1e-6 * max(1, target[r.src])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.src] = taken.get(r.src, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1000, s
    assert sum(taken.values()) <= M.SHARE * sum(sizes.values())
    again = M.mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    applied = M.apply_mix(df)
    assert applied.columns == df.columns
    assert applied.count() == sum(r.copies for r in out)


@pytest.mark.parametrize("sizes", [{"a": 9000}, {"a": 500, "b": 90, "c": 4000}, {f"s{i:02}": 300 + 17 * i for i in range(20)}, {"a": 3, "b": 20_000, "c": 5, None: 700, "d": 0}])
def test_budget_is_spent(spark, sizes):
    """One, some and many sources below their cap; one that holds almost all words; one without any."""
    rows = [(i, s, "w " * 10 if n else "") for i, (s, n) in enumerate((s, n) for s, n in sizes.items() for _ in range(max(1, n // 10)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: n // 10 * 10 or 10 * (n > 0) for s, n in sizes.items()}
    words, want = sum(sizes.values()), brute_targets(sizes)
    got = {r.src: (r.target, r.t) for r in M.mix_sources(df).groupBy("src", "target").agg(F.sum("taken").alias("t")).collect()}
    assert abs(sum(t for t, _ in got.values()) - 1.5 * words) < 1e-6 * words
    for s, (target, taken) in got.items():
        assert abs(target - want[s]) < 1e-6 * words and abs(taken - target) <= 20
        assert sizes[s] == 0 or target > 0
    assert sum(taken for _, taken in got.values()) > 1.5 * words - 20 * len(sizes)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix_sources(df).count() == 0 and M.apply_mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in M.mix_sources(blank).collect()] == [0]


def test_applied_as_counted(spark):
    """Each row as often as its copies say, also where a source's name looks like no name; and no shuffle moves the texts."""
    rows = [(i % 400 or None, (None, "\x00", "", "a")[i // 400], "w " * (i * 37 % 400 % 90)) for i in range(1600)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, source string, text string").withColumn("mix_s", F.lit("x"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "32k")
    try:
        applied = M.apply_mix(df)
        plan = applied._jdf.queryExecution().executedPlan().toString()
        got = {(r.doc_id, r.source): r["count"] for r in applied.groupBy("doc_id", "source").count().collect()}
    finally:
        spark.conf.set(limit, before)
    assert applied.columns == df.columns and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    want = {(r.doc_id, r.src): r.n for r in M.mix_sources(df).groupBy("doc_id", "src").agg(F.sum("copies").alias("n")).collect()}
    assert any(want[i, None] != want[i, "\x00"] for i in range(1, 400))
    assert got == {k: n for k, n in want.items() if n}
