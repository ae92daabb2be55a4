"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled queue (md5 of the seed and its id).  Its *virtual
finish time* is the words of its source up to and including it, divided by the source's target; a second
pass through the queue follows the first, so each document can be taken twice.  All sources' entries are
merged in order of finish time, and the merged queue is cut at the total budget.  A source therefore gets
its target to within a document.

The running totals are two-level: sums by (source, leading digits of the md5), then a window inside such a
bucket, so that no source, however large, meets in one task.  The merged queue is sorted by ranges over all
tasks; sums of the ranges tell where the budget ends, and only that range is summed row by row.

Inside a source finish times follow the queue, so what a pass takes is the queue's beginning: one last entry a
source and pass says which documents are taken, and no text has to move for it.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own
and sorts last; rows of one source that have the same id and size share their finish time and are taken
alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, drop_staged, fresh, quoted, staged

#: Fixed values of the production mix.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
SEED = "mix"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id, seed: str):
    """Where a document stands in its source's queue; among equal places smaller texts come first."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source (columns ``src``, ``size``): total size and target.  One row a source from here on.

    Targets are the water level: ``min(most * size, weight * level)`` with the level that spends the budget.
    In order of ``size / weight`` the capped sources come first, so running sums give the level directly.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("rest_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("budget") - F.col("capped")) / F.col("rest_weight")
    # The level rises while sources below it are capped and falls behind the first that isn't: the largest is the one.
    per = per.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") > level, level)).over(everything))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), F.col("cap").cast("double"))
    return per.select("src", "rank", "source_size", target.alias("target"), "budget")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(id, src, size, h) of every row: the texts are read once, nothing after this sees them."""
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, source_col).alias("src"), n_words(col(docs, text_col)).alias("size"))
    return staged(rows.withColumn("h", place(F.col("id"), seed)), "sizes")


def _finish_times(rows: DataFrame, weights, share, most) -> DataFrame:
    """``rows`` (id, src, size, h) with source_size, target, budget and the words queued up to each row."""
    rows = rows.withColumn("bucket", F.substring("h", 1, 3)).withColumn("null_src", F.col("src").isNull())
    rows = rows.withColumn("skey", F.coalesce("src", F.lit("")))
    sums = rows.groupBy("skey", "null_src", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("src").alias("src"))
    in_source = Window.partitionBy("skey", "null_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
    targets = source_targets(sums.select("src", F.col("bucket_size").alias("size")), weights, share, most)
    targets = targets.withColumns({"null_src": F.col("src").isNull(), "skey": F.coalesce("src", F.lit(""))}).drop("src")
    offsets = sums.drop("src", "bucket_size").join(targets, ["skey", "null_src"])
    rows = rows.join(offsets, ["skey", "null_src", "bucket"])
    queue = Window.partitionBy("skey", "null_src", "bucket").orderBy("h", "size")
    peers = queue.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # rows that tie finish together
    return rows.withColumn("queued", F.col("offset") + F.sum("size").over(peers))


#: The order of the merged queue; entries that agree in all of it are taken alike.
QUEUE = (("vft", "double"), ("rank", "int"), ("h", "string"), ("size", "long"), ("turn", "int"))


def _cut(timed: DataFrame, most: int):
    """The first entry of the merged queue that goes beyond the budget, or None if the budget takes all.

    A global range sort: entries are dealt by ranges of the queue's order and each range is summed; the ranges' sums
    (as many rows as shuffle partitions) tell in which range the budget ends, and only that range is summed row by row.
    """
    spark = timed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finish = (F.col("source_size") * F.col("turn") + F.col("queued")) / F.col("target")
    entries = timed.where("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    entries = entries.select(finish.alias("vft"), "rank", "h", "size", "turn", "budget")
    names = [name for name, _ in QUEUE]
    # Ranges are drawn by sampling, so which range a row is in is written down before it is used twice.
    dealt = staged(entries.repartitionByRange(parts, *names).withColumn("range", F.spark_partition_id()), "queue")
    spent, at = 0, None
    for r in dealt.groupBy("range").agg(F.sum("size").alias("s"), F.first("budget").alias("b")).orderBy("range").collect():
        if spent + r["s"] > r["b"]:
            at = r["range"]
            break
        spent += r["s"]
    limit = None
    if at is not None:
        order = Window.partitionBy("range").orderBy(*names).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inside = dealt.where(F.col("range") == at).withColumn("sum", F.lit(spent) + F.sum("size").over(order))
        limit = inside.where("sum > budget").agg(F.min(F.struct(*names)).alias("m")).first()["m"]
    drop_staged(dealt)
    return limit


def _merged(docs: DataFrame, id_col, text_col, source_col, weights, share, most, seed):
    """Every row's place in its source's queue, as a staged table, and the entry at which the merged queue is cut."""
    sizes = _sized(docs, id_col, text_col, source_col, seed)
    timed = staged(_finish_times(sizes, weights, share, most).select("id", "src", "size", "rank", "source_size", "target", "budget", "queued", "h"), "mix")
    drop_staged(sizes)
    return timed, _cut(timed, most)


def _taken(limit, turn: int):
    """Whether pass ``turn`` through the queues takes a row."""
    some = (F.col("size") > 0) & (F.col("target") > 0)
    if limit is None:
        return some
    vft = (F.col("source_size") * turn + F.col("queued")) / F.col("target")
    here = F.struct(vft.alias("vft"), F.col("rank"), F.col("h"), F.col("size"), F.lit(turn).alias("turn"))
    there = F.struct(*[F.lit(limit[k]).cast(t).alias(k) for k, t in QUEUE])
    return some & (here < there)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """One row a document: id, src, size, source_size, target, copies (0 to ``most``), taken."""
    timed, limit = _merged(docs, id_col, text_col, source_col, weights, share, most, seed)
    taken = sum((F.when(_taken(limit, turn), 1).otherwise(0) for turn in range(most)), F.lit(0))
    return timed.select(
        F.col("id").alias(id_col), "src", "size", "source_size", "target", taken.alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``copies`` says, with its own columns only.

    Empty texts have nothing to take and go.  The last entry each pass takes of a source is staged, so that Spark knows
    how small that table is and sends it to the texts.
    """
    timed, limit = _merged(docs, id_col, text_col, source_col, weights, share, most, seed)
    s, h, n, c = (fresh(docs, f"mix_{x}") for x in "shnc")
    ends = [fresh(docs, f"mix_end{turn}") for turn in range(most)]
    entry = F.struct(F.col("h"), F.col("size"))
    last = [F.max(F.when(_taken(limit, turn), entry)).alias(end) for turn, end in enumerate(ends)]
    bounds = staged(timed.groupBy(F.col("src").alias(s)).agg(*last), "bounds")
    drop_staged(timed)
    placed = docs.withColumns({h: place(col(docs, id_col), seed), n: n_words(col(docs, text_col))})
    joined = placed.join(bounds, col(placed, source_col).eqNullSafe(F.col(s)))
    here = F.struct(F.col(h).alias("h"), F.col(n).alias("size"))
    copies = sum((F.when((F.col(n) > 0) & (here <= F.col(end)), 1).otherwise(0) for end in ends), F.lit(0))
    repeated = joined.withColumn(c, F.explode(F.array_repeat(F.lit(0), copies)))
    return repeated.select(*[quoted(x) for x in docs.columns])
