"""Statistics after more and more windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import c_ln_c
from .windows import prefixes


def _point(i, n: int, points: int):
    """The count of point ``i`` from 0: ``i`` of ``points - 1`` equal steps, halves rounded to even, the last one ``n``."""
    return F.when(i >= points - 1, n).otherwise(F.rint(i * (n / (points - 1)))).cast("long")


def milestones(spark: SparkSession, n: int, points: int) -> DataFrame:
    """``points`` equally spaced counts from 0 to ``n``, distinct and rising, without the zero."""
    if points < 2:
        raise ValueError("there must be two points at least")
    return spark.range(points).select(_point(F.col("id"), n, points).alias("milestone")).where("milestone > 0").distinct().orderBy("milestone")


def milestone_of(index, n: int, points: int):
    """First milestone that has seen window ``index`` (from 0), as a column."""
    k = F.ceil((index + 1) / F.lit(n / (points - 1)))
    low, here = _point(k - 1, n, points), _point(k, n, points)
    return F.when(low >= index + 1, low).when(here >= index + 1, here).otherwise(_point(k + 1, n, points))


def growth_curve(windows: DataFrame, T: int, points: int, n: int, index: str = "idx") -> DataFrame:
    """``(milestone, level, entropy, total_ctx, unique_ctx)`` after each milestone of windows seen.

    Counts per (context, next, milestone) become running counts inside their context; a
    milestone's change of ``sum c ln c`` and ``sum n ln n`` comes from touched contexts only, and the
    small table of changes is summed up over milestones.
    """
    x = prefixes(windows.select(milestone_of(F.col(index), n, points).alias("m"), "tokens"), T)
    c = x.groupBy("level", "context", "next", "m").agg(F.count("*").alias("k"))
    run = W.partitionBy("level", "context", "next").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("c", F.sum("k").over(run))
    dc = c_ln_c(F.col("c")) - c_ln_c(F.col("c") - F.col("k"))
    per = c.groupBy("level", "context", "m").agg(F.sum("k").alias("k"), F.sum(dc).alias("dc"))
    run = W.partitionBy("level", "context").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("n", F.sum("k").over(run))
    dn = c_ln_c(F.col("n")) - c_ln_c(F.col("n") - F.col("k"))
    d = per.groupBy("level", "m").agg(F.sum("k").alias("k"), F.sum(dn - F.col("dc")).alias("dh"), F.count_if(F.col("n") == F.col("k")).alias("new"))
    run = W.partitionBy("level").orderBy("m").rowsBetween(W.unboundedPreceding, 0)  # one row per milestone
    d = d.select("level", F.col("m").alias("milestone"), F.sum("dh").over(run).alias("h"), F.sum("k").over(run).alias("total_ctx"), F.sum("new").over(run).alias("unique_ctx"))
    return d.select("milestone", "level", (F.col("h") / F.col("total_ctx")).alias("entropy"), "total_ctx", "unique_ctx")


def online_target_probability(windows: DataFrame, T: int, block: int = 1 << 18) -> DataFrame:
    """``(start, pos, prob)``: probability of the true next token as of each window, which counts itself.

    Running counts are taken inside blocks of starts and added to the counts of earlier blocks, so a
    context that most windows share is spread over as many tasks as there are blocks.
    """
    x = prefixes(windows.select("start", "tokens"), T).withColumn("b", F.floor(F.col("start") / block))

    def running(x: DataFrame, keys: list[str], name: str) -> DataFrame:
        per = x.groupBy(*keys, "b").agg(F.count("*").alias("_k"))
        earlier = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # one row per block
        per = per.select(*keys, "b", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
        inside = F.row_number().over(W.partitionBy(*keys, "b").orderBy("start"))
        return x.withColumn("_r", inside).join(per, [*keys, "b"]).withColumn(name, F.col("_before") + F.col("_r")).drop("_r", "_before")

    x = running(x, ["level", "context", "next"], "seen")
    x = running(x, ["level", "context"], "visits")
    return x.select("start", (F.col("level") - 1).alias("pos"), (F.col("seen") / F.col("visits")).alias("prob"))


def online_soft_labels(windows: DataFrame, T: int, min_level: int = 1, block: int = 1 << 18) -> DataFrame:
    """``(start, pos, next, prob)``: the whole distribution as of each insertion, a row per token seen so far.

    As in :func:`online_target_probability`, starts are cut into blocks. A block knows how often each token came in earlier
    ones; inside it, one running count per context and token is taken. So a context that most windows share is
    spread over blocks and tokens, and no task holds more than one block of one of its tokens.
    """
    key = ["level", "context"]
    x = prefixes(windows.select("start", "tokens"), T).where(F.col("level") >= min_level).withColumn("b", F.floor(F.col("start") / block))
    per = x.groupBy(*key, "b", "next").agg(F.count("*").alias("k"))
    seen = per.groupBy(*key, "next").agg(F.min("b").alias("b0"))
    total = per.groupBy(*key, "b").agg(F.sum("k").alias("n"))
    earlier = W.partitionBy(*key).orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    total = total.select(*key, "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    grid = total.join(seen, key).where("b >= b0").join(per, [*key, "b", "next"], "left")
    earlier = W.partitionBy(*key, "next").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select(*key, "b", "next", "n_before", F.coalesce(F.sum(F.coalesce("k", F.lit(0))).over(earlier), F.lit(0)).alias("before"))
    y = x.withColumnRenamed("next", "hit").join(grid, [*key, "b"])
    inside = W.partitionBy(*key, "b", "next").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    c = F.col("before") + F.sum((F.col("hit") == F.col("next")).cast("long")).over(inside)
    y = y.withColumn("c", c).withColumn("n", F.col("n_before") + F.row_number().over(W.partitionBy(*key, "b", "next").orderBy("start")))
    return y.where("c > 0").select("start", (F.col("level") - 1).alias("pos"), "next", (F.col("c") / F.col("n")).alias("prob"))
