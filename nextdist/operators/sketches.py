"""Distinct contexts by HyperLogLog sketches that are stored and merged.

A sketch of some kilobytes per level, shard and milestone stands for all contexts seen there; unions of sketches are the sketches of
unions, so shards are merged and growth is read off without the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .growth import milestone_of
from .windows import prefixes

#: 2 ** 14 registers: a standard error of 0.8 percent.
LG_K = 14


def context_sketches(windows: DataFrame, T: int, *keys: str, lg_k: int = LG_K) -> DataFrame:
    """``(keys, level, windows, sketch)`` of the contexts of ``windows(keys, tokens)``. Tasks send one sketch per group, whatever the number of contexts."""
    x = prefixes(windows.select(*keys, "tokens"), T)
    return x.groupBy(*keys, "level").agg(F.count("*").alias("windows"), F.hll_sketch_agg(F.xxhash64("context"), F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of any origin united over what is not among ``keys`` or the level."""
    return sketches.groupBy(*keys, "level").agg(F.sum("windows").alias("windows"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_contexts(sketches: DataFrame) -> DataFrame:
    """The estimated number of distinct contexts beside the sketches' keys."""
    return sketches.withColumn("contexts", F.hll_sketch_estimate("sketch")).drop("sketch")


def sketched_growth(windows: DataFrame, T: int, points: int, n: int, index: str = "idx", lg_k: int = LG_K) -> DataFrame:
    """``(milestone, level, total_ctx, contexts)``: distinct contexts after each milestone of windows seen, estimated.

    One sketch per level and stretch between milestones; the small table of these is united over all earlier ones.
    """
    x = windows.select(milestone_of(F.col(index), n, points).alias("m"), "tokens")
    each = context_sketches(x, T, "m", lg_k=lg_k)
    upto = each.select(F.col("m").alias("milestone")).distinct()
    x = upto.join(F.broadcast(each), F.col("m") <= F.col("milestone"))  # one row per milestone and level
    return sketched_contexts(merge_sketches(x, "milestone")).withColumnRenamed("windows", "total_ctx").select("milestone", "level", "total_ctx", "contexts")
