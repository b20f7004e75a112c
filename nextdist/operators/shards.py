"""Balanced shards by starting tokens, and merging what shards found."""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered

def top_pairs(pair_counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent pairs; ties by the pair."""
    return pair_counts.orderBy(F.desc("cnt"), "t0", "t1").limit(k)


def round_robin_bins(pair_counts: DataFrame, bins: int) -> DataFrame:
    """Pairs by falling count, dealt to the bins in turn; ties by the pair. No task ranks all pairs."""
    x = numbered(pair_counts.select("t0", "t1", "cnt"), [F.desc("cnt"), F.col("t0"), F.col("t1")], "_rank", "pair-ranks")
    return x.select("t0", "t1", "cnt", (F.col("_rank") % bins).cast("int").alias("bin"))


def greedy_runs(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, list[int]]]:
    """``(count, first rank, number of ranks, bins in turn)``: the greedy rule for ``(count, pairs)``, heaviest first.

    Bins whose loads lie within one count take pairs of that count in turn, until they reach the next
    bin, which then takes its turn too. So a run of any length has one piece per bin at most.
    """
    loads = [(0, b) for b in range(bins)]
    out = []
    for cnt, n in runs:
        at = 0
        while at < n:
            loads.sort()
            low = (loads[0][0] + cnt, loads[0][1])
            turn = [x for x in loads if x < low]
            m = n - at
            if len(turn) < bins:  # those that are still the least loaded before the next bin is
                load, b = loads[len(turn)]
                m = min(m, sum((load - x) // cnt + ((load - x) % cnt > 0 or y < b) for x, y in turn))
            out.append((cnt, at, m, [b for _, b in turn]))
            full, rest = divmod(m, len(turn))
            loads = [(x + cnt * (full + (i < rest)), b) for i, (x, b) in enumerate(turn)] + loads[len(turn) :]
            at += m
    return out


def greedy_bins(pair_counts: DataFrame, bins: int) -> DataFrame:
    """Heaviest pair first, each into the least loaded bin (ties: lowest number).

    The driver gets the number of pairs of each count only, and applies the rule to whole runs of
    equal counts; each pair finds its bin by its rank inside its count. No task ranks all pairs.
    """
    spark = pair_counts.sparkSession
    x = numbered(pair_counts.select("t0", "t1", "cnt"), [F.desc("cnt"), F.col("t0"), F.col("t1")], "_rank", "pair-ranks")
    runs = sorted((tuple(r) for r in x.groupBy("cnt").agg(F.count("*")).collect()), reverse=True)
    before, rows = dict(zip([c for c, _ in runs], itertools.accumulate([n for _, n in runs], initial=0), strict=False)), []
    for cnt, at, n, order in greedy_runs(runs, bins):
        rows.append((cnt, before[cnt] + at, before[cnt] + at + n, order))
    table = spark.createDataFrame(rows, "_cnt long, _from long, _to long, _order array<int>")
    here = (F.col("cnt") == F.col("_cnt")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    x = x.join(F.broadcast(table), here)  # at most a row per bin and distinct count
    return x.select("t0", "t1", "cnt", F.expr("_order[cast((_rank - _from) % size(_order) as int)]").alias("bin"))


def bin_loads(binned: DataFrame) -> DataFrame:
    """Load and members per bin."""
    return binned.groupBy("bin").agg(F.sum("cnt").alias("load"), F.count("*").alias("members"))


def assign_shard(windows: DataFrame, pair_shard: DataFrame) -> DataFrame:
    """Windows with the shard of their first two tokens; pairs without a shard are left out."""
    x = windows.withColumn("t0", F.col("tokens")[0]).withColumn("t1", F.col("tokens")[1])
    return x.join(pair_shard.select("t0", "t1", F.col("bin").alias("shard")), ["t0", "t1"]).drop("t0", "t1")


def combine_growth_logs(logs: DataFrame, value: str = "entropy", weight: str = "total_ctx") -> DataFrame:
    """Per milestone and level, the weighted mean of the shards' values and the sum of their weights."""
    w = F.col(weight)
    return logs.groupBy("milestone", "level").agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value), F.sum(w).alias(weight))
