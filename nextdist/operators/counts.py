"""Next-token counts of contexts, and the statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .windows import prefixes


def context_next_counts(windows: DataFrame, T: int) -> DataFrame:
    """``(level, context, next, cnt)`` for every prefix of every window.

    T rows per window meet in a grouping with map-side sums; for long windows take :func:`~nextdist.operators.sorted_stats.context_next_counts_sorted`.
    """
    return prefixes(windows.select("tokens"), T).groupBy("level", "context", "next").agg(F.count("*").alias("cnt"))


def unigram_transitions(windows: DataFrame) -> DataFrame:
    """``(t0, t1, cnt)`` over the windows' starts."""
    return windows.groupBy(F.col("tokens")[0].alias("t0"), F.col("tokens")[1].alias("t1")).agg(F.count("*").alias("cnt"))


def bigram_transitions(windows: DataFrame) -> DataFrame:
    """``(t0, t1, t2, cnt)`` over the windows' starts."""
    return windows.groupBy(*[F.col("tokens")[i].alias(f"t{i}") for i in range(3)]).agg(F.count("*").alias("cnt"))


def start_prefix_counts(windows: DataFrame, k: int) -> DataFrame:
    """``(prefix, cnt)``: the first ``k`` tokens of the windows."""
    return windows.groupBy(F.slice("tokens", 1, k).alias("prefix")).agg(F.count("*").alias("cnt"))


def start_pair_counts(windows: DataFrame) -> DataFrame:
    """``(t0, t1, cnt)``: first two tokens of the windows."""
    return unigram_transitions(windows)


def first_token_counts(windows: DataFrame) -> DataFrame:
    """``(t0, cnt)``: first tokens of the windows."""
    return windows.groupBy(F.col("tokens")[0].alias("t0")).agg(F.count("*").alias("cnt"))


def pair_locations(windows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(t0, t1, start)`` in long form, so that a frequent pair is no row of its own; ``pairs`` restricts them."""
    x = windows.select(F.col("tokens")[0].alias("t0"), F.col("tokens")[1].alias("t1"), "start")
    return x if pairs is None else x.join(pairs.select("t0", "t1"), ["t0", "t1"], "left_semi")


def context_totals(ctx_next: DataFrame) -> DataFrame:
    """``(level, context, n, support, entropy, onehot, sum_sq)`` per context (natural log)."""
    c = F.col("cnt")
    x = ctx_next.groupBy("level", "context").agg(
        F.sum(c).alias("n"), F.count("*").alias("support"), F.sum(c * F.ln(c)).alias("_s"), F.sum(c.cast("double") * c).alias("sum_sq")
    )
    h = F.when(F.col("support") == 1, 0.0).otherwise(F.ln("n") - F.col("_s") / F.col("n"))
    return x.select("level", "context", "n", "support", h.alias("entropy"), (F.col("support") == 1).alias("onehot"), "sum_sq")


LEVEL_SUMS = ["total_entropy", "total_uniformity", "total_visits", "unique_nodes", "total_support", "onehot_contexts", "onehot_visits"]


def level_sums(totals: DataFrame, *keys: str) -> DataFrame:
    """The additive part of the level statistics."""
    nh = F.col("n") * F.col("entropy")
    return totals.groupBy(*keys, "level").agg(
        F.sum(nh).alias("total_entropy"),
        F.coalesce(F.sum(F.when(F.col("support") > 1, nh / F.ln("support"))), F.lit(0.0)).alias("total_uniformity"),
        F.sum("n").alias("total_visits"),
        F.count("*").alias("unique_nodes"),
        F.sum("support").alias("total_support"),
        F.count_if(F.col("support") == 1).alias("onehot_contexts"),
        F.coalesce(F.sum(F.when(F.col("support") == 1, F.col("n"))), F.lit(0)).alias("onehot_visits"),
        F.sum(F.col("support") * F.col("n")).alias("visit_support"),
    )


def with_averages(sums: DataFrame) -> DataFrame:
    """Add the ratios to level sums; averages are never averaged."""
    v, u = F.col("total_visits"), F.col("unique_nodes")
    return (
        sums.withColumn("avg_entropy", ratio(F.col("total_entropy"), v))
        .withColumn("avg_uniformity", ratio(F.col("total_uniformity"), v))
        .withColumn("avg_support_per_context", ratio(F.col("total_support"), u))
        .withColumn("avg_support_per_visit", ratio(F.col("visit_support"), v))
    )


def level_stats(ctx_next: DataFrame) -> DataFrame:
    """One row of statistics per level."""
    return with_averages(level_sums(context_totals(ctx_next)))


def corpus_entropy(totals: DataFrame) -> DataFrame:
    """Visit-weighted mean entropy over all contexts and levels."""
    return totals.agg((F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("corpus_entropy"), F.sum("n").alias("observations"), F.count("*").alias("contexts"))


def entropy_share_per_level(stats: DataFrame) -> DataFrame:
    """Each level's part of the corpus entropy. ``stats`` has one row per level."""
    every = W.partitionBy(F.lit(0))
    return stats.select("level", (F.col("total_entropy") / F.sum("total_visits").over(every)).alias("entropy_share"))


def context_entropy_contribution(totals: DataFrame) -> DataFrame:
    """Per context, its entropy over all observations of its level."""
    n = totals.groupBy("level").agg(F.sum("n").alias("_v"))
    return totals.join(F.broadcast(n), "level").select("level", "context", (F.col("entropy") / F.col("_v")).alias("contribution"))  # one row per level


def context_counts(totals: DataFrame) -> DataFrame:
    """Distinct contexts and all observations."""
    return totals.agg(F.count("*").alias("unique_contexts"), F.sum("n").alias("total_contexts"))


def approx_unique_contexts(windows: DataFrame, T: int, rsd: float = 0.02) -> DataFrame:
    """Distinct contexts per level by a sketch, without counting any."""
    return prefixes(windows.select("tokens"), T).groupBy("level").agg(F.approx_count_distinct(F.xxhash64("context"), rsd).alias("approx_contexts"))


def enumerate_contexts(totals: DataFrame, min_level: int = 1) -> DataFrame:
    """Every context of at least a level, with its count."""
    return totals.where(F.col("level") >= min_level).select("level", "context", "n")


def doc_context_counts(contexts: DataFrame) -> DataFrame:
    """Counts per document and overall (``doc_id`` null, ``whole`` 1), from rows ``(doc_id, context, next)``."""
    return contexts.groupingSets([["doc_id", "context", "next"], ["context", "next"]], "doc_id", "context", "next").agg(F.count("*").alias("cnt"), F.grouping("doc_id").cast("int").alias("whole"))


def first_encoding(contexts: DataFrame) -> DataFrame:
    """The id sequence of a context string's first appearance."""
    return contexts.groupBy("context").agg(F.min_by("ids", F.struct("doc_id", "pos")).alias("ids"))


def merge_level_stats(root: DataFrame, shards: DataFrame, root_levels: int = 2) -> DataFrame:
    """Levels up to ``root_levels`` from ``root``, deeper ones summed over shards; ratios are made anew."""
    cols = ["level", *LEVEL_SUMS, "visit_support"]
    x = root.where(F.col("level") <= root_levels).select(*cols).unionByName(shards.where(F.col("level") > root_levels).select(*cols))
    return with_averages(x.groupBy("level").agg(*[F.sum(c).alias(c) for c in cols[1:]]))


def aggregate_metrics(stats: DataFrame, *keys: str) -> DataFrame:
    """Visit-weighted means over levels and totals, one row per run."""
    v = F.sum("total_visits")
    return stats.groupBy(*keys).agg(
        (F.sum("total_entropy") / v).alias("entropy"),
        (F.sum("total_uniformity") / v).alias("uniformity"),
        (F.sum("visit_support") / v).alias("support"),
        (F.sum("onehot_contexts") / v).alias("onehot_ratio"),
        (F.sum("unique_nodes") / v).alias("unique_per_visit"),
        v.alias("visits"),
        F.sum("unique_nodes").alias("contexts"),
    )


def onehot_ratio(stats: DataFrame) -> DataFrame:
    """One-hot contexts over visits per level."""
    return stats.select("level", ratio(F.col("onehot_contexts"), F.col("total_visits")).alias("onehot_ratio"), ratio(F.col("onehot_visits"), F.col("total_visits")).alias("onehot_visit_ratio"))


def compare_runs(stats: DataFrame, run: str, value: str, runs: list | None = None) -> DataFrame:
    """One row per level with a column per run."""
    return stats.groupBy("level").pivot(run, runs).agg(F.first(value))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Sum of partial count tables of any origin."""
    x = tables[0]
    for t in tables[1:]:
        x = x.unionByName(t)
    return x.groupBy(*[c for c in x.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def compare_final(growth: DataFrame, row: str, column: str, points: int) -> DataFrame:
    """Each run's entropy at its last milestone, ``row`` by ``column``; only runs with all ``points`` milestones."""
    x = growth.groupBy(row, column).agg(F.max_by("entropy", "milestone").alias("final"), F.countDistinct("milestone").alias("n")).where(F.col("n") == points)
    return x.groupBy(row).pivot(column).agg(F.first("final"))
