"""Lookups of contexts in count tables, soft labels and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import context_totals
from .windows import prefixes

KEY = ["level", "context"]


def with_level(contexts: DataFrame) -> DataFrame:
    """``contexts(context)`` with the level that their length is."""
    return contexts.withColumn("level", F.size("context"))


def next_distribution(ctx_next: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(level, context, next, prob)`` of the given contexts; unknown ones have no row."""
    x = ctx_next.join(with_level(contexts.select("context").distinct()), KEY, "left_semi")
    n = x.groupBy(*KEY).agg(F.sum("cnt").alias("n"))
    return x.join(n, KEY).select(*KEY, "next", (F.col("cnt") / F.col("n")).alias("prob"))


def context_count(totals: DataFrame, contexts: DataFrame) -> DataFrame:
    """Visits of each given context, 0 if unknown."""
    x = with_level(contexts).join(totals.select(*KEY, "n"), KEY, "left")
    return x.select("context", F.coalesce("n", F.lit(0)).alias("n"))


def context_level(totals: DataFrame, contexts: DataFrame) -> DataFrame:
    """Depth of each given context, -1 if unknown."""
    x = with_level(contexts).join(totals.select(*KEY, F.lit(True).alias("_known")), KEY, "left")
    return x.select("context", F.when(F.col("_known"), F.col("level")).otherwise(-1).alias("depth"))


def soft_labels(windows: DataFrame, ctx_next: DataFrame, T: int, norm: str = "l1") -> DataFrame:
    """``(start, pos, next, prob)`` sparse: the distribution given ``w[0..pos]``; unknown prefixes have no row.

    Each distinct query prefix meets the counts once; a count row meets a
    window's position in the last join only. ``norm``: ``l1`` or ``l2``.
    """
    q = prefixes(windows.select("start", "tokens"), T).select("start", (F.col("level") - 1).alias("pos"), *KEY)
    known = ctx_next.join(q.select(*KEY).distinct(), KEY, "left_semi")
    size = F.sum("cnt") if norm == "l1" else F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt")))
    n = known.groupBy(*KEY).agg(size.alias("_n"))
    labels = known.join(n, KEY).select(*KEY, "next", (F.col("cnt") / F.col("_n")).alias("prob"))
    return q.join(labels, KEY).select("start", "pos", "next", "prob")


def training_batch(windows: DataFrame, ctx_next: DataFrame, T: int) -> DataFrame:
    """``(start, tokens, pos, hard, soft)``: one row per position, soft targets as a map of token to probability.

    A context's counts become one map before the join, so a window's position is one row throughout.
    """
    q = prefixes(windows.select("start", F.col("tokens").alias("sequence"), "tokens"), T)
    q = q.select("start", "sequence", (F.col("level") - 1).alias("pos"), *KEY, F.col("next").alias("hard"))
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("next", "cnt"))))
    n = ctx_next.groupBy(*KEY).agg(labels.alias("m"), F.sum("cnt").alias("n"))
    soft = n.select(*KEY, F.transform_values("m", lambda _, c: c / F.col("n")).alias("soft"))
    return q.join(soft, KEY, "left").select("start", F.col("sequence").alias("tokens"), "pos", "hard", "soft")


def cross_corpus_entropy(eval_windows: DataFrame, ref_ctx_next: DataFrame, T: int) -> DataFrame:
    """Mean entropy of the evaluation contexts under another corpus, per level, and how many it does not know."""
    q = prefixes(eval_windows.select("tokens"), T).groupBy(*KEY).agg(F.count("*").alias("visits"))
    x = q.join(context_totals(ref_ctx_next).select(*KEY, "entropy"), KEY, "left")
    known = F.when(F.col("entropy").isNotNull(), F.col("visits"))
    return x.groupBy("level").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("num_true"),
        F.coalesce(F.sum(F.when(F.col("entropy").isNull(), F.col("visits"))), F.lit(0)).alias("num_false"),
        F.coalesce(F.sum(F.col("entropy") * F.col("visits")), F.lit(0.0)).alias("sum_entropy"),
        (F.sum(F.col("entropy") * F.col("visits")) / F.sum(known)).alias("mean_entropy"),
    )


def unknown_contexts(eval_windows: DataFrame, ref_ctx_next: DataFrame, T: int) -> DataFrame:
    """Evaluation contexts that the other corpus never has."""
    q = prefixes(eval_windows.select("tokens"), T).groupBy(*KEY).agg(F.count("*").alias("visits"))
    return q.join(ref_ctx_next.select(*KEY).distinct(), KEY, "left_anti")


def soft_hard_distance(totals: DataFrame) -> DataFrame:
    """Mean L1 distance of one-hot targets and soft labels per level, in closed form ``2 (1 - sum p^2)``; ``l2`` is ``1 - sum p^2``."""
    gap = 1 - F.col("sum_sq") / (F.col("n").cast("double") * F.col("n"))
    return totals.groupBy("level").agg((F.sum(F.col("n") * 2 * gap) / F.sum("n")).alias("l1"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("l2"))


def diff_distributions(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float = 1e-6) -> DataFrame:
    """Keys that only one table has, or whose values differ by more than ``tol``; null keys match each other."""
    left = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(value).alias("a"), F.lit(1).alias("in_a"))
    right = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(value).alias("b"), F.lit(1).alias("in_b"))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    x = left.join(right, on, "full_outer")
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.abs(F.col("a") - F.col("b")) > tol, "differs")
    named = [F.when(F.col("in_a").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys]
    return x.withColumn("side", side).where("side is not null").select(*named, "a", "b", "side")


def only_on_one_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that one table has more often."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def docs_with_contexts(contexts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, context)`` of documents' k-grams ``contexts(doc_id, context)`` that are targets; exact token match by an equi-join."""
    return contexts.select("doc_id", "context").join(targets.select("context").distinct(), "context").distinct().select("doc_id", "context")


def docs_containing(docs: DataFrame, targets: list[str]) -> DataFrame:
    """``(doc_id, context)`` of documents whose text has a target as a substring; ``targets`` is a short list that every task gets."""
    hits = F.filter(F.array(*[F.lit(t) for t in dict.fromkeys(targets)]), lambda t: F.contains("text", t))
    return docs.select("doc_id", F.explode(hits).alias("context"))
