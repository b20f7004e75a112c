"""Support sets: which tokens follow a context, and contexts that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def support_sets(ctx_next: DataFrame) -> DataFrame:
    """``(level, context, support, n)``: sorted tokens that follow each context, at most a vocabulary long."""
    return ctx_next.groupBy("level", "context").agg(F.sort_array(F.collect_set("next")).alias("support"), F.sum("cnt").alias("n"))


def contexts_per_support(sets: DataFrame) -> DataFrame:
    """How many contexts have each support set, most first."""
    return sets.groupBy("level", "support").agg(F.count("*").alias("contexts"))


def support_size_histogram(sets: DataFrame) -> DataFrame:
    """How many contexts have how many next tokens."""
    return sets.groupBy("level", F.size("support").alias("size")).agg(F.count("*").alias("contexts"))


def distinct_supports(sets: DataFrame) -> DataFrame:
    """Number of distinct support sets per level."""
    return sets.select("level", "support").distinct().groupBy("level").agg(F.count("*").alias("supports"))


def token_groups(ctx_next: DataFrame) -> DataFrame:
    """Tokens that follow the same contexts of a level: the transposed question.

    A token's set of contexts is compared by its size and two sums of hashes, so a frequent token's contexts never become one row.
    """
    h = [F.xxhash64(F.lit(i), "context").cast("decimal(20,0)") for i in (1, 2)]
    by = ctx_next.groupBy("level", "next").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"h{i}") for i, x in enumerate(h)])
    return by.groupBy("level", "n", "h0", "h1").agg(F.sort_array(F.collect_list("next")).alias("tokens")).select("level", F.col("n").alias("contexts"), "tokens")


def top_contexts(totals: DataFrame, k: int = 1000) -> DataFrame:
    """The most frequent contexts; ties by the context."""
    return totals.orderBy(F.desc("n"), "level", "context").limit(k)


def support_overlap(ctx_next: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(a, b, shared)``: next tokens that two of the given contexts ``(id, level, context)`` share; no pair of one context with itself.

    Meant for the top contexts: the self-join is on their next tokens only.
    """
    x = ctx_next.join(contexts.select("id", "level", "context"), ["level", "context"]).select("id", "next")
    y = x.select(F.col("id").alias("b"), "next")
    return x.withColumnRenamed("id", "a").join(y, "next").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def top_overlap_contexts(overlap: DataFrame, num_targets: int) -> DataFrame:
    """Contexts from the strongest overlapping pairs, until there are ``num_targets``."""
    # a context's best pair decides, so each context's best is found before anything is ranked
    both = overlap.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "shared", "a", "b"), F.struct(F.col("b").alias("id"), "shared", "a", "b"))).alias("x")).select("x.*")
    best = both.groupBy("id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "a", "b")).alias("k"))
    return best.orderBy("k.s", "k.a", "k.b", "id").limit(num_targets).select("id", (-F.col("k.s")).alias("shared"))


def top_shared_support_groups(sets: DataFrame, groups: int = 10) -> DataFrame:
    """Among the given contexts' sets, the largest groups with the same support, with their members."""
    size = sets.groupBy("support").agg(F.count("*").alias("contexts"))
    best = size.orderBy(F.desc("contexts"), "support").limit(groups)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("contexts"), "support")))  # at most ``groups`` rows
    return sets.join(F.broadcast(best), "support").select("rank", "contexts", "level", "context", "support")


def sample_shared_support(sets: DataFrame, min_ctx: int = 10, per_set: int = 10, total: int = 100, last: int = 100_000) -> DataFrame:
    """Support sets by rising size, ``per_set`` contexts of each that has at least ``min_ctx``, until ``total``.

    Only the ``last`` sets by size are walked.
    """
    x = sets.groupBy("support").agg(F.count("*").alias("contexts")).withColumn("size", F.size("support"))
    walk = x.orderBy(F.desc("size"), F.desc("support")).limit(last).where(F.col("contexts") >= min_ctx)
    walk = walk.orderBy("size", "support").limit(-(-total // max(1, min(min_ctx, per_set))))
    picked = sets.join(walk.select("support", "size"), "support")
    picked = picked.groupBy("support", "size").agg(F.slice(F.sort_array(F.collect_set("context")), 1, per_set).alias("cs"))
    return picked.select("size", "support", F.explode("cs").alias("context")).orderBy("size", "support", "context").limit(total)


def support_count_sorted(sets: DataFrame) -> DataFrame:
    """Contexts per support set, sorted by that number."""
    return contexts_per_support(sets).orderBy("contexts", "level", "support")


def sparse_matrix(ctx_next: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(row, token, support, cnt)`` of the given contexts ``(id, level, context)``; zero cells have no row."""
    x = ctx_next.join(contexts.select("id", "level", "context"), ["level", "context"])
    return x.select(F.col("id").alias("row"), F.col("next").alias("token"), F.lit(1).alias("support"), "cnt")
