"""Test input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_tokens(spark: SparkSession, n: int, vocab: int, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """``(pos, token)``: n draws, the probability of rank k in proportion to ``k ** -alpha``.

    A draw is a uniform hash of its position, looked up in the cumulative weights, an array of ``vocab`` numbers.
    """
    weights = [(k + 1) ** -alpha for k in range(vocab)]
    total, upto, cum = sum(weights), 0.0, []
    for w in weights:
        upto += w
        cum.append(upto / total)
    cum[-1] = 1.0
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([0.0, *cum[:-1]], cum, strict=True))], "token int, lo double, hi double")
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / float(1 << 53)
    # the range lookup as an equi-join: both sides meet in cells of the unit interval
    cells = max(1, vocab)
    x = spark.range(n).select(F.col("id").alias("pos"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    t = table.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    return x.join(F.broadcast(t), "cell").where("u >= lo and u < hi").select("pos", "token")
