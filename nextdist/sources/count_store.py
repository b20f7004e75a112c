"""Counts of contexts in a bucketed, sorted table that can be asked without a scan and joined without a shuffle.

A context's hash is its key. The table is cut into buckets by the key and sorted by it inside a bucket. A join on the key takes the buckets as they
lie, so only the other side is shuffled; a question for some contexts reads their buckets only, and of these the row groups that may
hold the key. The context itself is compared as well, so equal hashes do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import prefixes

#: Counts in a bucket, and bytes of a row group.
ROWS_PER_BUCKET, ROW_GROUP = 4_000_000, 8 << 20


def context_key(context: str | Column = "context") -> Column:
    return F.xxhash64(context)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_count_store(ctx_next: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write ``(level, context, next, cnt)`` as a store under a new ``path`` and open it. One shuffle, by the key; the number of buckets follows the rows."""
    spark = ctx_next.sparkSession
    if buckets is None:
        buckets = max(1, -(-ctx_next.count() // ROWS_PER_BUCKET))
    x = ctx_next.select(context_key().alias("key"), "level", "context", "next", "cnt")
    name = f"nextdist_{uuid.uuid4().hex}"
    # dealt as the buckets are, so each is one file
    w = x.repartition(buckets, "key").write.format("parquet").bucketBy(buckets, "key").sortBy("key")
    w.option("path", f"{path}/buckets-{buckets}").option("parquet.block.size", ROW_GROUP).saveAsTable(name)
    return spark.table(name)


def open_count_store(spark: SparkSession, path: str) -> DataFrame:
    """A store that another session wrote. Its folder's name tells the number of buckets."""
    p, system = _path(spark, path)
    found = [s.getPath() for s in system.listStatus(p) if s.getPath().getName().startswith("buckets-")]
    if len(found) != 1:
        raise ValueError(f"{path} holds no count store")
    where = found[0].toString()
    kinds = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(where).dtypes)
    name = f"nextdist_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({kinds}) using parquet options (path '{where}') clustered by (key) sorted by (key) into {found[0].getName().removeprefix('buckets-')} buckets")
    return spark.table(name)


def stored_distribution(store: DataFrame, contexts: list[list]) -> DataFrame:
    """``(level, context, next, prob)`` of the given contexts; unknown ones have no row. Only their buckets are read, and nothing but the answer is shuffled."""
    spark = store.sparkSession
    kind = store.schema["context"].dataType
    asked = spark.createDataFrame([(c,) for c in contexts], f"context {kind.simpleString()}").distinct()
    keys = [r[0] for r in asked.select(context_key()).collect()]  # what was asked for
    x = store.where(F.col("key").isin(keys) if keys else F.lit(False)).join(F.broadcast(asked), "context", "left_semi")
    n = F.sum("cnt").over(_same_context())
    return x.select("level", "context", "next", (F.col("cnt") / n).alias("prob"))


def _same_context() -> WindowSpec:
    return W.partitionBy("key", "context")


def stored_soft_labels(windows: DataFrame, store: DataFrame, T: int, norm: str = "l1") -> DataFrame:
    """``(start, pos, next, prob)`` as of :func:`~nextdist.operators.lookup.soft_labels`, from a store.

    The windows' prefixes go to the buckets; the store's rows stay where they are. A context's size is summed inside its bucket.
    """
    q = prefixes(windows.select("start", "tokens"), T).select(context_key().alias("key"), F.col("context").alias("asked"), "start", (F.col("level") - 1).alias("pos"))
    # inside the key, by which the buckets are dealt already
    per = F.sum("cnt").over(_same_context()) if norm == "l1" else F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt")).over(_same_context()))
    labels = store.select("key", "context", "next", (F.col("cnt") / per).alias("prob"))
    # equality that is no further join key, which would have the store shuffled
    same = (F.col("context") >= F.col("asked")) & (F.col("context") <= F.col("asked"))
    x = q.hint("merge").join(labels, "key").where(same)
    return x.select("start", "pos", "next", "prob")
