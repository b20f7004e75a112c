"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only where the setting is missing on one machine (tests) is a folder made here; on a cluster, whose executors would not
    see that folder, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        found = tempfile.mkdtemp(prefix="nextdist-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str, codec: str = "snappy", **options: object) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, with the writer's ``options``, and read it again.

    This cuts the lineage: what follows survives lost executors without running
    ``df`` again, and ids made by ``monotonically_increasing_id`` stay as written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nextdist/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`saved` returned and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running_sum(df: DataFrame, order: list[Column], n: str, name: str, tag: str) -> DataFrame:
    """Add ``name``: the sum of column ``n`` over all rows before a row in the given order, without one task seeing all rows.

    Rows are range-partitioned, sorted and written; sums run inside a partition and start from the sum of those before it, a
    table with one row per partition. Ranges follow the rows, so keys of any spread are dealt evenly.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_at", F.monotonically_increasing_id()), tag).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, total = [], 0
    for p, rows in sorted(placed.groupBy("_part").agg(F.sum(n)).collect()):
        before.append((p, total))
        total += rows or 0
    starts = spark.createDataFrame(before, "_part int, _start long")
    inside = F.coalesce(F.sum(n).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = placed.withColumn("_inside", inside).join(F.broadcast(starts), "_part")  # one row per partition
    return x.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_at", "_part", "_start", "_inside")


def numbered(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... over all rows in the given order, without one task seeing all rows.

    Rows are range-partitioned and sorted, then written; the id that Spark gives
    (partition and place in it) becomes a global number by a prefix sum over the
    partitions' row counts, a table with one row per partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33).cast("int")
    before, total = [], 0
    for p, rows in sorted(placed.groupBy(part.alias("_part")).agg(F.count("*")).collect()):
        before.append((p, total))
        total += rows
    starts = spark.createDataFrame(before, "_part int, _start long")
    x = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per partition
    here = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return x.withColumn(name, F.col("_start") + here).drop("_at", "_part", "_start")
