"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, numbered, saved, shared_dir

__all__ = ["components", "discard", "file_rows", "numbered", "saved", "shared_dir", "shielded", "table", "with_rows", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_rows(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Add ``name``: a long for each row, which stays the same in every scan.

    For a frame read from Parquet files it is made of the row's file and place in it: however a scan is split, and whichever executors read
    it, a row gets the same number; nothing is written. The files' numbers are a table with one row per file. Rows
    of other frames (joins, unions, made ones) are numbered and written with their numbers.
    """
    x = without(docs, [name])
    try:  # the files' own column, whatever the table's columns are called
        place = x.metadataColumn("_metadata")
        x = x.select("*", place["file_path"].alias("_nextdist_file"), place["row_index"].alias("_nextdist_place"))
    except AnalysisException:
        return saved(x.withColumn(name, F.monotonically_increasing_id()), "file-rows")
    files = sorted(r[0] for r in x.select("_nextdist_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_nextdist_number long, _nextdist_file string")
    x = x.join(F.broadcast(numbers), "_nextdist_file")  # one row per file
    return x.withColumn(name, F.shiftleft("_nextdist_number", 40) + F.col("_nextdist_place")).drop("_nextdist_file", "_nextdist_place", "_nextdist_number")


def with_rows(docs: DataFrame, row: str | None, own: list[str], tag: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``_row``, a stable number of each row, and the names of its other columns but ``own``.

    ``row`` names a column of such numbers, as :func:`file_rows` adds it; without one, rows are numbered here and written with their numbers.
    """
    x = without(docs, [*own, *({"_row"} - {row})])
    names = [c for c in x.columns if c != row]
    if row is None:
        return saved(x.withColumn("_row", F.monotonically_increasing_id()), tag), names
    return x.withColumnRenamed(row, "_row"), names


def shielded(df: DataFrame, used: list[str], keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """The columns ``used`` of ``df`` and, under names that nobody else has, the other columns of ``keep``; and the columns that bring ``keep`` back.

    Between the two an operator may name its helper columns as it likes.
    """
    own = {c.lower(): c for c in used}
    rest = [c for c in keep if c.lower() not in own]
    inner = df.select(*[F.col(f"`{c}`") for c in used], *[F.col(f"`{c}`").alias(f"_nextdist_keep{i}") for i, c in enumerate(rest)])
    names = {c: f"_nextdist_keep{i}" for i, c in enumerate(rest)} | {c: own[c.lower()] for c in keep if c.lower() in own}
    return inner, [F.col(f"`{names[c]}`").alias(c) for c in keep]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns whose names an operator gives to its own results."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of an undirected graph given as ``(a, b)`` longs.

    Alternates large-star and small-star steps until the edges stop changing.
    Returns ``(node, root)`` for each node other than its component's smallest,
    which is ``root``. Both steps are a grouped minimum (summed map-side) and an
    inner join, so that a node with very many neighbours is split like any skewed key.
    """
    e = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        tag,
    )
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.distinct(), tag)
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = saved(small.select("x.u", "x.v").where("u <> v").distinct(), tag)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large)
        discard(e)
        e = nxt
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
