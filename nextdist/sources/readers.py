"""Corpora and token files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_blank

#: Bytes of a token file that one record may hold, bytes that one range of a larger file has, and tokens in a batch.
WHOLE, SPAN, CHUNK = 1 << 30, 1 << 27, 1 << 22


def read_json_docs(spark: SparkSession, path: str, field: str = "story") -> DataFrame:
    """``(text)`` from files ``data*.json`` that hold JSON arrays of objects."""
    return spark.read.schema(f"`{field}` string").option("multiLine", True).json(f"{path}/data*.json").select(F.col(field).alias("text"))


def read_jsonl_docs(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """``(text)`` from files with one JSON object per line; blank lines and texts go."""
    x = spark.read.schema(f"`{field}` string").json(path).select(F.col(field).alias("text"))
    return x.where(~is_blank("text"))


def read_corpus_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "validation", "test"), kind: str = "parquet") -> DataFrame:
    """``(split, split_order, text, ...)``: the splits' tables under one path, in one frame."""
    out = None
    for i, s in enumerate(splits):
        x = spark.read.format(kind).load(f"{path}/{s}").withColumn("split", F.lit(s)).withColumn("split_order", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def read_token_bin(spark: SparkSession, path: str, pct: float | None = None, max_tokens: int | None = None, width: int = 2, whole: int = WHOLE, span: int = SPAN, index: DataFrame | None = None) -> DataFrame:
    """``(file, pos, token)`` of flat little-endian unsigned files without a header, positions in each file.

    ``max_tokens`` overrides ``pct`` (percent of a file's tokens). Files up to ``whole`` bytes come through Spark's ``binaryFile``; of
    larger ones, which no single record can hold, ranges of ``span`` bytes are read each on its own, from any place that Arrow's file systems open.
    With ``index(file, first_pos)`` only ``(pos, token)`` of its files come, positions from ``first_pos`` of a file on; it is joined to the files, not to their tokens.
    """
    kind = f"<u{width}"
    schema = "pos long, token int" if index is not None else "file string, pos long, token int"

    index_given = index is not None

    def tokens(name: str, start: int, first: int, data, size: int) -> Iterator[pa.RecordBatch]:
        n = size // width
        upto = n if pct is None else int(n * pct / 100)
        upto = upto if max_tokens is None else min(n, max_tokens)
        x = np.frombuffer(data, dtype=kind, count=len(data) // width)[: max(0, upto - first)]
        for lo in range(0, len(x), CHUNK):
            part = x[lo : lo + CHUNK]
            got = [pa.array(np.arange(start + first + lo, start + first + lo + len(part))), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*([] if index_given else [pa.repeat(name, len(part))]), *got], [*([] if index_given else ["file"]), "pos", "token"])

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data, start in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                buf = data.as_buffer()
                yield from tokens(name, start, 0, buf, buf.size)

    def run_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, size, start, lo in zip(*[c.to_pylist() for c in b.columns], strict=True):
                system, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if re.match("file:/[^/]", name) else name)
                with system.open_input_file(at) as f:
                    f.seek(lo)
                    yield from tokens(name, start, lo // width, f.read(min(step, size - lo)), size)

    step = span - span % width
    files = spark.read.format("binaryFile").load(path)
    files = files.withColumn("start", F.lit(0).cast("long"))
    if index is not None:
        last = lambda c: F.regexp_extract(c, "[^/]+$", 0)
        starts = index.select(last("file").alias("_name"), F.col("first_pos").cast("long").alias("start"))
        files = files.drop("start").withColumn("_name", last("path")).join(F.broadcast(starts), "_name")  # one row per file
    small = files.where(F.col("length") <= whole).select("path", "content", "start").mapInArrow(run_whole, schema)
    ranges = files.where(F.col("length") > whole).select("path", "length", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("lo"))
    return small.unionByName(ranges.repartition("path", "lo").mapInArrow(run_ranges, schema))


def read_counts(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """Saved ``ctx_next`` tables; a level reads its own folder only."""
    x = spark.read.parquet(path)
    return x if level is None else x.where(F.col("level") == level)


def read_pair_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(t0, t1, cnt, bin)`` as saved."""
    return spark.read.schema("t0 int, t1 int, cnt long, bin int").parquet(path)


def read_level_stats(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Saved statistics of all runs, with their ``run``."""
    return spark.read.format(kind).load(path)
