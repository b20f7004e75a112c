"""Sinks: token files, padded sequences, counts, shards, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_bin_parts(stream: DataFrame, per_part: int = 1 << 26, width: int = 2) -> DataFrame:
    """``(part, first_pos, n, data)``: the stream ``(pos, token)`` cut into files' bytes, in order.

    Parts are ranges of ``pos``, so each is made by one task and bounded by ``per_part`` tokens.
    """
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, first = None, [], 0

        def row() -> pa.RecordBatch:
            x = np.concatenate(got)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first]), pa.array([len(x)]), pa.array([x.astype(kind).tobytes()], pa.binary())], ["part", "first_pos", "n", "data"])

        for b in batches:
            part, pos, token = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cuts[1:], len(part)], strict=True):
                if lo == hi:
                    continue
                if part[lo] != now:
                    if got:
                        yield row()
                    now, got, first = int(part[lo]), [], int(pos[lo])
                got.append(token[lo:hi])
        if got:
            yield row()

    x = stream.select(F.floor(F.col("pos") / per_part).cast("long").alias("part"), F.col("pos").cast("long").alias("pos"), F.col("token").cast("long").alias("token"))
    n = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(n, "part").sortWithinPartitions("part", "pos")
    return x.mapInArrow(run, "part long, first_pos long, n long, data binary")


def write_token_bin(stream: DataFrame, path: str, per_part: int = 1 << 26, width: int = 2) -> DataFrame:
    """Write the stream, ``(pos, token)`` or whole sequences ``(offset, tokens)``, as flat files ``tokens-<part>.bin`` under ``path``, by the data source ``tokenbin``, and return their index.

    Parquet is the canonical sink; these files are for readers that want raw ids. Files appear when all of them are whole.
    """
    from .token_files import token_index, write_sequence_files, write_token_files

    (write_sequence_files if "tokens" in stream.columns else write_token_files)(stream, path, per_part, width)
    return token_index(stream.sparkSession, path)


def padded_sequences(seqs: DataFrame, pad: int, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """``(doc_id, tokens, length, num_stories, max_length, ...)``: every sequence padded to the longest one."""
    size = seqs.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0)).alias("max_length"), F.count("*").alias("num_stories"))
    x = seqs.select("doc_id", "tokens").crossJoin(F.broadcast(size))  # one row
    filled = F.concat("tokens", F.array_repeat(F.lit(pad).cast("int"), F.col("max_length") - F.size("tokens")))
    return x.select("doc_id", filled.alias("tokens"), F.size("tokens").alias("length"), "num_stories", "max_length", F.lit(pad).alias("pad_id"), F.lit(bos).cast("int").alias("bos_id"), F.lit(eos).cast("int").alias("eos_id"))


def write_counts(ctx_next: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Transitions of any level, a folder per level."""
    ctx_next.write.mode(mode).partitionBy("level").parquet(path)


def write_pair_shards(binned: DataFrame, path: str, mode: str = "overwrite") -> None:
    binned.write.mode(mode).parquet(path)


def write_shards(windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Start positions of each shard's windows, a folder per shard."""
    windows.select("shard", "start").write.mode(mode).partitionBy("shard").parquet(path)


def write_level_stats(stats: DataFrame, path: str, run: str, kind: str = "json", mode: str = "append") -> None:
    """Statistics of one run, a folder per run."""
    stats.withColumn("run", F.lit(run)).write.mode(mode).partitionBy("run").format(kind).save(path)


def context_json(contexts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, context, counts)`` with the counts of next tokens as JSON text, from rows ``(context, next, cnt)``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("next").cast("string").alias("next"), "cnt")))
    return contexts.groupBy(*keys, "context").agg(F.to_json(F.map_from_entries(rows)).alias("counts"))


def write_context_json(contexts: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    rows = F.array_sort(F.collect_list(F.struct(F.col("next").cast("string").alias("next"), "cnt")))
    contexts.groupBy(*keys, "context").agg(F.map_from_entries(rows).alias("counts")).write.mode(mode).json(path)
