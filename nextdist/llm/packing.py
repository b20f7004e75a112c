"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length t belongs to class k = capacity // t: k such pieces always fit
in one bin. Classes are filled independently of each other and of other workers:
a piece's place is its number within its class, so its bin is that number
divided by k. To keep padding low a document is first cut into whole sequences, and a rest
that would fill its class badly into the next reciprocal of the capacity and a smaller rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 2
#: A piece is cut further when k of its length would leave more than this share of a bin empty.
MAX_WASTE = 0.02


def cut_lengths(n: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= max_waste * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and cut; ``nth`` counts a class's pieces within one input partition ``part``."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, k int, part int, nth long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids = memoryview(ids + end)
                n, at = len(ids) // 4, 0
                for size in cut_lengths(n, capacity):
                    k = capacity // size
                    rows.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, k, part, int(count[k])))
                    count[k] += 1
                    at += size
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fill(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First-fit decreasing of the classes' last, incomplete bins."""
    pdf = pdf.sort_values(["length", "k", "rank"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    room: list[int] = []
    bins = []
    for size in pdf["length"]:
        for i, left in enumerate(room):  # at most one bin a class
            if left >= size:
                room[i] -= size
                bins.append(i)
                break
        else:
            room.append(capacity - size)
            bins.append(len(room) - 1)
    return pd.DataFrame({"k": pdf["k"], "rank": pdf["rank"], "bin": bins})


def harmonic_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)``; one result row per piece.

    ``start`` and ``length`` say which of its document's ids a piece has,
    ``sequence_id`` and ``offset`` where it lies. Full bins need only each class's
    counts per input partition. What is left is less than one bin per class (under
    200 classes for the default capacity), whatever the input; it is packed first-fit.

    Nulls: a null text is empty, and the document is its end id alone; a null
    ``doc_id`` is kept. Repeated rows are packed each on its own. An
    empty table gives an empty result. Other input columns are ignored.
    """
    path = path or tokenizer_path()
    cut = saved(pieces(docs, path, capacity, end_id), "pack-pieces")
    per = cut.groupBy("k", "part").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    classes = per.groupBy("k").agg(F.sum("n").alias("total"))
    classes = classes.withColumn("first", F.coalesce(F.sum(F.expr("total div k")).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    classes = saved(classes, "pack-classes")
    full = classes.agg(F.coalesce(F.sum(F.expr("total div k")), F.lit(0))).first()[0]
    x = cut.join(per.select("k", "part", "before"), ["k", "part"]).join(F.broadcast(classes), "k")  # at most one row per class
    x = x.withColumn("rank", F.col("before") + F.col("nth")).withColumn("bin", F.expr("rank div k"))
    whole = x.where("bin < total div k").withColumn("sequence_id", F.col("first") + F.col("bin"))
    left = x.where("bin >= total div k")
    fills = left.select("k", "rank", "length", F.expr("k * 0").alias("one")).groupBy("one").applyInPandas(lambda pdf: _fill(pdf, capacity), "k int, rank long, bin long")
    fills = fills.select("k", "rank", (F.lit(full) + F.col("bin")).alias("sequence_id"))
    rest = left.join(fills, ["k", "rank"])
    cols = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "k", "rank"]
    placed = whole.select(*cols).unionByName(rest.select(*cols))
    w = W.partitionBy("sequence_id").orderBy("k", "rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
