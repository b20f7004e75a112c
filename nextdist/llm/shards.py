"""Training-order materialisation: fixed-stride files in a keyed random order.

Sequences are numbered, and a keyed Feistel permutation with cycle-walking gives each
number its slot in [0, n). Slot ranges are shards, one raw file each: records of one fixed size in slot order and nothing
else. A reader finds slot s in file s // per_shard at byte (s % per_shard) * stride, reads on from there, and can stop
and resume anywhere. Files are written by Spark's text writer, which puts bytes down as they are, on any file system
that Spark knows, and whose committer makes a lost task's file appear once; the line feed after a record is its last byte.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, shared_dir
from .tokens import encoder, tokenizer_path

SEQUENCE = 512
PER_SHARD = 16_384
END_ID = 2
KEY = 20240229
ROUNDS = 6
#: Jobs that write the shards, one after the other; the shuffle files of one are removed when it ends.
WRITES = 3
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def record(length: int = SEQUENCE, width: int = 2) -> np.dtype:
    """A record of a shard file, as numpy reads or maps it: header, ids padded with zeros, line feed."""
    return np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("nth", "<i4"), ("length", "<i4"), ("ids", f"<u{width}", (length,)), ("end", "u1")])


def id_width(path: str) -> int:
    """Bytes of an id: two where the vocabulary fits them, else four."""
    return 2 if len(encoder(path).ends) <= 1 << 16 else 4


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def feistel_slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of numbers below ``n``: a bijection of [0, n), the same for the same key.

    The network permutes [0, 4^b) with 4^b the first such power of at least ``n``; a value
    at or over ``n`` goes through it again until it is below, on average fewer than four times.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64), np.uint64(key % 2**64))
    x = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> half, x[todo] & mask
        for k in keys:
            a, b = b, a ^ (_mix(b, k) & mask)
        x[todo] = (a << half) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """``(part, idx, data)``: token ids of each document and an end id, cut into records of ``length`` ids, the last one padded.

    ``data`` is a :func:`record` without its line feed. An id that ``width`` bytes do not hold is an error.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = record(length, width)
    size = kind.itemsize - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids = [np.frombuffer(x + end, dtype="<u4") for x in enc.encode(b.column(1).to_pylist())]
                n_ids = np.array([len(x) for x in ids])
                rows = -(-n_ids // length)
                first = np.cumsum(rows) - rows
                n = int(rows.sum())
                flat = np.zeros(n * length, "<u4")
                for x, k in zip(ids, (first * length).tolist(), strict=True):
                    flat[k : k + len(x)] = x
                if flat.max() >= 1 << 8 * width:
                    raise ValueError(f"token id {flat.max()} does not fit {width} bytes")
                doc = np.repeat(np.arange(len(ids)), rows)
                out = np.zeros(n, kind)
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                out["has_id"], out["doc_id"] = known[doc], b.column(0).fill_null(0).to_numpy(zero_copy_only=False)[doc]
                out["nth"] = np.arange(n) - first[doc]
                out["length"] = np.minimum(length, n_ids[doc] - out["nth"] * length)
                out["ids"] = flat.reshape(n, length)
                raw = np.ascontiguousarray(out.view("u1").reshape(n, size + 1)[:, :size])
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype="<i4") * np.int32(size)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), data], ["part", "idx", "data"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "part int, idx long, data binary")


def write_shards(seqs: DataFrame, path: str, key: int = KEY, per_shard: int = PER_SHARD, writes: int = WRITES) -> int:
    """Write ``seqs`` (written frame of :func:`sequences`) to ``path`` in permuted order; returns how many there are.

    File ``part-<k>`` holds slots ``k * per_shard`` and on; a shard is one task's partition. Shards are written in up to ``writes`` jobs, each of a
    range of shards, so that only a part of the sequences lies in shuffle files beside those saved and those written.
    """
    spark = seqs.sparkSession
    before, n = [], 0
    for part, rows in sorted(seqs.groupBy("part").agg(F.count("*")).collect()):  # one row per partition
        before.append((part, n))
        n += rows
    start = spark.createDataFrame(before, "part int, start long")

    @F.arrow_udf("long")
    def slot(number: pa.Array) -> pa.Array:
        return pa.array(feistel_slots(number.to_numpy(zero_copy_only=False), n, key))

    slot = slot.asNondeterministic()  # or a filter on slots would have them made a second time, by a second Python process of each task
    placed = seqs.join(F.broadcast(start), "part").select(slot(F.col("start") + F.col("idx")).alias("slot"), "data")  # one row per partition
    shards = max(1, -(-n // per_shard))
    step = -(-shards // writes)
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for first in range(0, shards, step):
            some = placed.where(F.col("slot").between(first * per_shard, (first + step) * per_shard - 1))
            some = some.repartitionById(min(shards, first + step), F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
            # a task without rows writes no file, so each part's number is its shard's
            out = some.select(F.col("data").cast("string").alias("value")).write.mode("append" if first else "error")
            out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(first + step >= shards).lower())  # _SUCCESS comes last
            out.options(compression="none", maxRecordsPerFile=0).text(path)
            if first:
                _drop_empty_first(spark, path)
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)
    return n


def _drop_empty_first(spark: SparkSession, path: str) -> None:
    """Delete the file without rows that Spark's first task writes in any case."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "part-00000-*")):
        if x.getLen() == 0:
            fs.delete(x.getPath(), False)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, per_shard: int = PER_SHARD, length: int = SEQUENCE, width: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per sequence from ``from_slot`` on; files before it are not read."""
    kind = record(length, width)
    shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where(shard >= from_slot // per_shard).select(shard.alias("shard"), "content")
    names = ["slot", "shard", "byte_offset", "doc_id", "nth", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not len(content.as_buffer()):
                    continue
                x = np.frombuffer(content.as_buffer(), kind)
                for lo in range(max(0, from_slot - shard * per_shard), len(x), 4096):
                    y = x[lo : lo + 4096]
                    at = np.arange(lo, lo + len(y))
                    rows = [r[:k].tobytes() for r, k in zip(y["ids"], y["length"].tolist(), strict=True)]
                    cols = [pa.array(shard * per_shard + at), pa.array(np.full(len(y), shard)), pa.array(at * kind.itemsize), pa.array(y["doc_id"].copy(), mask=y["has_id"] == 0), pa.array(y["nth"].copy()), pa.array(y["length"].copy()), pa.array([zlib.crc32(r) for r in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.array(rows, pa.binary())] if with_ids else [])], names)

    return files.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, nth int, n_tokens int, ids_crc32 long" + (", ids binary" if with_ids else ""))


def training_order(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = KEY, to: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenize ``docs(doc_id, text)``, write its sequences as shard files to ``to``, and read them back.

    Nulls: a null text is empty, and its sequence has the end id alone; a null ``doc_id``
    is kept. Repeated rows have sequences of their own. An empty table writes an empty file. Other input columns are ignored.
    Texts of any length are read whole. Ids take two bytes, or four where the vocabulary needs them.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    to = to or f"{shared_dir(spark)}/nextdist/shards-{uuid.uuid4().hex}"
    width = id_width(path)
    # these files, a part of the shuffle and the shards are on disk together, so the first are made small
    seqs = saved(sequences(docs, path, length, width=width), "shards-sequences", "zstd")
    write_shards(seqs, to, key, per_shard)
    discard(seqs)
    return read_shards(spark, to, 0, per_shard, length, width, with_ids)
