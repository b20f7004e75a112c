"""Counts of arriving windows kept as a log-structured table: a batch adds a run, and runs of one size are merged.

Every batch writes the counts of its own windows as a run, in buckets of the contexts' hash. When ``FANOUT`` runs of one tier are there they
become one of the next, so a count is rewritten once per tier and a question meets few runs. A manifest per batch names the
live runs and has the totals of each level. It is written last, by renaming, so a batch that comes again finds its manifest and changes nothing,
and one that broke off starts over from the manifest before it.

The totals follow from what a batch touches: for its own contexts only, the counts before it are looked up in the buckets that these
contexts are in.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import c_ln_c
from ..sources.shared import discard, saved

#: ``COMBINED``: rows that a task looks through for equal ones. ``PASSES``: jobs that deal out a level of a batch, each the rows of some buckets.
FANOUT, BUCKETS, COMBINED, PASSES = 4, 64, 1 << 20, 4
COUNTS = "level int, context {kind}, next {token}, cnt long"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them has ended, not when the driver happens to collect its garbage."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


class Store:
    """The runs and manifests under a path, on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.system = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.hadoop.Path(path)

    def manifest(self, before: int | None = None) -> dict:
        """The manifest of the last batch (of those under ``before``), or an empty one."""
        top = self._at(f"{self.path}/manifests")
        found = [int(s.getPath().getName().removesuffix(".json")) for s in self.system.listStatus(top) if s.getPath().getName().endswith(".json")] if self.system.exists(top) else []
        found = [b for b in found if before is None or b < before]
        return self.read(max(found)) if found else {"batch": -1, "runs": [], "gone": [], "levels": {}}

    def read(self, batch: int) -> dict:
        stream = self.system.open(self._at(f"{self.path}/manifests/{batch}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has(self, batch: int) -> bool:
        return self.system.exists(self._at(f"{self.path}/manifests/{batch}.json"))

    def write(self, manifest: dict) -> None:
        """Put a manifest in its place, whole or not at all."""
        here, there = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{manifest['batch']}.json")
        stream = self.system.create(here, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self.system.rename(here, there):
            raise OSError(f"{there.toString()} can't be written")

    def run(self, name: str) -> str:
        return f"{self.path}/runs/{name}"

    def put(self, counts: DataFrame, name: str) -> None:
        x = counts.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", "level", "context", "next")
        x.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(self.run(name))

    def put_level(self, counts: DataFrame, level: int, name: str) -> tuple[float, int, int, int]:
        """Add the counts ``(context, next, cnt)`` of one level to a run; equal ones are summed. Visits times entropy, visits, contexts and rows of the level.

        Rows are dealt once, by their context, so that all of a context is in one place: there they are summed, measured and written in order.
        """
        keys = [bucket().alias("bucket"), F.shiftright(F.xxhash64("context"), 40).alias("part")]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        x = counts.select(*keys, "context", "next", "cnt").withColumn("part", F.pmod("part", F.lit(max(1, -(-n // BUCKETS)))))
        x = x.repartition("bucket", "part").groupBy("bucket", "part", "context", "next").agg(F.sum("cnt").alias("cnt"))
        one = W.partitionBy("bucket", "part", "context")
        x = x.withColumn("_n", F.sum("cnt").over(one)).withColumn("_k", F.row_number().over(one.orderBy("next")))
        seen = Observation()
        logs = F.col("cnt") * F.ln("_n") - c_ln_c(F.col("cnt"))
        x = x.observe(seen, F.coalesce(F.sum(logs), F.lit(0.0)).alias("h"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count_if(F.col("_k") == 1).alias("u"), F.count("*").alias("rows"))
        x = x.select(F.lit(level).cast("int").alias("level"), "context", "next", "cnt", "bucket")
        x.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(self.run(name))
        got = seen.get
        return got["h"], got["n"], got["u"], got["rows"]

    def counts(self, runs: list[dict], schema: str) -> DataFrame:
        """The rows of some runs; a count may come once from each."""
        out = self.spark.createDataFrame([], f"{schema}, bucket int")
        for r in runs:
            out = out.unionByName(self.spark.read.schema(f"{schema}, bucket int").parquet(self.run(r["name"]))) if r["rows"] else out
        return out

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.system.delete(self._at(self.run(n)), True)


def bucket(context: str | Column = "context") -> Column:
    return F.pmod(F.xxhash64(context), F.lit(BUCKETS)).cast("int")


def _combined(rows: DataFrame, level: int, kind: str, first: int, last: int, at_once: int) -> DataFrame:
    """``(context, next, cnt)`` from rows ``(tokens, cnt)``, of contexts of a level in buckets ``first`` to ``last`` - 1; equal rows of a task become one, as long as they are among ``at_once``."""
    names = [f"t{i}" for i in range(level + 1)]
    x = rows.select(*[F.get("tokens", i).alias(c) for i, c in enumerate(names)], "cnt").where(bucket(F.array(*names[:-1])).between(first, last - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def summed() -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(got).group_by(names).aggregate([("cnt", "sum")])
            return t.rename_columns([*names, "cnt"]).to_batches(max_chunksize=65_536)

        for b in batches:
            got.append(b)
            size += b.num_rows
            if size >= at_once:
                yield from summed()
                got, size = [], 0
        if size:
            yield from summed()

    if kind in ("string", "int", "bigint", "smallint"):
        x = x.mapInArrow(run, ", ".join(f"{c} {kind}" for c in names) + ", cnt long")
    return x.select(F.array(*names[:-1]).alias("context"), F.col(names[-1]).alias("next"), "cnt")


def _schema(windows: DataFrame) -> str:
    kind = windows.schema["tokens"].dataType.elementType.simpleString()
    return COUNTS.format(kind=f"array<{kind}>", token=kind)


def _entropy_sums(counts: DataFrame) -> DataFrame:
    """``(level, context, n, h)``: visits, and visits times entropy, of each context."""
    x = counts.groupBy("level", "context").agg(F.sum("cnt").alias("n"), F.sum(c_ln_c(F.col("cnt"))).alias("s"))
    return x.select("level", "context", "n", (c_ln_c(F.col("n")) - F.col("s")).alias("h"))


def add_batch(windows: DataFrame, T: int, path: str, batch: int, fanout: int = FANOUT) -> None:
    """Add the windows of a batch. A batch that was added already changes nothing."""
    store = Store(windows.sparkSession, path)
    if not store.has(batch):
        with shuffles_removed(windows.sparkSession):
            _add(store, windows, T, batch, fanout)


def _add(store: Store, windows: DataFrame, T: int, batch: int, fanout: int) -> None:
    spark = store.spark
    last = store.manifest(batch)
    key = ["level", "context"]
    kind, schema = windows.schema["tokens"].dataType.elementType.simpleString(), _schema(windows)
    own = {"name": f"{batch}-{batch}-{uuid.uuid4().hex[:8]}", "tier": 0, "rows": 0}
    written = spark.read.schema(f"{schema}, bucket int")
    levels = {int(k): v for k, v in last["levels"].items()}
    first, touched_rows = not any(r["rows"] for r in last["runs"]), 0
    for level in range(T, 0, -1):
        if level == T:
            x = windows.select("tokens", F.lit(1).cast("long").alias("cnt"))
        else:  # each window counts at every level, so the sums of the longer contexts, which lie in order
            x = written.parquet(store.run(own["name"])).where(F.col("level") == level + 1).select(F.col("context").alias("tokens"), "cnt")
        # by parts, so that only a part of the rows lies in shuffle files beside the counts
        parts = [_combined(x, level, kind, lo, lo + BUCKETS // PASSES, COMBINED) for lo in range(0, BUCKETS, BUCKETS // PASSES)]
        sums = [store.put_level(x, level, own["name"]) for x in parts]
        h, n, u, rows = math.fsum(x[0] for x in sums), *[sum(x[i] for x in sums) for i in (1, 2, 3)]
        if not rows:
            break
        if first:
            levels[level] = (h, n, u)
        own["rows"] += rows
    if own["rows"] and not first:
        touched_rows = _change(store, written.parquet(store.run(own["name"])), last["runs"], schema, levels)
    runs, gone = [*last["runs"], own], []
    while True:
        tier = next((t for t in sorted({r["tier"] for r in runs}) if sum(r["tier"] == t for r in runs) >= fanout), None)
        if tier is None:
            break
        old_runs = [r for r in runs if r["tier"] == tier]
        merged = {"name": f"{old_runs[0]['name'].split('-')[0]}-{batch}-{uuid.uuid4().hex[:8]}", "tier": tier + 1, "rows": 0}
        x = store.counts(old_runs, schema).groupBy("bucket", *key, "next").agg(F.sum("cnt").alias("cnt")).drop("bucket")
        store.put(x, merged["name"])
        merged["rows"] = spark.read.schema(f"{schema}, bucket int").parquet(store.run(merged["name"])).count()
        runs = [r for r in runs if r["tier"] != tier] + [merged]
        gone += [r["name"] for r in old_runs]
    store.write({"batch": batch, "schema": schema, "runs": runs, "gone": gone, "levels": {str(k): v for k, v in levels.items()}, "touched": touched_rows, "own": own["rows"]})
    store.drop(last["gone"])  # nobody reads the manifest before the last any more


def _change(store: Store, new: DataFrame, runs: list[dict], schema: str, levels: dict[int, tuple]) -> int:
    """Add to the totals of ``levels`` what a batch's counts change; how many counts its contexts had before."""
    key = ["level", "context"]
    # what the touched contexts had before; the files of other buckets are not read
    touched = new.select("bucket", *key).distinct()
    buckets = sorted(r[0] for r in new.select("bucket").distinct().collect())  # ``BUCKETS`` at most
    before = store.counts(runs, schema).where(F.col("bucket").isin(buckets)).join(touched, ["bucket", *key], "left_semi").groupBy(*key, "next").agg(F.sum("cnt").alias("cnt"))
    before = saved(before, "touched", "zstd")
    after = before.unionByName(new.select(*before.columns)).groupBy(*key, "next").agg(F.sum("cnt").alias("cnt"))
    old = _entropy_sums(before).select(*key, F.col("h").alias("h0"), F.col("n").alias("n0"))
    change = _entropy_sums(after).join(old, key, "left").groupBy("level").agg(
        F.sum(F.col("h") - F.coalesce("h0", F.lit(0.0))).alias("h"), F.sum(F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"), F.count_if(F.col("n0").isNull()).alias("u")
    )
    for r in change.collect():  # a row per level
        h, n, u = levels.get(r.level, (0.0, 0, 0))
        levels[r.level] = (math.fsum((h, r.h)), n + r.n, u + r.u)
    rows = before.count()
    discard(before)
    return rows


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``(level, context, next, cnt)`` of all added batches."""
    store = Store(spark, path)
    last = store.manifest()
    if not last["runs"]:
        raise ValueError(f"{path} has no counts")
    x = store.counts(last["runs"], last["schema"]).select("level", "context", "next", "cnt")
    if sum(r["rows"] > 0 for r in last["runs"]) == 1:  # whose counts are whole
        return x
    return x.groupBy("level", "context", "next").agg(F.sum("cnt").alias("cnt"))


def growth(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, level, entropy, total_ctx, unique_ctx)`` after each batch, from the manifests alone."""
    store, rows, m = Store(spark, path), [], None
    while (m := store.manifest(m and m["batch"]))["batch"] >= 0:
        rows += [(m["batch"], int(k), h / n if n else 0.0, n, u) for k, (h, n, u) in m["levels"].items()]
        if m["batch"] == 0:
            break
    return spark.createDataFrame(rows, "batch int, level int, entropy double, total_ctx long, unique_ctx long")
