"""Counts and labels of arriving windows in the state store.

Running counts are an aggregation in output mode ``update``: a batch's result has the counts that it changed. Labels come from a stateful
processor, which keeps for each context its visits and a map with the count of each next token, so a batch touches the entries of its own
tokens only. Both run on the RocksDB state store, whose state is on disk and in the checkpoint, not in an executor's heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.windows import prefixes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside use the RocksDB state store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def start_updates(windows: DataFrame, T: int, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Write the counts that each batch changes, as they are after it, under ``path``, a folder per batch; a batch that comes again replaces its own."""
    spark = windows.sparkSession
    counts = prefixes(windows.select("tokens"), T).groupBy("level", "context", "next").agg(F.count("*").alias("cnt"))

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb(spark):
        w = counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return w.options(**options).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(level, context, next, cnt)`` as of the last batch: of each count its last update."""
    x = spark.read.parquet(path)
    return x.groupBy("level", "context", "next").agg(F.max_by("cnt", "batch").alias("cnt"))


class OnlineLabels(StatefulProcessor):
    """The probability of each window's next token as of the window, for one context."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visits = handle.getValueState("visits", "n long")
        self.counts = handle.getMapState("counts", "next int", "cnt long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("start", kind="stable")
        visits = self.visits.get()[0] if self.visits.exists() else 0
        seen = {}
        for t in pdf["next"].unique().tolist():  # of the map only these entries
            seen[t] = self.counts.getValue((t,))[0] if self.counts.containsKey((t,)) else 0
        here = pdf.groupby("next").cumcount() + 1 + pdf["next"].map(seen)
        for t, n in pdf["next"].value_counts().items():
            self.counts.updateValue((int(t),), (seen[t] + int(n),))
        self.visits.update((visits + len(pdf),))
        yield pd.DataFrame({"start": pdf["start"].to_numpy(), "pos": pdf["level"].to_numpy() - 1, "prob": here.to_numpy() / (visits + np.arange(1, len(pdf) + 1))})

    def close(self) -> None:
        pass


def stateful_labels(windows: DataFrame, T: int) -> DataFrame:
    """``(start, pos, prob)`` of a stream of windows ``(start, tokens)``, for output mode ``append``.

    Windows come in the order of their starts from batch to batch. A task reads one batch's rows of a context at once; ``maxFilesPerTrigger`` bounds a batch.
    """
    x = prefixes(windows.select("start", "tokens"), T)
    x = x.select("start", "level", "next", F.array_join(F.col("context").cast("array<string>"), "-").alias("key"))
    return x.groupBy("key").transformWithStateInPandas(statefulProcessor=OnlineLabels(), outputStructType="start long, pos int, prob double", outputMode="Append", timeMode="None")


def start_labels(windows: DataFrame, T: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the labels of arriving windows to the table under ``path``."""
    with rocksdb(windows.sparkSession):
        w = stateful_labels(windows, T).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return w.outputMode("append").trigger(availableNow=True).start()
