"""Level statistics from sorted windows: one shuffle of the windows, whatever the number of levels.

Equal windows of a task become one row with their number before they are shuffled, so a window that a large
part of the corpus repeats is a few rows. Windows are range-partitioned and sorted, so a context's windows are neighbours. Each
partition reads all levels from the common prefix lengths of neighbours and reports sums for
contexts that lie inside it. The first and last context of each level may go on in the next
partition; their counts are sent back and finished by a small grouping. A frequent start is
thus spread over partitions like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .counts import context_totals, level_sums, with_averages

#: Windows that a task sorts at once, and that it looks through for equal ones.
ROWS_PER_PARTITION, COMBINED = 500_000, 1 << 20
_SUMS = ["total_entropy", "total_uniformity", "total_visits", "unique_nodes", "total_support", "onehot_contexts", "onehot_visits", "visit_support"]


def _runs(new: np.ndarray) -> np.ndarray:
    """Borders of runs, from flags of where a run begins."""
    return np.append(np.flatnonzero(new), len(new))


def _xlnx(c: np.ndarray) -> np.ndarray:
    return c * np.log(c)


def partition_stats(m: np.ndarray, T: int, times: np.ndarray | None = None) -> tuple[list[tuple], list[tuple]]:
    """Sums per level of the inner contexts, and ``(level, context, next, cnt)`` of the outer ones; ``m`` is sorted, ``times`` has how often each row counts."""
    times = np.ones(len(m), np.int64) if times is None else times
    differs = m[1:] != m[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), T + 1)
    lcp = np.concatenate([[0], lcp])
    sums, outer = [], []
    for level in range(1, T + 1):
        ctx = _runs(lcp < level)
        child = _runs(lcp < level + 1)
        c = np.add.reduceat(times, child[:-1])
        first = np.searchsorted(child[:-1], ctx[:-1])  # each context's first child
        n = np.add.reduceat(times, ctx[:-1])
        support = np.diff(np.append(first, len(c)))
        nh = np.where(support == 1, 0.0, _xlnx(n) - np.add.reduceat(_xlnx(c), first))
        for k in sorted({0, len(n) - 1}):
            for j in range(first[k], first[k] + support[k]):
                row = m[child[j]]
                outer.append((level, row[:level].tolist(), int(row[level]), int(c[j])))
        inner = slice(1, len(n) - 1)
        n, support, nh = n[inner], support[inner], nh[inner]
        if len(n):
            many = support > 1
            one = ~many
            sums.append((level, float(nh.sum()), float((nh[many] / np.log(support[many])).sum()), int(n.sum()), len(n), int(support.sum()), int(one.sum()), int(n[one].sum()), int((n * support).sum())))
    return sums, outer


def combined(m: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix, sorted, and how often each comes."""
    order = np.lexsort(m.T[::-1])
    m = m[order]
    start = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]).any(1)])[: len(m)])
    if times is None:
        return m[start], np.diff(np.append(start, len(m)))
    return m[start], np.add.reduceat(times[order], start) if len(start) else times


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)


def combined_windows(windows: DataFrame, T: int, at_once: int = COMBINED) -> DataFrame:
    """``(t0, ..., tT, times)``: equal windows of a task in one row each, as long as they are among ``at_once`` windows."""
    names = [f"t{i}" for i in range(T + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            m, times = combined(np.concatenate(got))
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(m[:, i])) for i in range(T + 1)], pa.array(times)], [*names, "times"])

        for b in batches:
            if b.num_rows:
                got.append(_matrix(b.columns))
            if sum(map(len, got)) >= at_once:
                yield row()
                got = []
        if got:
            yield row()

    cols = [F.col("tokens")[i].cast("int").alias(c) for i, c in enumerate(names)]
    return windows.select(*cols).mapInArrow(run, ", ".join(f"{c} int" for c in names) + ", times long")


def _sorted_windows(windows: DataFrame, T: int, rows_per_partition: int) -> DataFrame:
    """Different windows, tokens as columns, range-partitioned and sorted; written before that, as ranges are found by a scan of their own."""
    names = [f"t{i}" for i in range(T + 1)]
    x = saved(combined_windows(windows, T), "combined-windows")
    n = x.count()
    return x.repartitionByRange(max(1, -(-n // rows_per_partition)), *names).sortWithinPartitions(*names)


def partition_counts(m: np.ndarray, T: int, times: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """``(level, first row of each run, its count, whether it may go on in another partition)`` of the runs of equal contexts and next tokens; ``m`` is sorted."""
    times = np.ones(len(m), np.int64) if times is None else times
    differs = m[1:] != m[:-1]
    lcp = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), T + 1)])
    for level in range(1, T + 1):
        runs = _runs(lcp < level + 1)
        at = runs[:-1]
        c = np.add.reduceat(times, at)
        outer = np.unique([0, len(at) - 1])
        yield level, at[outer], c[outer], True
        if len(at) > 2:
            yield level, at[1:-1], c[1:-1], False


def context_next_counts_sorted(windows: DataFrame, T: int, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The same table as ``context_next_counts(windows, T)`` with one shuffle of the windows, for long ones.

    The plain form shuffles T contexts of up to T tokens per window, which grows with T squared; here a window's T+1 tokens
    cross the network once, and only the first and last count of each level and partition are grouped again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(_matrix(b.columns[:-1]), b.columns[-1].to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        m = np.concatenate([x for x, _ in got])
        for level, at, c, outer in partition_counts(m, T, np.concatenate([t for _, t in got])):
            for lo in range(0, len(at), 65_536):
                a = at[lo : lo + 65_536]
                context = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * np.int32(level)), pa.array(m[a, :level].ravel().astype(np.int32)))
                cols = [pa.array(np.full(len(a), level, np.int32)), context, pa.array(m[a, level].astype(np.int32)), pa.array(c[lo : lo + 65_536]), pa.array(np.full(len(a), outer))]
                yield pa.RecordBatch.from_arrays(cols, ["level", "context", "next", "cnt", "outer"])

    found = saved(_sorted_windows(windows, T, rows_per_partition).mapInArrow(run, "level int, context array<int>, next int, cnt long, outer boolean"), "sorted-counts")
    edge = found.where("outer").groupBy("level", "context", "next").agg(F.sum("cnt").alias("cnt"))
    return found.where("not outer").select("level", "context", "next", "cnt").unionByName(edge)


def level_stats_sorted(windows: DataFrame, T: int, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The same table as ``level_stats(context_next_counts(windows, T))``.

    A task holds one partition's windows as a matrix of 32-bit ids, ``rows_per_partition`` x (T+1) x 4 bytes.
    """
    x = _sorted_windows(windows, T, rows_per_partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(_matrix(b.columns[:-1]), b.columns[-1].to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        sums, outer = partition_stats(np.concatenate([x for x, _ in got]), T, np.concatenate([t for _, t in got]))
        rows = [(*s, None, None, None) for s in sums] + [(lv, *[None] * 8, c, nx, k) for lv, c, nx, k in outer]
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.int64()] * 6, pa.list_(pa.int32()), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["level", *_SUMS, "context", "next", "cnt"])

    schema = "level int, total_entropy double, total_uniformity double, " + ", ".join(f"{c} long" for c in _SUMS[2:]) + ", context array<int>, next int, cnt long"
    found = saved(x.mapInArrow(run, schema), "sorted-stats")
    inner = found.where("context is null").groupBy("level").agg(*[F.sum(c).alias(c) for c in _SUMS])
    edge = found.where("context is not null").groupBy("level", "context", "next").agg(F.sum("cnt").alias("cnt"))
    edge = level_sums(context_totals(edge)).select("level", *_SUMS)
    return with_averages(inner.unionByName(edge).groupBy("level").agg(*[F.sum(c).alias(c) for c in _SUMS]))
