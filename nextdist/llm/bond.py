"""Hard negatives by a BOND scan: branch and bound over vertically stored vectors.

Rows are dealt into blocks, and a block keeps its vectors by dimension. For an anchor the dimensions are read in the
order of the anchor's largest magnitudes. After some of them every candidate has a partial score, and what the
rest can still add lies between two sums of the block's smallest and largest values; candidates whose bounds leave
every window leave the bitmap too, until the scores of those left are exact.

The first scan finds an anchor's positives, the best rows of its label; the second its negatives, the best rows of
other labels in a window of scores below each positive. Each block gives its own best, which a window function merges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Components in a block of rows, anchors that meet it at once, rows from which a table is dealt out at all, and dimensions between two looks at the bounds.
CELLS, ANCHORS, SMALL, STEP = 1 << 22, 4096, 2048, 8
_EXACT = 2**53

Judge = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Block:
    """Vectors of whole numbers, one array per dimension, with each dimension's smallest and largest value."""

    def __init__(self, rows: np.ndarray, exact: bool = False):
        self.columns = np.ascontiguousarray(rows.T)
        if exact:  # sums may pass what a double holds exactly
            self.columns = np.array([[int(x) for x in c] for c in self.columns], object).reshape(self.columns.shape)
        self.low = self.columns.min(1) if len(rows) else np.zeros(rows.shape[1])
        self.high = self.columns.max(1) if len(rows) else np.zeros(rows.shape[1])


def kth_largest(x: np.ndarray, k: int):
    return np.sort(x)[-k] if x.dtype == object else np.partition(x, -k)[-k]


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, judge: Judge, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers that the bitmap ``alive`` is left with, their exact scores, and how many cells were read.

    ``judge`` gets each candidate's lowest and highest possible score and says which ones to go on with.
    """
    order = np.argsort(-np.abs(anchor).astype(float), kind="stable")
    order = order[anchor[order] != 0]
    ends = np.stack([anchor[order] * block.low[order], anchor[order] * block.high[order]])
    least, most = ends.min(0).sum() if len(order) else 0, ends.max(0).sum() if len(order) else 0
    alive, read = alive.copy(), 0
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), block.columns.dtype)
    for i, k in enumerate(order):
        score = score + anchor[k] * block.columns[k][at]
        least, most, read = least - ends[:, i].min(), most - ends[:, i].max(), read + len(at)
        if (i + 1) % step == 0 and len(at):
            fine = judge(score + least, score + most)
            if not fine.all():
                alive[at[~fine]] = False
                at, score = at[fine], score[fine]
    return at, score, read


def best_of(k: int) -> Judge:
    """Whoever may still be among the ``k`` highest."""

    def judge(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= kth_largest(low, k) if len(low) > k else np.ones(len(low), bool)

    return judge


def best_in(windows: list[tuple[int, int]], k: int) -> Judge:
    """Whoever may still be among the ``k`` highest of some window of scores (both ends belong to it)."""

    def judge(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for a, b in windows:
            may = (high >= a) & (low <= b)
            sure = may & (low >= a) & (high <= b)
            if sure.sum() >= k:
                may &= high >= kth_largest(low[sure], k)
            out |= may
        return out

    return judge


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Whole scores ``s`` with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim) if dim else np.zeros((len(v), 0))


def _ids(t: pa.Table) -> np.ndarray:
    """Order of the ids, nulls last."""
    order = np.empty(t.num_rows, np.int64)
    order[pc.sort_indices(t.select(["id", "rid"]), sort_keys=[("id", "ascending"), ("rid", "ascending")], null_placement="at_end").to_numpy()] = np.arange(t.num_rows)
    return order


def _first(at: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places in ``at`` of the ``k`` highest scores, equal ones by id."""
    if len(at) > k:
        cut = np.flatnonzero(score >= kth_largest(score, k))
    else:
        cut = np.arange(len(at))
    return cut[sorted(range(len(cut)), key=lambda i: (-score[cut[i]], rank[at[cut[i]]]))[:k]]


def _search(rows: pa.Table, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> tuple[list, list, list, list]:
    """``(anchor, number of its positive, row, score)`` of a block's best; without known positives, number 0 and the best of the label."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not rows.num_rows or not anchors.num_rows:
        return out
    dim = rows.column("dim")[0].as_py()
    x, a = _matrix(rows, dim), _matrix(anchors, dim)
    exact = bool(dim) and dim * float(np.abs(x).max()) * float(np.abs(a).max()) >= _EXACT
    block = Block(x, exact)
    codes = pa.chunked_array([*rows.column("label").chunks, *anchors.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    label, wanted = codes[: len(x)], codes[len(x) :]
    rid, own = rows.column("rid").to_numpy(), anchors.column("rid").to_numpy()
    rank = _ids(rows)
    known = anchors.column("scores").to_pylist() if "scores" in anchors.column_names else None

    def add(anchor: int, number: int, at: np.ndarray, score: np.ndarray) -> None:
        for i in range(len(at)):
            for column, v in zip(out, (int(own[anchor]), number, int(at[i]), int(score[i])), strict=True):
                column.append(v)

    for i in range(len(a)):
        vector = np.array([int(v) for v in a[i]], object) if exact else a[i]
        if known is None:
            at, score, _ = scan(block, vector, (label == wanted[i]) & (rid != own[i]), best_of(positives))
            best = _first(at, score, rank, positives)
            add(i, 0, at[best], score[best])
            continue
        windows = [window_of(s, low, high) for s in known[i]]
        at, score, _ = scan(block, vector, label != wanted[i], best_in([w for w in dict.fromkeys(windows) if w[0] <= w[1]], negatives))
        for number, (lo, hi) in enumerate(windows, 1):
            inside = np.flatnonzero((score >= lo) & (score <= hi))
            best = inside[_first(at[inside], score[inside], rank, negatives)]
            add(i, number, at[best], score[best])
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cells: int = CELLS, anchors: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, embedding, label)``.

    Rows for which ``anchor`` holds are searched against all rows. A score is the inner product of the components' ``floor(256 x)``.
    An anchor's positives are its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's are ranked from 1. Equal scores stand by ``vec_id``.

    Nulls: rows with a null label, a null vector, or a null or non-finite component take no part; a null ``vec_id`` stands behind all
    others. Vectors of different lengths don't meet. Repeated rows are rows each, and other rows of each other. Scores are exact,
    beyond doubles too; one of more than 64 bits is an error. An empty table gives an empty result; further columns don't matter.

    A block of rows has about ``cells`` components and meets ``anchors`` anchors in one task, so memory doesn't grow with the table.
    """
    spark = vectors.sparkSession
    fine = F.expr("label is not null and embedding is not null and forall(embedding, x -> x is not null and abs(x) <= 1.7976931348623157e308D)")
    whole = F.transform("embedding", lambda x: _floor(F.lit(float(SCALE)) * x.cast("double")))
    x = vectors.where(fine).select(F.col("vec_id").alias("id"), "label", whole.alias("v"), F.size("embedding").alias("dim"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    x = saved(x.select(F.monotonically_increasing_id().alias("rid"), "*"), "bond-rows")
    n, dims, m = x.agg(F.count("*"), F.max("dim"), F.count_if("is_anchor")).first()
    a = x.where("is_anchor")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nb = max(-(-n * max(1, dims or 0) // cells), min(parts, -(-n // SMALL)), 1)
    na = max(1, -(-m // anchors))
    key = ["dim", "block", "group"]

    def dealt(t: DataFrame, mine: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        t = t.withColumn(mine[0], F.pmod(F.xxhash64("rid"), F.lit(mine[1])).cast("int"))
        return t.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))))

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        some = some.rename_columns([c.removeprefix("a_") for c in some.column_names])
        anchor_rid, number, at, score = _search(rows, some, positives, negatives, low, high)
        got = rows.select(["rid", "id"]).take(pa.array(at, pa.int64()))
        return pa.table({"a": pa.array(anchor_rid, pa.int64()), "number": pa.array(number, pa.int32()), "rid": got.column("rid"), "id": got.column("id"), "score": pa.array(score, pa.int64())})

    schema = f"a long, number int, rid long, id {x.schema['id'].dataType.simpleString()}, score long"
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("rid")]

    def searched(some: DataFrame, k: int, tag: str) -> DataFrame:
        left = dealt(x.select("rid", "id", "label", "v", "dim"), ("block", nb), ("group", na)).groupBy(*key)
        # new columns, so that nobody takes those of one side for those of the other
        right = dealt(some, ("group", na), ("block", nb)).select(*[F.col(c).alias(f"a_{c}") for c in [*some.columns, "block", "group"]]).groupBy(*[f"a_{c}" for c in key])
        found = left.cogroup(right).applyInArrow(run, schema)
        r = F.row_number().over(W.partitionBy("a", "number").orderBy(*order))  # a few rows per block
        return saved(found.withColumn("rank", r).where(F.col("rank") <= k), tag)

    best = searched(a.select("rid", "label", "v", "dim"), positives, "bond-positives")
    scores = best.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))  # at most ``positives``
    some = a.select("rid", "label", "v", "dim").join(scores, F.col("rid") == F.col("a")).drop("a")
    found = searched(some, negatives, "bond-negatives")
    pairs = best.select("a", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(a.select(F.col("rid").alias("a"), F.col("id").alias("anchor_id")), "a")
    found = found.select("a", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["a", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(x: Column) -> Column:
    """The floor as a double, for numbers of any size: from 2^52 on all are whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def shifted(vectors: DataFrame) -> DataFrame:
    """``embeddings`` with the label of every seventh row moved to the next of ten, as mistaken labels."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: Every anchor against every row.
ORACLE_SQL = f"""
with v as (select row_number() over () as r, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e
 from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as vec_id, b.label = a.label as same, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.r <> b.r and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, br) <= {POSITIVES})
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.ar, p.br order by n.score desc, n.vec_id, n.br)::integer as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on p.ar = n.ar and not n.same and {LOW} * p.score <= 100 * n.score and 100 * n.score <= {HIGH} * p.score
qualify row_number() over (partition by p.ar, p.br order by n.score desc, n.vec_id, n.br) <= {NEGATIVES}
"""
