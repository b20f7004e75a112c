import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextdist.llm import bond as B

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if k is not None and fine(v)]
    by = lambda s: (-s[0], rows[s[1]][0] is None, rows[s[1]][0] or 0)
    out = []
    for a, (aid, av, ak) in enumerate(rows):
        if not anchor(aid):
            continue
        scored = [(sum(x * y for x, y in zip(av, v, strict=True)), j) for j, (_, v, _) in enumerate(rows) if j != a and len(v) == len(av)]
        for ps, p in sorted((s for s in scored if rows[s[1]][2] == ak), key=by)[:positives]:
            hits = sorted((s for s in scored if rows[s[1]][2] != ak and low * ps <= 100 * s[0] <= high * ps), key=by)
            out += [(aid, rows[p][0], r, rows[n][0], ps, ns) for r, (ns, n) in enumerate(hits[:negatives], 1)]
    return sorted(out, key=repr)


def made(n=260, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] * rng.uniform(0, 1) + rng.normal(size=dim)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    return rows


def odd():
    rows = made()
    rows += [rows[0], rows[20], rows[20], (300, rows[40][1], 2), (301, rows[40][1], 3), (302, [0.0] * 24, 1), (303, None, 1), (304, [None, 1.0], 1), (305, [float("nan")] * 24, 1), (306, [float("inf")] * 24, 1)]
    return rows + [(307, rows[3][1], None), (None, rows[8][1], 0), (310, [1.0, -2.0], 1), (320, [2.0, 1.5], 1), (330, [1.0, 0.5], 2), (340, [], 1), (341, [], 1), (342, [], 2)]


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cells,anchors", [(B.CELLS, B.ANCHORS), (24 * 40, 3)])
def test_against_brute_force_in_one_block_and_in_many(spark, cells, anchors):
    df = spark.createDataFrame(odd(), SCHEMA)
    want = brute(odd(), lambda i: i is not None and i % 10 == 0)
    assert len(want) > 500
    assert found(B.hard_negatives(df, F.col("vec_id") % 10 == 0, cells=cells, anchors=anchors)) == want


def test_other_numbers_clashing_columns_and_the_empty_table(spark):
    df = spark.createDataFrame(made(90), SCHEMA)
    for name in ("id", "rid", "v", "dim", "rank", "score", "a", "block", "group", "number", "is_anchor", "scores"):
        df = df.withColumn(name, F.lit("x"))
    args = {"positives": 2, "negatives": 3, "low": -50, "high": 100}
    assert found(B.hard_negatives(df, F.col("vec_id") % 9 == 0, **args)) == brute(made(90), lambda i: i % 9 == 0, **args)
    assert found(B.hard_negatives(df.where("false"), F.col("vec_id") % 9 == 0)) == []
    assert found(B.hard_negatives(df, F.col("vec_id") < 0)) == []


def test_numbers_that_doubles_do_not_hold(spark):
    rows = [(i, [float((i * 7919) % 1000) * 1e3 + 1, float(i) * 3e4 - 1, -(i % 3) * 1e5], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    want = brute(rows, lambda i: i % 5 == 0)
    assert max(w[4] for w in want) > 2**53
    assert found(B.hard_negatives(df, F.col("vec_id") % 5 == 0)) == want


def test_bounds_shrink_the_bitmap_and_keep_what_counts():
    rng = np.random.default_rng(0)
    decay = 0.8 ** np.arange(64)
    x = np.floor(256 * rng.normal(size=(4000, 64)) * decay)
    a = np.floor(256 * rng.normal(size=64) * decay)
    block, every, want = B.Block(x), np.ones(4000, bool), x @ a
    at, score, read = B.scan(block, a, every, B.best_of(5))
    assert (score == want[at]).all() and set(np.argsort(-want)[:5]) <= set(at) and read < 0.5 * x.size
    window = B.window_of(int(want.max()))
    at, score, read = B.scan(block, a, every, B.best_in([window], 10))
    inside = np.flatnonzero((want >= window[0]) & (want <= window[1]))
    assert set(inside[np.argsort(-want[inside])[:10]]) <= set(at) and read < 0.7 * x.size


def test_windows_of_scores():
    assert [B.window_of(s) for s in (10, 11, 0, -5)] == [(3, 9), (4, 9), (0, 0), (-1, -5)]
