"""The log-structured counts of arriving windows."""
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from nextdist.operators import counts as C
from nextdist.streaming import merged as M

SCHEMA = "start long, tokens array<int>"


def batches(n=9, size=120, seed=2):
    rng = random.Random(seed)
    return [[(b * size + i, [int(rng.paretovariate(0.9)) % (4 + b) for _ in range(4)]) for i in range(size)] for b in range(n)]


def rows(df):
    return sorted((r.level, tuple(r.context), r.next, r.cnt) for r in df.collect())


def test_each_batch_leaves_the_counts_and_growth_of_all_so_far(spark, tmp_path):
    path, seen = str(tmp_path / "s"), []
    for b, ws in enumerate(batches(5)):
        seen += ws
        M.add_batch(spark.createDataFrame(ws, SCHEMA), 3, path, b, fanout=2)
        if b in (0, 2, 4):
            cn = C.context_next_counts(spark.createDataFrame(seen, SCHEMA), 3)
            assert rows(M.counts_so_far(spark, path)) == rows(cn)
            want = {r.level: r for r in C.level_stats(cn).collect()}
            got = {r.level: r for r in M.growth(spark, path).where(f"batch = {b}").collect()}
            for k, w in want.items():
                assert (got[k].total_ctx, got[k].unique_ctx) == (w.total_visits, w.unique_nodes) and math.isclose(got[k].entropy, w.avg_entropy, abs_tol=1e-9)
    last = M.Store(spark, path).manifest()
    assert [r["tier"] for r in last["runs"]] == [2, 0]  # four batches merged by twos, and the last
    assert sorted(os.listdir(f"{path}/runs")) == sorted([*[r["name"] for r in last["runs"]], *last["gone"]])
    assert M.growth(spark, path).count() == 15


def test_a_batch_that_comes_again_or_broke_off_changes_nothing(spark, tmp_path, monkeypatch):
    path, ws = str(tmp_path / "s"), batches(4)
    for b in (0, 1):
        M.add_batch(spark.createDataFrame(ws[b], SCHEMA), 3, path, b, fanout=2)
    before, files = rows(M.counts_so_far(spark, path)), M.Store(spark, path).manifest()
    M.add_batch(spark.createDataFrame(ws[1], SCHEMA), 3, path, 1, fanout=2)
    M.add_batch(spark.createDataFrame(ws[3], SCHEMA), 3, path, 0, fanout=2)
    assert rows(M.counts_so_far(spark, path)) == before and M.Store(spark, path).manifest() == files

    def lost(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(M.Store, "write", lost)
        with pytest.raises(OSError):
            M.add_batch(spark.createDataFrame(ws[2], SCHEMA), 3, path, 2, fanout=2)
    assert rows(M.counts_so_far(spark, path)) == before
    M.add_batch(spark.createDataFrame(ws[2], SCHEMA), 3, path, 2, fanout=2)
    assert rows(M.counts_so_far(spark, path)) == rows(C.context_next_counts(spark.createDataFrame([w for b in ws[:3] for w in b], SCHEMA), 3))


def test_a_batch_looks_up_its_own_contexts_only(spark, tmp_path):
    path = str(tmp_path / "s")
    many = [(i, [i % 50, i % 7, i % 11, i % 3]) for i in range(3000)]
    M.add_batch(spark.createDataFrame(many, SCHEMA), 3, path, 0)
    M.add_batch(spark.createDataFrame([(0, [1, 1, 1, 1]), (1, [77, 1, 1, 1])], SCHEMA), 3, path, 1)
    m = M.Store(spark, path).manifest()
    assert m["own"] == 6 and m["touched"] < 60 < m["runs"][0]["rows"]
    buckets = {r[0] for r in spark.read.parquet(M.Store(spark, path).run(m["runs"][1]["name"])).select("bucket").distinct().collect()}
    x = M.Store(spark, path).counts(m["runs"][:1], m["schema"]).where(F.col("bucket").isin(list(buckets)))
    assert len(buckets) <= 6 and re.search(r"PartitionFilters: \[bucket#\d+ IN", x._jdf.queryExecution().executedPlan().toString())


def test_empty_batches_and_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no counts"):
        M.counts_so_far(spark, path)
    M.add_batch(spark.createDataFrame([], SCHEMA), 3, path, 0)
    assert M.counts_so_far(spark, path).count() == 0 and M.growth(spark, path).count() == 0
    M.add_batch(spark.createDataFrame([(0, [1, 2, 3, 4])], SCHEMA), 3, path, 1)
    assert M.counts_so_far(spark, path).count() == 3 and M.growth(spark, path).count() == 3


def test_a_first_batch_is_dealt_once_and_read_as_it_lies(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    words = spark.createDataFrame([(i, [f"w{i % 3}", f"w{i % 5}", None if i % 7 == 0 else f"w{i % 4}"]) for i in range(200)], "start long, tokens array<string>")
    monkeypatch.setattr(M, "COMBINED", 30)
    M.add_batch(words, 2, path, 0)
    cn = C.context_next_counts(words, 2)
    got = M.counts_so_far(spark, path)
    key = lambda df: sorted(((r.level, tuple(r.context), r.next, r.cnt) for r in df.collect()), key=repr)
    assert key(got) == key(cn)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # one run was grouped again
    want = {r.level: r for r in C.level_stats(cn).collect()}
    for r in M.growth(spark, path).collect():
        w = want[r.level]
        assert (r.total_ctx, r.unique_ctx) == (w.total_visits, w.unique_nodes) and math.isclose(r.entropy, w.avg_entropy, abs_tol=1e-9)
    assert spark.conf.get(M._CLEANUP, "false") != "true"
