"""Token files as a data source, and the bucketed count store."""
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextdist.operators import counts as C
from nextdist.operators import lookup as L
from nextdist.sources import count_store as CS
from nextdist.sources import token_files as TF


def stream(spark, n, parts=5):
    return spark.range(n).select(F.col("id").alias("pos"), F.expr("(id * 7919) % 65536").alias("token")).repartition(parts)


@pytest.mark.parametrize("n,per_part,span", [(10_000, 999, 1000), (10_000, 3000, 7), (5, 100, 1 << 20), (4096, 4096, 8192)])
def test_files_come_back_whatever_the_ranges(spark, tmp_path, n, per_part, span):
    path = str(tmp_path / "t")
    TF.write_token_files(stream(spark, n), path, per_part)
    names = sorted(os.listdir(path))
    assert names == ["_index.json", *[f"tokens-{i:06d}.bin" for i in range(-(-n // per_part))]]
    x = TF.read_token_files(spark, path, span=max(span, n // 40))
    assert sorted((r.pos, r.token) for r in x.collect()) == [(i, i * 7919 % 65536) for i in range(n)]
    first = np.fromfile(f"{path}/tokens-000000.bin", "<u2")
    assert first.tolist() == [i * 7919 % 65536 for i in range(min(n, per_part))]


def test_one_partition_per_range_of_bytes(spark, tmp_path):
    path = str(tmp_path / "t")
    TF.write_token_files(stream(spark, 10_000), path, 6000)
    assert TF.read_token_files(spark, path, span=4001).rdd.getNumPartitions() == 3 + 2  # 12,000 and 8,000 bytes
    one = spark.read.format("tokenbin").load(f"{path}/tokens-000001.bin")  # a single file counts from its own start
    assert [r.pos for r in one.orderBy("pos").limit(2).collect()] == [0, 1] and one.count() == 4000


def test_wide_ids_empty_streams_and_uris(spark, tmp_path):
    path = "file://" + str(tmp_path / "w")
    TF.write_token_files(stream(spark, 100).withColumn("token", F.col("token") + 100_000), path, 30, width=4)
    assert sorted(r.token for r in TF.read_token_files(spark, path, 4).collect()) == sorted(i * 7919 % 65536 + 100_000 for i in range(100))
    TF.write_token_files(stream(spark, 0), path, 30)  # overwrites
    assert TF.read_token_files(spark, path).count() == 0 and os.listdir(tmp_path / "w") == ["_index.json"]
    with pytest.raises(Exception, match="must fit in 2 bytes"):
        TF.write_token_files(stream(spark, 10).withColumn("token", F.lit(70_000)), path, 30)
    assert os.listdir(tmp_path / "w") == ["_index.json"]


def test_a_task_that_fails_or_runs_twice_leaves_one_whole_file(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "t")
    batch = lambda part, lo, hi: pa.RecordBatch.from_pydict({"part": [part] * (hi - lo), "pos": list(range(lo, hi)), "token": list(range(lo, hi))})
    w = TF.TokenWriter(path, 2, True)
    first = w.write(iter([batch(0, 0, 5), batch(0, 5, 9), batch(1, 9, 12)]))
    again = w.write(iter([batch(0, 0, 5), batch(0, 5, 9), batch(1, 9, 12)]))  # the same task once more; only one of them is told of

    def broken():
        yield batch(2, 12, 14)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(broken())
    rest = w.write(iter([batch(2, 12, 20)]))
    assert not [f for f in os.listdir(path) if f.endswith(".bin")]  # nothing is seen before the commit
    w.commit([again, None, rest])
    assert sorted(os.listdir(path)) == ["_index.json", "tokens-000000.bin", "tokens-000001.bin", "tokens-000002.bin"]
    assert np.concatenate([np.fromfile(f"{path}/tokens-00000{i}.bin", "<u2") for i in range(3)]).tolist() == list(range(20))
    assert [r["first_pos"] for r in json.load(open(f"{path}/_index.json"))] == [0, 9, 12] and first.files[0][0] != again.files[0][0]
    w = TF.TokenWriter(path, 2, True)
    twice = w.write(iter([batch(0, 0, 5)]))
    with pytest.raises(ValueError, match="more than one piece"):
        w.commit([twice, w.write(iter([batch(0, 5, 9)]))])
    assert np.fromfile(f"{path}/tokens-000000.bin", "<u2").tolist() == list(range(9)) and len(os.listdir(path)) == 4
    w = TF.TokenWriter(path, 2, True)
    w.write(iter([batch(7, 0, 5)]))
    w.abort([None])
    assert len(os.listdir(path)) == 4


def windows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, [int(rng.paretovariate(0.8)) % 12 for _ in range(4)]) for i in range(n)]
    return spark.createDataFrame(rows, "start long, tokens array<int>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_joined_where_it_lies(spark, tmp_path):
    w = windows(spark)
    cn = C.context_next_counts(w, 3)
    store = CS.write_count_store(cn, str(tmp_path / "s"), 6)
    assert len([f for f in os.listdir(tmp_path / "s" / "buckets-6") if f.endswith(".parquet")]) == 6
    for norm in ("l1", "l2"):
        got = CS.stored_soft_labels(w, store, 3, norm)
        key = lambda df: sorted((r.start, r.pos, r.next, round(r.prob, 9)) for r in df.collect())
        assert key(got) == key(L.soft_labels(w, cn, 3, norm))
    text = plan(CS.stored_soft_labels(w, store, 3))  # before it runs, so that it stands there once
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+L?, 6\)", text)) == text.count("Exchange") == 1  # the windows' side only
    assert "Bucketed: true" in text


def test_questions_read_few_files(spark, tmp_path):
    w = windows(spark)
    cn = C.context_next_counts(w, 3)
    CS.write_count_store(cn, str(tmp_path / "s"), 40)
    store = CS.open_count_store(spark, str(tmp_path / "s"))
    asked = [[1], [1, 2], [1, 1, 1], [11, 11, 11], [99], [2, 1]]
    got = CS.stored_distribution(store, asked)
    key = lambda df: sorted((r.level, tuple(r.context), r.next, round(r.prob, 9)) for r in df.collect())
    assert key(got) == key(L.next_distribution(cn, spark.createDataFrame([(a,) for a in asked], "context array<int>")))
    selected = re.search(r"SelectedBucketsCount: (\d+) out of 40", plan(got))
    assert selected and int(selected[1]) <= 6
    assert CS.stored_distribution(store, []).count() == 0 and CS.stored_distribution(store, [[99]]).count() == 0


def test_number_of_buckets_follows_the_rows_and_a_missing_store_is_an_error(spark, tmp_path, monkeypatch):
    cn = C.context_next_counts(windows(spark, 200), 3)
    monkeypatch.setattr(CS, "ROWS_PER_BUCKET", 100)
    CS.write_count_store(cn, str(tmp_path / "s"))
    assert os.listdir(tmp_path / "s") == [f"buckets-{-(-cn.count() // 100)}"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no count store"):
        CS.open_count_store(spark, str(tmp_path / "none"))
