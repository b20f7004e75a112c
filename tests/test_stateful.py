"""Streams in the state store, stopped and started again."""
import random

from nextdist.operators import counts as C
from nextdist.operators.growth import online_target_probability
from nextdist.streaming import stateful as S

SCHEMA = "start long, tokens array<int>"


def made(n=120, seed=5):
    rng = random.Random(seed)
    return [(i, [int(rng.paretovariate(1)) % 5 for _ in range(3)]) for i in range(n)]


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_updates_go_on_after_a_restart(spark, tmp_path):
    ws, src, out, progress = made(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (ws[:50], ws[50:60], ws[60:]):
        S.start_updates(arrive(spark, src, part), 2, out, progress).awaitTermination()
    want = {(r.level, tuple(r.context), r.next): r.cnt for r in C.context_next_counts(spark.createDataFrame(ws, SCHEMA), 2).collect()}
    assert {(r.level, tuple(r.context), r.next): r.cnt for r in S.latest_counts(spark, out).collect()} == want
    changed = spark.read.parquet(out).groupBy("batch").count().collect()
    assert len(changed) == 3 and min(r["count"] for r in changed) <= 20 < len(want)  # a batch tells of its own counts only
    assert spark.conf.get(S._PROVIDER, None) != S.ROCKSDB


def test_labels_go_on_after_a_restart(spark, tmp_path):
    ws, src, out, progress = made(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (ws[:70], ws[70:]):
        S.start_labels(arrive(spark, src, part), 2, out, progress).awaitTermination()
    got = {(r.start, r.pos): r.prob for r in spark.read.parquet(out).collect()}
    want = {(r.start, r.pos): r.prob for r in online_target_probability(spark.createDataFrame(ws, SCHEMA), 2).collect()}
    assert got == want and len(got) == 240
