import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from nextdist.llm import shards as S
from nextdist.llm import tokens


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_and_keyed(n):
    slots = S.feistel_slots(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (S.feistel_slots(np.arange(n), n) == slots).all()
    if n > 100:
        assert (S.feistel_slots(np.arange(n), n, key=1) != slots).any()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def test_round_trip_and_resume(spark, tmp_path):
    rows = [(i, f"document {i} says hello " * (i % 97), "x") for i in range(200)] + [(3, "again"), (None, "no id"), (900, None), (901, "")]
    df = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, slot string").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    to = str(tmp_path / "out")
    got = S.training_order(spark.read.parquet(str(tmp_path / "in")), length=64, per_shard=16, to=to).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * S.record(64).itemsize for r in got)
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    want = []
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u2")
        want += [(repr(d), k // 64, ids[k : k + 64].tobytes()) for k in range(0, len(ids), 64)]
    assert sorted((repr(r.doc_id), r.nth, bytes(r.ids)) for r in got) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    later = S.read_shards(spark, to, 37, 16, 64).collect()
    assert sorted(r.slot for r in later) == list(range(37, len(got)))
    # without Spark: seek in the file of slots 32 to 47, or map it
    (name,) = (tmp_path / "out").glob("part-00002-*")
    kind = S.record(64)
    row = next(r for r in got if r.slot == 33)
    with open(name, "rb") as f:
        f.seek(row.byte_offset)
        one = np.frombuffer(f.read(kind.itemsize), kind)[0]
    assert one["ids"][: one["length"]].tobytes() == row.ids and one["end"] == 10
    assert len(np.memmap(name, kind)) == 16 and name.stat().st_size == 16 * kind.itemsize


def test_ids_too_wide_are_an_error_and_four_bytes_hold_them(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string").coalesce(1)
    path = tokens.tokenizer_path()
    with pytest.raises(Exception, match="does not fit"):
        S.sequences(docs, path, 8, end_id=70_000).collect()
    data = S.sequences(docs, path, 8, end_id=70_000, width=4).first().data
    got = np.frombuffer(bytes(data) + b"\n", S.record(8, 4))[0]
    assert got["ids"][got["length"] - 1] == 70_000 and S.id_width(path) == 2


def test_a_very_long_text_and_repeated_rows(spark, tmp_path):
    long = "some words of a long text " * 100_000
    docs = spark.createDataFrame([(1, long), (2, "x"), (2, "x")], "doc_id long, text string")
    got = S.training_order(docs, per_shard=256, to=str(tmp_path / "o")).collect()
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.nth))
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    assert ids == np.array([*tok.encode(long, add_special_tokens=False).ids, 2], "<u2").tobytes()
    assert sum(r.doc_id == 2 for r in got) == 2 and sorted(r.slot for r in got) == list(range(len(got)))


def test_empty_table(spark):
    assert S.training_order(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffle_files_do_not_pile_up_beside_the_shards(spark, tmp_path):
    """Shards are written in several jobs, and what one shuffled is gone when it ends; the order and the files are the same as in one job."""
    rows = [(i, f"document {i} says hello " * 40) for i in range(200)]
    seqs = S.saved(S.sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokens.tokenizer_path(), 64), "test-sequences")
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {x: x.stat().st_size for d in folders for x in Path(d).rglob("shuffle_*.data")}
    before, made = held(), 1
    n = S.write_shards(seqs, str(tmp_path / "several"), per_shard=16)
    for _ in range(100):  # files are removed in the background
        made = sum(v for k, v in held().items() if k not in before)
        if made < 10_000:
            break
        time.sleep(0.1)
    assert made < 10_000 < n * S.record(64).itemsize
    assert (tmp_path / "several" / "_SUCCESS").exists()
    assert n == S.write_shards(seqs, str(tmp_path / "one"), per_shard=16, writes=1) > 64
    files = lambda d: [(x.name.split("-")[1], x.read_bytes()) for x in sorted((tmp_path / d).glob("part-*"))]
    assert files("several") == files("one") and len(files("one")) == -(-n // 16)
