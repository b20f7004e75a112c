import pytest
"""Sources, sinks, vocabularies and the streaming forms."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from nextdist.operators import bpe
from nextdist.operators import counts as C
from nextdist.operators import tokens as K
from nextdist.operators import windows as P
from nextdist.sources import readers as R
from nextdist.sources import synthetic
from nextdist.sources import writers as W
from nextdist.streaming import counts as ST


def test_readers(spark, tmp_path):
    (tmp_path / "data0.json").write_text(json.dumps([{"story": " a b "}, {"story": ""}]))
    (tmp_path / "data1.json").write_text(json.dumps([{"story": "c"}]))
    assert sorted(r.text for r in R.read_json_docs(spark, str(tmp_path)).collect()) == ["", " a b ", "c"]
    (tmp_path / "x.jsonl").write_text('{"text": "one"}\n\n{"text": " \\n"}\n{"text": "two"}\n')
    assert sorted(r.text for r in R.read_jsonl_docs(spark, str(tmp_path / "x.jsonl")).collect()) == ["one", "two"]


def test_token_files_round_trip(spark, tmp_path):
    tokens = np.random.default_rng(1).integers(0, 65536, 10_007)
    df = spark.createDataFrame([(i, int(t)) for i, t in enumerate(tokens)], "pos long, token int").repartition(5)
    index = W.write_token_bin(df, str(tmp_path / "bin"), per_part=4000).orderBy("part").collect()
    assert [(r.first_pos, r.n) for r in index] == [(0, 4000), (4000, 4000), (8000, 2007)]
    whole = np.concatenate([np.fromfile(r.file, "<u2") for r in index])
    assert (whole == tokens).all()
    back = R.read_token_bin(spark, index[0].file, pct=50).collect()
    assert [r.token for r in sorted(back, key=lambda r: r.pos)] == tokens[:2000].tolist()
    assert R.read_token_bin(spark, index[0].file, pct=50, max_tokens=7).count() == 7


def test_counts_and_statistics_persist(spark, tmp_path):
    w = spark.createDataFrame([(0, [1, 2, 3], 0), (1, [1, 2, 4], 1)], "start long, tokens array<int>, shard int")
    cn = C.context_next_counts(w, 2)
    W.write_counts(cn, str(tmp_path / "cn"))
    back = R.read_counts(spark, str(tmp_path / "cn"))
    assert back.count() == cn.count() == 3 and R.read_counts(spark, str(tmp_path / "cn"), 2).count() == 2
    W.write_shards(w, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).where("shard = 1").first().start == 1
    W.write_level_stats(C.level_stats(cn), str(tmp_path / "stats"), "run1")
    assert spark.read.json(str(tmp_path / "stats")).where("run = 'run1'").count() == 2
    W.write_pair_shards(spark.createDataFrame([(1, 2, 3)], "t0 int, t1 int, bin int"), str(tmp_path / "pairs"))
    W.write_context_json(cn.withColumn("context", F.array_join(F.col("context").cast("array<string>"), "-")), str(tmp_path / "json"), "level")
    assert {r.context: r.counts.asDict() for r in spark.read.json(str(tmp_path / "json")).collect()}["1-2"] == {"3": 1, "4": 1, "2": None}


def test_vocabulary_encode_decode(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a  z")], "doc_id long, text string")
    vocab = K.word_vocab(docs, 3)
    assert [(r.token, r.piece, r.freq) for r in vocab.orderBy("token").collect()] == [(0, "a", 2), (1, "b", 2), (2, "", 1)]
    toks = K.encode_words(docs, vocab, 9, bos=7, eos=8)
    assert {r.doc_id: list(r.tokens) for r in K.to_sequences(toks).collect()} == {1: [7, 1, 0, 1, 9, 8], 2: [7, 0, 2, 9, 8]}
    plain = K.encode_words(docs, vocab, 9)
    assert {r.doc_id: r.text for r in K.decode_words(plain, vocab).collect()} == {1: "b a b <unk>", 2: "a  <unk>"}
    flat = K.flatten_stream(K.to_sequences(plain)).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in flat] == list(enumerate([1, 0, 1, 9, 0, 2, 9]))


def test_bpe_merges_the_most_frequent_pair_first(spark):
    assert bpe.learn_merges({"abab": 3, "abc": 2, "zz": 1}, 2) == [("a", "b"), ("ab", "ab")]
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[i::20])) for i in range(20)], "doc_id long, text string")
    vocab, merges = bpe.train_bpe(docs, 15, specials=("<s>",))
    ids = {r.piece: r.token for r in vocab.collect()}
    assert len(ids) == 15 and ids["<s>"] == 0
    pieces = {i: p for p, i in ids.items()}
    for r in bpe.encode_bpe(docs, vocab, merges, -1).collect():
        assert "".join(pieces[t] for t in r.tokens) == "".join(words[r.doc_id :: 20])


def test_padding(spark):
    x = W.padded_sequences(spark.createDataFrame([(1, [5]), (2, [1, 2, 3])], "doc_id long, tokens array<int>"), 0).orderBy("doc_id").collect()
    assert [(list(r.tokens), r.length, r.max_length, r.num_stories) for r in x] == [([5, 0, 0], 1, 3, 2), ([1, 2, 3], 3, 3, 2)]


def test_synthetic_tokens_follow_the_power_law(spark):
    got = {r.token: r["count"] for r in synthetic.synthetic_tokens(spark, 20_000, 5, 1.0, 3).groupBy("token").count().collect()}
    total = sum(1 / k for k in range(1, 6))
    for k in range(5):
        assert abs(got[k] / 20_000 - 1 / (k + 1) / total) < 0.02


def windows_files(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "start long, tokens array<int>").coalesce(1).write.mode("append").parquet(f"{path}")


def test_streamed_counts_growth_and_resume(spark, tmp_path):
    rng = random.Random(3)
    tokens = [rng.randrange(4) for _ in range(200)]
    ws = [(i, tokens[i : i + 4]) for i in range(197)]
    src = str(tmp_path / "in")
    schema = "start long, tokens array<int>"
    windows_files(spark, src, [ws[:60], ws[60:90]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ST.start_growth(stream, 3, out, cp).awaitTermination()
    windows_files(spark, src, [ws[90:]])
    ST.start_growth(stream, 3, out, cp).awaitTermination()  # goes on after what it has seen
    want = C.context_next_counts(spark.createDataFrame(ws, schema), 3)
    key = lambda df: sorted((r.level, tuple(r.context), r.next, r.cnt) for r in df.collect())
    assert key(ST.read_counts_so_far(spark, out)) == key(want)
    growth = ST.read_growth(spark, out).collect()
    assert len({r.batch for r in growth}) == 3
    last = {r.level: r for r in growth if r.batch == max(x.batch for x in growth)}
    for r in C.level_stats(want).collect():
        assert last[r.level].unique_ctx == r.unique_nodes and last[r.level].total_ctx == r.total_visits
        assert abs(last[r.level].entropy - r.avg_entropy) < 1e-9
    q = ST.stream_context_counts(spark.readStream.schema(schema).parquet(src), 3).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(spark.table("counts")) == key(want)


def test_streamed_online_labels(spark, tmp_path):
    from nextdist.operators.growth import online_target_probability

    ws = [(i, [i % 2, (i // 2) % 2, 1]) for i in range(40)]
    src = str(tmp_path / "in")
    windows_files(spark, src, [ws[:25]])
    stream = spark.readStream.schema("start long, tokens array<int>").parquet(src)
    q = ST.online_labels(stream, 2).writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.pos): r.prob for r in spark.table("labels").collect()}
    want = {(r.start, r.pos): r.prob for r in online_target_probability(spark.createDataFrame(ws[:25], "start long, tokens array<int>"), 2).collect()}
    assert got == want


def test_windows_by_pairs_and_starts(spark):
    w = spark.createDataFrame([(0, [1, 2, 3]), (5, [2, 2, 1]), (9, [1, 2, 9])], "start long, tokens array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "t0 int, t1 int")
    assert sorted(r.start for r in P.windows_by_pairs(w, pairs).collect()) == [0, 9]
    starts = spark.createDataFrame([(5,), (5,), (77,)], "start long")
    assert [r.start for r in P.windows_by_starts(w, starts).collect()] == [5]


def test_merges_learnt_by_spark_equal_the_helpers(spark):
    rng = random.Random(3)
    for letters, merges in (("abc", 30), ("abcdefgh", 60), ("ab\\$E.Q", 40)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(120)}
        want = bpe.learn_merges(dict(words), merges)
        got = bpe.learn_merges_spark(spark.createDataFrame(list(words.items()), "w string, n long"), merges, at_once=6, write_every=3)
        assert got == want


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from nextdist.sources import shared

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(fake)


def test_ranges_of_large_token_files(spark, tmp_path):
    x = np.arange(5001, dtype="<u2")
    x.tofile(tmp_path / "a.bin")
    whole = sorted((r.pos, r.token) for r in R.read_token_bin(spark, str(tmp_path)).collect())
    assert whole == [(i, i) for i in range(5001)]
    assert sorted((r.pos, r.token) for r in R.read_token_bin(spark, str(tmp_path), whole=100, span=999).collect()) == whole
    assert sorted(r.pos for r in R.read_token_bin(spark, str(tmp_path), pct=50, whole=100, span=998).collect()) == list(range(2500))
    assert R.read_token_bin(spark, str(tmp_path), max_tokens=7, whole=100, span=998).count() == 7
