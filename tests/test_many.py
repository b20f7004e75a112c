"""Many targets, sketches, samples and bins against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from nextdist.operators import contain, counts, growth, shards, sketches, windows
from nextdist.plans import queries as Q


def test_ten_thousand_targets_equal_contains(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    texts = [(i % 90, word(rng.randint(0, 60))) for i in range(100)] + [(500, None), (None, "abc abc"), (501, ""), (502, "a" * 50_000)]
    targets = list({word(rng.randint(1, 7)) for _ in range(14_000)})[:10_000] + ["", "a" * 49_999]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("context", F.lit("x"))
    frame = spark.createDataFrame([(t,) for t in [*targets, targets[0], None]], "context string")
    want = sorted(((d, t) for d, text in texts if text is not None for t in targets if t in text), key=repr)
    for letters in (contain.LETTERS, 20_000):  # one automaton, and several
        got = [(r.doc_id, r.context) for r in contain.docs_containing_any(docs, frame, letters).collect()]
        assert sorted(got, key=repr) == want
    assert contain.docs_containing_any(docs, frame.where("false")).count() == 0


def made(n=6000, seed=1):
    rng = random.Random(seed)
    return [(i, i % 4, [int(rng.paretovariate(0.7)) % 300 for _ in range(4)]) for i in range(n)]


def test_sketches_of_shards_and_milestones_are_near_the_exact_counts(spark):
    rows = made()
    w = spark.createDataFrame(rows, "idx long, shard int, tokens array<int>")
    exact = {k: len({tuple(t[:k]) for _, _, t in rows}) for k in (1, 2, 3)}
    parts = sketches.context_sketches(w, 3, "shard")
    assert parts.count() == 12
    for r in sketches.sketched_contexts(sketches.merge_sketches(parts)).collect():
        assert r.windows == len(rows) and abs(r.contexts - exact[r.level]) <= max(1, 0.025 * exact[r.level])
    whole = {r.level: r.contexts for r in sketches.sketched_contexts(sketches.context_sketches(w, 3)).collect()}
    united = {r.level: r.contexts for r in sketches.sketched_contexts(sketches.merge_sketches(parts)).collect()}
    assert all(abs(whole[k] - united[k]) <= max(1, 0.01 * exact[k]) for k in exact)
    want = {(r.milestone, r.level): r for r in growth.growth_curve(w, 3, 6, len(rows)).collect()}
    got = sketches.sketched_growth(w, 3, 6, len(rows)).collect()
    assert len(got) == len(want) == 15
    for r in got:
        x = want[r.milestone, r.level]
        assert r.total_ctx == x.total_ctx and abs(r.contexts - x.unique_ctx) <= max(1, 0.03 * x.unique_ctx)
    approx = {r.level: r.approx_contexts for r in counts.approx_unique_contexts(w, 3).collect()}
    assert all(abs(approx[k] - exact[k]) <= max(1, 0.06 * exact[k]) for k in exact)


def test_samples_of_documents(spark):
    docs = spark.createDataFrame([(i, f"s{i % 5}") for i in range(20_000)], "doc_id long, source string")
    a = windows.sample_docs(docs, 20, 1, "source")
    picked = {r.doc_id for r in a.collect()}
    assert picked == {r.doc_id for r in windows.sample_docs(docs.repartition(7), 20, 1, "source").collect()}
    by = {r.source: r["count"] for r in a.groupBy("source").count().collect()}
    assert len(by) == 5 and all(abs(n - 800) <= 4 * (4000 * 0.2 * 0.8) ** 0.5 for n in by.values())  # four standard deviations
    other = {r.doc_id for r in windows.sample_docs(docs, 20, 2, "source").collect()}
    assert abs(len(picked & other) - 800) <= 150 and picked <= {r.doc_id for r in windows.sample_docs(docs, 50, 1, "source").collect()}
    assert windows.sample_docs(docs, 0).count() == 0 and windows.sample_docs(docs, 100).count() == 20_000


def test_greedy_bins_of_the_documents_pairs(spark):
    d = "/root/testdata/sf0.001"
    pairs = counts.start_pair_counts(Q.doc_windows(spark, d))
    load, want = [0] * 16, {}
    for r in sorted(pairs.collect(), key=lambda r: (-r.cnt, r.t0, r.t1)):
        b = min(range(16), key=lambda i: (load[i], i))
        load[b] += r.cnt
        want[r.t0, r.t1] = b
    assert {(r.t0, r.t1): r.bin for r in shards.greedy_bins(pairs, 16).collect()} == want


def test_bpe_of_the_documents(spark):
    from nextdist.operators import bpe

    docs = Q.documents(spark, "/root/testdata/sf0.001").limit(60)
    vocab, merges = bpe.train_bpe(docs, 120)
    split = {}
    for r in docs.collect():
        for w in (r.text or "").split():
            split.setdefault(w, [0, list(w)])[0] += 1
    want = []
    while len(want) < len(merges):
        pair = {}
        for n, s in split.values():
            for p in zip(s, s[1:], strict=False):
                pair[p] = pair.get(p, 0) + n
        want.append(min(pair, key=lambda p: (-pair[p], p)))
        for x in split.values():
            x[1] = bpe.apply_merge(x[1], want[-1])
    assert merges == want and len(merges) > 20
    pieces = {r.token: r.piece for r in vocab.collect()}
    for r in bpe.encode_bpe(docs, vocab, merges, -1).join(docs, "doc_id").collect():
        assert [pieces[t] for t in r.tokens] == [p for w in r.text.split() for p in split[w][1]]


@pytest.mark.parametrize("letters,least", [(1 << 30, 1), (1000, 20)])
def test_sequences_are_spread_by_their_text(spark, letters, least):
    from nextdist.operators import tokens as K

    docs = Q.documents(spark, "/root/testdata/sf0.001")
    seqs = K.encode_sequences(docs, K.word_vocab(docs, 50), 50, 50)
    x = K.spread(docs, seqs, letters)
    assert x.rdd.getNumPartitions() >= max(least, spark.sparkContext.defaultParallelism)
    assert sorted((r.doc_id, r.tokens) for r in x.collect()) == sorted((r.doc_id, r.tokens) for r in seqs.collect())
