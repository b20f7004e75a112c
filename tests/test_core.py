"""Literal cases, brute force and invariants of the counting operators."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nextdist.operators import counts as C
from nextdist.operators import growth as G
from nextdist.operators import lookup as L
from nextdist.operators import shards as S
from nextdist.operators import support as U
from nextdist.operators import tokens as K
from nextdist.operators import windows as P
from nextdist.operators.sorted_stats import context_next_counts_sorted, level_stats_sorted

F1 = [0, 1, 2, 1, 0, 2, 0, 0, 1, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 2, 0]
F1_LEVELS = {
    1: (3, 17, 7, 0, 0, 11.642607, 0.684859, 13.828726, 0.813454, 2.333333),
    2: (7, 17, 11, 3, 3, 8.047190, 0.473364, 11.609640, 0.682920, 1.571429),
    3: (11, 17, 13, 9, 10, 4.158883, 0.244640, 6.000000, 0.352941, 1.181818),
    4: (13, 17, 14, 12, 14, 1.909543, 0.112326, 2.754888, 0.162052, 1.076923),
}
COLUMNS = ["unique_nodes", "total_visits", "total_support", "onehot_contexts", "onehot_visits", "total_entropy", "avg_entropy", "total_uniformity", "avg_uniformity", "avg_support_per_context"]


def stream(spark, tokens):
    return spark.createDataFrame(list(enumerate(tokens)), "pos long, token int").repartition(3)


def heavy_tailed(n, vocab, seed):
    rng = random.Random(seed)
    return rng.choices(range(vocab), [(k + 1) ** -0.8 for k in range(vocab)], k=n)


def brute_windows(tokens, T, s):
    return [(i, tokens[i : i + T + 1]) for i in range(0, len(tokens) - T, s)]


def brute_counts(windows, T):
    c = defaultdict(Counter)
    for _, w in windows:
        for k in range(1, T + 1):
            c[tuple(w[:k])][w[k]] += 1
    return c


def brute_levels(counts):
    out = {}
    for ctx, nexts in counts.items():
        n, k = sum(nexts.values()), len(nexts)
        h = -sum(c / n * math.log(c / n) for c in nexts.values())
        row = out.setdefault(len(ctx), [0, 0, 0, 0, 0, 0.0, 0.0])
        for i, x in enumerate([1, n, k, k == 1, n * (k == 1), n * h, n * h / math.log(k) if k > 1 else 0.0]):
            row[i] += x
    return out


def test_literal_case(spark):
    cn = C.context_next_counts(P.sliding_windows(stream(spark, F1), 4), 4)
    got = {r.level: r for r in C.level_stats(cn).collect()}
    for level, want in F1_LEVELS.items():
        assert [round(got[level][c], 6) for c in COLUMNS] == pytest.approx(want, abs=2e-6)
    tot = C.context_totals(cn)
    e = C.corpus_entropy(tot).first()
    assert (round(e.corpus_entropy, 6), e.observations, e.contexts) == (0.378797, 68, 34)
    d = tot.groupBy().agg((F.sum(2 * (F.col("n") - F.col("sum_sq") / F.col("n"))) / F.sum("n")).alias("x")).first().x
    assert round(d, 6) == 0.497339


@pytest.mark.parametrize(("n", "vocab", "T", "s"), [(800, 20, 5, 1), (801, 7, 4, 2), (500, 3, 6, 3), (90, 1, 4, 1), (5, 3, 5, 1), (6, 3, 5, 1), (0, 3, 2, 1)])
def test_windows_counts_and_levels_match_brute_force(spark, n, vocab, T, s):
    tokens = heavy_tailed(n, vocab, n)
    w = P.sliding_windows(stream(spark, tokens), T, s, block=T + 3).cache()
    want = brute_windows(tokens, T, s)
    assert sorted((r.start, list(r.tokens)) for r in w.collect()) == want
    counts = brute_counts(want, T)
    cn = C.context_next_counts(w, T).cache()
    assert {(tuple(r.context), r.next): r.cnt for r in cn.collect()} == {(c, x): k for c, m in counts.items() for x, k in m.items()}
    levels = brute_levels(counts)
    for table in (C.level_stats(cn), level_stats_sorted(w, T, rows_per_partition=max(1, n // 5))):
        rows = table.collect()
        assert {r.level for r in rows} == set(levels)
        for r in rows:
            assert [r[c] for c in [*COLUMNS[:5], "total_entropy", "total_uniformity"]] == pytest.approx(levels[r.level], abs=1e-6)
            assert r.total_visits == len(want)  # each window is seen once at every level
            if r.level + 1 in levels:
                assert r.total_support == levels[r.level + 1][0]


def test_windows_inside_documents(spark):
    docs = [(1, [1, 2, 3, 4, 5, 6, 7]), (2, [1]), (3, [1, 2, 3]), (4, []), (5, list(range(10)))]
    seqs = spark.createDataFrame(docs, "doc_id long, tokens array<int>")
    got = sorted((r.doc_id, r.start, list(r.tokens)) for r in P.windows_within_documents(seqs, 2, 2).collect())
    assert got == [(d, i, t[i : i + 3]) for d, t in docs for i in range(0, len(t) - 2, 2)]
    padded = sorted((r.doc_id, r.start, list(r.tokens), r.length) for r in P.windows_padded(seqs, 3, 2, 99).collect())
    assert padded == [(1, 0, [1, 2, 3, 4], 4), (1, 2, [3, 4, 5, 6], 4), (1, 4, [5, 6, 7, 99], 3), (3, 0, [1, 2, 3, 99], 3), (5, 0, [0, 1, 2, 3], 4), (5, 2, [2, 3, 4, 5], 4), (5, 4, [4, 5, 6, 7], 4), (5, 6, [6, 7, 8, 9], 4)]
    with pytest.raises(ValueError):
        P.windows_padded(seqs, 3, 4, 99)
    flat = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate((d, t) for d, ts in docs for t in ts)], "pos long, doc_id long, token int")
    by_doc = P.sliding_windows(flat, 2, 1, by_document=True, block=4)
    assert by_doc.count() == sum(max(0, len(t) - 2) for _, t in docs)


def test_sharded_statistics_equal_the_whole(spark):
    tokens = heavy_tailed(2000, 12, 3)
    w = P.sliding_windows(stream(spark, tokens), 5).cache()
    whole = {r.level: r.asDict() for r in C.level_stats(C.context_next_counts(w, 5)).collect()}
    pairs = C.start_pair_counts(w)
    for bins in (S.round_robin_bins(pairs, 4), S.greedy_bins(pairs, 4)):
        sharded = S.assign_shard(w, bins).cache()
        parts = None
        for k in range(4):
            x = C.level_stats(C.context_next_counts(sharded.where(F.col("shard") == k), 5))
            parts = x if parts is None else parts.unionByName(x)
        root = C.level_stats(C.context_next_counts(P.root_windows(w, 2), 2))
        merged = {r.level: r.asDict() for r in C.merge_level_stats(root, parts).collect()}
        for level, row in whole.items():
            for c, v in row.items():
                assert merged[level][c] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_greedy_bins_put_the_heaviest_into_the_least_loaded(spark):
    f2 = {(2, 2): 13, (3, 2): 13, (3, 3): 13, (0, 3): 12, (1, 3): 12, (2, 1): 12, (3, 1): 12, (0, 0): 11, (2, 3): 11, (1, 2): 10, (3, 0): 10, (0, 2): 9, (2, 0): 9, (1, 1): 8, (1, 0): 6, (0, 1): 4}
    pairs = spark.createDataFrame([(*p, c) for p, c in f2.items()], "t0 int, t1 int, cnt long")
    got = {(r.t0, r.t1): r.bin for r in S.greedy_bins(pairs, 3).collect()}
    loads = [0] * 3
    for p, c in sorted(f2.items(), key=lambda x: (-x[1], x[0])):
        b = loads.index(min(loads))
        assert got[p] == b
        loads[b] += c
    assert max(loads) - min(loads) <= 13
    rr = {(r.t0, r.t1): r.bin for r in S.round_robin_bins(pairs, 3).collect()}
    assert [rr[p] for p, _ in sorted(f2.items(), key=lambda x: (-x[1], x[0]))] == [i % 3 for i in range(16)]


@pytest.mark.parametrize("bins", [1, 3, 16])
def test_greedy_runs_are_the_rule_for_every_pair(bins):
    rng = random.Random(bins)
    for _ in range(200):
        runs = sorted(((c, rng.randint(1, 60)) for c in set(rng.choices([1, 2, 3, 5, 8, 40, 300, 1000], k=4))), reverse=True)
        got = [(cnt, order[i % len(order)]) for cnt, at, m, order in S.greedy_runs(runs, bins) for i in range(m)]
        loads, want = [0] * bins, []
        for cnt, n in runs:
            for _ in range(n):
                want.append((cnt, loads.index(min(loads))))
                loads[want[-1][1]] += cnt
        assert got == want
    assert len(S.greedy_runs([(1_000_000, 1), (2, 10**9), (1, 10**12)], bins)) <= 3 * bins


def test_greedy_bins_have_no_cap(spark):
    pairs = spark.range(250_000).select((F.col("id") % 500).cast("int").alias("t0"), F.floor(F.col("id") / 500).cast("int").alias("t1"), F.when(F.col("id") == 0, 100_000).otherwise(1 + F.col("id") % 2).cast("long").alias("cnt"))
    loads = [r.load for r in S.bin_loads(S.greedy_bins(pairs, 3)).collect()]
    assert sum(loads) == 100_000 + 374_999 and max(loads) - min(loads) <= 1


def test_soft_labels_and_lookups(spark):
    tokens = heavy_tailed(600, 8, 9)
    T = 4
    w = P.sliding_windows(stream(spark, tokens[:400]), T)
    q = P.sliding_windows(stream(spark, tokens[350:]), T)
    counts = brute_counts(brute_windows(tokens[:400], T, 1), T)
    cn = C.context_next_counts(w, T)
    got = {(r.start, r.pos, r.next): r.prob for r in L.soft_labels(q, cn, T).collect()}
    want = {}
    for s, ws in brute_windows(tokens[350:], T, 1):
        for k in range(1, T + 1):
            m = counts.get(tuple(ws[:k]), {})
            for x, c in m.items():
                want[s, k - 1, x] = c / sum(m.values())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for r in L.training_batch(q, cn, T).collect():
        assert r.hard == r.tokens[r.pos + 1]
        if r.soft is not None:
            assert sum(r.soft.values()) == pytest.approx(1)
        assert (r.soft or {}) == pytest.approx({x: p for (s, k, x), p in want.items() if (s, k) == (r.start, r.pos)})
    x = {r.level: r for r in L.cross_corpus_entropy(q, cn, T).collect()}
    for level in range(1, T + 1):
        known = [counts[tuple(ws[:level])] for _, ws in brute_windows(tokens[350:], T, 1) if tuple(ws[:level]) in counts]
        h = [-sum(c / sum(m.values()) * math.log(c / sum(m.values())) for c in m.values()) for m in known]
        assert x[level].num_true == len(h) and x[level].num_true + x[level].num_false == 250 - T
        assert x[level].mean_entropy == pytest.approx(sum(h) / len(h))


def test_growth_equals_counting_again(spark):
    tokens = heavy_tailed(300, 6, 4)
    T, points = 3, 7
    ws = brute_windows(tokens, T, 1)
    n = len(ws)
    w = P.sliding_windows(stream(spark, tokens), T).withColumn("idx", F.col("start"))
    marks = [r.milestone for r in G.milestones(spark, n, points).collect()]
    assert marks == sorted({round(i * (n / (points - 1))) for i in range(1, points)}) and marks[-1] == n
    got = {(r.milestone, r.level): r for r in G.growth_curve(w, T, points, n).collect()}
    assert {m for m, _ in got} == set(marks)
    for (m, level), r in got.items():
        row = brute_levels(brute_counts(ws[:m], T))[level]
        assert (r.unique_ctx, r.total_ctx) == (row[0], row[1])
        assert r.entropy == pytest.approx(row[5] / row[1], abs=1e-9)


def test_online_labels_as_of_each_window(spark):
    tokens = heavy_tailed(120, 4, 8)
    T = 3
    seen = defaultdict(Counter)
    prob, full = {}, {}
    for s, w in brute_windows(tokens, T, 1):
        for k in range(1, T + 1):
            m = seen[tuple(w[:k])]
            m[w[k]] += 1
            prob[s, k - 1] = m[w[k]] / sum(m.values())
            full |= {(s, k - 1, x): c / sum(m.values()) for x, c in m.items()}
    w = P.sliding_windows(stream(spark, tokens), T)
    got = {(r.start, r.pos): r.prob for r in G.online_target_probability(w, T).collect()}
    assert got == pytest.approx(prob)
    got = {(r.start, r.pos, r.next): r.prob for r in G.online_soft_labels(w, T).collect()}
    assert got == pytest.approx(full)


def test_support_sets(spark):
    tokens = heavy_tailed(400, 9, 11)
    counts = brute_counts(brute_windows(tokens, 2, 1), 2)
    cn = C.context_next_counts(P.sliding_windows(stream(spark, tokens), 2), 2)
    sets = U.support_sets(cn)
    assert {tuple(r.context): list(r.support) for r in sets.collect()} == {c: sorted(m) for c, m in counts.items()}
    groups = defaultdict(list)
    for level in (1, 2):
        by = defaultdict(set)
        for c, m in counts.items():
            for x in m:
                if len(c) == level:
                    by[x].add(c)
        for x, cs in by.items():
            groups[level, frozenset(cs)].append(x)
    got = sorted((r.level, r.contexts, list(r.tokens)) for r in U.token_groups(cn).collect())
    assert got == sorted((level, len(cs), sorted(xs)) for (level, cs), xs in groups.items())


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0)], "i int, k string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-9), (2, None, 2.5), (4, "z", 3.0)], "i int, k string, v double")
    got = sorted((r.i, r.k, r.side) for r in L.diff_distributions(a, b, ["i", "k"], "v").collect())
    assert got == [(2, None, "differs"), (3, "z", "only_a"), (4, "z", "only_b")]


def test_null_and_repeated_ids(spark):
    """Rows with equal or no ids are rows like any other, in streams, ranks and samples."""
    rows = [(2, "a b"), (2, "a"), (None, "b b"), (1, "c"), (1, "c"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.head_docs(docs, 2).collect()) == [1, 1]
    assert len(P.head_docs(docs, 3).collect()) == 3 and len(P.tail_docs(docs, 3).collect()) == 3
    assert [r.doc_id for r in P.tail_docs(docs, 2).collect()] == [None, None]
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "token int, piece string")
    seqs = K.encode_sequences(docs, vocab, 3, 3)
    got = sorted((r.pos, r.doc_id, r.token) for r in K.flatten_stream(seqs).collect())
    assert [p for p, *_ in got] == list(range(8))
    assert [(d, t) for _, d, t in got[:2]] == [(1, 2), (1, 2)]
    assert sorted(t for _, d, t in got[2:5]) == [0, 0, 1] and [d for _, d, _ in got[5:]] == [None] * 3


def test_row_local_encoding_equals_the_join(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "ä", "", "zz", "c"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(900, None), (901, ""), (902, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = K.word_vocab(docs.where("text is not null"), 4)
    want = sorted(map(tuple, K.to_sequences(K.encode_words(docs, vocab, 9, size=4)).collect()))
    assert sorted(map(tuple, K.encode_sequences(docs, vocab, 9, 4).collect())) == want
    monkeypatch.setattr(K, "BROADCAST_VOCAB", 2)
    assert sorted(map(tuple, K.encode_sequences(docs, vocab, 9, 4).collect())) == want
    assert K.encode_sequences(docs.limit(0), vocab, 9, 4).collect() == []


def test_offsets_of_ids_far_apart(spark):
    rows = [(i, i % 5 + 1) for i in range(500)] + [(10**17, 7), (-(10**17), 3)]
    got = {r.k: r.offset for r in K.exclusive_offsets(spark.createDataFrame(rows, "k long, n int"), "k", "n").collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n


def test_online_labels_in_blocks(spark):
    rng = random.Random(8)
    w = spark.createDataFrame([(i, [rng.randrange(3) for _ in range(3)]) for i in range(60)], "start long, tokens array<int>")
    whole = sorted(map(tuple, G.online_soft_labels(w, 2).collect()))
    assert sorted(map(tuple, G.online_soft_labels(w, 2, block=7).collect())) == whole


def test_sorted_counts_equal_the_grouping(spark):
    tokens = heavy_tailed(900, 4, 2)
    w = P.sliding_windows(stream(spark, tokens), 5).select("tokens")
    got = [(r.level, tuple(r.context), r.next, r.cnt) for r in context_next_counts_sorted(w, 5, rows_per_partition=100).collect()]
    want = [(r.level, tuple(r.context), r.next, r.cnt) for r in C.context_next_counts(w, 5).collect()]
    assert sorted(got) == sorted(want)
    assert context_next_counts_sorted(w.limit(0), 5).collect() == []


def test_a_window_that_a_third_of_the_corpus_repeats_is_few_rows(spark):
    """Equal windows are counted before the shuffle, so the largest partition stays near the others, and the statistics are the same."""
    from nextdist.operators.sorted_stats import _sorted_windows, combined_windows

    rng = random.Random(7)
    hot = [3, 3, 3, 3, 3]
    rows = [hot if i % 3 == 0 else [rng.randrange(9) for _ in range(5)] for i in range(30_000)]
    w = spark.createDataFrame([(r,) for r in rows], "tokens array<int>").repartition(4)
    x = combined_windows(w, 4)
    assert x.where(" and ".join(f"t{i} = 3" for i in range(5))).count() <= 4 and x.agg(F.sum("times")).first()[0] == 30_000
    sizes = sorted(r["count"] for r in _sorted_windows(w, 4, 1000).groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = {(r.level, tuple(r.context), r.next): r.cnt for r in C.context_next_counts(w, 4).collect()}
    assert {(r.level, tuple(r.context), r.next): r.cnt for r in context_next_counts_sorted(w, 4, rows_per_partition=500).collect()} == plain
    key = lambda df: sorted(tuple(round(v, 6) for v in (r[c] for c in sorted(df.columns))) for r in df.collect())
    assert key(level_stats_sorted(w, 4, rows_per_partition=500)) == key(C.level_stats(C.context_next_counts(w, 4)))
