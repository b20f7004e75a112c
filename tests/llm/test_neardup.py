import random

import numpy as np
import pytest

import corpus_pipeline
from nextdist.llm import neardup as N


def brute_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest doc_id of each group that links of Jaccard 0.8 or more connect."""
    sets, group = [brute_shingles(t) for _, t, *_ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) / (len(a | b) or 1) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group, strict=True) if g == k) for k in set(group))


def rows(hot=60):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    for n in (60, 90, 200, 400):
        for changed in (0, 1, 2, 3, 4, 6, 9, 14):  # around similarity 0.8
            base = make(n)
            other = list(base)
            for at in rng.sample(range(n), changed):
                other[at] = "changed"
            texts += [base, other]
    chain = make(120)
    texts += [chain[i : i + 110] for i in range(0, 11)]  # linked by neighbours
    near = make(150)
    texts += [[*near, f"tail{i}"] for i in range(hot)]
    half = make(80)
    texts += [[*half, *make(60)] for _ in range(20)]  # alike in part only
    out = [" ".join(t) for t in texts] + [None, "", " \n", "one", "One", "one two"]
    ids = rng.sample(range(1000), len(out))
    return [(i, t, "en", "s", 1) for i, t in zip(ids, out, strict=True)]


@pytest.mark.parametrize("block", [512, 7])
def test_stage_keeps_what_brute_force_keeps(spark, tmp_path, monkeypatch, block):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near_dedup_stage(spark, docs, "") if block == 512 else N.first_of_similar(docs, block_texts=block)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(data)


def test_candidates_at_exactly_the_similarity_share_a_key():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        h = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
        missed += not set(N.band_keys(h[:90])) & set(N.band_keys(h[10:]))  # 80 of 100
    assert missed <= 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert N.first_of_similar(spark.read.parquet(str(tmp_path / "d"))).collect() == []


@pytest.mark.parametrize("one_size", [False, True])
def test_tree_finds_all_close_fingerprints(spark, one_size):
    """Every pair that brute force finds is connected, over leaves by sizes and by balls, and nothing else is."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (150, N.FP_WORDS), dtype=np.uint64)
    flips = [np.packbits(rng.permutation(64 * N.FP_WORDS) < k).view("<u8") for k in (0, 40, 70, 76, 77, 90)]
    fp = np.concatenate([base ^ f for f in flips])
    size = np.full(len(fp), 60) if one_size else rng.integers(40, 120, len(fp))
    rows = [(7 * i, int(s), bytearray(f.astype("<u8").tobytes())) for i, (s, f) in enumerate(zip(size, fp, strict=True))]
    each = spark.createDataFrame([*rows, (999_999, 0, bytearray(8 * N.FP_WORDS))], "node long, size long, fp binary")
    close = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=np.int64) <= N.MAX_BITS
    close &= np.bitwise_count(fp[:, None, :2] ^ fp[None, :, :2]).sum(2, dtype=np.int64) <= N.FIRST_BITS
    close &= np.minimum.outer(size, size) >= 0.8 * np.maximum.outer(size, size) - 1e-9

    def groups(a, b):
        root = list(range(len(fp)))
        for x, y in zip(a, b, strict=True):
            old, new = root[x], root[y]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    got = N.candidates(each, leaf_size=60, queries=50).collect()
    tree = N.fit_tree(size, fp, 15)
    assert not one_size or all(x[0] is not None for x in tree)
    assert len({x[0] for x in tree if len(x) == 1}) > 5
    a, b = np.nonzero(np.triu(close, 1))
    assert len(a) > 100 and groups([r.a // 7 for r in got], [r.b // 7 for r in got]) == groups(a.tolist(), b.tolist())


def test_fingerprints_at_exactly_the_similarity_are_close():
    rng = np.random.default_rng(1)
    for n, shared in ((5, 4), (10, 8), (15, 12), (100, 80), (1000, 800)):
        for _ in range(300):
            h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            a, b = h[: shared + (n - shared) // 2], np.concatenate([h[:shared], h[shared + (n - shared) // 2 :]])
            x = np.frombuffer(N.fingerprint(a), "<u8") ^ np.frombuffer(N.fingerprint(b), "<u8")
            assert np.bitwise_count(x).sum() <= N.MAX_BITS and np.bitwise_count(x[: N.FP_WORDS // 2]).sum() <= N.FIRST_BITS


def test_stage_takes_its_candidates_from_the_tree(spark, tmp_path, monkeypatch):
    """The vantage-point tree over SimHash fingerprints finds the pairs; without its candidates only copies come together."""
    base = " ".join(f"w{i}" for i in range(100))
    data = [(1, base, "en", "s", 1), (2, base + " tail", "en", "s", 1), (3, base, "en", "s", 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()] == [1]
    found = N.candidates
    monkeypatch.setattr(N, "candidates", lambda *a, **k: found(*a, **k).where("false"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 2]


def test_group_of_near_copies_takes_memory_by_its_members():
    import tracemalloc

    rng = np.random.default_rng(5)
    fp = np.repeat(rng.integers(0, 1 << 63, (3, N.FP_WORDS), dtype=np.uint64), [2000, 300, 1], axis=0)
    fp ^= np.uint64(1) << rng.integers(0, 64, fp.shape, dtype=np.uint64)  # eight bits at most between copies
    order = rng.permutation(len(fp))
    fp, kind = fp[order], np.repeat([0, 1, 2], [2000, 300, 1])[order]
    size, stored = np.full(len(fp), 50), rng.random(len(fp)) < 0.8
    tracemalloc.start()
    root = N.close_roots(size, fp, stored, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert root.tolist() == [np.flatnonzero(kind == k)[0] for k in kind]
    assert peak < 40e6  # two million pairs held at once took some 200 MB and more
    some = np.concatenate(list(p[0] for p in N.close_pairs(size, fp, stored, True)))
    assert len(some) > 1_900_000
