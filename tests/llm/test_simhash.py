import random

import numpy as np
import pytest
import xxhash

from nextdist.llm import simhash as S


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=2):
    group = {i: {i} for i in range(len(rows))}
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= bits and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    out = []
    for i, (d, _) in enumerate(rows):
        out.append((d, min((rows[k][0] for k in group[i] if rows[k][0] is not None), default=None)))
    return out


def test_fingerprint_is_the_brute_force_one():
    rng = random.Random(1)
    words = ["Ab", "é", "c", "ÀZ", "d e"]
    for n in [0, 1, 2, 3, 4, 5, 40]:
        t = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        assert S.simhash(t) == brute_fp(t)
    assert S.simhash(None) == 0


@pytest.mark.parametrize("leaves", [1, 5, 40])
def test_routing_and_search_find_every_pair(leaves, monkeypatch):
    monkeypatch.setattr(S, "BRUTE", 8)
    rng = np.random.default_rng(leaves)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:150] for i, j in rng.integers(0, 64, (3, 2))]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 1, 3, 7, 2**64 - 1], np.uint64)]))
    tree = S.fit_tree(x[::2], leaves)
    leaf, idx, stored = S.route(tree, x)
    assert sorted(idx[stored].tolist()) == list(range(len(x)))
    found = set()
    for k in set(leaf.tolist()):
        here = leaf == k
        for a, b in S.close_pairs(x[idx[here & stored]], x[idx[here & ~stored]]):
            found |= {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 2}
    assert found == want


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:30] + [None, "", " \n", "one", "one two", "one", "x " * 5000]
    rows = [(i * 3 % 131, t, "en", "s", 1, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    got = S.simhash_components(docs, leaf_size=10).collect()
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    want = sorted((repr(d), f"{f:016x}", repr(c)) for (d, f), (_, c) in zip(fps, brute_components(fps), strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_reduced_in_parts_reach_the_same_roots():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 1 << 62, 40).astype(np.uint64) % 300, rng.integers(0, 1 << 62, 40).astype(np.uint64) % 300) for _ in range(6)]
    whole = dict(zip(*map(np.ndarray.tolist, S.local_roots(iter(pairs))), strict=True))
    parts = dict(zip(*map(np.ndarray.tolist, S.local_roots(iter(pairs), at_once=50)), strict=True))
    assert {k: v for k, v in parts.items()} == {k: v for k, v in whole.items() if k in parts} and {k for k, v in whole.items() if k != v} <= set(parts)
