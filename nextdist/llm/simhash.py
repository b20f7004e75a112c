"""SimHash near-duplicates with a vantage-point tree over Hamming space.

Fingerprints (distinct ones only) are dealt to the leaves of a vantage-point
tree fitted on a bounded sample. Each fingerprint is stored in one leaf; near a
node's radius it is also sent, as a query, to the other side, as far as the
triangle inequality allows a partner there. Each leaf is searched on its own
with the same pruning, so all pairs within the limit are found exactly, and
sends back one link per fingerprint that has a partner, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, without

SEED = 42
MAX_BITS = 2
#: Stored fingerprints a leaf should have; the leaves' number follows the input.
LEAF_SIZE = 16_384
#: Sampled fingerprints per leaf for fitting, and the most in all.
SAMPLE_PER_LEAF = 64
MAX_SAMPLE = 1_000_000
BRUTE = 512
_STEP = 1 << 16
#: Pairs that a task holds at most before it reduces them to links.
MAX_PAIRS = 2_000_000


def simhash(text: str | None, words_in_shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    buf = b" ".join(words)
    k = words_in_shingle
    if n <= k:
        return digest(buf, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - k + 1].tolist()
    stop = end[k - 1 :].tolist()
    total, m = np.zeros(64, np.int64), n - k + 1
    for i in range(0, m, _STEP):
        h = np.array([digest(buf[a:b], SEED) for a, b in zip(start[i : i + _STEP], stop[i : i + _STEP], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x.as_py()) for x in b.column("_nextdist_body")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], [*keep, "fp"])

    return docs.select(F.col("text").alias("_nextdist_body"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(x ^ v).astype(np.int64)
    return d.sum(1) if d.ndim == 2 else d


def best_ball(x: np.ndarray, rng: np.random.Generator, max_bits: int) -> tuple[float, np.ndarray, int] | None:
    """The cost, vantage point and radius of a ball with few points near its border; None if nothing divides ``x``.

    Fingerprints are words, or rows of several words.
    """
    best = None
    bits = 64 if x.ndim == 1 else 64 * x.shape[1]
    for v in rng.choice(x, min(6, len(x)), replace=False):
        count = np.bincount(_distance(x, v), minlength=bits + 2)
        upto = np.cumsum(count)
        for r in range(bits):
            inner = upto[r] / len(x)
            if 0.3 <= inner <= 0.7 or (best is None and 0 < inner < 1):
                near = count[max(0, r - max_bits + 1) : r + max_bits + 1].sum() / len(x)
                cost = near + abs(inner - 0.5) + (0 if 0.3 <= inner <= 0.7 else 1)
                if best is None or cost < best[0]:
                    best = (cost, v, r)
    return best


def _split(x: np.ndarray, rng: np.random.Generator, max_bits: int) -> tuple[np.uint64, int] | None:
    best = best_ball(x, rng, max_bits)
    return None if best is None else (np.uint64(best[1]), int(best[2]))


def fit_tree(sample: np.ndarray, leaves: int, max_bits: int = MAX_BITS, seed: int = 7) -> list[tuple]:
    """Nodes ``(vantage, radius, inner child, outer child)``; a leaf is ``(None, number)``."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    least = max(2, len(sample) // max(1, leaves))
    found = 0
    todo = [(sample, None, 0)]
    while todo:
        x, parent, side = todo.pop()
        at = len(nodes)
        cut = _split(x, rng, max_bits) if len(x) >= 1.5 * least and leaves > 1 else None
        if cut is None:
            nodes.append((None, found))
            found += 1
        else:
            nodes.append((cut[0], cut[1], -1, -1))
            inside = _distance(x, cut[0]) <= cut[1]
            todo += [(x[inside], at, 2), (x[~inside], at, 3)]
        if parent is not None:
            node = list(nodes[parent])
            node[side] = at
            nodes[parent] = tuple(node)
    return nodes


def route(tree: list[tuple], x: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(leaf, index into x, stored)``: one stored place per point, and its query copies.

    A pair that a node divides lies within ``max_bits`` of its radius. Its inner
    point goes to the outer side as a query; a query goes to both sides where needed.
    """
    out: list[tuple[int, np.ndarray, bool]] = []
    todo = [(0, np.arange(len(x)), True)]
    while todo:
        at, idx, stored = todo.pop()
        if not len(idx):
            continue
        node = tree[at]
        if node[0] is None:
            out.append((node[1], idx, stored))
            continue
        v, r, inner, outer = node
        d = _distance(x[idx], v)
        if stored:
            todo += [(inner, idx[d <= r], True), (outer, idx[d > r], True), (outer, idx[(d <= r) & (d > r - max_bits)], False)]
        else:
            todo += [(inner, idx[d <= r + max_bits], False), (outer, idx[d > r - max_bits], False)]
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
    return (
        np.concatenate([np.full(len(i), leaf, np.int32) for leaf, i, _ in out]),
        np.concatenate([i for _, i, _ in out]),
        np.concatenate([np.full(len(i), s) for _, i, s in out]),
    )


def close_pairs(stored: np.ndarray, queries: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a stored point with another stored point or a query, as arrays of values.

    The same pruning as between leaves goes on until few points are left.
    """
    rng = np.random.default_rng(3)
    todo = [(stored, queries, True)]  # the last: pairs among the stored ones are still to be found
    while todo:
        s, q, own = todo.pop()
        if not len(s) or (not len(q) and not own):
            continue
        cut = _split(s if len(s) < 4096 else rng.choice(s, 4096, replace=False), rng, max_bits) if len(s) > BRUTE else None
        if cut is None:
            other = np.concatenate([s, q]) if own else q
            for i in range(0, len(other), 2048):
                a, b = np.nonzero(np.bitwise_count(other[i : i + 2048, None] ^ s[None, :]) <= max_bits)
                x, y = other[i + a], s[b]
                yield x[x != y], y[x != y]
            continue
        v, r = cut
        d, e = _distance(s, v), _distance(q, v)
        near = s[(d <= r) & (d > r - max_bits)] if own else s[:0]
        todo += [(s[d <= r], q[e <= r + max_bits], own), (s[d > r], np.concatenate([q[e > r - max_bits], near]), own)]


def local_roots(pairs: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int = MAX_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Each value of the pairs, and the smallest value that it reaches by them.

    Whenever ``at_once`` pairs have come together they are replaced by one link per value, so a group of
    near copies takes memory by its members, not by its pairs.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for a, b in pairs:
        if len(a):
            found.append((a.view(np.int64), b.view(np.int64)))
            held += len(a)
            if held >= at_once:
                found = [_reach(found)]
                held = 0
    return _reach(found)


def _reach(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return values, values[root]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of the distinct column ``fp`` within ``max_bits``."""
    n = distinct.count()
    leaves = max(1, -(-n // leaf_size))
    want = min(MAX_SAMPLE, leaves * SAMPLE_PER_LEAF, n)
    sample = np.empty(0, np.uint64)
    if leaves > 1:
        # a bounded sample, by the fingerprint's own hash, so that each run fits the same tree
        share = min(1.0, 1.2 * want / n)
        rows = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("fp").limit(2 * want).collect()
        sample = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    tree = fit_tree(sample, leaves, max_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            leaf, idx, stored = route(tree, x.view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x[idx]), pa.array(stored)], ["leaf", "fp", "stored"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        own = pdf["stored"].to_numpy(bool)
        a, b = local_roots(close_pairs(x[own], x[~own], max_bits))
        far = a != b
        return pd.DataFrame({"a": a[far], "b": b[far]})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf int, fp long, stored boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a long, b long")


def simhash_components(docs: DataFrame, keep: list[str] | None = None, max_bits: int = MAX_BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Fingerprint every row of ``docs(doc_id, text, ...)`` and give it its near-duplicate group.

    Adds ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest
    ``doc_id`` reachable over links of at most ``max_bits`` differing bits).

    Nulls: a null text is an empty one and has fingerprint zero; a null ``doc_id``
    gets a group but never names one unless its group has no other. Repeated rows
    and exact copies share a fingerprint, which is searched once however many rows
    have it. An empty table gives an empty result. Input columns named like a result are replaced.
    """
    own = ["fingerprint", "component_id", "fp"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in own]
    if "doc_id" not in keep:
        keep = ["doc_id", *keep]
    fps, each = _groups(without(docs, own), keep, max_bits, leaf_size)
    least = each.groupBy("root").agg(F.min("low").alias("component_id"))
    group = each.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(group, "fp").select(*[F.col(f"`{c}`") for c in keep], hexed, "component_id")


def _groups(docs: DataFrame, keep: list[str], max_bits: int, leaf_size: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``(fp, low, root)``: each fingerprint's smallest ``doc_id`` and its group."""
    fps = saved(fingerprints(docs, keep), "simhash-fp")
    each = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    comp = components(links(each.select("fp"), max_bits, leaf_size), "simhash-cc")
    each = each.join(comp, each.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return fps, each
