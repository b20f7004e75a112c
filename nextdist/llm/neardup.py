"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Candidates are texts whose SimHash fingerprints, of 256 bits over the distinct shingles, differ in at most ``MAX_BITS`` bits and in at most
``FIRST_BITS`` of the first half. At similarity 0.8 a bit differs with a chance of 0.152 in long texts and of 0.1875 at most (four shingles beside
five), so a pair is missed with a chance of 2e-8 and of 2e-5 at most, and less above. They are found by a vantage-point tree whose points are the empty set,
from which a text's distance is its number of shingles, and fingerprints. As in :mod:`~nextdist.llm.simhash` each text is stored in one
leaf and goes as a query wherever a partner may lie. Pairs of
candidates are verified by the exact similarity of their whole shingle sets.
Texts with equal sets are compared once. A large group of candidates is dealt out in
blocks, so one task never gets more than two blocks of it, and sends back one link per text, not all pairs.

Fingerprints of unlike texts lie at about half the bits from each other, so at this radius only numbers of shingles prune: of the
pairs of texts of different length all within the similarity's ratio are compared, which grows with the square of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, with_rows
from .simhash import _distance, best_ball, local_roots
from .tokens import release

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
#: 64-bit words of a fingerprint, and the most bits in which candidates differ: in all, and in the first two words.
FP_WORDS, MAX_BITS, FIRST_BITS = 4, 76, 44
#: Texts stored in a leaf of a large tree; leaves that a small tree has; queries that a task gets on average.
LEAF_SIZE, MIN_LEAVES, LEAF_QUERIES = 65_536, 16, 1 << 17
#: Sampled texts per leaf for fitting, and the most in all.
SAMPLE_PER_LEAF, MAX_SAMPLE = 64, 200_000
#: Texts, and shingles in all, that a block of candidates has at most on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 20
#: Candidate pairs that a task holds at most before it reduces them to links, and that are compared by all bits at once.
MAX_PAIRS, _PAIRS = 1 << 17, 1 << 16
_STEP = 1024
_STARTS = np.arange(1, FP_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of a shorter text the whole, of no words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    buf, n = b" ".join(w), len(w)
    if n <= words:
        return np.array([digest(buf, SEED)] if n else [], dtype="<u8")
    size = np.fromiter(map(len, w), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start, stop = (end - size)[: n - words + 1].tolist(), end[words - 1 :].tolist()
    return np.unique(np.fromiter((digest(buf[a:b], SEED) for a, b in zip(start, stop, strict=True)), "<u8", n - words + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long per band of minima; none for no shingles. A measure to hold the tree's candidates against."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _STEP):
        np.minimum(low, np.multiply.outer(_FACTORS, hashes[i : i + _STEP]).min(1), out=low)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of distinct shingles: each one's hash is mixed into ``FP_WORDS`` words, and a bit is 1 if it is set in over half."""
    total = np.zeros(64 * FP_WORDS, np.int64)
    for i in range(0, len(hashes), 255):  # so that bytes hold the sums
        x = hashes[i : i + 255, None] + _STARTS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(x.astype("<u8").view("u1"), axis=1, bitorder="little"), axis=0, dtype="u1")
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """``(doc_id, _row, same, size, fp)``: ``same`` names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            same, size, fp = [], [], []
            for x in b.column("text"):
                h = shingles(x.as_py(), words)
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                fp.append(fingerprint(h))
            cols = [pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(fp, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], ["doc_id", "_row", "same", "size", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("text", "doc_id", "_row").mapInArrow(run, f"doc_id {kind}, _row long, same binary, size long, fp binary")


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), "<u8").reshape(-1, FP_WORDS)


def _best_size(size: np.ndarray, similarity: float) -> tuple[float, None, int] | None:
    """The cost and radius of the best ball around the empty set; None if all sizes are equal."""
    best = None
    for r in np.unique(np.quantile(size, [0.3, 0.4, 0.5, 0.6, 0.7], method="lower")).tolist():
        inner = np.mean(size <= r)
        if inner < 1:
            near = np.mean((size <= r) & (size >= similarity * (r + 1)))
            cost = near + abs(inner - 0.5) + (0 if 0.3 <= inner <= 0.7 else 1)
            if best is None or cost < best[0]:
                best = (cost, None, int(r))
    return best


def fit_tree(size: np.ndarray, fp: np.ndarray, leaves: int, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, seed: int = 7) -> list[tuple]:
    """Nodes ``(vantage, radius, inner child, outer child)``, with None for the empty set; a leaf is ``(number,)``."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    least = max(2, len(size) // max(1, leaves))
    found = 0
    todo = [(np.arange(len(size)), None, 0)]
    while todo:
        idx, parent, side = todo.pop()
        at = len(nodes)
        cuts = [_best_size(size[idx], similarity), best_ball(fp[idx], rng, max_bits)] if len(idx) >= 1.5 * least and leaves > 1 else []
        cut = min((c for c in cuts if c is not None), key=lambda c: c[0], default=None)
        if cut is None:
            nodes.append((found,))
            found += 1
        else:
            nodes.append((cut[1], int(cut[2]), -1, -1))
            inside = (size[idx] if cut[1] is None else _distance(fp[idx], cut[1])) <= cut[2]
            todo += [(idx[inside], at, 2), (idx[~inside], at, 3)]
        if parent is not None:
            node = list(nodes[parent])
            node[side] = at
            nodes[parent] = tuple(node)
    return nodes


def route(tree: list[tuple], size: np.ndarray, fp: np.ndarray, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(leaf, index, stored)``: one stored place per text, and its query copies, where the triangle inequality allows a partner."""
    out: list[tuple[int, np.ndarray, bool]] = []
    todo = [(0, np.arange(len(size)), True)]
    while todo:
        at, idx, stored = todo.pop()
        if not len(idx):
            continue
        node = tree[at]
        if len(node) == 1:
            out.append((node[0], idx, stored))
            continue
        v, r, inner, outer = node
        if v is None:
            d = size[idx]
            to_inner, to_outer = similarity * d <= r + 1e-6, d >= similarity * (r + 1) - 1e-6
        else:
            d = _distance(fp[idx], v)
            to_inner, to_outer = d <= r + max_bits, d > r - max_bits
        if stored:
            todo += [(inner, idx[d <= r], True), (outer, idx[d > r], True), (outer, idx[(d <= r) & to_outer], False)]
        else:
            todo += [(inner, idx[to_inner], False), (outer, idx[to_outer], False)]
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
    return (
        np.concatenate([np.full(len(i), leaf, np.int32) for leaf, i, _ in out]),
        np.concatenate([i for _, i, _ in out]),
        np.concatenate([np.full(len(i), s) for _, i, s in out]),
    )


def close_pairs(size: np.ndarray, fp: np.ndarray, stored: np.ndarray, own: bool, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs of a leaf's stored texts with its queries and, if ``own``, among themselves, as row numbers.

    Blocks of first words are compared as products of signs, and what is left of them by all bits. Pairs whose rows have the same ``root``
    by the time they come up are left out; the caller may change ``root`` meanwhile.
    """
    order = np.argsort(size, kind="stable")
    s, q = order[stored[order]], order[~stored[order]]
    bits = 64 * (FP_WORDS // 2)
    first_bits = FIRST_BITS if max_bits == MAX_BITS else max_bits

    def signs(rows: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(fp[rows, : FP_WORDS // 2]).view("u1")
        return np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1

    sizes, right = size[s], signs(s)
    for rows, among in ((q, False), (s, True)) if own else ((q, False),):
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            left = signs(part)
            low = np.searchsorted(sizes, similarity * size[part[0]] - 1e-6)
            high = i + len(part) if among else np.searchsorted(sizes, size[part[-1]] / similarity + 1e-6, "right")
            for j in range(low, high, _STEP):
                k = min(j + _STEP, high)
                near = np.flatnonzero(left @ right[j:k].T >= bits - 2 * first_bits)
                for at in range(0, len(near), _PAIRS):
                    a, b = np.divmod(near[at : at + _PAIRS], k - j)
                    x, y = part[a], s[j + b]
                    hit = x != y if root is None else root[x] != root[y]
                    x, y = x[hit], y[hit]
                    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                    hit = small >= similarity * large - 1e-6
                    x, y = x[hit], y[hit]
                    hit = np.bitwise_count(fp[x] ^ fp[y]).sum(1, dtype=np.int64) <= max_bits
                    yield x[hit], y[hit]


def close_roots(size: np.ndarray, fp: np.ndarray, stored: np.ndarray, own: bool, similarity: float = SIMILARITY, max_bits: int = MAX_BITS, at_once: int = MAX_PAIRS) -> np.ndarray:
    """Of each row the smallest that it reaches by :func:`close_pairs`.

    Whenever ``at_once`` pairs have come together they are reduced to roots, and rows with one root are not paired again; so a group of
    near copies takes memory by its members, not by its pairs.
    """
    root = np.arange(len(size))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def reduce() -> None:
        values, low = local_roots(iter(found))
        to = np.arange(len(root))
        to[values] = low
        root[:] = to[root]
        found.clear()

    held = 0
    for x, y in close_pairs(size, fp, stored, own, similarity, max_bits, root):
        found.append((root[x], root[y]))
        held += len(x)
        if held >= at_once:
            reduce()
            held = 0
    reduce()
    return root


def candidates(each: DataFrame, similarity: float = SIMILARITY, leaf_size: int = LEAF_SIZE, min_leaves: int = MIN_LEAVES, max_bits: int = MAX_BITS, queries: int = LEAF_QUERIES) -> DataFrame:
    """Links ``(a, b)`` that connect all candidate pairs of ``each(node, size, fp)``, a written frame with one row per set of shingles.

    The tree is fitted on a bounded sample. A leaf with many queries is dealt out in slices, each with the leaf's stored texts.
    """
    each = each.where("size > 0").select("node", "size", "fp")
    n = each.count()
    leaves = max(1, -(-n // leaf_size), min(min_leaves, n // (leaf_size // min_leaves + 1)))
    want = min(MAX_SAMPLE, leaves * SAMPLE_PER_LEAF, n)
    share = min(1.0, 1.2 * want / max(1, n))
    rows = []
    if leaves > 1:
        rows = each.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("node").limit(2 * want).collect()
    size, fp = np.array([r["size"] for r in rows], np.int64), _words([bytes(r["fp"]) for r in rows])
    tree = fit_tree(size, fp, leaves, similarity, max_bits)
    leaf, _, stored = route(tree, size, fp, similarity, max_bits)
    copies = np.bincount(leaf[~stored], minlength=len(tree)) * (n / max(1, len(rows)))
    slices = np.maximum(1, np.ceil(copies / queries)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "slice", "node", "size", "fp", "stored"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                node, size = b.column(0).to_numpy(), b.column(1).to_numpy()
                leaf, idx, stored = route(tree, size, _words(b.column(2).to_pylist()), similarity, max_bits)
                times = np.where(stored, slices[leaf], 1)
                at = np.repeat(np.arange(len(leaf)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                leaf, idx, stored = leaf[at], idx[at], stored[at]
                part = np.where(stored, nth, (node[idx] % 1_000_003) % slices[leaf])
                fp = b.column(2).take(pa.array(idx))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part, pa.int32()), pa.array(node[idx]), pa.array(size[idx]), fp, pa.array(stored)], names)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy(np.int64)
        root = node[close_roots(pdf["size"].to_numpy(np.int64), _words(pdf["fp"].tolist()), pdf["stored"].to_numpy(bool), int(key[1]) == 0, similarity, max_bits)]
        far = node != root
        return pd.DataFrame({"a": node[far], "b": root[far]})

    dealt = each.mapInArrow(deal, "leaf int, slice int, node long, size long, fp binary, stored boolean")
    return dealt.groupBy("leaf", "slice").applyInPandas(search, "a long, b long")


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all texts whose sets are similar; a text already reached is not compared again."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    left = np.ones(len(sets), bool)
    a, b = [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo and left.any():
            i = todo.pop()
            mine = np.zeros(len(values), bool)
            mine[flat[start[i] : start[i] + size[i]]] = True
            both = np.add.reduceat(mine[flat], start, dtype=np.int64)
            hit = np.flatnonzero(left & (both / (size + size[i] - both) >= similarity))
            left[hit] = False
            todo += hit.tolist()
            a.append(nodes[hit])
            b.append(np.full(len(hit), nodes[i]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(rows: DataFrame, each: DataFrame, groups: DataFrame, words: int, similarity: float, block_texts: int) -> DataFrame:
    """Links ``(a, b)`` between texts of one candidate group that are similar indeed."""
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = saved(members.join(each.select("node", "size"), "node"), "near-members")
    count = F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    members = members.join(members.groupBy("root").agg(count.alias("blocks")), "root")
    members = members.select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = rows.select("text", F.col("_row").alias("node")).join(members, "node")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "p", "q", "node", "hashes"]
        for batch in batches:
            for r in (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                n, k = r["blocks"], r["block"]
                low, high = [min(k, i) for i in range(n)], [max(k, i) for i in range(n)]
                h = shingles(r["text"], words).tobytes()
                cols = [pa.array([r["root"]] * n, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array([r["node"]] * n, pa.int64()), pa.array([h] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = similar_links(pdf["node"].to_numpy(np.int64), [np.frombuffer(x, "<u8") for x in pdf["hashes"]], similarity)
        return pd.DataFrame({"a": a, "b": b})

    dealt = texts.select("root", "blocks", "block", "node", "text").mapInArrow(deal, "root long, p int, q int, node long, hashes binary")
    return dealt.groupBy("root", "p", "q").applyInPandas(search, "a long, b long")


def first_of_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block_texts: int = BLOCK_TEXTS, row: str | None = None) -> DataFrame:
    """The row of ``docs`` with the smallest ``doc_id`` of each group (nulls last, then row order), with all columns.

    A group is what links of at least ``similarity`` (0.8 or more) connect. Rows keep their numbers however a scan is split: those of
    the column ``row`` (:func:`~nextdist.llm.common.file_rows`), or else rows are numbered once and written. Texts without words, and null ones, are copies of each other. Repeated rows are copies; an empty table
    gives an empty result. A column ``_row`` of the input is replaced and not returned.
    """
    rows, names = with_rows(docs, row, [], "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    sig = _signatures(rows, words).withColumn("first", order)
    each = sig.groupBy("same").agg(F.min(F.struct("first", "size", "fp")).alias("x"))  # copies come together first
    each = saved(each.select(F.col("x.first._row").alias("node"), "x.first", "x.size", "x.fp"), "near-each")
    links = _verified(rows, each, components(candidates(each, similarity), "near-candidates"), words, similarity, block_texts)
    found = components(links, "near-cc")
    kept = each.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*[F.col(f"`{c}`") for c in names])
