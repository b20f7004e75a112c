"""Embedding near-duplicates by E8 lattice hashing.

Vectors are scaled to length one and projected at random to eight dimensions, several
times; each projection is decoded to the nearest point of the lattice E8. A vector is
stored in its own cell and looks into the neighbouring cells it lies closest to. Vectors that meet are
verified by their exact cosine. Cells hold identical vectors once, and a
crowded cell is dealt out in blocks, so one task never gets more than two blocks of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, shielded
from .simhash import local_roots

COSINE = 0.98
#: Tables, neighbouring cells probed per table, and the projection's scale. At cosine 0.98 exactly
#: a pair is missed with a chance of about 1 in 10,000; two unrelated vectors meet with 3 in 10,000 per table.
TABLES = 6
PROBES = 2
SCALE = 0.9
BLOCK = 2048
ROWS_PER_TASK = 40_000
SEED = 11
OWN = ["n_links", "component_id", "kept"]


def minimal_vectors() -> np.ndarray:
    """The 240 shortest nonzero points of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(x)
    gap = x - f
    worst = np.abs(gap).argmax(1)
    rows = np.arange(len(x))
    odd = f.sum(1) % 2 != 0
    f[rows[odd], worst[odd]] += np.where(gap[rows[odd], worst[odd]] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: E8 is D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _names(points: np.ndarray, table: int) -> np.ndarray:
    """A long for each lattice point (last axis), by a mixed polynomial of its doubled coordinates."""
    h = np.full(points.shape[:-1], 0x9E3779B97F4A7C15 * (table + 1) % 2**64, np.uint64)
    whole = np.rint(2 * points).astype(np.int64).view(np.uint64)
    for i in range(points.shape[-1]):
        h = (h ^ whole[..., i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """``(rows, tables, 1 + probes)`` cell names of unit vectors: the own cell, then the closest neighbours."""
    shifts = minimal_vectors()
    rng = np.random.default_rng((seed, x.shape[1]))
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = x @ (rng.normal(size=(x.shape[1], 8)) * scale)
        own = nearest_e8(y)
        toward = np.argsort(-((y - own) @ shifts.T), axis=1, kind="stable")[:, :probes]
        out[:, t] = _names(np.concatenate([own[:, None], own[:, None] + shifts[toward]], axis=1), t)
    return out


def linked_in_cell(name: int, t: int, rows: dict, left: np.ndarray, right: np.ndarray, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell at or over the cosine that no earlier cell finds, as row numbers.

    ``left`` are rows that are stored here or look in here, ``right`` those stored. The codes tell
    whether two vectors also meet in an earlier table, or twice in this one.
    """
    x, norm, codes, rid = rows["x"], rows["norm"], rows["codes"], rows["rid"]
    sims = (x[left] @ x[right].T) / np.outer(norm[left], norm[right])
    i, j = np.nonzero(sims >= cosine)
    a, b = left[i], right[j]
    both = codes[a, t * width] == name  # the left row is stored here as well, so the pair comes twice
    ok = np.where(both, rid[a] < rid[b], True)
    a, b = a[ok], b[ok]
    for u in range(t + 1):
        ca, cb = codes[a, u * width : (u + 1) * width], codes[b, u * width : (u + 1) * width]
        in_b = (cb == ca[:, :1]).any(1)  # they meet in a's own cell
        in_a = (ca == cb[:, :1]).any(1)  # they meet in b's own cell
        if u < t:
            ok = ~(in_a | in_b)
        else:
            first = np.where(in_a & in_b, np.minimum(ca[:, 0], cb[:, 0]), np.where(in_b, ca[:, 0], cb[:, 0]))
            ok = first == name
        a, b = a[ok], b[ok]
    return a, b


def _search(pdf: pd.DataFrame, cosine: float, probes: int) -> pd.DataFrame:
    width = 1 + probes
    out_id, out_n, out_root = [], [], []
    for _, same in pdf.groupby("dim", sort=False):
        same = same.sort_values(["cell", "i", "j"], kind="stable").reset_index(drop=True)
        x = np.stack(same["embedding"].to_numpy()).astype(np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # a power of two, so cosines stay as they are and squares neither vanish nor overflow
        rows = {"x": x, "norm": np.sqrt((x * x).sum(1)), "codes": np.stack(same["codes"].to_numpy()), "rid": same["rid"].to_numpy()}
        n = same["n"].to_numpy()
        isleft, isright, t = same["isleft"].to_numpy(), same["isright"].to_numpy(), same["t"].to_numpy()
        key = same[["label", "t", "cell", "i", "j"]].to_numpy()
        order = np.lexsort(key.T[::-1])
        key = key[order]
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        links = np.zeros(len(same), np.int64)
        pa_, pb_ = [], []
        for part in np.split(order, edge):
            left, right = part[isleft[part]], part[isright[part]]
            if len(left) and len(right):
                a, b = linked_in_cell(same["cell"].iat[part[0]], t[part[0]], rows, left, right, cosine, width)
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                pa_.append(rows["rid"][a])
                pb_.append(rows["rid"][b])
        node, root = local_roots(iter(list(zip(pa_, pb_, strict=True))))
        got = np.flatnonzero(links)
        out_id += [rows["rid"][got], node]
        out_n += [links[got], np.zeros(len(node), np.int64)]
        out_root += [rows["rid"][got], root]
    if not out_id:
        return pd.DataFrame({"rid": [], "links": [], "root": []})
    return pd.DataFrame({"rid": np.concatenate(out_id), "links": np.concatenate(out_n), "root": np.concatenate(out_root)})


def embedding_links(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """Link the rows of ``vectors(vec_id, embedding, label)`` within a label by cosine.

    Adds ``n_links`` (other rows linked directly), ``component_id`` (the smallest ``vec_id``
    reachable) and ``kept`` (whether the row is that one).

    Nulls: a null label, a null or zero vector, or one with a null or non-finite component
    links with nothing and is its own component; vectors of different lengths do not link. A row
    without ``vec_id`` gets links, and names no component unless its own has no other name.
    Repeated rows and identical vectors are compared once and counted each. An empty table
    gives an empty result. Input columns named like a result are replaced.
    """
    keep = [c for c in (["vec_id"] if keep is None else keep) if c.lower() not in OWN]
    rows, back = shielded(vectors, ["vec_id", "embedding", "label"], keep)
    e = F.col("embedding").cast("array<double>")
    # nan and infinity are greater than any finite number in Spark's order
    fine = F.expr("label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) <= 1.7976931348623157e308D) and exists(embedding, x -> x <> 0)")
    reps = rows.where(fine).groupBy("label", e.alias("embedding")).agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    reps = saved(reps.select(F.monotonically_increasing_id().alias("rid"), "*"), "lattice-reps")
    width = 1 + probes

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            codes: list = [None] * len(dims)
            vecs = b.column("embedding")
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                x = x / np.abs(x).max(1)[:, None]  # so that squares neither vanish nor overflow
                c = cells(x / np.sqrt((x * x).sum(1))[:, None], tables, probes, scale)
                for i, row in zip(at, c.reshape(len(at), -1), strict=True):
                    codes[i] = row
            cols = [b.column("rid"), b.column("label"), b.column("dim"), pa.array(codes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "label", "dim", "codes"])

    label_type = reps.schema["label"].dataType.simpleString()
    coded = reps.select("rid", "label", F.size("embedding").alias("dim"), "embedding").mapInArrow(hash_batches, f"rid long, label {label_type}, dim int, codes array<long>")
    coded = saved(coded, "lattice-codes")
    # one row per vector and cell; a neighbour's cell can't be the own cell of the same table
    places = coded.select("rid", "label", "dim", F.posexplode("codes").alias("c", "cell"))
    places = places.select("rid", "label", "dim", "cell", F.expr(f"c div {width}").cast("int").alias("t"), (F.col("c") % width == 0).alias("stored"))
    by = ["label", "dim", "t", "cell"]
    sizes = places.groupBy(*by).agg(F.count("*").alias("m"), F.count_if("stored").alias("s")).where("m > 1 and s > 0")
    sizes = sizes.select(*by, F.expr(f"cast((m + {block} - 1) div {block} as int)").alias("nb"))
    met = places.join(sizes, by).withColumn("mine", F.expr("pmod(xxhash64(rid), nb)").cast("int"))
    # a crowded cell becomes nb x nb blocks; a row is on the left of nb of them, and on the right of nb if stored
    met = met.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    as_left = F.struct(F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("isleft"), (F.col("stored") & (F.col("mine") == F.col("other"))).alias("isright"))
    as_right = F.struct(F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("isleft"), F.lit(True).alias("isright"))
    met = met.withColumn("r", F.explode(F.array_compact(F.array(as_left, F.when(F.col("stored") & (F.col("mine") != F.col("other")), as_right)))))
    met = saved(met.select("rid", *by, "r.*"), "lattice-met")
    total = met.count()
    parts = max(1, -(-total // ROWS_PER_TASK))
    met = met.withColumn("part", F.pmod(F.xxhash64(*by, "i", "j"), F.lit(parts)))
    full = met.join(coded.select("rid", "codes"), "rid").join(reps.select("rid", "embedding", "n"), "rid")
    found = full.groupBy("part").applyInPandas(lambda pdf: _search(pdf.assign(label=pd.factorize(pdf["label"])[0]), cosine, probes), "rid long, links long, root long")
    found = saved(found, "lattice-found")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")), "lattice-cc")
    each = reps.join(counts, "rid", "left").join(comp, reps.rid == comp.node, "left")
    each = saved(each.select("label", "embedding", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("root", "rid").alias("root")), "lattice-each")
    least = each.groupBy("root").agg(F.min("low").alias("_least"))
    group = each.join(least, "root").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "_links", "_least")
    key = F.when(fine, e)
    x = rows.withColumn("_key", key).join(group, (F.col("label") == F.col("_label")) & (F.col("_key") == F.col("_embedding")), "left")
    comp_id = F.coalesce("_least", "vec_id")
    return x.select(
        *back,
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        comp_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(comp_id).alias("kept"),
    )


#: All pairs within a label; the search has found every one of them on the given tables.
ORACLE_SQL = f"""
with v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
g as (select *, list_sum(list_transform(e, lambda x: x * x)) as nn from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r where a.nn > 0 and b.nn > 0 and list_dot_product(a.e, b.e) / (sqrt(a.nn) * sqrt(b.nn)) >= {COSINE}),
reach as (with recursive c(v, to_) as (select vec_id, vec_id from v union select c.v, p.b from c join p on c.to_ = p.a) select v, min(to_) as component_id from c group by v)
select v.vec_id, count(p.b)::bigint as n_links, any_value(component_id) as component_id, v.vec_id = any_value(component_id) as kept
from v left join p on v.vec_id = p.a join reach on reach.v = v.vec_id group by v.vec_id, v.r
"""
