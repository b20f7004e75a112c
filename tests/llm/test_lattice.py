import itertools

import numpy as np

from nextdist.llm import lattice as E


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    got = E.nearest_e8(x)
    whole = np.isclose(got, np.rint(got)).all(1)
    half = np.isclose(got + 0.5, np.rint(got + 0.5)).all(1)
    assert (whole | half).all() and (np.rint(got.sum(1)) % 2 == 0).all()
    shifts = E.minimal_vectors()
    assert len(shifts) == 240 and np.allclose((shifts**2).sum(1), 2)
    # no neighbour is closer: the minimal vectors are all that can be
    d = ((x - got) ** 2).sum(1)
    assert all((((x - got - v) ** 2).sum(1) >= d - 1e-9).all() for v in shifts)


def brute(rows, cosine=0.98):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [set() for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is None or la != lb or not fine(a) or not fine(b) or len(a) != len(b):
            continue
        a, b = np.array(a, float), np.array(b, float)
        if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] == comp))
    return sorted(map(repr, out))


def planted(seed=0, n=150, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((v, int(i % 3)))
        for _ in range(i % 4):
            noise = rng.normal(size=dim)
            rows.append((v + noise * np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.0, 0.25), int(i % 3)))
    rows += [rows[0], rows[0], rows[5], (np.zeros(dim), 1), (rows[1][0], 2), (rng.normal(size=8), 1), (rows[3][0] * 3, rows[3][1])]
    return [(i, [float(np.float32(x)) for x in v], k) for i, (v, k) in enumerate(rows)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = E.embedding_links(df.repartition(3), **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(repr(tuple(r)) for r in got.collect())


def test_links_match_brute_force(spark):
    rows = planted()
    rows += [(9000, None, 1), (9001, [1.0, None] + [0.0] * 62, 1), (9002, [float("nan")] * 64, 1), (9003, [float("inf")] * 64, 1), (9004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (7, rows[9][1], 0), (9005, [], 1)]
    assert run(spark, rows) == brute(rows)


def test_crowded_cells_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=64) * 0.02], 1) for i in range(90)]
    rows += [(i + 90, r[1], 1) for i, r in enumerate(rows[:5])]
    assert run(spark, rows, block=8) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    ca, cb = E.cells(a), E.cells(b)
    met = ((cb == ca[:, :, :1]).any(2) | (ca == cb[:, :, :1]).any(2)).any(1)
    assert met.mean() > 0.995


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_large_and_small_vectors_link_by_direction(spark):
    rows = [(1, [1e200, 1e198], 1, "n"), (2, [1e200, 1.01e198], 1, "n"), (3, [1e-200, 1e-202], 1, "n"), (4, [1e-200, 1.01e-202], 1, "n"), (5, [-1e300, 1e300], 1, "n"), (6, [5e-324, 0.0], 1, "n")]
    got = E.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {**{i: (4, 1) for i in (1, 2, 3, 4, 6)}, 5: (0, 5)}
