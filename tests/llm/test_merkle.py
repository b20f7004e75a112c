import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from nextdist.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def first(v):
    return (v is not None, v)


def tree(nodes, fanout):
    """Root of a list of hashes, and each one's ``(left, right)`` on the way."""
    ways = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for lo in range(0, len(nodes), fanout):
            run = nodes[lo : lo + fanout]
            for j in range(len(run)):
                for i in below[lo + j]:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            under.append([i for b in below[lo : lo + fanout] for i in b])
        nodes, below = up, under
    return nodes[0], ways


def brute(rows, fanout=8):
    leaf = [H(*map(field, r)) for r in rows]
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[2], []).append(i)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    sub, ways = {}, {}
    for lang in langs:
        at = sorted(by[lang], key=lambda i: (first(rows[i][0]), leaf[i]))
        sub[lang], w = tree([leaf[i] for i in at], fanout)
        ways.update(zip(at, w, strict=True))
    root, above = tree([sub[x] for x in langs], fanout) if langs else (None, [])
    out = []
    for i, (doc_id, source, lang, n, text) in enumerate(rows):
        way = ways[i] + above[langs.index(lang)]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        now = text if text is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        h = H(*map(field, (doc_id, source, lang, n, now)))
        for left, right in way:
            h = H(left, h, right)
        out.append((doc_id, leaf[i], sub[lang], root, H(*[x for s in way for x in s]), h, h == root))
    return sorted(out, key=repr)


def odd_rows():
    rows = [(i * 7 % 331, f"s{i % 3}", ["en", "en", "en", "de", "fr"][i % 5], i, f"Text {i} Äß\nX" if i % 4 else "no capitals") for i in range(331)]
    rows += [rows[5], rows[5], (5, None, "en", None, None), (None, "s", "en", 3, "ABC"), (None, "s", None, 3, ""), (1, "s", None, 3, "Z" * 70_000), (-4, "s", "", 1, "A"), (9, "s", "Ä", 1, "ÄB"), (10, "s", "zz", 1, "x:1-")]
    return rows


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    assert df.columns == COLS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = odd_rows()
    assert found(M.tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_borders_of_runs(spark, n):
    rows = [(i, "s", "en", i, f"A{i}") for i in range(n)]
    assert found(M.tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_many_languages_have_a_tree_of_their_own(spark):
    rows = [(i, "s", f"l{i % 75:02d}", i, f"A{i}") for i in range(230)]
    assert found(M.tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_any_fanout_proofs_lead_to_the_root_and_clashing_columns_are_no_harm(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("leaf", "subroot", "root", "proof", "left", "right", "hash", "run", "_metadata"):
        df = df.withColumn(name, F.lit(7))
    x = M.merkle_manifest(df, keep=["doc_id", "left", "hash"], fanout=3)
    assert x.columns == ["doc_id", "left", "hash", "leaf", "subroot", "root", "proof"]
    got = x.withColumn("again", M.folded("leaf", "proof")).collect()
    want = brute(rows, 3)
    assert sorted((r.doc_id is None, r.doc_id, r.leaf, r.subroot, r.root) for r in got) == sorted((w[0] is None, w[0], *w[1:4]) for w in want)
    assert len(got) == len(rows) and all(r.again == r.root and r.left == 7 for r in got)


def test_a_change_of_any_field_is_seen(spark):
    rows = [(i, "s", "en", i, f"A{i}") for i in range(20)]
    root = brute(rows)[0][3]
    for j, v in enumerate([99, "t", "de", 5, "a7"]):
        changed = list(rows[7])
        changed[j] = v
        df = spark.createDataFrame([*rows[:7], tuple(changed), *rows[8:]], SCHEMA)
        assert M.merkle_manifest(df).first().root != root
