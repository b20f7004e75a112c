import random
import re

import pytest

from nextdist.llm import linededup as D


def brute(rows, min_lines, min_words):
    """Deleted (row, line) by comparing every run with every earlier one."""
    lines = [[x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seen, gone = set(), set()
    for r in order:
        ls = lines[r]
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if j - i >= min_lines and sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone |= {(r, k) for k in range(i, j)}
                    seen.add(run)
    return [sorted(k for r2, k in gone if r2 == r) for r in range(len(rows))]


@pytest.mark.parametrize(("min_lines", "min_words"), [(1, 1), (1, 5), (2, 4), (3, 6), (1, 12)])
def test_deleted_lines_match_brute_force(spark, tmp_path, min_lines, min_words):
    rng = random.Random(min_lines * 100 + min_words)
    pool = ["a", "b c", "d e f", "", "g h i j k", " a ", "\tb c", "l", "m n o p q r s"]
    rows = [(i * 7 % 61, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (500, None), (501, ""), (502, "x y z w v\n" * 40), (503, "x y z w v\n" * 40)]
    path = str(tmp_path / "docs")
    df = spark.createDataFrame([(i, d, t, "n") for i, (d, t) in enumerate(rows)], "i long, doc_id long, text string, n_deleted string")
    df.coalesce(1).write.parquet(path)
    got = {r.i: r for r in D.line_dedup(spark.read.parquet(path), min_lines, min_words).collect()}
    assert len(got) == len(rows)
    for i, gone in enumerate(brute(rows, min_lines, min_words)):
        ls = (rows[i][1] or "").split("\n")
        want = rows[i][1] if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)
        assert (got[i].text, got[i].n_deleted, got[i].n_lines) == (want, len(gone), len(ls)), (i, gone)


def test_empty_table(spark):
    assert D.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_and_lcp_arrays_match_brute_force(spark):
    """Order, shared prefixes and depth, against sorted lists of lines."""
    rng = random.Random(5)
    docs = [[rng.choice("abcd" if rng.random() < 0.9 else "uvwxyz") for _ in range(rng.randint(1, 30))] for _ in range(25)]
    docs += [list("abcabcabcabd"), list("abcabcabcabd"), ["q"], list("aaaaaaaaaaaaaaaaa")]
    flat, at = [], 0
    for d in docs:
        for i, line in enumerate(d):
            flat.append((at, len(d) - i, line))
            at += 1
    often = sorted({x for x in "abcdquvwxyz" if sum(f[2] == x for f in flat) > 1})
    active = spark.createDataFrame([(p, left, often.index(x)) for p, left, x in flat if x in often], "pos long, left int, rank long")
    depth = 16
    ranks = D.suffix_ranks(active, depth)
    sa = sorted(D.suffix_array(ranks).collect(), key=lambda r: r.sa)
    assert [r.sa for r in sa] == list(range(active.count()))
    suffix = {p: [x if x in often else (x, i) for i, (_, _, x) in enumerate(flat[p : p + left])] for p, left, x in flat}

    def shared(a, b):
        n = 0
        while n < min(len(suffix[a]), len(suffix[b]), depth) and flat[a + n][2] == flat[b + n][2] and flat[a + n][2] in often:
            n += 1
        return n

    for before, r in zip(sa, sa[1:]):
        assert min(r.lcp, depth) == shared(before.pos, r.pos), (before, r)
    # suffixes that share a prefix of any length stand together
    for n in (1, 2, 3, 5, 8, 13):
        names = [tuple(x[2] for x in flat[r.pos : r.pos + n]) if len(suffix[r.pos]) >= n and all(x[2] in often for x in flat[r.pos : r.pos + n]) else r.pos for r in sa]
        runs = [x for i, x in enumerate(names) if i == 0 or names[i - 1] != x]
        assert len(runs) == len(set(runs))


def test_long_texts_and_runs_of_blank_lines(spark):
    long = "\n".join(f"line {i} of a long text with more than ten words in it a b c" for i in range(20_000))
    blank = "\n" * 3000 + "one two three four five six seven eight nine ten"
    rows = [(1, long), (2, "x\n" + long + "\ny"), (3, "first\n" + blank), (4, blank + "\nlast")]
    got = {r.doc_id: r for r in D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text, got[1].n_deleted) == (long, 0)
    assert (got[2].text, got[2].n_deleted) == ("x\ny", 20_000)
    assert (got[3].text, got[3].n_deleted) == (rows[2][1], 0)
    assert got[4].text.strip("\n") == "last" and got[4].n_deleted >= 3000


def test_a_change_of_splits_between_scans_changes_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    pool = [f"this is line {i} of those that many texts share with each other" for i in range(40)]
    rows = [(i, "\n".join([f"own {i}", *rng.sample(pool, 3)])) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    want = sorted(map(tuple, D.line_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()))
    calls = []

    def saved(df, *a, **k):
        calls.append(1)
        spark.conf.set("spark.sql.files.minPartitionNum", 4 if len(calls) % 2 else 40)
        return real(df, *a, **k)

    real = D.saved
    monkeypatch.setattr(D, "saved", saved)
    try:
        got = sorted(map(tuple, D.line_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want


def test_words_and_ends_of_lines_with_odd_blanks(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice(["a", "é", " ", "  ", "\t", "\r", "\x0b", "\x0c", " ", "　"]) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    got = {r.line: r for r in D.line_ids(spark.createDataFrame([(0, 0, "\n".join(lines))], "_row long, doc_id long, text string")).collect()}
    hashes = {}
    for i, x in enumerate(lines):
        x = x.strip(" \t\r\x0b\x0c")
        assert got[i].words == (len(re.split(r"[ \t\r\x0b\x0c]+", x)) if x else 0)
        assert hashes.setdefault(x, (got[i].h1, got[i].h2)) == (got[i].h1, got[i].h2)
    assert len(set(hashes.values())) == len(hashes)


def test_a_text_is_cut_into_lines_once(spark):
    x = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"{x}\na\nb"), (2, f"c\n{x}\nd\n"), (3, None)], "doc_id long, text string")
    got = D.line_dedup(docs)
    assert sorted(map(tuple, got.collect())) == [(1, f"{x}\na\nb", 3, 0), (2, "c\nd\n", 4, 1), (3, None, 1, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan and not re.search(r"lambdafunction\([^#]*split\(", plan)
    assert plan.count("split(") == 1
