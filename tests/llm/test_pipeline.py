"""The whole pipeline against plain Python, stage by stage on the same small table."""

import random
import zlib
from collections import defaultdict

import numpy as np
import test_linededup
import test_mixing
import test_neardup
import test_quality
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from nextdist.llm import linededup, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(700)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(14) for _ in range(6)]
    texts = []
    for i in range(230):
        lines = [line(rng.randint(15, 30)) for _ in range(rng.randint(3, 6))]
        if i % 6 == 0:
            lines.insert(rng.randint(0, len(lines)), shared[i % 5])
            lines.append(shared[(i + 1) % 5])
        if i % 9 == 0:
            lines.append(" ".join(["vile nasty"] * 3))
        texts.append("\n".join(lines))
    long = [line(130) for _ in range(8)]
    texts += [*long, *(" ".join([*t.split()[:60], f"changed{k}", *t.split()[61:]]) for t in long for k in range(2))]  # near copies
    texts += texts[20:26]  # exact ones
    texts += ["too short", "", None, "same words again " * 40, " ".join(w + "####" for w in texts[3].split()), texts[1] + "\n\n" + texts[1]]
    rows = [(i * 7 % 1009, t, "en" if i % 3 else "de", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[5], None, "s1", 9)]
    labels = [(r[0], 0 if i % 4 == 0 else 1, 1 if r[1] and "vile" in r[1] else 0) for i, r in enumerate(rows[:200]) if i % 2]
    return rows, labels


def brute_quality(rows):
    feats = [dict(zip(quality.FEATURES, test_quality.brute(r[1]), strict=True)) for r in rows]
    kept = test_quality.brute_verdicts([(r[2], r[3], f) for r, f in zip(rows, feats, strict=True)])
    return [r for r, k in zip(rows, kept, strict=True) if k]


def brute_lines(rows):
    out = []
    for r, gone in zip(rows, test_linededup.brute([(r[0], r[1]) for r in rows], linededup.MIN_LINES, linededup.MIN_WORDS), strict=True):
        lines = (r[1] or "").split("\n")
        text = r[1] if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            out.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    return out


def brute_near(rows):
    left = list(test_neardup.brute_kept([(i, r[1]) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]))
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [ordered[i] for i in left]


def brute_mixing(rows, labels):
    post = np.array(test_mixing.brute_posteriors([(r[0], r[1]) for r in rows], labels))
    rate = test_mixing.brute_rates(post[:, 0], post[:, 1:].round(9))
    out = []
    for r, x in zip(rows, rate, strict=True):
        h = xxhash.xxh64_intdigest(b"mix", 42)
        if r[0] is not None:
            h = xxhash.xxh64_intdigest(int(r[0]).to_bytes(8, "little", signed=True), h)
        draw = (h % (1 << 30)) / (1 << 30)  # two's complement keeps the low bits
        out += [r] * (int(x) + (draw < x - int(x)))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_each_stage_and_the_run_match_plain_python(spark, tmp_path):
    rows, labels = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (brute_quality, brute_lines, brute_near, lambda r: brute_mixing(r, labels)), strict=True):
        before = len(want)
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs, want = spark.read.parquet(str(tmp_path / name.replace(" ", "-"))), brute(want)
        assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        assert plain(docs.collect()) == plain(want), name
        assert len(want) != before or name == "line dedup", name
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = Tokenizer.from_file(tokens.tokenizer_path())
    whole = defaultdict(list)
    for r in want:
        whole[r[0]].append(np.array([*enc.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in run:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(whole)
    for d, docs_of in whole.items():
        cut = sorted(pieces[d])
        for ids in docs_of:  # equal ids can be in several rows; each has its own whole set of pieces
            at = 0
            while at < len(ids):
                hit = next(x for x in cut if x[0] == at and x[2] == zlib.crc32(ids[at : at + x[1]].tobytes()))
                cut.remove(hit)
                at += hit[1]
            assert at == len(ids)
        assert not cut
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_further_columns_with_clashing_names_go_along(spark, tmp_path):
    names = ["kept", "n_words", "copies", "rate", "node", "size", "first", "keys", "root", "n_lines", "_gone", "_lang", "_body", "_copy", "max_symbols", "_row", "fp", "same", "extra"]
    rows = [(i, " ".join(f"w{i % 5}x{k}" for k in range(80)), "en", "s", 5, *["x"] * len(names)) for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        docs = stage(spark, docs, str(tmp_path))
        assert name != "near-dedup" or sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 3, 4]
    got = docs.collect()
    assert all(r.extra == r.first == r.size == "x" for r in got) and {"doc_id", "text", "lang", "source", "n_chars"} <= set(docs.columns)
