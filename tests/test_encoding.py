"""Vocabularies and encodings that look at a text once."""
from collections import Counter

import pytest

from nextdist.operators import tokens as K

TEXTS = ["a b  a", "", None, " b", "é a\nb a ", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")


def test_vocabulary_counts_batches(spark, docs, monkeypatch):
    want = Counter(p for t in TEXTS if t is not None for p in t.split(" "))
    rows = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for at_once in (K.WORDS_AT_ONCE, 2):
        monkeypatch.setattr(K, "WORDS_AT_ONCE", at_once)
        assert [(r.token, r.piece, r.freq) for r in K.word_vocab(docs, 4).orderBy("token").collect()] == [(i, *r) for i, r in enumerate(rows[:4])]
    assert K.word_vocab(docs.where("text is null"), 4).count() == 0
    assert "Generate" not in K.piece_counts(docs)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [3, None])
@pytest.mark.parametrize("bos,eos", [(None, None), (7, None), (None, 8), (7, 8)])
def test_a_text_is_split_once(spark, docs, size, bos, eos):
    vocab = spark.createDataFrame([(0, "x"), (1, "a"), (2, "")], "token int, piece string")
    ids, want = {"x": 0, "a": 1, "": 2}, []
    for i, t in enumerate(TEXTS):
        row = [] if t is None else [*[bos] * (bos is not None), *[ids.get(p, 9) for p in t.split(" ")], *[eos] * (eos is not None)]
        want += [(i, k, x) for k, x in enumerate(row)]
    got = K.encode_words(docs, vocab, 9, bos, eos, size=size)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1  # it was split again for every piece
    assert sorted(map(tuple, got.collect())) == want
    assert dict(got.dtypes) == {"doc_id": "int", "pos": "bigint", "token": "int"}


def test_sequences_are_placed_and_written_without_a_row_for_each_token(spark, tmp_path):
    from nextdist.sources import readers as R
    from nextdist.sources import writers as W

    seqs = spark.createDataFrame([(i, [(7 * i + k) % 500 for k in range(i % 9 * 5)]) for i in [*range(40), 3, 3]] + [(None, [1, 2]), (50, None)], "doc_id int, tokens array<int>")
    placed = K.placed_sequences(seqs)
    assert placed.count() == 44  # a row for each sequence
    flat = [(r.pos, r.token) for r in K.flatten_stream(seqs).orderBy("pos").collect()]
    want = [t for r in sorted(seqs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)) for t in r.tokens or []]
    assert flat == list(enumerate(want))
    for per_part in (7, 64, 1 << 20):
        path = str(tmp_path / f"t{per_part}")
        index = W.write_token_bin(placed, path, per_part)
        assert sorted((r.part, r.first_pos, r.n) for r in index.collect()) == [(k, k * per_part, min(per_part, len(want) - k * per_part)) for k in range(-(-len(want) // per_part))]
        for whole in (1 << 30, 40):
            assert sorted(map(tuple, R.read_token_bin(spark, path, index=index, whole=whole, span=22).collect())) == flat
    assert W.write_token_bin(placed.where("false"), str(tmp_path / "none")).count() == 0
