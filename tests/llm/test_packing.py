import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from nextdist.llm import packing as P
from nextdist.llm import tokens


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 2047, 2049, 4095, 4096, 4097, 100_001])
def test_cuts_add_up(n):
    cut = P.cut_lengths(n)
    assert sum(cut) == n and all(0 < c <= 4096 for c in cut)


def test_pieces_hold_each_id_once_with_little_padding(spark):
    texts = [None, "", " ", "Hello, World!", "naïve <|endoftext|> Σίσυφος \x1c x"] + [f"the quick fox {i} jumps. " * (i % 400) for i in range(300)] + ["long word soup " * 20_000]
    rows = [(i, t, "zzz") for i, t in enumerate(texts)] + [(3, "Hello, World!", "zzz"), (None, "no id", None)]
    got = P.harmonic_packing(spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)).collect()
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    want = sorted([[*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in rows], key=repr)
    seqs = defaultdict(list)
    left = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        left[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            p = next(x for x in left[d] if x[0] == at and x[3] == len(ids) and zlib.crc32(np.array(ids[at : at + x[1]], "<u4").tobytes()) == x[2])
            left[d].remove(p)
            at += p[1]
        assert at == len(ids)
    assert not any(left.values()) and want
    total = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096
        total += at
    assert len(seqs) * 4096 - total < 0.05 * total


def test_encoder_is_the_tokenizer():
    enc = tokens.encoder(tokens.tokenizer_path())
    for t in ["It's DON'T we'll '' 's", "a_b 1٣² ﬁ ʰª İstanbul ΟΔΟΣ ΣΑ", "é é", "x<|startoftext|>y", "a\x1cb\x85c d　e", "😀👍🏽 漢字かな"]:
        assert enc.encode([t])[0] == enc._whole(t)


def test_empty_table(spark):
    assert P.harmonic_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []
