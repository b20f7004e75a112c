"""Texts that contain some of very many targets, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the targets that one automaton holds (some hundred bytes each); with more, texts are read once for each group of targets.
LETTERS = 2_000_000


def docs_containing_any(docs: DataFrame, targets: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``(doc_id, context)`` of documents whose text has a target of ``targets(context)`` as a substring, each pair once per row.

    A text is read once, however many targets there are, where it lies. Targets of ``letters`` letters at most are sent to every task; more are
    dealt into groups by their hash, each an automaton and a reading of its own. The empty target is in every text; null texts and targets match nothing.
    """
    t = targets.select("context").where("context is not null").distinct()
    size = t.agg(F.sum(F.length("context"))).first()[0] or 0
    groups = max(1, -(-size // letters))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where("text is not null")
    out = texts.join(F.broadcast(t.where("context = ''")), F.lit(True)).select("doc_id", "context")  # one row at most
    for g in range(groups):
        words = [r[0] for r in t.where((F.col("context") != "") & (F.pmod(F.xxhash64("context"), F.lit(groups)) == g)).collect()]
        if words:
            out = out.unionByName(_found(texts, words, kind))
    return out


def _found(texts: DataFrame, words: list[str], kind: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            automaton.add_word(w, i)
        automaton.make_automaton()
        names = pa.array(shared.value, pa.string())
        for b in batches:
            at, hit = [], []
            for row, text in enumerate(b.column(1)):
                found = {i for _, i in automaton.iter(text.as_py())}
                at += [row] * len(found)
                hit += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), names.take(pa.array(hit, pa.int64()))], ["doc_id", "context"])

    return texts.mapInArrow(run, f"doc_id {kind}, context string")
