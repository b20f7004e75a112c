"""From documents to token streams: cleaning, vocabularies, encoding, positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import is_blank, strip
from ..sources.shared import running_sum, saved

#: A vocabulary up to this many rows is small enough to send to every task.
BROADCAST_VOCAB = 200_000
#: Letters of text whose tokens one task gets, where what follows makes many rows of each token.
LETTERS_PER_TASK = 1 << 22
#: Words that a task counts at once.
WORDS_AT_ONCE = 1 << 22


def normalize(docs: DataFrame) -> DataFrame:
    """Texts without white space at their ends."""
    return docs.withColumn("text", strip("text"))


def drop_blank(docs: DataFrame) -> DataFrame:
    """Without empty or white-space-only texts."""
    return docs.where(~is_blank("text"))


def pieces(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, piece)``: texts split at single blanks."""
    return docs.select(key, F.posexplode(F.split("text", " ", -1)).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def piece_counts(docs: DataFrame) -> DataFrame:
    """``(piece, n)``: pieces of texts split at single blanks, each once for some batches of a task, and how often it comes there; nothing is exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def rows() -> list[pa.RecordBatch]:
            t = pa.table([pa.chunked_array(got).cast(pa.large_string())], ["piece"]).group_by("piece").aggregate([([], "count_all")])
            return t.rename_columns(["piece", "n"]).select(["piece", "n"]).cast(pa.schema([("piece", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=65_536)

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                got.append(pc.split_pattern(b.column(0).slice(lo, 512).cast(pa.large_string()), " ").flatten())
                size += len(got[-1])
                if size >= WORDS_AT_ONCE:
                    yield from rows()
                    got, size = [], 0
        if size:
            yield from rows()

    return docs.select("text").where("text is not null").mapInArrow(run, "piece string, n long")


def word_vocab(docs: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent pieces as ``(token, piece, freq)``; equal counts by piece.

    ``orderBy.limit`` keeps each task's own best, so only ``size`` rows per task reach the last sort.
    """
    counts = piece_counts(docs).groupBy("piece").agg(F.sum("n").alias("freq"))
    best = counts.orderBy(F.desc("freq"), "piece").limit(size)
    return best.select((F.row_number().over(W.orderBy(F.desc("freq"), "piece")) - 1).cast("int").alias("token"), "piece", "freq")


def encode_words(docs: DataFrame, vocab: DataFrame, unk: int, bos: int | None = None, eos: int | None = None, size: int | None = None) -> DataFrame:
    """``(doc_id, pos, token)``; pieces outside the vocabulary become ``unk``, with optional begin and end ids.

    ``size``: the vocabulary's known row bound; up to ``BROADCAST_VOCAB`` it is sent to every task, and a document is encoded as a whole before its ids become rows.
    """
    if size is not None and size <= BROADCAST_VOCAB:
        seqs = encode_sequences(docs, vocab, unk, size)
        ends = [F.array(F.lit(t).cast("int")) if t is not None else None for t in (bos, eos)]
        parts = [x for x in (ends[0], F.col("tokens"), ends[1]) if x is not None]
        x = seqs.select("doc_id", F.posexplode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("pos", "token"))
        return x.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")
    # each piece beside the id that it has in any case, so that nothing of the text is looked at again for a piece
    row = lambda piece, token: F.struct(piece.cast("string").alias("piece"), F.lit(token).cast("int").alias("own"))
    mark = lambda token: [] if token is None else [F.array(row(F.lit(None), token))]
    marked = F.concat(*mark(bos), F.transform(F.split("text", " ", -1), lambda w: row(w, None)), *mark(eos))
    x = docs.select("doc_id", F.posexplode(marked).alias("pos", "p")).select("doc_id", "pos", "p.piece", "p.own")
    x = x.join(vocab.select("piece", "token"), "piece", "left")
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("own", "token", F.lit(unk)).cast("int").alias("token"))


def encode_sequences(docs: DataFrame, vocab: DataFrame, unk: int, size: int) -> DataFrame:
    """``(doc_id, tokens, length)``: the same as ``to_sequences(encode_words(...))`` for distinct ids, but row by row.

    A document stays where it is: its pieces are looked up on Arrow batches in the vocabulary, which every task gets, so nothing is
    shuffled. For a vocabulary (``size``, its known row bound) over ``BROADCAST_VOCAB`` the lookup is a join. Repeated ids stay rows of their own; null texts have none.
    """
    if size > BROADCAST_VOCAB:
        return to_sequences(encode_words(docs, vocab, unk, size=size))
    rows = vocab.select("piece", "token").collect()  # at most ``size`` rows
    shared = docs.sparkSession.sparkContext.broadcast(([r.piece for r in rows], [r.token for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids = pa.array(shared.value[0], pa.string()), pa.array([*shared.value[1], unk], pa.int32())
        last = pa.scalar(len(pieces), pa.int32())
        for b in batches:
            split = pc.split_pattern(b.column(1).cast(pa.large_string()), " ")
            at = pc.fill_null(pc.index_in(split.flatten().cast(pa.string()), value_set=pieces), last)
            lists = pa.ListArray.from_arrays(split.offsets.cast(pa.int32()), ids.take(at))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pc.list_value_length(lists)], ["doc_id", "tokens", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, tokens array<int>, length int")


def spread(docs: DataFrame, seqs: DataFrame, letters_per_task: int = LETTERS_PER_TASK) -> DataFrame:
    """The sequences ``(doc_id, tokens, length)`` of ``docs`` in as many partitions as their text has ``letters_per_task``, one per core at least.

    A file of texts is a few splits and its ids are much smaller still, but every token becomes a row or more in what follows.
    """
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-letters // letters_per_task))
    return seqs.repartition(parts, "doc_id", "length")


def decode_words(tokens: DataFrame, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """``(doc_id, text)``: pieces in order, joined by single blanks."""
    x = tokens.join(vocab.select("token", "piece"), "token", "left").withColumn("piece", F.coalesce("piece", F.lit(unk)))
    rows = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["piece"]), " ").alias("text"))


def to_sequences(tokens: DataFrame) -> DataFrame:
    """``(doc_id, tokens, length)`` from the long form."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("doc_id").agg(F.transform(rows, lambda r: r["token"]).alias("tokens")).withColumn("length", F.size("tokens"))


def append_separator(seqs: DataFrame, sep: int) -> DataFrame:
    """One separator id after each document."""
    return seqs.withColumn("tokens", F.concat("tokens", F.array(F.lit(sep).cast("int")))).withColumn("length", F.size("tokens"))


def truncate(seqs: DataFrame, max_len: int = 2048) -> DataFrame:
    """The first ``max_len`` tokens of each document."""
    return seqs.withColumn("tokens", F.slice("tokens", 1, max_len)).withColumn("length", F.size("tokens"))


def exclusive_offsets(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """``(key, offset)``: the sum of ``n`` over all smaller keys (nulls last), however the keys are spread."""
    return running_sum(sizes.select(key, n), [F.col(key).asc_nulls_last()], n, "offset", "offsets").select(key, "offset")


def placed_sequences(seqs: DataFrame) -> DataFrame:
    """``(doc_id, tokens, offset)``: sequences with the place of their first token in the stream of all documents, in ``doc_id`` order, nulls last.

    Whole sequences are range-partitioned, sorted and written; a row is a document, not a token. Repeated and null ids are rows like any other.
    """
    n = F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens")).cast("long")
    return running_sum(seqs.select("doc_id", "tokens", n.alias("_n")), [F.col("doc_id").asc_nulls_last()], "_n", "offset", "stream").select("doc_id", "tokens", "offset")


def flatten_stream(seqs: DataFrame) -> DataFrame:
    """``(pos, doc_id, token)``: all documents one after the other, in the order and at the places of :func:`placed_sequences`."""
    x = placed_sequences(seqs).select("offset", "doc_id", F.posexplode("tokens").alias("_i", "token"))
    return x.select((F.col("offset") + F.col("_i")).alias("pos"), "doc_id", "token")


def avg_sequence_length(tokens: DataFrame, bos: int) -> DataFrame:
    """Tokens per begin id."""
    return tokens.agg((F.count("*") / F.count_if(F.col("token") == bos)).alias("avg_length"))


def effective_vocab_size(tokens: DataFrame) -> DataFrame:
    """Largest id plus one."""
    return tokens.agg((F.max("token") + 1).alias("vocab_size"))


def corpus_summary(seqs: DataFrame, T: int, stride: int, batch: int = 512) -> DataFrame:
    """Stories, chunks, tokens, mean length, tokens seen with overlap, and steps per epoch."""
    n = F.size("tokens")
    chunks = F.when(n >= T + 1, F.floor((n - T - 1) / stride) + 1).otherwise(0).cast("long")
    x = seqs.select(n.alias("n"), chunks.alias("c")).agg(
        F.count("*").alias("stories"), F.sum("c").alias("chunks"), F.sum("n").alias("tokens"), F.avg("n").alias("avg_length")
    )
    return x.withColumn("effective_tokens", F.col("chunks") * (T + 1)).withColumn("steps_per_epoch", F.expr(f"chunks div {batch}"))
