"""Projections, filters, samples and windows of token streams.

A stream is ``(pos, token)`` with ``pos`` 0, 1, 2, ..., and ``doc_id`` where document borders
matter. A sequence is ``(doc_id, tokens)``. A window is ``(start, tokens)`` with T+1 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def take_percentage(stream: DataFrame, pct: float, total: int | None = None) -> DataFrame:
    """The first ``int(N * pct / 100)`` tokens."""
    n = stream.count() if total is None else total
    return stream.where(F.col("pos") < int(n * pct / 100))


def take_tokens(stream: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tokens; this overrides a percentage."""
    return stream.where(F.col("pos") < n)


def ranked_docs(docs: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0, by ``doc_id``, nulls last) and ``n_docs`` without one task sorting all rows; repeated ids have a rank each."""
    from ..sources.shared import numbered

    n = docs.agg(F.count("*").alias("n_docs"))
    return numbered(docs, [F.col("doc_id").asc_nulls_last()], "rank", "ranked").crossJoin(F.broadcast(n))  # one row


def head_docs(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by ``doc_id``."""
    return ranked_docs(docs).where(F.col("rank") < n).drop("rank", "n_docs")


def tail_docs(docs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` documents by ``doc_id``."""
    return ranked_docs(docs).where(F.col("rank") >= F.col("n_docs") - n).drop("rank", "n_docs")


def doc_range(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Documents ``lo`` to ``hi`` - 1 by rank, for growing a corpus step by step."""
    return ranked_docs(docs).where((F.col("rank") >= lo) & (F.col("rank") < hi)).drop("rank", "n_docs")


def sample_docs(docs: DataFrame, pct: float, seed: int = 0, group: str | None = None) -> DataFrame:
    """About ``pct`` percent of each group's documents (a file or source), the same ones for a seed.

    The draw is a hash of the id, so no group is sorted.
    """
    keys = [F.lit(seed), F.col(group) if group else F.lit(""), F.col("doc_id")]
    return docs.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(pct * 10_000))


def sample_files(docs: DataFrame, pct: float, group: str, seed: int = 0) -> DataFrame:
    """``pct`` percent of the files, one at least, and of each the same share of its documents, both rounded down.

    The order of the draw is the MD5 of seed and name or id, so a seed gives the same documents each time. Documents are ranked over
    all files at once in ranges, so a file of any size is no task of its own.
    """
    from ..sources.shared import numbered

    draw = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")))
    files = docs.groupBy(group).agg(F.count("*").alias("_n"))
    k = max(1, int(files.count() * pct / 100))
    files = files.orderBy(draw(group), group).limit(k).select(F.col(group).alias("_g"), F.expr(f"cast(floor(_n * {pct} / 100) as bigint)").alias("_take"))
    x = docs.join(files, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    x = numbered(x.withColumn("_h", draw("doc_id")), [F.col(group), F.col("_h"), F.col("doc_id")], "_r", "sampled")
    first = x.groupBy(F.col(group).alias("_g")).agg(F.min("_r").alias("_first"))
    x = x.join(first, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_r") - F.col("_first") < F.col("_take"))
    return x.select(*[F.col(f"`{c}`") for c in docs.columns])


def _starts(n: Column, T: int, stride: int) -> Column:
    """0, s, 2s, ... as long as T+1 tokens follow; none for shorter sequences."""
    return F.when(n >= T + 1, F.sequence(F.lit(0), n - (T + 1), F.lit(stride)))


def sliding_windows(stream: DataFrame, T: int, stride: int = 1, by_document: bool = False, block: int = BLOCK) -> DataFrame:
    """All windows of T+1 tokens whose start is a multiple of ``stride``.

    The stream is cut into blocks; each token goes to its block, and to the one before if it is
    among the first T of its own. A block then holds all windows that start in it, so the only shuffle is
    by block, however long the stream. ``by_document``: only windows inside one document.
    """
    block = max(block, T + 1)
    own = F.floor(F.col("pos") / block)
    to = F.when((F.col("pos") % block < T) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    fields = ["pos", "token", *(["doc_id"] if by_document else [])]
    x = stream.select(*fields, F.explode(to).alias("b"))
    x = x.groupBy("b").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("r"))
    # plain arrays before the windows are cut, so that a window is a slice of numbers
    x = x.select("b", F.col("r.token").alias("r"), *([F.col("r.doc_id").alias("d")] if by_document else []))
    base = F.col("b") * block
    n = F.size("r")
    first = F.when(base % stride == 0, 0).otherwise(stride - base % stride)
    last = F.least(n - (T + 1), F.lit(block - 1))
    x = x.withColumn("i", F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"), F.lit(stride)))))
    start, w = (base + F.col("i")).cast("long").alias("start"), F.slice("r", F.col("i") + 1, T + 1).alias("tokens")
    if by_document:
        x = x.where(F.get("d", F.col("i")).eqNullSafe(F.get("d", F.col("i") + T)))
        return x.select(start, F.get("d", F.col("i")).alias("doc_id"), w)
    return x.select(start, w)


def windows_within_documents(seqs: DataFrame, T: int, stride: int = 1) -> DataFrame:
    """Windows that do not cross a document; ``start`` counts in the document. Nothing is shuffled."""
    x = seqs.select("doc_id", "tokens", F.explode(_starts(F.size("tokens"), T, stride)).alias("p"))
    return x.select("doc_id", F.col("p").cast("long").alias("start"), F.slice("tokens", F.col("p") + 1, T + 1).alias("tokens"))


def windows_padded(seqs: DataFrame, T: int, stride: int, pad: int) -> DataFrame:
    """As :func:`windows_within_documents`, with a document's last incomplete window padded.

    Documents of two tokens or fewer are skipped; ``stride`` must be between 1 and T.
    """
    if not 0 < stride <= T:
        raise ValueError("stride must be between 1 and T")
    n = F.size("tokens")
    x = seqs.where(n > 2).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 2, F.lit(stride))).alias("p"))
    # after the first window that reaches the document's end there is nothing new
    x = x.where((F.col("p") == 0) | (F.col("p") - stride + T + 1 < n))
    part = F.slice("tokens", F.col("p") + 1, T + 1)
    filled = F.concat(part, F.array_repeat(F.lit(pad).cast("int"), T + 1 - F.size(part)))
    return x.select("doc_id", F.col("p").cast("long").alias("start"), filled.alias("tokens"), F.size(part).alias("length"))


def root_windows(windows: DataFrame, R: int) -> DataFrame:
    """The first R+1 tokens of each window."""
    return windows.withColumn("tokens", F.slice("tokens", 1, R + 1))


def input_target(windows: DataFrame, mode: str = "ar") -> DataFrame:
    """``ar``: x without the last token, y without the first; ``last``: y is the last token."""
    n = F.size("tokens")
    x = F.slice("tokens", 1, n - 1).alias("x")
    y = F.slice("tokens", 2, n - 1) if mode == "ar" else F.element_at("tokens", -1)
    return windows.select(*[c for c in windows.columns if c != "tokens"], x, y.alias("y"))


def windows_by_pairs(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Windows whose first two tokens are a row of ``pairs(t0, t1)``."""
    x = windows.withColumn("t0", F.col("tokens")[0]).withColumn("t1", F.col("tokens")[1])
    return x.join(pairs.select("t0", "t1"), ["t0", "t1"], "left_semi").drop("t0", "t1")


def windows_by_starts(windows: DataFrame, starts: DataFrame) -> DataFrame:
    """Windows at the positions ``starts(start)``; positions too near the end have none."""
    return windows.join(starts.select("start").distinct(), "start", "left_semi")


def quarter_stride_windows(stream: DataFrame, T: int) -> DataFrame:
    """Windows at 0, T div 4, 2 (T div 4), ..."""
    return sliding_windows(stream, T, max(1, T // 4))


def prefixes(windows: DataFrame, T: int) -> DataFrame:
    """Each window as T rows ``(level, context, next)``; other columns stay."""
    rows = F.transform(F.sequence(F.lit(1), F.lit(T)), lambda k: F.struct(k.alias("level"), F.slice("tokens", 1, k).alias("context"), F.get("tokens", k).alias("next")))
    return windows.select(*[c for c in windows.columns if c != "tokens"], F.inline(rows))


def fixed_length_contexts(seqs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, pos, context, next)`` of level ``k`` inside documents; contexts are pieces joined by blanks, ids stay beside."""
    n = F.size("tokens")
    at = F.when(n > k, F.sequence(F.lit(k), n - 1))
    x = seqs.select("doc_id", "tokens", F.explode(at).alias("i"))
    ctx = F.slice("tokens", F.col("i") - k + 1, k)
    return x.select("doc_id", F.col("i").cast("long").alias("pos"), F.array_join(ctx.cast("array<string>"), " ").alias("context"), ctx.alias("ids"), F.get("tokens", F.col("i")).alias("next"))
