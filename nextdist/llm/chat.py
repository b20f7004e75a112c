"""Quotation linking: conversations in reply order, without quoted text.

Lines that start with ``>`` are quotes; the number of ``>`` is the level. Runs of one level
are passages. A passage, each of its paragraphs, sentences, lines and pairs of neighbouring lines are normalised, hashed, and joined to the
earliest message whose own text has them, as a whole, a paragraph, a sentence, a line or a pair of lines; so a part of a paragraph links
even if a mail client has wrapped it anew. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, numbered, saved, shielded

#: Parts of a quote shorter than this, once normalised, link nothing on their own; the whole of a quote does.
MIN_LINE = 12
#: Where a sentence ends: white space after its mark, or a blank line.
SENTENCE = r"(?<=[.!?])\s+|\n[ \t]*\n"
_PREFIX = r"^((?:[ \t]*>)+)[ \t]?"
_ATTRIBUTION = r"^.*\b(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
OWN = ["parent_turn", "quoted_conv_id", "quoted_turn", "n_quotes", "root_turn", "reply_depth", "position", "body", "formatted"]


def normal(x: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def name(x: Column) -> Column:
    return F.md5(normal(x))


def pieces_of(x: str) -> Column:
    """The whole of a text, its paragraphs, sentences, lines and pairs of neighbouring lines, each once."""
    lines = F.filter(F.split(x, "\n", -1), lambda y: F.length(normal(y)) > 0)
    pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.concat_ws("\n", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_distinct(F.concat(F.array(x), F.split(x, r"\n[ \t]*\n"), F.split(x, SENTENCE), lines, pairs))


def _lines(msgs: DataFrame) -> DataFrame:
    """One row per line of messages that quote: its level, the text after the marks, and its passage's number."""
    x = msgs.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    x = x.select("_m", "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    x = x.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", _PREFIX, 1), "[^>]", "")))
    x = x.withColumn("said", F.regexp_replace("line", _PREFIX, ""))
    w = W.partitionBy("_m").orderBy("i")  # one message
    x = x.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(w)).cast("int")).withColumn("next_level", F.lead("level", 1, 0).over(w))
    return x.withColumn("passage", F.sum("new").over(w))


def _originals(bodies: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The earliest message with each wanted hash, within its conversation, and in the two first conversations of all."""
    x = bodies.select("conv_id", "turn", F.explode(pieces_of("body")).alias("piece"))
    x = x.where(F.length(normal(F.col("piece"))) > 0).select("conv_id", "turn", name(F.col("piece")).alias("h"))
    x = saved(x.join(wanted, "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("turn")), "chat-originals")
    o = x.select("h", F.struct("conv_id", "turn").alias("o"))
    first = o.groupBy("h").agg(F.min("o").alias("first"))
    # a row per conversation and hash, so the next smallest is another conversation's
    second = o.join(first, "h").groupBy("h").agg(F.min("first").alias("first"), F.min(F.when(~F.col("o.conv_id").eqNullSafe(F.col("first.conv_id")), F.col("o"))).alias("second"))
    return x, second


def _roots(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, root_turn, hops)`` by pointer doubling; a parent's turn is always smaller."""
    state = saved(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("hops")), "chat-roots")
    while True:
        b = state.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        x = state.join(b, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("t2")), "left")
        x = saved(x.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("t2").isNotNull().alias("moved")), "chat-roots")
        moved = not x.where("moved").isEmpty()
        discard(state)
        state = x.drop("moved")
        if not moved:
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "hops")


def quotation_links(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Link quotes in ``messages(conv_id, turn, role, text)`` and order each conversation by replies.

    One row per message: ``body`` (its text without quotes and their attribution lines), ``quoted_conv_id``
    and ``quoted_turn`` (the original of its best quote: lowest level, then most
    characters, then latest), ``parent_turn`` (that turn if it is in the same
    conversation), ``n_quotes``, ``root_turn``, ``reply_depth``, ``position`` and ``formatted``. In a
    conversation, messages stand by the turn of their thread's first message, then depth, then turn; ``position``
    counts from 0. The rows stay apart, so a conversation of any size is no row of its own.

    Nulls: a null text is an empty message; null conversations are one conversation; a null
    turn links to nothing, and stands first. Repeated rows are repeated in the result, next to each other. Quotes
    without an original are dropped from the text and link nothing. An empty table gives an
    empty result. Input columns named like a result are replaced. Texts of any length are read whole.
    """
    keep = [c for c in (messages.columns if keep is None else keep) if c.lower() not in OWN]
    msgs, back = shielded(messages, ["conv_id", "turn", "role", "text"], keep)
    msgs = msgs.withColumn("_m", F.monotonically_increasing_id())
    msgs = saved(msgs, "chat-messages")
    lines = saved(_lines(msgs), "chat-lines")
    gone = (F.col("level") > 0) | ((F.col("next_level") > 0) & F.col("said").rlike(_ATTRIBUTION))
    own = F.array_sort(F.collect_list(F.when(~gone, F.struct("i", "line"))))
    clean = lines.groupBy("_m").agg(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("_clean"))
    x = msgs.join(clean, "_m", "left")
    x = saved(x.withColumn("body", F.coalesce("_clean", "text", F.lit(""))).drop("_clean"), "chat-bodies")

    said = F.array_sort(F.collect_list(F.struct("i", "said")))
    quotes = lines.where("level > 0").groupBy("_m", "conv_id", "turn", "passage", "level").agg(F.array_join(F.transform(said, lambda s: s["said"]), "\n").alias("q"))
    quotes = saved(quotes.where(F.length(normal(F.col("q"))) > 0), "chat-quotes")
    # short lines link nothing on their own, but the whole and runs of them do
    p = F.filter(pieces_of("q"), lambda y: (y == F.col("q")) | (F.length(normal(y)) >= MIN_LINE))
    pieces = quotes.select("_m", "conv_id", "turn", "level", F.explode(p).alias("p"))
    pieces = saved(pieces.select("_m", "conv_id", "turn", "level", name(F.col("p")).alias("h"), F.length(normal(F.col("p"))).alias("size")), "chat-pieces")
    near, far = _originals(x, pieces.select("h").distinct())
    near = near.select("h", F.col("conv_id").alias("near_conv"), F.col("turn").alias("near_turn"))
    hit = pieces.join(near, (pieces.h == near.h) & F.col("conv_id").eqNullSafe(F.col("near_conv")) & (F.col("near_turn") < F.col("turn")), "left").drop(near.h)
    hit = hit.join(far, "h", "left")
    # an original in another conversation counts where the own one has none
    hit = hit.withColumn("other", F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first")))
    hit = hit.withColumn("at", F.when(F.col("near_turn").isNotNull(), F.struct("conv_id", F.col("near_turn").alias("turn"))).when(F.col("other.turn").isNotNull(), F.col("other")))
    votes = hit.where("at is not null").groupBy("_m", "conv_id", "level", "at").agg(F.sum("size").alias("votes"))
    best = votes.groupBy("_m").agg(F.max(F.struct(-F.col("level"), F.col("votes"), F.col("at.conv_id").eqNullSafe(F.col("conv_id")), "at")).alias("b"))
    counts = quotes.groupBy("_m").agg(F.count("*").alias("n_quotes"))
    links = saved(counts.join(best, "_m", "left").select(F.col("_m").alias("_k"), "n_quotes", F.col("b.at.conv_id").alias("quoted_conv_id"), F.col("b.at.turn").alias("quoted_turn")), "chat-links")
    x = x.join(links, x._m == links._k, "left").drop("_k")
    x = x.withColumn("parent_turn", F.when(F.col("quoted_conv_id").eqNullSafe(F.col("conv_id")) & F.col("quoted_turn").isNotNull(), F.col("quoted_turn")))
    x = saved(x, "chat-parents")
    up = x.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn"))
    roots = _roots(up).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "root_turn", "hops")
    x = x.join(roots, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    x = x.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("reply_depth", F.coalesce("hops", F.lit(0)).cast("long"))
    tagged = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"))
    x = x.withColumn("n_quotes", F.coalesce("n_quotes", F.lit(0)).cast("long")).withColumn("formatted", tagged)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "root_turn", "reply_depth", "turn", "_m")]
    slim = numbered(x.select("_m", "conv_id", "root_turn", "reply_depth", "turn"), order, "_g", "chat-order")
    first = slim.groupBy("conv_id").agg(F.min("_g").alias("_f")).withColumnRenamed("conv_id", "_c")
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).select(F.col("_m").alias("_k"), (F.col("_g") - F.col("_f")).alias("position"))
    x = x.join(slim, x._m == slim._k)
    return x.select(*back, *OWN)


#: For tables in which no message quotes another, which it checks: every message is its own thread.
ORACLE_SQL = r"""
with q as (select count(*) as quoting from conversations where regexp_matches(text, '(?m)^[ \t]*>'))
select conv_id, turn, role, null::bigint as parent_turn, null::bigint as quoted_conv_id, null::bigint as quoted_turn, 0::bigint as n_quotes, turn as root_turn, 0::bigint as reply_depth,
 (row_number() over (partition by conv_id order by turn nulls first) - 1)::bigint as position, coalesce(text, '') as body, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') as formatted
from conversations, q where quoting = 0
"""
