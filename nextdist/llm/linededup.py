"""Line dedup: repeated runs of lines, found with a suffix array over line ids.

Each document is a sequence of line ids. Prefix doubling sorts the suffixes: at level k a suffix's rank is the
place of its first 2^k lines in sorted order, made from two ranks of level k-1. Lines that occur
once begin no repeated run, so only suffixes at other lines are sorted.

A run of lines counts when it has ``min_lines`` lines and ``min_words`` words. Each counting run is
the union of its shortest counting windows, from each line forward and to each line backward. Suffixes are sorted to the depth of
the longest such window. The array of longest common prefixes (LCP) of neighbours in sorted order then cuts it into
intervals: neighbours whose LCP is at least a window's size share that window. Deleting every window whose
interval has an earlier member deletes all later copies of all maximal repeated runs, and no more.
Doubling stops at the longest window, not at the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, numbered, saved, with_rows

MIN_LINES = 1
MIN_WORDS = 10
_BLANKS = " \t\r\x0b\x0c"
_BLANK = r"[ \t\r\x0b\x0c]+"
#: Places of the suffix array that one task gets of one interval at most.
BLOCK = 4096
OWN = ["n_lines", "n_deleted"]


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _trimmed(x: Column) -> Column:
    """``x`` without blanks at its ends; most lines have none and are not copied."""
    return F.when(reduce(or_, [f(F.lit(c)) for c in _BLANKS for f in (x.startswith, x.endswith)]), F.btrim(x, F.lit(_BLANKS))).otherwise(x)


def _count(x: Column, one: str) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(one), F.lit("")))


def _n_words(x: Column) -> Column:
    """Words of a trimmed line: one more than its spaces; only lines with other blanks, or several in a row, are cut into words."""
    odd = reduce(or_, [x.contains(c) for c in ["  ", *_BLANKS[1:]]])
    return F.when(x == "", 0).when(odd, F.size(F.split(x, _BLANK))).otherwise(_count(x, " ") + 1)


def _sorted_ids(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """Add an id that grows with ``order``: rows are range-partitioned, sorted and written with it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), tag)


def line_ids(rows: DataFrame, tag: str = "lines-flat") -> DataFrame:
    """One row per line of ``rows(_row, text)``: ``pos`` (a place that grows by one in a document), ``left`` (lines up to its document's end), 128 bits of hash, words.

    Lines are compared without blanks at their ends.
    """
    trimmed = F.transform(_lines(), _trimmed)
    ids = F.transform(
        trimmed,
        lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), _n_words(x).alias("words")),
    )
    flat = rows.select("_row", ids.alias("_ids")).select("_row", F.size("_ids").alias("_n"), F.posexplode("_ids").alias("line", "id"))
    return saved(flat.select("_row", "line", (F.col("_n") - F.col("line")).alias("left"), "id.*", F.monotonically_increasing_id().alias("pos")), tag)


def windows(active: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """``(at, size)``: the shortest counting window from each line forward and to each line backward.

    Only stretches of lines that all occur elsewhere count. One row here is one document, so
    nothing larger than a document comes together.
    """
    rows = active.groupBy("_row").agg(F.collect_list("pos").alias("pos"), F.collect_list("words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for pos, words in zip(b.column("pos"), b.column("words"), strict=True):
                p = pos.values.to_numpy(zero_copy_only=False)
                w = words.values.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(p)
                p, w = p[order], w[order]
                cut = np.flatnonzero(np.diff(p) != 1) + 1
                for p1, w1 in zip(np.split(p, cut), np.split(w, cut), strict=True):
                    m = len(p1)
                    cum = np.concatenate([[0], np.cumsum(w1)])
                    i = np.arange(m)
                    j = np.maximum(np.searchsorted(cum, cum[:-1] + min_words), i + min_lines)  # the window is [i, j)
                    ok = j <= m
                    at.append(p1[i[ok]])
                    size.append((j - i)[ok])
                    i = np.minimum(np.searchsorted(cum, cum[1:] - min_words, side="right") - 1, np.arange(1, m + 1) - min_lines)
                    ok = i >= 0
                    at.append(p1[i[ok]])
                    size.append((np.arange(1, m + 1) - i)[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(size))], ["at", "size"])

    return rows.select("pos", "words").mapInArrow(run, "at long, size long").distinct()


def suffix_ranks(active: DataFrame, depth: int) -> DataFrame:
    """``(pos, left, r)``: ``r[k]`` is the rank of the suffix at ``pos`` by its first 2^k lines, up to ``depth`` lines at least.

    ``active(pos, left, rank)`` has every line that occurs twice. A line that is not there is unlike all others, and so is what follows it.
    """
    x, half = active.select("pos", "left", F.array("rank").alias("r")), 1
    while half < depth:
        then = x.select(F.col("pos").alias("then"), F.element_at("r", -1).alias("then_rank"))
        y = x.withColumn("then", F.col("pos") + half).join(then, "then", "left")
        second = F.when(F.col("left") <= half, F.lit(-1)).otherwise(F.coalesce("then_rank", -2 - F.col("pos")))
        y = saved(y.select("pos", "left", "r", F.element_at("r", -1).alias("rank"), second.alias("second")), "lines-pairs")
        new = _sorted_ids(y.select("rank", "second").distinct(), [F.col("rank"), F.col("second")], "new", "lines-rank")
        old, x = x, saved(y.join(new, ["rank", "second"]).select("pos", "left", F.concat("r", F.array("new")).alias("r")), "lines-level")
        discard(y)
        discard(new)
        if half > 1:
            discard(old)
        half *= 2
    return x


def suffix_array(ranks: DataFrame) -> DataFrame:
    """``(sa, pos, lcp)``: suffixes numbered in sorted order, with the lines that each shares with the one before.

    ``ranks`` are those of :func:`suffix_ranks`; prefixes are compared up to the depth sorted there, equal ones stand by ``pos``.
    """
    sa = numbered(ranks, [F.element_at("r", -1), F.col("pos")], "sa", "lines-sa")
    before = sa.select((F.col("sa") + 1).alias("sa"), F.col("pos").alias("prev"), F.col("r").alias("prev_r"), F.col("left").alias("prev_left"))
    # ranks of deeper levels divide those of the levels before, so equal ones come first
    same = F.size(F.filter(F.zip_with("r", "prev_r", lambda a, b: a.eqNullSafe(b)), lambda e: e))
    x = sa.join(before, "sa", "left").select("sa", "pos", "prev", F.least("left", "prev_left").alias("room"), F.when(F.col("prev").isNull(), 0).otherwise(same).alias("same"))
    lcp = F.when(F.col("same") == 0, 0).otherwise(F.least(F.expr("shiftleft(1, same - 1)"), "room"))
    x = saved(x.withColumn("lcp", lcp), "lines-lcp")
    levels = x.agg(F.max("same")).first()[0] or 0
    # below the deepest level on which two neighbours agree, their shared prefix grows by halves
    for k in range(levels - 2, -1, -1):
        todo = (F.col("same") > k + 1) & (F.col("lcp") < F.col("room"))
        a = ranks.select(F.col("pos").alias("pa"), F.get("r", F.lit(k)).alias("ra"))
        b = ranks.select(F.col("pos").alias("pb"), F.get("r", F.lit(k)).alias("rb"))
        y = x.where(todo).join(a, F.col("pos") + F.col("lcp") == F.col("pa"), "left").join(b, F.col("prev") + F.col("lcp") == F.col("pb"), "left")
        grown = F.when(F.col("ra") == F.col("rb"), F.least(F.col("lcp") + 2**k, "room")).otherwise(F.col("lcp"))
        old, x = x, saved(y.withColumn("lcp", grown).select(*x.columns).unionByName(x.where(~todo)), "lines-lcp")
        discard(old)
    return x.select("sa", "pos", "lcp")


def later_copies(wins: DataFrame, sa: DataFrame, order: DataFrame) -> DataFrame:
    """Those of ``wins(at, size)`` whose LCP interval has a member that comes earlier by ``order(pos, ord)``.

    An interval's name is its first place in the array. Places are cut into blocks; a frequent
    run's interval spans many blocks, and no join key has more rows than a block.
    """
    w = wins.join(sa.join(order, "pos").withColumnRenamed("pos", "at"), "at").withColumn("block", F.expr(f"sa div {BLOCK}"))
    w = saved(w.withColumn("first", F.when(F.col("lcp") < F.col("size"), F.col("sa"))), "lines-places")
    inside = W.partitionBy("size", "block").orderBy("sa").rowsBetween(W.unboundedPreceding, 0)  # a block at most
    over = W.partitionBy("size").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    carried = w.groupBy("size", "block").agg(F.max("first").alias("first")).withColumn("carried", F.last("first", True).over(over)).drop("first")
    w = w.withColumn("first", F.last("first", True).over(inside)).join(carried, ["size", "block"])
    w = saved(w.select("at", "size", "block", "ord", F.coalesce("first", "carried").alias("first")), "lines-intervals")
    low = w.groupBy("size", "first").agg(F.min("ord").alias("low"), F.count("*").alias("n"), F.min("block").alias("b0"), F.max("block").alias("b1")).where("n > 1")
    low = low.select("size", "first", "low", F.explode(F.sequence("b0", "b1")).alias("block"))
    return w.join(low, ["size", "first", "block"]).where("ord > low").select("at", "size")


def repeated_lines(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_row, line)`` of every line that a later copy of a counting run covers; ``rows(_row, doc_id, text)`` have stable numbers."""
    flat = line_ids(rows)
    keys = flat.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    first = _sorted_ids(keys, [F.col("h1"), F.col("h2")], "rank", "lines-rank")
    active = saved(flat.join(first, ["h1", "h2"]).select("_row", "line", "pos", "left", "words", "rank"), "lines-active")
    discard(flat)
    wins = saved(windows(active, min_lines, min_words), "lines-windows")
    ranks = suffix_ranks(active, wins.agg(F.max("size")).first()[0] or 0)
    # the first copy is the one that comes first by id, nulls last, then by row and line
    order = active.join(rows.select("_row", "doc_id"), "_row").select("pos", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos").alias("ord"))
    found = later_copies(wins, suffix_array(ranks), order).groupBy(F.col("at").alias("pos")).agg(F.max(F.col("at") + F.col("size")).alias("end"))
    upto = F.max("end").over(W.partitionBy("_row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))  # one document
    return active.select("_row", "line", "pos").join(found, "pos", "left").withColumn("upto", upto).where("upto > pos").select("_row", "line")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, row: str | None = None) -> DataFrame:
    """Delete later copies of repeated line runs from ``docs(doc_id, text, ...)``.

    All columns are kept, ``text`` without the deleted lines; ``n_lines`` and ``n_deleted``
    count a text's lines before and those deleted. The first copy in ``doc_id`` order
    (nulls last, then row order) stays. Rows keep their numbers however a scan is split: those of the column ``row``
    (:func:`~nextdist.llm.common.file_rows`), or else rows are numbered once and written with their numbers.

    Nulls: a null text stays null and counts as one empty line. Texts without words lose
    nothing. Repeated rows: the first keeps its lines, the others lose
    their counting runs. An empty table gives an empty result. Input columns named like a
    result are replaced. Texts of any length are read whole.
    """
    rows, names = with_rows(docs, row, [*OWN, "_gone"], "lines-rows")
    gone = repeated_lines(rows, min_lines, min_words)
    gone = saved(gone.groupBy("_row").agg(F.collect_list("line").alias("_gone")), "lines-gone")
    # one plan at every size: texts are shuffled once, against a hash table of deleted line numbers
    x = rows.join(gone.hint("shuffle_hash"), "_row", "left")
    # only texts that lose lines are cut into lines, each once: a column of its own, as a lambda would cut the text for each line anew
    x = x.withColumn("_nextdist_lines", F.when(F.col("_gone").isNotNull(), _lines()))
    left = F.array_except(F.sequence(F.lit(0), F.size("_nextdist_lines") - 1), F.col("_gone"))
    kept = F.transform(left, lambda i: F.get("_nextdist_lines", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = _count(F.coalesce("text", F.lit("")), "\n") + 1
    counts = [n_lines.cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_deleted")]
    return x.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *counts)


ORACLE_SQL = rf"""
with d as (select row_number() over (order by doc_id) as r, doc_id, text from documents),
l0 as (select r, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from d),
l as (select r, i, raw, regexp_replace(raw, '^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$', '', 'g') as line from l0),
w as (select *, case when line = '' then 0 else len(regexp_split_to_array(line, '[ \t\r\x0b\x0c]+')) end as n from l),
c as (select *, sum(n) over (partition by r order by i) as upto from w),
fwd as (select a.r, a.i as i, min(b.i) as j from c a join c b on a.r = b.r and b.i >= a.i and b.upto - a.upto + a.n >= {MIN_WORDS} group by a.r, a.i),
bwd as (select b.r, max(a.i) as i, b.i as j from c a join c b on a.r = b.r and b.i >= a.i and b.upto - a.upto + a.n >= {MIN_WORDS} group by b.r, b.i),
win as (select r, i, j from fwd union select r, i, j from bwd),
t as (select win.r, win.i, j, string_agg(line, chr(10) order by w.i) as body from win join w on w.r = win.r and w.i between win.i and win.j group by win.r, win.i, j),
later as (select r, i, j from (select *, row_number() over (partition by body order by r, i) as k from t) where k > 1),
gone as (select distinct w.r, w.i from w join later on w.r = later.r and w.i between later.i and later.j)
select d.doc_id, case when count(gone.i) = 0 then any_value(d.text) else coalesce(string_agg(raw, chr(10) order by w.i) filter (gone.i is null), '') end as text,
 count(*)::bigint as n_lines, count(gone.i)::bigint as n_deleted
from d join w on d.r = w.r left join gone on gone.r = w.r and gone.i = w.i group by d.r, d.doc_id
"""
