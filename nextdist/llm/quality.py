"""Quality rules: fixed base rules and adaptive limits per language and source.

The limits come from mergeable quantile sketches. A sketch is a histogram over
value buckets that keep the six highest bits of an integer, so a bucket's lower
bound is within 1/32 of each value in it. Sketches of parts add up to the sketch of the
whole; (language, source) sketches are merged into those of the language and of
the corpus for groups that are too small to set a limit of their own. No limit is a constant: the mean
word length has fences of so many interquartile ranges, and counts that most texts have none of are judged by the
texts that do have some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, without
from .tokens import release

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Counts in thousandths that most texts may have none of: (name, numerator, denominator, sketch of the denominator, least number
#: of one case: a window of three words that comes twice).
COUNTS = [("symbols", "n_symbols", "n_words", "words", 1), ("dup_lines", "n_dup_lines", "n_lines", "lines", 1), ("repeats", "n_repeat_words", "n_words", "words", 6)]
#: What is sketched, as SQL.
METRICS = {**{m: f"{a} * 1000 div nullif({b}, 0)" for m, a, b, *_ in COUNTS}, "word_length": "word_chars * 1000 div nullif(n_words, 0)", "words": "n_words", "lines": "n_lines"}
#: Documents that a group needs for quartiles of its own, and documents with some of what is counted.
MIN_GROUP, MIN_SOME = 200, 100
#: Interquartile ranges of the mean word length, interquartile ratios of a count's logarithm, and standard deviations of counting.
FENCE, RATIO_FENCE, NOISE = 6, 1.5, 3


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k == n:
        return 0
    if k < 2_000_000:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        keys = pairs * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(n, bool)
    at = order[twice]
    cover[at] = cover[at + 1] = cover[at + 2] = True
    return int(cover.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The base counts of one text, in the order of ``FEATURES``."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the base counts of its column ``text``."""
    names = [*keep, *FEATURES]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            rows = [text_features(x.as_py()) for x in b.column("_nextdist_body")]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names)

    return docs.select(F.col("text").alias("_nextdist_body"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _base_failed():
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _bucket(v: str) -> str:
    return f"({v} - {v} % shiftleft(1L, greatest(length(bin({v})) - 6, 0)))"


def sketches(features: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, n)``: the sketch of each metric, over documents that pass the base rules."""
    parts = ", ".join(f"'{m}', {v}" for m, v in METRICS.items())
    long = features.where(~_base_failed()).selectExpr("lang", "source", f"stack({len(METRICS)}, {parts}) as (metric, v)").where("v is not null")
    return long.groupBy("lang", "source", "metric", F.expr(_bucket("v")).alias("bucket")).agg(F.count("*").alias("n"))


#: Of a sketch: its documents, those above zero, the quartiles of all, and the lowest twentieth and the quartiles of those above zero.
_QUARTILES = {
    "total": "any_value(total)", "n_some": "any_value(total - n_none)", "q1": "min(case when upto * 4 >= total then bucket end)", "q2": "min(case when upto * 2 >= total then bucket end)", "q3": "min(case when upto * 4 >= total * 3 then bucket end)",
    "p0": "min(case when bucket > 0 and (upto - n_none) * 20 >= total - n_none then bucket end)",
    "p1": "min(case when bucket > 0 and (upto - n_none) * 4 >= total - n_none then bucket end)", "p3": "min(case when bucket > 0 and (upto - n_none) * 4 >= (total - n_none) * 3 then bucket end)",
}


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window as W

    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    none = F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w)
    cum = merged.select(*keys, "metric", "bucket", F.sum("n").over(w).alias("total"), none.alias("n_none"), F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    return cum.groupBy(*keys, "metric").agg(*[F.expr(x).alias(c) for c, x in _QUARTILES.items()])


def _pick(own: str, lang: str, every: str, min_group: int, min_some: int) -> dict[str, str]:
    """SQL of a group's figures: of its own sketch, its language's or all documents', whichever first has enough of them."""
    size = f"case when {own}total >= {min_group} then {own}{{0}} when {lang}total >= {min_group} then {lang}{{0}} else {every}{{0}} end"
    some = f"case when {own}n_some >= {min_some} then {own}{{0}} when {lang}n_some >= {min_some} then {lang}{{0}} else {every}{{0}} end"
    return {**{c: size.format(c) for c in ("q1", "q2", "q3")}, **{c: some.format(c) for c in ("total", "n_some", "p0", "p1", "p3")}}


def _limits_sql() -> tuple[list[str], list[str]]:
    """SQL of the figures of one group by metric, and of its limits from them; the same for both engines."""
    flat = [f"max(case when metric = '{m}' then {c} end) as {m}_{c}" for m, *_ in COUNTS for c in ("total", "n_some", "p0", "p1", "p3")]
    flat += [f"max(case when metric = '{m}' then {c} end) as {m}_{c}" for m, c in (("word_length", "q1"), ("word_length", "q3"), ("words", "q2"), ("lines", "q2"))]
    out = []
    for m, _, _, size, least in COUNTS:
        one = f"({least * 1000}.0e0 / greatest({size}_q2, 1))"  # one case in a text of middling size
        r = f"({m}_p3 * 1.0e0 / {m}_p1)"
        spread = f"({r} * sqrt({r}))"  # the power of RATIO_FENCE
        high = f"({m}_p3 * {spread})"
        apart = f"2 * {m}_n_some < {m}_total and {m}_p0 > {1 + NOISE} * {one}"
        out.append(f"cast(floor(case when {apart} then sqrt({m}_p0 * {one}) else {high} + {NOISE} * sqrt({high} * {one}) end) as bigint) as max_{m}")
    # a bucket's upper end, as the quartile is its lower one
    out.append(f"word_length_q3 + cast(ceil(word_length_q3 / 32.0e0) as bigint) + {FENCE} * (word_length_q3 - word_length_q1) as max_word_length")
    out.append(f"word_length_q1 - {FENCE} * (word_length_q3 - word_length_q1) as min_word_length")
    return flat, out


def limits(sketch: DataFrame, min_group: int = MIN_GROUP, min_some: int = MIN_SOME) -> DataFrame:
    """One row per (lang, source): the highest allowed value of each metric and the lowest mean word length.

    The mean word length may lie ``FENCE`` interquartile ranges outside the quartiles. For a count that texts may have none of, the quartiles
    are those of the texts with some: their ratio to the power of ``RATIO_FENCE`` is the spread. The limit is the upper quartile
    times the spread, and the noise of counting in a text of middling size. But if less than half of the texts have some, and even the lowest
    twentieth of these has more than one case in a text of middling size and its noise, they are a kind of their own, apart from
    the texts without, and the limit lies in the (geometric) middle of the gap. A metric that no text has sets no limit.

    A group of fewer than ``min_group`` documents, or ``min_some`` with some, takes the merged sketch of its language, and of all
    documents if that is too small as well.
    """
    own, lang, every = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    cols = list(_QUARTILES)
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[F.col(c).alias(f"l_{c}") for c in cols])
    every = every.select(F.col("metric").alias("a_metric"), *[F.col(c).alias(f"a_{c}") for c in cols])
    own = own.select("lang", "source", "metric", *[F.col(c).alias(f"o_{c}") for c in cols])
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("a_metric"))
    x = x.selectExpr("lang", "source", "metric", *[f"{v} as {c}" for c, v in _pick("o_", "l_", "a_", min_group, min_some).items()])
    flat, out = _limits_sql()
    return x.groupBy("lang", "source").agg(*[F.expr(e) for e in flat]).selectExpr("lang", "source", *out)


def quality_rules(docs: DataFrame, keep: list[str] | None = None, min_group: int = MIN_GROUP, reread: bool = False) -> DataFrame:
    """Judge every row of ``docs(text, lang, source, ...)``.

    Adds the base counts, ``base_failed`` and ``kept`` to the columns ``keep``
    (default: all). Each text is read once; its counts are written beside ``keep``. With ``reread``, for wide ``keep``, texts
    are read twice instead, for the sketches and for the verdicts, and nothing is written but the sketches (a few hundred buckets per
    group), which are all that is shuffled in either case.

    Nulls: a null text counts as empty and fails the base rules; null language or
    source are groups of their own. Repeated rows are judged alike, each once. An
    empty table gives an empty result. Input columns named like a result are replaced.
    Texts of any length are read whole.
    """
    own = [*FEATURES, "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    need = [*keep, *[c for c in ("lang", "source") if c not in keep]]
    judged = with_features(without(docs, own), need).withColumn("base_failed", _base_failed())
    judged = judged if reread else saved(judged, "quality-counts")
    lim = saved(limits(saved(sketches(with_features(docs, ["lang", "source"]) if reread else judged), "quality-sketch"), min_group), "quality-limits")
    lim = lim.select(*[F.col(c).alias(f"_nextdist_{c}") for c in lim.columns])
    x = judged.join(lim, F.col("lang").eqNullSafe(F.col("_nextdist_lang")) & F.col("source").eqNullSafe(F.col("_nextdist_source")), "left")
    fine = " and ".join(f"coalesce({METRICS[m]} <= _nextdist_max_{m}, true)" for m in (*[c[0] for c in COUNTS], "word_length"))
    x = x.withColumn("kept", F.expr(f"not base_failed and {fine} and coalesce({METRICS['word_length']} >= _nextdist_min_word_length, true)"))
    return x.select(*[F.col(f"`{c}`") for c in keep], *own)


def _oracle() -> str:
    duck = {m: v.replace(" div ", " // ") for m, v in METRICS.items()}
    metrics = " union all ".join(f"select lang, source, '{m}' as metric, {v} as v from f where not base_failed" for m, v in duck.items())
    quartiles = ", ".join(f"{x} as {c}" for c, x in _QUARTILES.items())
    fence = lambda keys, name: f"""{name} as (select {keys}metric, {quartiles}
 from (select {keys}metric, bucket, sum(n) over (partition by {keys}metric) as total, coalesce(sum(n) filter (bucket = 0) over (partition by {keys}metric), 0) as n_none, sum(n) over (partition by {keys}metric order by bucket) as upto
 from (select {keys}metric, bucket, sum(n)::bigint as n from sk group by {keys}metric, bucket)) group by {keys}metric)"""  # noqa: E731
    picked = ", ".join(f"{v} as {c}" for c, v in _pick("o.", "l.", "a.", MIN_GROUP, MIN_SOME).items())
    flat, out = _limits_sql()
    fine = " and ".join(f"coalesce({duck[m]} <= max_{m}, true)" for m in (*[c[0] for c in COUNTS], "word_length"))
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
tri as (select rid, i, w || ' ' || lead(w) over p || ' ' || lead(w, 2) over p as t from w window p as (partition by rid order by i)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, t) as c from tri where t is not null) where c > 1),
cov as (select rid, count(distinct j) as n_repeat_words from (select rid, i + o as j from rep, (values (0), (1), (2)) as v(o)) group by rid),
ln as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
f0 as (select d.rid, doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
 from d left join ln using (rid) left join cov using (rid)),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from f0),
m as ({metrics}),
sk as (select lang, source, metric, v - v % (1::bigint << greatest(length(bin(v)) - 6, 0)) as bucket, count(*) as n from m where v is not null group by all),
{fence("lang, source, ", "o")}, {fence("lang, ", "l")}, {fence("", "a")},
lim0 as (select o.lang, o.source, o.metric, {picked} from o join l on o.lang is not distinct from l.lang and o.metric = l.metric join a on o.metric = a.metric),
lim1 as (select lang, source, {", ".join(flat)} from lim0 group by lang, source),
lim as (select lang, source, {", ".join(out)} from lim1)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_lines::bigint as n_lines, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
 (not base_failed and {fine} and coalesce({duck["word_length"]} >= min_word_length, true)) as kept
from f left join lim on f.lang is not distinct from lim.lang and f.source is not distinct from lim.source
"""


ORACLE_SQL = _oracle()
