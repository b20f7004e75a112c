"""Mixing to target weights by soft domain membership.

A classifier fitted on the labelled table gives each document a posterior over
domains. Projected gradient then looks for a rate per document, none negative, at which the domains'
expected token totals come closest to their targets in the least-squares sense. All of it is DataFrame work: the
unknown rates stay distributed, and a round sends one residual per domain to the driver.
"""

from __future__ import annotations

import functools
import math
import operator
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, with_rows

#: Domains of the labelled table, as SQL over its columns.
DOMAINS = {"good": "quality = 1 and toxic = 0", "low": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"good": 0.95, "low": 0.045, "toxic": 0.005}
#: Labelled documents used for fitting at most.
MAX_FIT = 40_000
#: A classifier of up to this many words (some 50 bytes each) is sent to every task; a larger one is joined by a shuffle.
BROADCAST_WORDS = 200_000
MIN_DOCS = 5
#: A word is kept when its documents in some domain are this many standard errors over their share.
MIN_TELLS = 5.0
#: And when that domain's share of documents with it is so many times the share in all: more labelled documents make weaker words
#: certain, but not telling.
MIN_RATIO = 1.5
SMOOTH = 0.5
#: A document's evidence is at most this, so that posteriors stay soft.
MAX_LOGIT = 12.0
#: Rounds at most; :func:`target_report` and a warning say when they did not do.
ROUNDS = 120
CLOSE = 1e-6
#: Steps that each take less than this share off the error, so many in a row, mean that the targets are out of reach; the longest step.
SLOW, PATIENCE = 1e-4, 8
MAX_STEP = 1000.0
#: Rounds after which the rates so far are written, to keep expressions short.
WRITE_EVERY = 12
_SPLIT = r"[ \t\n\x0b\x0c\r]+"
_BLANKS = " \t\n\x0b\x0c\r"


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` (words) and ``words``: each distinct word, and words for the text's shape."""
    body = F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(_BLANKS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _SPLIT))
    x = docs.select(*[F.col(f"`{c}`") for c in keep], words.alias("_w"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("_s"))
    x = x.withColumn("_d", F.array_distinct("_w"))
    n = F.size("_w")
    shape = F.array(
        F.lit(" bias"),
        F.concat(F.lit(" variety "), F.when(n < 20, "short").otherwise(F.expr("(10 * size(_d)) div greatest(1, size(_w))").cast("string"))),
        F.concat(F.lit(" symbols "), F.when(n == 0, "none").otherwise(F.ceil(F.log2(1 + 64 * F.col("_s") / F.greatest(n, F.lit(1)))).cast("string"))),
    )
    return x.select(*[F.col(f"`{c}`") for c in keep], n.cast("long").alias("n_tokens"), F.concat("_d", shape).alias("words"))


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)``: one domain per labelled document; rows without a full label go."""
    case = "case " + " ".join(f"when {c} then '{d}'" for d, c in DOMAINS.items()) + " end"
    x = labels.select("doc_id", F.expr(case).alias("domain")).where("doc_id is not null and domain is not null")
    return x.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """Naive Bayes over word presence and absence: ``(word, w_<domain>...)``.

    Fitted on at most about ``max_fit`` labelled documents, chosen by their ids' hash. Only words that are
    clearly more frequent in a domain other than the first, and surely so, are kept, so a short text that lacks them
    is one of the first domain. The word `` bias`` has the priors and what the absence of all words says.
    """
    lab = labelled(labels)
    n = lab.count()
    if n > max_fit:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_fit / n * (1 << 30)))
    lab = saved(lab, "mix-labels")
    x = features(docs.join(lab, "doc_id"), ["domain"])
    # never empty, so ``outer`` changes nothing but spares a filter that would split each text several times over
    seen = x.select("domain", F.explode_outer("words").alias("word"))
    sums = [F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    by_word = saved(seen.groupBy("word").agg(*sums, F.count("*").alias("n")).where(f"n >= {MIN_DOCS} or word = ' bias'"), "mix-counts")
    total = by_word.where("word = ' bias'").first()
    size = {d: (total[d] if total else 0) for d in DOMAINS}
    every = max(1, sum(size.values()))
    odd = {d: (F.col(d) - F.col("n") * (size[d] / every)) / F.sqrt(F.col("n") * (size[d] / every) * (1 - size[d] / every) + 1) for d in DOMAINS}
    ratio = {d: F.col(d) / F.lit(max(size[d], 1)) / (F.col("n") / F.lit(every)) for d in DOMAINS}
    telling = [(odd[d] >= MIN_TELLS) & (ratio[d] >= MIN_RATIO) for d in list(DOMAINS)[1:]]
    w = by_word.where("word <> ' bias'").where(functools.reduce(operator.or_, telling))
    p = {d: (F.col(d) + SMOOTH) / (size[d] + 2 * SMOOTH) for d in DOMAINS}
    w = saved(w.select("word", *[F.log(p[d] / (1 - p[d])).alias(f"w_{d}") for d in DOMAINS], *[F.log(1 - p[d]).alias(f"a_{d}") for d in DOMAINS]), "mix-weights")
    absent = w.agg(*[F.sum(f"a_{d}").alias(d) for d in DOMAINS]).first()
    bias = [math.log((size[d] + SMOOTH) / (every + len(DOMAINS) * SMOOTH)) + (absent[d] or 0.0) for d in DOMAINS]
    w = w.select("word", *[f"w_{d}" for d in DOMAINS])
    return w.unionByName(w.sparkSession.createDataFrame([(" bias", *bias)], w.schema))


def posteriors(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``(_row, doc_id, n_tokens, p_<domain>...)`` for every row of ``docs(_row, doc_id, text)``."""
    x = features(docs, ["_row", "doc_id"])
    small = weights.count() <= BROADCAST_WORDS
    hits = x.select("_row", "doc_id", "n_tokens", F.explode_outer("words").alias("word")).join(F.broadcast(weights) if small else weights, "word")
    got = hits.groupBy("_row", "doc_id", "n_tokens").agg(*[F.sum(f"w_{d}").alias(f"z_{d}") for d in DOMAINS])
    top = F.greatest(*[F.col(f"z_{d}") for d in DOMAINS])
    e = {d: F.exp(F.greatest(F.col(f"z_{d}") - top, F.lit(-MAX_LOGIT))) for d in DOMAINS}
    norm = sum(e.values())
    return got.select("_row", "doc_id", "n_tokens", *[F.round(e[d] / norm, 9).alias(f"p_{d}") for d in DOMAINS])


def fit_rates(post: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``rate`` >= 0 to written ``post``: projected gradient on sum over domains of (expected - target)^2 / natural total.

    A document's coordinate is scaled by its length, for which the largest eigenvalue is one; the step is one over the mean eigenvalue
    that the gradient of the round before sees (:func:`step_width`), which takes far fewer rounds than a step of one. Targets are shares; the
    first domain's target is its natural total, so that its documents keep a rate near one. A domain that has no tokens is
    left out. Warns when the rounds end before the targets are met within ``CLOSE``.
    """
    names = list(DOMAINS)
    n = F.col("n_tokens")
    sums = post.agg(*[F.sum(n * F.col(f"p_{d}")).alias(d) for d in names], *[F.sum(n * F.col(f"p_{d}") * F.col(f"p_{e}")).alias(f"{d}*{e}") for d in names for e in names]).first()
    natural = {d: sums[d] or 0.0 for d in names}
    live = [d for d in names if natural[d] > 0]
    mass = [[sums[f"{d}*{e}"] for e in live] for d in live]
    budget = natural[names[0]] / targets[names[0]]
    want = {d: targets[d] * budget for d in live}
    base, rate = post.withColumn("rate", F.lit(1.0)), F.col("rate")
    trial, before, gap, error, width, steps, since = rate, [], [], math.inf, 1.0, 0, 0
    for k in range(1, rounds + 1):
        now = base.agg(*[F.sum(n * F.col(f"p_{d}") * trial).alias(d) for d in live]).first() if live else {}
        found = [(now[d] - want[d]) / natural[d] for d in live]
        off = sum(x * x * natural[d] for d, x in zip(live, found, strict=True))
        if off < error:  # a step is taken only if it brings the totals nearer; a step of one always does, short of the end
            since = since + 1 if off > error * (1 - SLOW) else 0
            rate, before, gap, error, steps = trial, gap, found, off, steps + 1
            width = step_width(before, mass, [natural[d] for d in live]) if before else 1.0
            if steps % WRITE_EVERY == 0:
                old, base, rate = base, saved(base.withColumn("rate", rate), "mix-rates"), F.col("rate")
                if steps > WRITE_EVERY:
                    discard(old)
        elif width == 1.0:
            break
        else:
            width = max(1.0, width / 8)
        if max(map(abs, gap), default=0.0) < CLOSE or since >= PATIENCE:
            break
        step: Column = sum(F.col(f"p_{d}") * F.lit(width * g) for d, g in zip(live, gap, strict=True))
        trial = F.greatest(F.lit(0.0), rate - step)
    worst = max(map(abs, gap), default=0.0)
    if worst >= CLOSE:
        warnings.warn(f"targets are not met: after {k} rounds a domain is off by {worst:.3g} of its natural total", stacklevel=2)
    return base.withColumn("rate", F.round(rate, 9))


def step_width(gap: list[float], mass: list[list[float]], natural: list[float]) -> float:
    """Barzilai and Borwein's step for the gradient ``gap``, from the domains' common token mass; one at least."""
    g = [sum(m * x for m, x in zip(row, gap, strict=True)) for row in mass]
    up, down = sum(a * b for a, b in zip(gap, g, strict=True)), sum(a * a / x for a, x in zip(g, natural, strict=True))
    return min(MAX_STEP, max(1.0, up / down)) if down > 0 else 1.0


def target_report(rates: DataFrame, targets: dict[str, float] = TARGETS, close: float = 1e-3) -> DataFrame:
    """``(domain, natural, target, expected, met)``: token totals of ``rates`` before and after, and whether the target is met within ``close``."""
    first = next(iter(DOMAINS))
    sums = rates.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * w).alias(f"{k}_{d}") for d in DOMAINS for k, w in (("natural", F.lit(1.0)), ("expected", F.col("rate")))])
    rows = [
        F.struct(F.lit(d).alias("domain"), F.coalesce(f"natural_{d}", F.lit(0.0)).alias("natural"), F.coalesce(F.col(f"natural_{first}") * (targets[d] / targets[first]), F.lit(0.0)).alias("target"), F.coalesce(f"expected_{d}", F.lit(0.0)).alias("expected"))
        for d in DOMAINS
    ]
    return sums.select(F.inline(F.array(*rows))).withColumn("met", F.abs(F.col("expected") - F.col("target")) <= close * F.greatest("natural", F.lit(1.0)))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>..., rate, copies)`` for every row of ``docs(doc_id, text)``.

    ``copies`` is the rate's whole part, plus one with the chance of the rest, drawn from the id's hash.

    Nulls: a null text is empty: no tokens, and the posterior of its shape; a null ``doc_id``
    is never a labelled one and gets a rate. Repeated rows get a rate each, the same. No labels: all posteriors are equal. An
    empty table gives an empty result. Other input columns are ignored. Texts of any length are read whole.
    """
    return _rates(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), labels, targets).drop("_row")


def _rates(rows: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    rows = rows.select("_row", "doc_id", "text")
    weights = fit(rows, labels)
    post = saved(posteriors(rows, weights), "mix-posteriors")
    rates = fit_rates(post, targets)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return rates.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, row: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its ``copies`` say; columns are unchanged.

    Rows keep their numbers however a scan is split: those of the column ``row`` (:func:`~nextdist.llm.common.file_rows`), or else
    rows are numbered once and written with their numbers. Nulls, repeated rows and empty tables are as in :func:`mixing_rates`; a column ``_row`` of the input is not returned.
    """
    rows, names = with_rows(docs, row, [], "mix-rows")
    rates = _rates(rows, labels, targets).where("copies > 0").select("_row", F.col("copies").alias("_nextdist_copies"))
    x = rows.join(rates, "_row").withColumn("_nextdist_copy", F.explode(F.sequence(F.lit(1), F.col("_nextdist_copies"))))
    return x.select(*[F.col(f"`{c}`") for c in names])
