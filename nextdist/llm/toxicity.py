"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learnt from labelled texts: words, and stems that several words share, that toxic texts have far more
often and surely so. Its terms stand in a trie. A word of a text is read as a Levenshtein automaton, whose
states are bit sets of the places in the word for each number of errors; walking the trie with it finds all terms within the
allowed distance at once. Words are counted by the different words before them, so that copies of a text count once. Each hit is weighed by the words around it: quoted or reported speech weighs little, direct
address more. A logistic model over the weighed hits of a text gives its score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, without

#: Labelled texts used for fitting at most, and terms of the lexicon at most.
MAX_FIT, MAX_TERMS = 40_000, 5_000
#: A term is so many times likelier in toxic texts at least, and its log-likelihood ratio (G) is at least this.
MIN_RATIO, MIN_G = 6.0, 24.0
#: Letters of a stem, and the share of its uses in toxic texts that one of its words may make.
STEM, ONE_WORD = (3, 12), 0.5
#: Letters from which a word may have one error, and two.
ONE_ERROR, TWO_ERRORS = 5, 8
#: What a misspelt hit counts of an exact one, words looked at on either side of a hit, and their weights.
MISSPELT, WINDOW = 0.7, 6
QUOTED, REPORTED, ADDRESSED = 0.4, 0.1, 1.25
RIDGE, THRESHOLD = 0.05, 0.7
CACHE = 400_000
OWN = ["score", "predicted"]
#: Fixed marks and words.
EDGES = ".,;:!?\"'()[]{}<>|“”„«»‹›‘’…#*$%&@~^_=+-/\\"
OPENING, CLOSING = frozenset("\"“„«‹‘'"), frozenset("\"”“»›’'")
REPORTING = frozenset("said says say saying called calls call quote quoted quotes quoting word words term terms wrote writes reported sagte sagt nannte wort zitat schrieb dit disait appelé mot citation écrit dijo dice llamó palabra cita escribió".split())
ADDRESS = frozenset("you your you're youre ur du dich dir dein deine ihr euch tu toi te vous votre tú usted ustedes vosotros eres".split())


def words_of(text: str | None) -> list[str]:
    """Words between white space, lower-cased, without marks at their ends; one of marks only is empty."""
    return [w.strip(EDGES) for w in (text or "").lower().split()]


class Lexicon:
    """Whole words and stems in a trie, and the search for a word's terms."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], usual: Iterable[str] = ()):
        """``usual``: words near a term that are no misspelling of it."""
        self.words, self.usual = frozenset(words), frozenset(usual)
        self.root: dict = {}
        self.longest = 0
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: dict[tuple[int, int], set[str]] = {}
        self.stems: dict[int, set[str]] = {}
        for term in self.words:
            self._add(term, errors_in(term))
            self._parts(term, errors_in(term))
        for term in stems:
            self._add(term, -1)
            self.stems.setdefault(len(term), set()).add(term)

    def _add(self, term: str, errors: int) -> None:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
            if errors >= 0:  # errors allowed below, and the words' lengths
                most, least, longest = node.get(" ", (0, len(term), 0))
                node[" "] = (max(most, errors), min(least, len(term)), max(longest, len(term)))
        node[""] = (term, errors)
        self.longest = max(self.longest, len(term))

    def _parts(self, term: str, errors: int) -> None:
        """Of so many parts plus one, one at least is whole in a word with so many errors."""
        if not errors:
            return
        n = len(term) // (errors + 1)
        self.heads.setdefault(n, set()).add(term[:n])
        rest = term[n:]
        if errors == 2:
            self.middles.setdefault((n, n), set()).add(rest[:n])
            rest = rest[n:]
        self.tails.setdefault(len(rest), set()).add(rest)

    def _may_match(self, word: str) -> bool:
        """Whether some part of a term stands where it would, so that most words never meet the trie."""
        return (
            any(word[:n] in s for n, s in self.stems.items())
            or any(word[:n] in s for n, s in self.heads.items())
            or any(word[-n:] in s for n, s in self.tails.items())
            or any(word[i : i + n] in s for (at, n), s in self.middles.items() for i in range(max(0, at - 2), at + 3))
        )

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance; a stem fits any word that begins with it. Equal distances: the longer term, then by the alphabet."""
        if word in self.words:
            return word, 0
        if not word or word in self.usual or not self._may_match(word):
            return None
        found = self.search(word)
        return min(found, key=lambda f: (f[1], -len(f[0]), f[0]), default=None)

    def search(self, word: str, most: int = 2) -> list[tuple[str, int]]:
        """``(term, distance)`` of all terms in reach, by walking trie and automaton together."""
        word = word[: self.longest + most + 1]  # what is longer fits stems only
        n = len(word)
        end, full = 1 << n, (1 << (n + 1)) - 1
        has: dict[str, int] = {}
        for i, c in enumerate(word):
            has[c] = has.get(c, 0) | 1 << i
        start = [(1 << (e + 1)) - 1 & full for e in range(most + 1)]  # e letters of the word left out
        out: list[tuple[str, int]] = []
        todo = [(self.root, start, 0)]
        while todo:
            node, state, depth = todo.pop()
            for c, child in node.items():
                if c == " ":
                    continue
                if not c:
                    term, errors = child
                    if errors < 0:
                        if state[0] >> depth & 1:
                            out.append((term, 0))
                    else:
                        d = next((e for e in range(errors + 1) if state[e] & end), None)
                        if d is not None:
                            out.append((term, d))
                    continue
                fits = has.get(c, 0)
                new = [(state[0] & fits) << 1]
                for e in range(1, most + 1):
                    # the letter fits; or it is one too many, or another one; or a letter of the word is left out
                    new.append(((state[e] & fits) << 1 | state[e - 1] | state[e - 1] << 1 | new[e - 1] << 1) & full)
                if new[0]:
                    todo.append((child, new, depth + 1))
                elif " " in child:
                    errors, least, longest = child[" "]
                    if least - errors <= n <= longest + errors and any(new[1 : errors + 1]):
                        todo.append((child, new, depth + 1))
        return out


def errors_in(term: str) -> int:
    return 0 if len(term) < ONE_ERROR else 1 if len(term) < TWO_ERRORS else 2


def context_weight(raw: list[str], words: list[str], i: int) -> float:
    """How much a hit at word ``i`` says, from the words around it."""
    lo, hi = max(0, i - WINDOW), min(len(raw), i + WINDOW + 1)
    opens = lambda j: raw[j].lstrip("([")[:1] in OPENING
    closes = lambda j: raw[j].rstrip(".,;:!?)]")[-1:] in CLOSING
    # to the left the nearest mark must open a quotation, to the right it must close one
    left = next((j for j in range(i, lo - 1, -1) if opens(j) or j < i and closes(j)), None)
    right = next((j for j in range(i, hi) if closes(j) or j > i and opens(j)), None)
    opened = left is not None and (left == i or not closes(left))
    closed = right is not None and (right == i or not opens(right))
    around = words[lo:hi]
    if opened and closed:
        return REPORTED if any(w in REPORTING for w in around) else QUOTED
    return ADDRESSED if any(w in ADDRESS for w in around) else 1.0


@dataclass
class Model:
    """Terms with their log ratios, words that only look like them, and the weights of the features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    usual: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [math.log(0.01 / 0.99), 0.0, 0.0, 0.0])

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A model in use: finds the hits of texts and scores them, with what it has learnt about words so far."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.words, model.stems, model.usual)
        self.value = {**model.stems, **model.words}
        self.known: dict[str, tuple[str, int] | None] = {}

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, str, str, int, float]]]:
        """Number of words, and ``(place, word, term, distance, weight)`` of each hit."""
        words = words_of(text)
        known, hot = self.known, {}
        for w in set(words):
            if w in known:
                f = known[w]
            else:
                if len(known) > CACHE:
                    known.clear()
                f = known[w] = self.lexicon.find(w)
            if f:
                hot[w] = f
        if not hot:
            return len(words), []
        raw = (text or "").split()
        return len(words), [(i, w, *hot[w], context_weight(raw, words, i)) for i, w in enumerate(words) if w in hot]

    def features(self, text: str | None) -> tuple[float, float, float]:
        n, found = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        e = sum(self.value[term] * weight * (MISSPELT if d else 1.0) for _, _, term, d, weight in found)
        return math.log1p(e), math.log1p(100 * e / (n + 1)), 1.0

    def score(self, text: str | None) -> float:
        return self.scores([self.features(text)])[0]

    def scores(self, rows: list[tuple[float, float, float]]) -> list[float]:
        z = np.array([(1.0, *r) for r in rows]).reshape(-1, 4) @ np.array(self.model.weights)
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9).tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic model by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _telling(n1: int, n0: int) -> tuple[str, str]:
    """SQL columns ``lr`` and ``g`` of a term used ``a`` times in toxic texts and ``b`` times in others, of so many uses of all words."""
    n = n1 + n0
    part = lambda c, m: f"case when {c} > 0 then {c} * ln({c} * {n}D / ((a + b) * {m}D)) else 0D end"
    return f"ln((a + 0.5D) / {n1 + 1}) - ln((b + 0.5D) / {n0 + 1}) as lr", f"2 * ({part('a', n1)} + {part('b', n0)}) as g"


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Learn lexicon and weights from the texts of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks.

    At most about ``max_fit`` labelled ids are used, chosen by their hash. A word is used once for each different word before it, in toxic and in
    other texts, so a text of many copies says no more than one. Uses are counted by a grouping; the driver gets the terms, the usual words near them, and three numbers per text.
    """
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = lab.count()
    if n > max_fit:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_fit / n * (1 << 30)))
    lab = lab.select(F.col("doc_id").alias("_nextdist_id"), F.col("toxic").alias("_nextdist_y"))
    x = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("_nextdist_id"))  # ``max_fit`` rows
    x = saved(x.select("text", F.col("_nextdist_y").alias("y")), "toxic-train")
    if x.select("y").distinct().count() < 2:
        return Model()

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = [w for w in words_of(text.as_py()) if w]
                pairs = {(w, zlib.crc32(before.encode("utf-8", "replace"))) for before, w in zip(["", *words], words, strict=False)}
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([h for _, h in pairs], pa.int64()), pa.array([y == 1] * len(pairs), pa.bool_())], ["w", "before", "y"])

    pairs = x.mapInArrow(uses, "w string, before long, y boolean").groupBy("w", "before").agg(F.max(F.col("y").cast("long")).alias("a"), F.max((~F.col("y")).cast("long")).alias("b"))
    counts = saved(pairs.groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-words")
    n1, n0 = (r or 0 for r in counts.agg(F.sum("a"), F.sum("b")).first())
    if not n1 or not n0:
        return Model()
    lr_g, fine = _telling(n1, n0), f"lr >= ln({MIN_RATIO}D) and g >= {MIN_G}D"
    words = {r.w: r.lr for r in counts.selectExpr("w", *lr_g).where(fine).orderBy(F.desc("g"), "w").limit(MAX_TERMS).collect()}
    prefix = F.explode(F.expr(f"transform(sequence({STEM[0]}, least(length(w), {STEM[1]})), k -> substring(w, 1, k))"))
    stems = counts.where(f"length(w) >= {STEM[0]}").select(prefix.alias("w"), "a", "b").groupBy("w").agg(F.max("a").alias("most"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    stems = stems.where(f"most < {ONE_WORD}D * a").selectExpr("w", *lr_g).where(fine).orderBy(F.desc("g"), "w").limit(MAX_TERMS).collect()
    kept: dict[str, float] = {}
    inner: set[str] = set()  # all beginnings of stems that are kept
    for r in stems:  # of stems that are parts of each other, the surest
        begins = {r.w[:k] for k in range(STEM[0], len(r.w) + 1)}
        if r.w not in inner and not begins & kept.keys():
            kept[r.w] = r.lr
            inner |= begins
    words = {w: lr for w, lr in words.items() if not any(w[:k] in kept for k in range(STEM[0], len(w) + 1))}
    terms = (list(words), list(kept))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*terms)
        for b in batches:
            yield b.filter(pa.array([(f := lexicon.find(w)) is not None and f[1] > 0 for w in b.column("w").to_pylist()], pa.bool_()))

    # words that clean texts have and toxic ones hardly more often are words of their own
    alike = counts.mapInArrow(near, "w string, a long, b long").where("b > 0").selectExpr("w", *lr_g).where(f"lr < ln({MIN_RATIO}D)")
    model = Model(words, kept, sorted(r.w for r in alike.collect()))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for b in batches:
            rows = [reader.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]], ["y", "f0", "f1", "f2"])

    rows = x.mapInArrow(featured, "y int, f0 double, f1 double, f2 double").toArrow()
    got = np.stack([c.to_numpy() for c in rows.columns], axis=1)
    got = got[np.lexsort(got.T)]  # one order, so that sums come out alike
    model.weights = fit_logistic(np.column_stack([np.ones(len(got)), got[:, 1:]]), (got[:, 0] == 1).astype(float)).tolist()
    return model


_HIT = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("place", T.IntegerType()), ("word", T.StringType()), ("term", T.StringType()), ("distance", T.IntegerType()), ("weight", T.DoubleType()))]))


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None, hits: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Score every row of ``docs(text, ...)``.

    Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to the columns ``keep`` (default: all), and with ``hits`` an array
    of ``(place, word, term, distance, weight)``. Rows are read whole and on their own, so nothing is shuffled; the model goes to every task.

    Nulls: a null text is an empty one, and an empty text has the score of a text without hits. Repeated rows are scored alike. An
    empty table gives an empty result. Input columns named like a result are replaced.
    """
    own = [*OWN, "hits"] if hits else OWN
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *([T.StructField("hits", _HIT)] if hits else [])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for b in batches:
            texts = [t.as_py() for t in b.column("_nextdist_text")]
            scores = reader.scores([reader.features(t) for t in texts])
            cols = [*b.columns[1:], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            if hits:
                names = _HIT.elementType.names
                kind = pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string()), ("term", pa.string()), ("distance", pa.int32()), ("weight", pa.float64())]))
                cols.append(pa.array([[dict(zip(names, h, strict=True)) for h in reader.hits(t)[1]] for t in texts], kind))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *own])

    return without(docs, own).select(F.col("text").alias("_nextdist_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt from: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
