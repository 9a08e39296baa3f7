"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

1. Folding. Words are lower-cased, look-alike letters of other scripts become Latin ones, digits and
   signs that stand for letters become these, and i and l become one letter, as 1 and | stand for both.
2. Lexicon. Terms are whole words or word beginnings of 3 to 6 letters. A term's evidence is the number
   of toxic documents that have it or, if that is smaller, of different neighbourhoods (word before, word
   after) it was seen in there: copies of one document, however many, are one neighbourhood. Against it
   stands the larger of both numbers in clean documents. The weight is the lower bound of the log odds.
   A few words known beforehand are terms as long as the labels do not contradict.
3. Exceptions. A phrase of a term and a neighbour that stands mostly in clean documents is learned as an
   exception, next to a given list; a term inside an exception does not count.
4. Score. One automaton of all terms and exceptions passes over the folded text; the summed weights per
   hundred words (with `PRIOR_WORDS` added, so that a short text is not condemned for one word) go
   through a logistic curve, corrected for how the two labels were sampled.

Lexicon, exceptions and curve are fitted on at most `fit_rows` labelled documents of each label, chosen
by the hash of their ids; their size depends on that bound, not on the corpus. Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored

# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs written for a letter.
STAND_INS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "+": "t",
}
# English insults that are terms without being learned.
KNOWN = (
    "bastard clown creep disgusting dumb dumbass fool idiot idiotic imbecile jerk loser moron moronic "
    "pathetic scum scumbag stupid trash ugly vermin worthless"
).split()
# Harmless phrases that contain one of them.
HARMLESS = (
    "circus clown", "class clown", "clown fish", "dumb bell", "fool proof", "idiot proof", "knee jerk",
    "pathetic fallacy", "trash bag", "trash bin", "trash can", "ugly duckling",
)

KNOWN_WEIGHT = 2.0
PRIOR_WORDS = 20
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!|+][^\W_]+)*")
SHORTEST, LONGEST = 3, 6
CACHED = 400_000


class Folder:
    """Folded words of a text; the forms of words already met are remembered."""

    def __init__(self):
        self._known: dict[str, str] = {}
        self._alike = str.maketrans(LOOK_ALIKES)
        self._signs = str.maketrans(STAND_INS)

    def word(self, word: str) -> str:
        """One lower-case word. Foreign letters are folded if all are look-alikes or some are Latin."""
        if not word.isascii():
            plain = word.translate(self._alike)
            if plain.isascii() or any("a" <= c <= "z" for c in word):
                word = plain
        if not word.isalpha() and any(map(str.isalpha, word)):
            word = word.translate(self._signs)
        return word.replace("l", "i")

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if len(self._known) > CACHED:
            self._known.clear()
        if not text.isascii():
            text = text.translate(HIDDEN)
        known, made = self._known, []
        for w in WORD.findall(text.lower()):
            f = known.get(w)
            if f is None:
                f = known[w] = self.word(w)
            made.append(f)
        return made


def terms_of(word: str) -> list[str]:
    """The word itself, marked by a blank at its end, and its beginnings."""
    return [word + " ", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


class Matcher:
    """Automaton over terms and exceptions; sums the weights of terms outside exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(" " + term, (len(term) + 1, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in the words joined by blanks, with a blank before and behind."""
        if not words or not len(self.automaton):
            return []
        found = [(end - size + 1, end, w) for end, (size, w) in self.automaton.iter(f" {' '.join(words)} ")]
        spared = [(a, b) for a, b, w in found if w is None]
        return [h for h in found if h[2] is not None and not any(a <= h[0] and h[1] <= b for a, b in spared)]


def chosen(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(label, text) of at most `fit_rows` documents of each label; labels is (doc_id, label)."""
    ids = None
    for label in (0, 1):
        some = labels.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        ids = some if ids is None else ids.unionByName(some)
    # At most 2 * fit_rows ids.
    ids = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label")))
    rows = docs.join(ids, F.col("doc_id") == F.col("_id")).select(F.col("_label").alias("label"), "text")
    # The sample is small, but every word of it is looked at: deal it out to all cores.
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return stored(rows, "toxicity-sample")


def evidence(sample: DataFrame) -> DataFrame:
    """(term, a, b): see the head of this module."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for batch in batches:
            terms, around = [], []
            for text in batch["text"]:
                w = fold(text)
                own_terms, own_places = [], []
                for before, word, after in set(zip(["", *w], w, [*w[1:], ""])):
                    made = terms_of(word)
                    own_terms += made
                    # 63 bits, so that the hash is a non-negative long.
                    own_places += [xxhash.xxh3_64_intdigest(f"{before} {after}".encode("utf-8", "surrogatepass")) >> 1] * len(made)
                terms.append(own_terms)
                around.append(own_places)
            yield pd.DataFrame({"label": batch["label"], "terms": terms, "around": around})

    rows = sample.mapInPandas(seen, "label int, terms array<string>, around array<long>")
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    pairs = rows.select("label", "doc", F.explode(F.arrays_zip("terms", "around")).alias("t"))
    counted = pairs.groupBy("label", F.col("t.terms").alias("term")).agg(
        F.approx_count_distinct("doc", 0.1).alias("docs"), F.approx_count_distinct("t.around", 0.1).alias("places")
    )
    toxic = F.col("label") == 1
    return counted.groupBy("term").agg(
        F.coalesce(F.max(F.when(toxic, F.least("docs", "places"))), F.lit(0)).alias("a"),
        F.coalesce(F.max(F.when(~toxic, F.greatest("docs", "places"))), F.lit(0)).alias("b"),
    )


def log_odds(a: float, b: float, n1: int, n0: int, errors: float) -> float:
    """Log odds of a term in a toxic against a clean document, less `errors` standard errors."""
    middle = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    return middle - errors * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def most_telling(found: dict[str, tuple[int, float]]) -> set[str]:
    """Of terms (support, weight) that begin one another, the ones to keep.

    A beginning gives way to longer ones, or whole words, if one of them tells more or has four fifths
    of its support; otherwise it stands for all that begin with it.
    """
    longer: dict[str, tuple[int, float]] = {}
    for term, (n, weight) in found.items():
        for k in range(SHORTEST, len(term)):
            most, best = longer.get(term[:k], (0, -math.inf))
            longer[term[:k]] = max(most, n), max(best, weight)
    kept: set[str] = set()
    for term in sorted(found, key=lambda t: (len(t), t)):
        if any(term[:k] in kept for k in range(SHORTEST, len(term))):
            continue
        n, weight = found[term]
        most, best = longer.get(term, (0, -math.inf))
        if most < 0.8 * n and best <= weight:
            kept.add(term)
    return kept


def lexicon(found: dict[str, tuple[int, int]], n1: int, n0: int, least: float, errors: float) -> dict[str, float]:
    """Weights of the terms that the labels support, and of known ones they do not contradict."""
    bound = {t: log_odds(a, b, n1, n0, errors) for t, (a, b) in found.items()}
    kept = most_telling({t: (found[t][0], w) for t, w in bound.items() if w >= least})
    weights = {t: bound[t] for t in kept}
    fold = Folder()
    for word in KNOWN:
        term = fold.word(word) + " "
        if any(term[:k] in weights for k in range(SHORTEST, len(term) + 1)):
            continue
        a, b = found.get(term, (0, 0))
        weight = KNOWN_WEIGHT if a + b < 5 else min(KNOWN_WEIGHT, log_odds(a, b, n1, n0, 1.0))
        if weight > 0:
            weights[term] = weight
    return weights


def phrases(sample: DataFrame, matcher: Matcher) -> DataFrame:
    """(phrase, a, b): toxic and clean documents of the sample with a term and its neighbour."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for batch in batches:
            made = []
            for text in batch["text"]:
                w = fold(text)
                starts = np.cumsum([1, *(len(x) + 1 for x in w)])
                own = set()
                for begin, _, _ in matcher.hits(w):
                    i = int(np.searchsorted(starts, begin + 1))
                    own.update(" ".join(w[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(w) - 1)
                made.append(sorted(own))
            yield pd.DataFrame({"label": batch["label"], "found": made})

    rows = sample.mapInPandas(near, "label int, found array<string>").select("label", F.explode("found").alias("phrase"))
    return rows.groupBy("phrase").agg(
        F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")
    )


def measure(sum_of_weights: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the curve takes: logarithm of the weight per hundred words."""
    return np.log(100 * sum_of_weights / (n_words + PRIOR_WORDS) + 0.05)


# Intercept and slope where labels are missing: one known word in twenty is more likely toxic than not.
UNFITTED = (0.0, 1.0)


def curve(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and (never negative) slope of a logistic curve, by Newton steps halved until they help."""
    if not 0 < y.sum() < len(y):
        return UNFITTED
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.array([math.log(y.sum() / (len(y) - y.sum())), 0.0])

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float((np.logaddexp(0, m) - y * m).sum() + ridge * b[1] ** 2 / 2)

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - ridge * np.array([0.0, beta[1]])
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-9, ridge])
        step = np.linalg.solve(h, gradient)
        while (new := loss(beta + step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if not new < now - 1e-12 * abs(now):
            break
        beta, now = beta + step, new
    return (float(beta[0]), float(beta[1])) if beta[1] > 0 else (math.log(y.sum() / (len(y) - y.sum())), 0.0)


def sums(texts: DataFrame, matcher: Matcher, first: str, kind: str) -> DataFrame:
    """(`first`, weight, n_words, n_hits) per row of `texts`, which has `first` and text."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for batch in batches:
            words = [fold(t) for t in batch["text"]]
            hits = [matcher.hits(w) for w in words]
            yield pd.DataFrame(
                {
                    first: batch[first].astype("Int64"),
                    "weight": [float(sum(w for _, _, w in h)) for h in hits],
                    "n_words": [len(w) for w in words],
                    "n_hits": [len(h) for h in hits],
                }
            )

    return texts.mapInPandas(go, f"{first} {kind}, weight double, n_words long, n_hits long")


class Model:
    """Lexicon weights, exceptions and the curve from weight per hundred words to a probability."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], intercept: float, slope: float):
        self.weights, self.exceptions = weights, exceptions
        self.intercept, self.slope = intercept, slope

    def matcher(self) -> Matcher:
        return Matcher(self.weights, self.exceptions)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, least: float = 1.5, errors: float = 3.0) -> Model:
    """`docs` is (doc_id, text), `labels` (doc_id, label) with one row per id and labels 0 and 1."""
    totals = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = chosen(docs, labels, fit_rows)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # What can never reach the bound, and is not asked for as a known word, stays on the executors.
    fold = Folder()
    known = [fold.word(w) + " " for w in KNOWN]
    odds = F.log((F.col("a") + 0.5) * (n0 + 1) / ((F.col("b") + 0.5) * (n1 + 1)))
    telling = evidence(sample).filter((odds >= least) | F.col("term").isin(known))
    found = {r.term: (r.a, r.b) for r in telling.collect() if r.term in known or log_odds(r.a, r.b, n1, n0, errors) >= least}
    weights = lexicon(found, n1, n0, least, errors)
    harmless = [" ".join(map(fold.word, p.split())) for p in HARMLESS]
    learned = phrases(sample, Matcher(weights, harmless)).filter((F.col("b") >= 5) & (F.col("b") * n1 >= 3 * F.col("a") * n0))
    harmless += sorted(r.phrase for r in learned.collect())
    rows = sums(sample, Matcher(weights, harmless), "label", "int").collect()
    x = measure(np.array([r.weight for r in rows]), np.array([r.n_words for r in rows]))
    intercept, slope = curve(x, np.array([float(r.label) for r in rows]))
    if n1 and n0:
        intercept += math.log(totals[1] / totals[0]) - math.log(n1 / n0)
    return Model(weights, harmless, intercept, slope)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1), predicted (score >= 0.5), weight, n_words, n_hits.

    Null and empty texts have no terms and get the score of a text without any. Null ids are kept,
    repeated rows are scored alike, and other columns are not looked at.
    """
    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = sums(asked, model.matcher(), "doc_id", "long")
    x = F.log(100 * F.col("weight") / (F.col("n_words") + PRIOR_WORDS) + 0.05)
    score = 1 / (1 + F.exp(-(model.intercept + model.slope * x)))
    return found.select(
        "doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "weight", "n_words", "n_hits"
    )


def held_out(doc_id) -> "F.Column":
    """Rows whose labels must not be learned from: one in five by the CRC-32 of the id; never null."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000) -> DataFrame:
    """Scores of all `docs`, learned from `labels` (doc_id, toxic) of rows that are not held out.

    Null labels and ids teach nothing; of several labels of one id the larger counts. Without any
    label the known words alone are the lexicon and `UNFITTED` is the curve.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("label")
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(own, known, fit_rows)
    return scored(own, model).withColumn("held_out", held_out(F.col("doc_id")))
