"""Language of texts: scripts narrow the candidates, Viterbi over words labels spans.

The model is learned from labelled texts: for every language how often each script and each
trigram (of a word with its two ends, counted per occurrence of the word) is met. It is fitted on at most about `per_language` texts of a language, chosen by a hash of
their id, and keeps the `max_grams` most frequent trigrams, so its size is bounded and it can go to
every task.

A word's score for a language is the sum of log probabilities of its trigrams, relative to the best
language and cut at `floor`, as one odd word should not outweigh a paragraph. Only languages that
use the word's script are candidates. The best path through the words of a text pays `penalty` for
each change of language; runs of one label are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored, words

# First and last code points of scripts; all other letters count as "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)

NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)


_FIRST = np.array(sorted(first for _, first, _ in SCRIPTS))
_LAST = np.array([last for _, _, last in sorted(SCRIPTS, key=lambda x: x[1])])
_NAME = np.array([NAMES.index(name) for name, _, _ in sorted(SCRIPTS, key=lambda x: x[1])])


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Numbers in NAMES of the scripts of code points."""
    at = np.searchsorted(_FIRST, points, side="right") - 1
    return np.where((at >= 0) & (points <= _LAST[at]), _NAME[at], len(NAMES) - 1)


def letters_of(word: str) -> str:
    """The letters of a word, lower case."""
    low = word.lower().strip(".,;:!?()\"'")
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of at least one letter between end marks: trigrams as numbers, where each word's
    begin, and the first letters. A word has as many trigrams as letters."""
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32)
    points = points.astype(np.int64)
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    inside = (points[:-2] != 3) & (points[1:-1] != 3)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    firsts = points[starts + 2 * np.arange(len(words)) + 1]
    return grams[inside], starts, firsts


def _held_part(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_words(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, word, n) over a sample by hash of at most about `per_language` texts of a language."""
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    # A written table shows its few bytes, so texts are not dealt out by language to be joined.
    share = stored(share, "language-shares")
    drawn = (F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit(2**40 - 1))) / float(2**40)
    return (
        rows.join(share, "lang")
        .filter(drawn < F.col("share"))
        .select("lang", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class LanguageModel:
    """Scores of words; small enough to go to every task."""

    def __init__(self, languages: list[str], grams: dict[int, np.ndarray], scripts: np.ndarray,
                 floor: float, penalty: float):
        self.languages, self.floor, self.penalty = languages, floor, penalty
        keys = sorted(grams)
        counts = np.array([*[grams[g] for g in keys], np.zeros(len(languages))])
        totals = counts.sum(axis=0) + 0.5 * len(counts)
        self.keys = np.array(keys, np.int64)
        self.logs = (np.log(counts + 0.5) - np.log(totals)).astype(np.float32)  # last row: unseen
        # A language uses a script if a hundredth of its letters are in it.
        used = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= 0.01
        used[:, ~used.any(axis=0)] = True
        self.outside = np.where(used.T, 0.0, -1e6).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores by language of words that have letters (as `letters_of` gives), best 0."""
        grams, starts, firsts = trigrams(words)
        at = np.searchsorted(self.keys, grams)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != grams] = len(self.keys)
        total = np.add.reduceat(self.logs[at], starts, axis=0)
        total += self.outside[scripts_of(firsts)]
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total, np.float32(-self.floor))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = 2000, max_grams: int = 60_000, floor: float = 12.0,
        penalty: float = 25.0) -> LanguageModel | None:
    """Learn from rows with a text and a language; None if there are none.

    Words are counted per language in Spark; tasks turn these counts into trigram counts, which are
    summed, ranked and cut to `max_grams` before they come to the driver.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter("doc_id is not null and text is not null and lang is not null")
    counted = training_words(rows, per_language)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(word=batch["word"].map(letters_of))
            for lang_, rows in batch[batch["word"] != ""].groupby("lang"):
                grams, starts, _ = trigrams(list(rows["word"]))
                sizes = np.diff(np.append(starts, len(grams)))
                n = np.repeat(rows["n"].to_numpy(np.int64), sizes)
                letters = scripts_of((grams >> 21) & (2**21 - 1))
                keys, inverse = np.unique(np.append(grams, -1 - letters), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, inverse, np.append(n, n))
                yield pd.DataFrame({"lang": lang_, "gram": keys, "n": sums})

    # Scripts come along as negative numbers; there are few of them and they sort first.
    sums = (
        counted.mapInPandas(cut, "lang string, gram long, n long")
        .groupBy("gram", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("gram")
        .agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n"))
    )
    kept = sums.orderBy((F.col("gram") < 0).desc(), F.desc("n"), "gram").limit(max_grams)
    found = kept.select("gram", "by").collect()
    languages = sorted({x["lang"] for row in found for x in row["by"]})
    if not languages:
        return None
    at = {name: i for i, name in enumerate(languages)}
    scripts = np.zeros((len(languages), len(NAMES)))
    grams: dict[int, np.ndarray] = {}
    for row in found:
        counts = np.zeros(len(languages))
        for x in row["by"]:
            counts[at[x["lang"]]] += x["n"]
        if row["gram"] < 0:
            scripts[:, -1 - row["gram"]] = counts
        else:
            grams[row["gram"]] = counts
    return LanguageModel(languages, grams, scripts, floor, penalty)


def best_paths(scores: np.ndarray, which: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Label of every word, texts one after the other from `starts`; `which` picks rows of `scores`.

    Texts go forward in step, longest first, so each step is one set of array operations over the
    texts that are not at their end.
    """
    n, k = len(which), scores.shape[1]
    labels = np.zeros(n, np.int16)
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    begin, size = starts[order], sizes[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    switched = np.zeros((n, k), bool)
    before = np.zeros(n, np.int16)
    value = scores[which[begin]].copy()
    for t in range(1, int(size[0])):
        m = alive[t]
        value = value[:m]
        best = value.argmax(axis=1)
        limit = value[np.arange(m), best][:, None] - penalty
        here = begin[:m] + t
        change = value < limit
        switched[here] = change
        before[here] = best
        value = np.where(change, limit, value) + scores[which[here]]
        # Ends of texts that stop here are read off below, from their last values.
        if t + 1 == size[0] or alive[t + 1] < m:
            gone = slice(alive[t + 1] if t + 1 < size[0] else 0, m)
            labels[here[gone]] = value[gone].argmax(axis=1)
    short = size == 1
    labels[begin[short]] = scores[which[begin[short]]].argmax(axis=1)
    last = begin + size - 1
    state = labels[last].copy()
    for back in range(1, int(size[0])):
        m = alive[back]
        here = last[:m] - back + 1
        state = state[:m]
        state = np.where(switched[here, state], before[here], state)
        labels[here - 1] = state
    return labels


class Labeller:
    """Spans of texts under a model; remembers the scores of the words it has met."""

    def __init__(self, model: LanguageModel | None):
        self.model = model
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, len(model.languages) if model else 1), np.float32)

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the rows in the table of its words, -1 for words without a letter."""
        known, get = self._known, self._known.get
        if len(known) > CACHED_WORDS:
            known.clear()
            self._table = self._table[:0]
        fresh: list[str] = []
        base = len(self._table)
        out = []
        for text in texts:
            found = (text or "").split()
            numbers = [get(w) for w in found]
            if None in numbers:
                for i, number in enumerate(numbers):
                    if number is None:
                        w = found[i]
                        number = get(w)
                        if number is None:
                            letters = letters_of(w)
                            number = known[w] = base + len(fresh) if letters else -1
                            if letters:
                                fresh.append(letters)
                        numbers[i] = number
            out.append(np.array(numbers, np.int32))
        if fresh:
            scored = [self.model.scores(fresh[i : i + 50_000]) for i in range(0, len(fresh), 50_000)]
            self._table = np.concatenate([self._table, *scored])
        return out

    def __call__(self, texts: list[str | None]) -> list[list[tuple[str, int, int, int]]]:
        """Per text its spans (language, first word, words, words with letters).

        Words without letters join the span before them, or the first one.
        """
        if self.model is None or not texts:
            return [[] for _ in texts]
        numbers = self._numbers(texts)
        counts = np.array([len(x) for x in numbers])
        every = np.concatenate(numbers)
        real = every >= 0
        bounds = np.append(0, np.cumsum(counts))
        before = np.append(0, np.cumsum(real))
        labels = best_paths(self._table, every[real], before[bounds[:-1]], self.model.penalty)
        positions = np.flatnonzero(real)
        out = []
        for i in range(len(texts)):
            a, b = before[bounds[i]], before[bounds[i + 1]]
            own = labels[a:b]
            if not len(own):
                out.append([])
                continue
            cuts = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            firsts = positions[a:b][cuts] - bounds[i]
            firsts[0] = 0
            ends = np.append(firsts[1:], counts[i])
            sizes = np.diff(np.append(cuts, len(own)))
            names = [self.model.languages[own[c]] for c in cuts]
            out.append(list(zip(names, firsts.tolist(), (ends - firsts).tolist(), sizes.tolist())))
        return out


CACHED_WORDS = 500_000

# Texts are labelled together up to so many characters: long enough to share the cost of a step.
CHARS_AT_ONCE = 16_000_000

SPANS = "spans array<struct<lang:string,first_word:long,n_words:long,n_scored:long>>"


def detect(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row of `docs`, from the text alone.

    lang_pred is the language of most words with letters (ties: the first name), score their share.
    Null texts, texts without letters and all texts without a model: `und`, score 0, no spans.
    Repeated rows give repeated rows; other columns are not looked at.
    """

    def rows(keys: list, spans_of: list) -> pd.DataFrame:
        out = []
        for key, spans in zip(keys, spans_of):
            share: dict[str, int] = {}
            for lang, _, _, n in spans:
                share[lang] = share.get(lang, 0) + n
            if share:
                top = min(share, key=lambda x: (-share[x], x))
                named = [dict(zip(("lang", "first_word", "n_words", "n_scored"), s)) for s in spans]
                out.append((key, top, share[top] / sum(share.values()), named))
            else:
                out.append((key, "und", 0.0, []))
        made = pd.DataFrame(out, columns=["doc_id", "lang_pred", "score", "spans"])
        return made.astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(model)
        keys: list = []
        texts: list = []
        held = 0
        for batch in batches:
            for key, body in zip(batch["doc_id"], batch["text"]):
                keys.append(key)
                texts.append(body)
                held += len(body or "")
                if held >= CHARS_AT_ONCE:
                    yield rows(keys, label(texts))
                    keys, texts, held = [], [], 0
        yield rows(keys, label(texts))

    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return asked.mapInPandas(run, f"doc_id long, lang_pred string, score double, {SPANS}")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                parts: int = 4, held: int = 2, **fitting) -> DataFrame:
    """Fit on rows whose crc32 of doc_id is not `held` modulo `parts`, then label all rows.

    held_out is false for a null doc_id; such rows are not learned from either.
    """
    part = _held_part(F.col(doc_id), parts)
    model = fit(docs.filter(part != held), doc_id, text, lang, **fitting)
    out = detect(docs, model, doc_id, text)
    return out.select(
        "doc_id",
        F.coalesce(_held_part(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "spans",
    )
