"""Line deduplication by a segment-partition edit join.

Lines (trimmed, of at least `min_chars` characters) are grouped by a 128-bit hash first, so a line
that stands in a third of all documents is one line from then on. Two distinct lines within `edits`
edits share one of the `edits + 1` segments of the shorter one at nearly its place, if the edits are
spread as the segments are: so every line is stored under the hashes of its segments, and asks with
those substrings of itself that could be a segment of a line of its length or up to `edits`
characters less (the multi-match-aware selection of places). Both sides meet in one equi-join that
adaptive execution may split, and pairs whose character parities differ too much are left out as they
meet (an exact bound). The others are verified with a bit-parallel edit distance in a
band of 2 * edits + 1 diagonals.

Two edits are little for a long line, so lines of 25 words or more are also linked by edits of whole
words, as many as `word_edits` gives for the shorter of the two. The same join does it, with words in
place of characters: a line is stored under the segments of its own number of words, and a longer one
asks with the segments that a shorter one would have, whatever the band of its length. Lines under
`min_chars` characters are too short for edits; they are one class if they are equal.

Linked lines form classes (components); the first occurrence of a class stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.llm.common import BLANKS, stored
from seqloom.llm.graph import connected
from seqloom.llm.segments import PARITIES, chunks, wide_parities, word_codes
from seqloom.llm.shared_keys import STORED, shared_probes
from seqloom.storage import Scratch


def _trimmed(line: Column) -> Column:
    """A trim by a set of characters walks through the whole line, so only lines that need it are trimmed."""
    blank = F.lit(False)
    for c in BLANKS:
        blank = blank | line.startswith(c) | line.endswith(c)
    return F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def lines_of(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line, k1, k2) of the lines that take part, in the given rows' order."""
    return (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
        .select("doc_id", "line_no", _trimmed(F.col("line")).alias("line"))
        .filter((F.char_length("line") >= min_chars) & F.col("doc_id").isNotNull())
        .withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})
    )


def word_edits(n: int) -> int:
    """Edits of whole words allowed in a line of n words: none under 25, 1 under 50, 2 under 100, and
    2 more with every doubling, so that the keys of a line grow more slowly than the line."""
    band = (n // 25).bit_length() - 1
    return max(1, 2 * band) if band >= 0 else 0


def word_keys(words: list[str], asked: bool) -> list[int]:
    """Hashes of runs of words: see `stored_keys` and `asked_keys`. None if no edits are allowed."""
    size = len(words)
    made = set()
    for less in range(word_edits(size) + 1 if asked else 1):
        edits = word_edits(size - less)
        if not edits or less > edits:
            continue
        for i in range(edits + 1):
            at, long = _segment(size - less, i, edits)
            low, high = (max(-i, less - (edits - i)), min(i, less + (edits - i))) if asked else (0, 0)
            for start in range(max(0, at + low), min(size - long, at + high) + 1):
                made.add(_key(" ".join(words[start : start + long]), size - less, i))
    return list(made)


def word_parities(words: list[str]) -> int:
    """64 bits: whether the words of each of 64 kinds are odd in number; an edit turns two at most."""
    odd = 0
    for w in words:
        odd ^= 1 << (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & 63)
    return odd - (odd >> 63 << 64)


def near_lines(a: str, b: str, edits: int) -> bool:
    """Whether two lines are linked, by characters or by words."""
    if within(a, b, edits):
        return True
    x, y = a.split(), b.split()
    most = word_edits(min(len(x), len(y)))
    return most > 0 and within(x, y, most)


def _segment(length: int, i: int, edits: int) -> tuple[int, int]:
    """Begin and length of segment i of a line; longer segments come last."""
    short, longer = divmod(length, edits + 1)
    even = edits + 1 - longer
    return short * i + max(0, i - even), short + (i >= even)


def stored_keys(line: str, edits: int) -> list[int]:
    """Hashes under which a line is stored: each segment with its number and the line's length."""
    made = []
    for i in range(edits + 1):
        at, long = _segment(len(line), i, edits)
        made.append(_key(line[at : at + long], len(line), i))
    return made


def asked_keys(line: str, edits: int) -> list[int]:
    """Hashes a line asks with, for lines of its own length and up to `edits` characters less.

    A segment i can have been moved by at most i edits on its left, and by the rest of the edits on
    its right, so places outside both ranges cannot be the first match.
    """
    size = len(line)
    made = set()
    for less in range(edits + 1):
        for i in range(edits + 1):
            at, long = _segment(size - less, i, edits)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for start in range(max(0, at + low), min(size - long, at + high) + 1):
                made.add(_key(line[start : start + long], size - less, i))
    return list(made)


def _key(part: str, size: int, i: int) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=size << 8 | i)
    return h - (h >> 63 << 64)


def parities(lines: pd.Series) -> np.ndarray:
    """Per line 32 bits: whether the characters of each of 32 kinds are odd in number.

    An insertion or deletion turns one bit and a substitution at most two, so lines whose bits
    differ in more than 2 * edits places are not within `edits`.
    """
    sizes = lines.str.len().to_numpy(np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.bitwise_xor.reduceat(np.uint32(1) << (codes & np.uint32(31)), first).view(np.int32)


def keyed(firsts: DataFrame, edits: int, asked: bool) -> DataFrame:
    """(k1, odd, key): one row per hash a line is stored under, or asks with."""
    keys = asked_keys if asked else stored_keys

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = [keys(line, edits) for line in batch["line"]]
                yield pd.DataFrame({"k1": batch["k1"], "odd": parities(batch["line"]), "key": made})

    rows = firsts.select("k1", "line").mapInPandas(make, "k1 long, odd int, key array<long>")
    return rows.select("k1", "odd", F.explode("key").alias("key"))


def word_keyed(firsts: DataFrame, asked: bool) -> DataFrame:
    """(k1, odd, n, key): one row per hash of words a line is stored under, or asks with."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [line.split() for line in batch["line"]]
            yield pd.DataFrame(
                {
                    "k1": batch["k1"],
                    "odd": np.array([word_parities(w) for w in split], np.int64),
                    "n": np.array([len(w) for w in split], np.int32),
                    "key": [word_keys(w, asked) for w in split],
                }
            )

    # Fewer than 49 characters cannot hold 25 words.
    rows = firsts.filter(F.char_length("line") >= 49).select("k1", "line")
    rows = rows.mapInPandas(make, "k1 long, odd long, n int, key array<long>")
    return rows.select("k1", "odd", "n", F.explode("key").alias("key"))


BAND = 512


def within(a: str | list[str], b: str | list[str], edits: int) -> bool:
    """Whether `b` is at most `edits` insertions, deletions or substitutions from `a`.

    What both have in common at either end is cut off. The rest is walked along its diagonal: a
    window of 2 * edits + 1 rows moves down with each column, as bits for the vertical steps of +1
    and -1; steps outside the window count as +1, which no path of at most `edits` edits takes.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > edits:
        return False
    first = 0
    while first < m and a[first] == b[first]:
        first += 1
    while m > first and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b, m, n = a[first:m], b[first:n], m - first, n - first
    if not m:
        return n <= edits
    window = (1 << 2 * edits + 1) - 1
    middle = 1 << edits
    up = (window >> edits + 1) << edits + 1  # rows 1 to `edits` of column 0, seen from column 0
    down = 0
    score = 0
    # Per character (or word) its rows, as bits from row `base` on. The masks hold the rows that the
    # next BAND columns can reach and no more, so a step costs the same in a line of any length.
    places: dict[str, int] = {}
    base = 0
    for j, c in enumerate(b, 1):
        if (j - 1) % BAND == 0:
            places, base = {}, max(0, j - 1 - edits)
            for i, x in enumerate(a[base : j + BAND + edits]):
                places[x] = places.get(x, 0) | 1 << i
        up, down = up >> 1 | 1 << 2 * edits, down >> 1
        shift = j - 1 - edits - base
        p = places.get(c, 0)
        match = (p >> shift if shift >= 0 else p << -shift) & window
        flat = ((((match & up) + up) ^ up) | match | down) & window
        right_up = (down | ~(flat | up)) & window
        right_down = flat & up
        score += not flat & middle
        if score - (n - m) > edits:
            return False
        above = (right_up << 1 | 1) & window
        up = (right_down << 1 | ~(flat | above)) & window
        down = flat & above
    # `score` is the value in row n of the last column; row m lies n - m rows above it.
    for row in range(n - m):
        bit = middle >> row
        score += bool(down & bit) - bool(up & bit)
    return score <= edits


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of first hashes whose lines are linked; `texts` has (k1, line)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [near_lines(x, y, edits) for x, y in zip(batch["la"], batch["lb"])]
            yield batch.loc[keep, ["a", "b"]]

    la = texts.select(F.col("k1").alias("a"), F.col("line").alias("la"))
    lb = texts.select(F.col("k1").alias("b"), F.col("line").alias("lb"))
    joined = pairs.join(la, "a").join(lb, "b").select("a", "b", "la", "lb")
    return joined.mapInPandas(check, "a long, b long").distinct()


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 40, doc_id: str = "doc_id",
                 text: str = "text", short: bool = True, all_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (k1, k2, copies, first, n_links, class_first) and the links (a, b) between them.

    `first` and `class_first` are (doc_id, line_no). Links are found between first hashes: two lines
    that share a 64-bit hash but not the second one are one node, and only of the class table are
    they told apart. Lines under `min_chars` characters have no links; without `short` they take no
    part, as nulls and blank lines never do. Without `all_links` only as many links are found as the classes need:
    the classes are the same, and n_links counts these.
    """
    return _classes(docs, line_places(docs, min_chars, doc_id, text, short), edits, min_chars, doc_id, text, all_links)


def line_places(docs: DataFrame, min_chars: int, doc_id: str, text: str, short: bool) -> DataFrame:
    """(doc_id, line_no, k1, k2) of the lines that take part, stored, as the texts are split only twice."""
    return stored(lines_of(docs, 1 if short else min_chars, doc_id, text).drop("line"), "line-places")


def _classes(docs: DataFrame, places: DataFrame, edits: int, min_chars: int, doc_id: str, text: str,
             all_links: bool) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "lines")
    groups = scratch.write(
        places.groupBy("k1", "k2").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies")
        )
    )
    firsts = first_texts(scratch, lines_of(docs, min_chars, doc_id, text))
    if all_links:
        links = stored(checked(scratch, firsts, met_pairs(scratch, firsts, edits), edits), "line-links")
    else:
        links = stored(star_links(scratch, firsts, edits), "line-links")
    names = connected(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("k1")).groupBy("k1").agg(F.count(F.lit(1)).alias("n_links"))
    )
    linked = names.withColumnRenamed("node", "k1").join(degree, "k1")
    marked = groups.join(linked, "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    heads = marked.groupBy("label").agg(F.min("first").alias("class_first"))
    classes = stored(
        marked.join(heads, "label").select(
            "k1", "k2", "copies", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_first"
        ),
        "line-classes",
    )
    scratch.drop_all()
    return classes, links


def first_texts(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """(k1, line) of the distinct lines, in buckets of k1, as most texts are moved here and never again.

    A text goes once from every task that has it. Lines that share k1 but not k2 are one node with several
    texts; they hardly ever occur, so the lines are only read again for them if there are any.
    """
    shared = F.min("k2") != F.max("k2")
    seen = Observation()
    texts = lines.groupBy("k1").agg(F.first("line").alias("line"), F.first("k2").alias("k2"), shared.alias("shared"))
    firsts = scratch.write_buckets(texts.observe(seen, F.count_if("shared").alias("n")), "k1")
    if not seen.get.get("n", 0):
        return firsts.select("k1", "line")
    known = firsts.filter("shared").select("k1", F.col("k2").alias("known"))
    others = lines.join(known, "k1").filter("k2 <> known").dropDuplicates(["k1", "k2"])
    return scratch.write(firsts.select("k1", "line").unionByName(others.select("k1", "line")))


def texts_of(firsts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `firsts` whose k1 is among `ids`, which are far fewer.

    Where `firsts` is in buckets only the ids are moved; without the hint the texts would be sorted for it.
    """
    return firsts.join(ids.hint("shuffle_hash"), "k1", "left_semi")


def checked(scratch: Scratch, firsts: DataFrame, met: DataFrame, edits: int) -> DataFrame:
    """The pairs of the written table `met` that are links; only texts of their lines are moved."""
    ends = met.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    texts = scratch.write(firsts.join(ends, "k1", "left_semi"))
    return verified(met, texts, edits)


def wide(firsts: DataFrame) -> DataFrame:
    """(k1, wide): parities of more kinds than a signature has room for, a sign for each word, and a line of usual length."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["k1"].to_numpy(np.int64), batch["line"].tolist()
            for part in chunks(np.array([len(x) for x in texts], np.int64)):
                made = dict(zip(("c1", "c2", "w1", "w2", "words"), wide_parities(texts[part])))
                usual = [x if len(x) <= USUAL else None for x in texts[part]]
                yield pd.DataFrame({"k1": ids[part], **made, "signs": word_codes(texts[part]), "line": usual})

    made = "k1 long, c1 long, c2 long, w1 long, w2 long, words long, signs string, line string"
    rows = firsts.select("k1", "line").mapInPandas(make, made)
    return rows.select("k1", F.struct("c1", "c2", "w1", "w2", "words", "signs", "line").alias("wide"))


USUAL = 4096  # characters of a line that goes along whole


def may_link(x: str, y: str, edits: int) -> Column:
    """Whether what `wide` gives of two lines allows a link by characters or by words (an exact bound).

    Distances come after parities, as they take longer. An edit of a character is at most two of words,
    as a blank put in or taken out parts or joins two.
    """
    turned = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    near = lambda c, most: F.call_function("levenshtein", F.col(f"{x}.{c}"), F.col(f"{y}.{c}"), most) >= 0
    most = F.least(f"{x}.words", f"{y}.words").cast("int")
    by_chars = (turned("c1") + turned("c2") <= 2 * edits) & near("signs", F.lit(2 * edits))
    by_words = (most > 0) & (turned("w1") + turned("w2") <= 2 * most) & near("signs", most)
    return by_words | (by_chars & F.coalesce(near("line", F.lit(edits)), F.lit(True)))


def star_links(scratch: Scratch, firsts: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) whose components are those of all links, without all pairs of a group of near copies.

    Every key makes a star: the first line stored under it with all that ask for it. Then the stored line
    with most links so far takes its place; copies changed at random places are linked with the line they
    come from, which is within reach of more centres than any of them. Only lines that still are in
    different components are compared pair by pair, under keys where several lines are stored.
    """
    rows = shared_probes(scratch, firsts, edits)
    stars = rows.filter(F.col("sig").bitwiseAND(F.lit(STORED)) != 0).groupBy("key").agg(
        F.min(F.struct("k1", "sig")).alias("c"), F.count(F.lit(1)).alias("size")
    )
    room = lambda sig: F.shiftright(F.col(sig).bitwiseAND(F.lit(STORED - 1)), PARITIES)
    differ = lambda c: F.col("sig").bitwiseXOR(F.col(f"{c}.sig")).bitwiseAND(F.lit((1 << PARITIES) - 1))
    fits = lambda c: (F.col(f"{c}.k1") != F.col("k1")) & (
        F.bit_count(differ(c)) <= F.least(room("sig"), room(f"{c}.sig"))
    )
    pair = lambda c: (F.least("k1", f"{c}.k1").alias("a"), F.greatest("k1", f"{c}.k1").alias("b"))
    met = rows.join(stars, "key").filter((F.col("size") > 1) | fits("c"))
    met = scratch.write(met)
    # From here on only lines that meet another one are moved.
    near = met.select("k1").union(met.select("c.k1")).distinct()
    firsts = scratch.write(texts_of(firsts, near))
    tested = scratch.write(met.filter(fits("c")).select(*pair("c")).distinct())
    links = scratch.write(checked(scratch, firsts, tested, edits))
    # Keys with one stored line are done.
    several = met.filter("size > 1").select("key", "k1", "sig")
    held = several.filter(F.col("sig").bitwiseAND(F.lit(STORED)) != 0)
    degree = links.select(F.explode(F.array("a", "b")).alias("k1")).groupBy("k1").agg(F.count(F.lit(1)).alias("links"))
    best = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "k1", "sig")).alias("c")
    hubs = held.join(degree, "k1", "left").groupBy("key").agg(best)
    second = several.join(hubs, "key").filter(fits("c")).select(*pair("c")).distinct()
    second = scratch.write(second.join(tested, ["a", "b"], "left_anti"))
    tested = tested.unionByName(second)
    links = scratch.write(links.unionByName(checked(scratch, firsts, second, edits)))
    names = connected(links).withColumnRenamed("node", "k1")
    labelled = lambda rows: rows.join(names, "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    asking = scratch.write(labelled(several))
    mixed = asking.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("key")
    asking = scratch.write(asking.join(mixed, "key", "left_semi"))
    # These lines are few and close to each other, so that they are worth more than a signature holds: of pairs
    # that are not linked hardly one becomes a row.
    far = scratch.write(wide(firsts.join(asking.select("k1").distinct(), "k1", "left_semi")))
    asking = asking.join(far, "k1")
    holding = asking.filter(F.col("sig").bitwiseAND(F.lit(STORED)) != 0).select("key", F.struct("k1", "sig", "label", "wide").alias("c"))
    apart = asking.join(holding, "key").filter((F.col("label") != F.col("c.label")) & fits("c") & may_link("wide", "c.wide", edits))
    apart = scratch.write(apart.select(*pair("c")).distinct().join(tested, ["a", "b"], "left_anti"))
    return links.unionByName(checked(scratch, firsts, apart, edits))


def met_pairs(scratch: Scratch, firsts: DataFrame, edits: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of lines that meet under a hash and whose parities allow a link.

    The parities are a condition of the join, so that lines which share a part of a much-copied
    passage, but differ in whole words, make no rows.
    """
    own = keyed(firsts, edits, False).select(F.col("k1").alias("i"), F.col("odd").alias("odd_i"), "key")
    asked = keyed(firsts, edits, True).select(F.col("k1").alias("j"), F.col("odd").alias("odd_j"), "key")
    turned = F.bit_count(F.col("odd_i").bitwiseXOR(F.col("odd_j")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    met = own.join(asked, "key").filter((F.col("i") != F.col("j")) & (turned <= 2 * edits)).select("i", "j")
    own = word_keyed(firsts, False).select(F.col("k1").alias("i"), F.col("odd").alias("odd_i"), F.col("n").alias("n_i"), "key")
    asked = word_keyed(firsts, True).select(F.col("k1").alias("j"), F.col("odd").alias("odd_j"), F.col("n").alias("n_j"), "key")
    # Bands of `word_edits` in the join: 1 under 50 words, then 2 more with every doubling.
    band = F.floor(F.log2(F.floor(F.least("n_i", "n_j") / 25) + F.lit(1e-9)))
    most = F.greatest(F.lit(1), 2 * band)
    turned = F.bit_count(F.col("odd_i").bitwiseXOR(F.col("odd_j")))
    by_words = own.join(asked, "key").filter((F.col("i") != F.col("j")) & (turned <= 2 * most)).select("i", "j")
    met = met.unionByName(by_words)
    return scratch.write(met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())


def line_report(docs: DataFrame, edits: int = 2, min_chars: int = 40, doc_id: str = "doc_id",
                text: str = "text", short: bool = True, all_links: bool = True) -> DataFrame:
    """One row per line that takes part: doc_id, line_no, class_doc, class_line, n_links, kept.

    n_links counts the other distinct lines linked to it; kept is true where the class has its
    first occurrence (smallest doc_id, then line_no). Rows that repeat a doc_id have the same places
    and are treated alike. Empty tables give an empty result.
    """
    places = line_places(docs, min_chars, doc_id, text, short)
    classes, _ = _classes(docs, places, edits, min_chars, doc_id, text, all_links)
    return places.join(classes, ["k1", "k2"]).select(
        "doc_id", "line_no",
        F.col("class_first.doc_id").alias("class_doc"), F.col("class_first.line_no").alias("class_line"),
        "n_links",
        (F.struct("doc_id", "line_no") == F.col("class_first")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 40, doc_id: str = "doc_id",
                           text: str = "text", short: bool = False) -> DataFrame:
    """`docs` with every line taken out that is not the first of its class; all columns stay.

    Lines under `min_chars` characters go only with `short`. Documents that lose all their words go; rows that had none before, or no doc_id, stay.
    Columns may have any names: each row travels as one value.
    """
    report = line_report(docs, edits, min_chars, doc_id, text, short, all_links=False)
    by_doc = report.filter("not kept").groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.col(text).alias("old"))
    rows = rows.join(by_doc, F.col("own_id") == F.col("doc"), "left").withColumn(
        "parts", F.when(F.col("gone").isNotNull(), F.split("old", "\n"))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    rows = rows.withColumn("new", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("old")))
    rows = rows.filter(F.col("gone").isNull() | (F.length(F.btrim("new", F.lit(BLANKS))) > 0))
    return rows.select(*[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
