"""Distribution divergence: documents against the references of their language.

Two histograms are taken of every text: its character classes, and its common words plus one cell
for all other words. The same histograms, summed over all documents of a language that pass the
base rules, are the references. A document is rejected if the Jensen-Shannon distance (base 2,
square root, so 0 to 1) to either reference is above its limit; the character rule needs `min_chars`
characters and the word rule `min_words` words, in the document and a hundred times as many in the
reference. Shorter documents and languages without a reference are not judged by that rule.

A text without any common word is only as far from its reference as the common words' share of that
makes it, 0.36 where they have a quarter, and a short sound text is nearly as far, as few words
scatter over many cells. So lack of common words has a rule of its own, on two cells, all common
words and all others, which scatter little: a document with a smaller share of common words than its
language is rejected if its distance over these is above `lack` times that of a text with none. It
holds where the document would have `min_hits` common words or more at its language's share.

Everything is column expressions: one pass makes a narrow table of counts per document (stored),
its sums by language are the references, and one join by language brings them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import stored, words

# Function words whose shares make the word histogram, by the language they are common in.
COMMON_WORDS = {
    "en": "the of and to a in is that it was for on are as with this be by at from or an not but he have",
    "de": "der die und in zu den das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ce il",
    "es": "de la que el en y a los del se las por un para con no una su al lo como pero sus le o",
}

# Character classes, counted in what is left of a text without small letters and blanks; all other
# characters are small letters, blanks or the rest.
CLASSES = {"digit": "0123456789", "stop": ".,;:!?", "symbols": "#*$%&|<>"}
UPPER = "\\P{Lu}+"
PLAIN = "[\\p{Ll}\\x20\\x09-\\x0D]+"
N_CLASSES = len(CLASSES) + 4


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Adds `_twice`: sorted starts of the three-word windows of `_w` that occur twice or more.

    A window is the 64-bit hash of its words. Only rows in which a hash occurs twice go on: there a
    window becomes one LONG, its hash shifted by as many bits as a position of this row needs, and
    the position. Sorting these brings equal windows side by side with their places; the fewer hash
    bits of long texts are made up for by comparing the whole hashes of neighbours.
    """
    pair = lambda a, b: F.xxhash64(a, b)
    n = F.size("_w")
    rows = rows.select(
        "*",
        F.when(
            n >= 3,
            F.slice(
                F.zip_with(
                    F.zip_with("_w", F.slice("_w", F.lit(2), n), pair),
                    F.slice("_w", F.lit(3), n),
                    pair,
                ),
                F.lit(1),
                n - 2,
            ),
        ).alias("_h"),
        F.ceil(F.log2(n + 1)).cast("int").alias("_bits"),
    )
    window = lambda i: F.get("_h", i)
    left = lambda x: F.call_function("shiftleft", x, F.col("_bits"))
    right = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    rows = rows.select(
        "*",
        F.sort_array(
            F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.transform("_h", lambda h, i: left(h).bitwiseOR(i.cast("long"))),
            )
        ).alias("_s"),
        F.expr("shiftleft(1L, _bits) - 1").alias("_mask"),
    )
    place = lambda i: F.get("_s", i).bitwiseAND(F.col("_mask")).cast("int")
    rows = rows.select(
        "*",
        F.filter(
            F.when(F.size("_s") >= 2, F.sequence(F.lit(1), F.size("_s") - 1)),
            lambda j: right(F.get("_s", j)) == right(F.get("_s", j - 1)),
        ).alias("_near"),
    )
    rows = rows.select(
        "*",
        F.filter("_near", lambda j: window(place(j)) == window(place(j - 1))).alias("_same"),
    )
    return rows.select(
        "*",
        F.sort_array(
            F.array_union(
                F.transform("_same", lambda j: place(j)),
                F.transform("_same", lambda j: place(j - 1)),
            )
        ).alias("_twice"),
    ).drop("_h", "_bits", "_s", "_mask", "_near", "_same")


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                common: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """Per document the base counts, the class counts and the counts of common words.

    Null and empty texts have no words and no lines. Other columns of `docs` are ignored. A word is
    repeated if a window of three words around it occurs twice in the text.
    """
    known = sorted({w for row in common.values() for w in row.split()})
    forms = known + [w.capitalize() for w in known]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    rows = rows.select(
        "*",
        words(F.col("_text")).alias("_w"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_full"),
        F.regexp_replace("_text", PLAIN, "").alias("_odd"),
    )
    rows = rows.select(
        "doc_id", "lang", "_w",
        F.length("_text").cast("long").alias("n_chars"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.length("_odd").cast("long").alias("n_odd"),
        F.length(F.regexp_replace("_odd", UPPER, "")).cast("long").alias("n_upper"),
        *[
            (F.length("_odd") - F.length(F.translate("_odd", own, ""))).cast("long").alias(f"n_{name}")
            for name, own in CLASSES.items()
        ],
        F.sort_array(
            F.transform(F.filter("_w", lambda w: w.isin(forms)), lambda w: F.lower(w))
        ).alias("_common"),
    )
    rows = repeated_windows(rows).select(
        "*",
        F.filter(
            F.when(F.size("_common") > 0, F.sequence(F.lit(0), F.size("_common") - 1)),
            lambda i: (i == 0) | (F.get("_common", i) != F.get("_common", i - 1)),
        ).alias("_starts"),
    )
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_chars",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_odd",
        "n_upper",
        *[f"n_{name}" for name in CLASSES],
        F.transform(
            "_starts",
            lambda i, j: F.struct(
                F.get("_common", i).alias("w"),
                (F.coalesce(F.get("_starts", j + 1), F.size("_common")) - i)
                .cast("long")
                .alias("n"),
            ),
        ).alias("common"),
    )
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _classes() -> list[Column]:
    counted = [F.col("n_upper"), *[F.col(f"n_{name}") for name in CLASSES]]
    blanks = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_odd") - sum(counted[1:], counted[0])
    return [*counted, blanks, rest, F.col("word_chars") - F.col("n_odd")]


def _pair(p: Column, q: Column) -> Column:
    """What a cell with shares p and q adds to twice the divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def references(sound: DataFrame) -> DataFrame:
    """One row per language: class sums, word sums, and the sum of each common word.

    The list of words of a row is bounded by the number of common words.
    """
    sums = sound.groupBy("lang").agg(
        F.array(*[F.sum(c) for c in _classes()]).alias("ref_classes"),
        F.sum("n_words").alias("ref_words"),
    )
    listed = (
        sound.select("lang", F.explode("common").alias("c"))
        .groupBy("lang", F.col("c.w").alias("w"))
        .agg(F.sum("c.n").alias("n"))
        .groupBy("lang")
        .agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("ref_common"))
    )
    return sums.join(listed, "lang", "left")


def typical(counts: DataFrame, accuracy: int = 1000) -> DataFrame:
    """Documents to build references from: they pass the base rules and, for each character class,
    have at most twice the share that three quarters of their language's documents have.

    Junk is a minority, but it would lend its symbols and capitals to sums over all documents.
    """
    sound = counts.filter(F.col("lang").isNotNull() & ~F.col("base_failed"))
    shares = {f"_p{i}": c / F.col("n_chars") for i, c in enumerate(_classes())}
    sound = sound.withColumns(shares)
    usual = stored(
        sound.groupBy(F.col("lang").alias("_lang")).agg(
            *[F.percentile_approx(p, 0.75, accuracy).alias(f"_q{p}") for p in shares]
        ),
        "usual-shares",
    )
    rows = sound.join(usual, F.col("lang") == F.col("_lang"))
    for p in shares:
        rows = rows.filter(F.col(p) <= 2 * F.col(f"_q{p}"))
    return rows.select(counts.columns)


def judged(counts: DataFrame, refs: DataFrame, max_class: float, max_word: float, min_chars: int,
           min_words: int, lack: float = 0.7, min_hits: int = 10) -> DataFrame:
    """Distances to the references (null where a guard holds) and the verdict."""
    rows = counts.join(refs, "lang", "left")
    rows = rows.withColumns(
        {
            "_c": F.array(*_classes()),
            "_ref_chars": F.aggregate("ref_classes", F.lit(0).cast("long"), lambda a, x: a + x),
            "_hits": F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x["n"]),
            "_ref_hits": F.aggregate(
                F.map_values("ref_common"), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        }
    )
    rows = rows.withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    by_class = sum(
        (
            _pair(F.get("_c", F.lit(i)) / F.col("n_chars"), F.get("ref_classes", F.lit(i)) / F.col("_ref_chars"))
            for i in range(1, N_CLASSES)
        ),
        _pair(F.get("_c", F.lit(0)) / F.col("n_chars"), F.get("ref_classes", F.lit(0)) / F.col("_ref_chars")),
    )
    share = lambda w: F.coalesce(F.element_at("ref_common", w), F.lit(0)) / F.col("ref_words")
    seen = F.aggregate(
        F.coalesce("common", F.array().cast("array<struct<w:string,n:bigint>>")),
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")),
        lambda acc, x: F.struct(
            (acc["d"] + _pair(x["n"] / F.col("n_words"), share(x["w"]))).alias("d"),
            (acc["q"] + share(x["w"])).alias("q"),
        ),
    )
    rows = rows.withColumn("_seen", seen)
    others = _pair(
        1 - F.col("_hits") / F.col("n_words"), 1 - F.col("_ref_hits") / F.col("ref_words")
    )
    # A common word that the document lacks adds its share of the reference.
    lacking = F.col("_ref_hits") / F.col("ref_words") - F.col("_seen")["q"]
    by_word = F.col("_seen")["d"] + others + F.greatest(lacking, F.lit(0.0))
    distance = lambda twice: F.sqrt(F.greatest(twice / 2, F.lit(0.0)))
    rows = rows.withColumns(
        {
            "class_distance": F.when(
                (F.col("n_chars") >= min_chars) & (F.col("_ref_chars") >= 100 * min_chars),
                distance(by_class),
            ),
            "word_distance": F.when(
                (F.col("n_words") >= min_words) & (F.col("ref_words") >= 100 * min_words),
                distance(by_word),
            ),
        }
    )
    share_of = lambda hits, n: F.col(hits) / F.nullif(F.col(n), F.lit(0))
    own, usual = share_of("_hits", "n_words"), share_of("_ref_hits", "ref_words")
    over_two = lambda p: distance(_pair(p, usual) + _pair(1 - p, 1 - usual))
    lacks = (
        F.col("word_distance").isNotNull()
        & (own < usual)
        & (F.col("n_words") * usual >= min_hits)
        & (over_two(own) > lack * over_two(F.lit(0.0)))
    )
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word
    )
    return rows.withColumn("kept", ~F.col("base_failed") & fine & ~F.coalesce(lacks, F.lit(False)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  max_class: float = 0.2, max_word: float = 0.45, min_chars: int = 300,
                  min_words: int = 50, lack: float = 0.7, min_hits: int = 10) -> DataFrame:
    """One row per row of `docs` with counts, distances and `kept`.

    Null or empty text: all counts 0, base_failed, not kept. Null language, or one whose reference
    is too short: only the base rules judge. Repeated rows give repeated rows. An empty table gives
    an empty result. Columns of `docs` other than the three named ones are not looked at.
    """
    counts = stored(base_counts(docs, doc_id, text, lang), "quality")
    # As written tables, the few rows of references show their size, and Spark can send them to all
    # tasks instead of dealing the documents out by language.
    refs = stored(references(typical(counts)), "references")
    return judged(counts, refs, max_class, max_word, min_chars, min_words, lack, min_hits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "class_distance", "word_distance", "kept",
    )
