"""Correction of reads by the spectrum of their words.

Words that hold a sequencing error are rare, all others occur about as often as the reads cover their
place. The valley between both in the histogram of counts parts weak words from solid ones. A wrong base
makes the words over it weak: a run of weak windows, whose first and last place tell where the base is.
Every run proposes its one or two positions with the three other bases, and a proposal is accepted if it
turns all words solid that only this position can mend.

Runs of windows meet the weak words by minimizer, and only the words of proposals are looked up in the counts; the
reads themselves are moved once more, to be written with their repairs. Rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.operators.superwords import gathered, places_of_words
from seqloom.operators.words import word_counts
from seqloom.storage import Scratch


def valley(counts: DataFrame) -> int:
    """The smallest count from which words are solid: the first minimum of the histogram.

    The histogram has a row per count that occurs, with empty ones between them counting as 0. If the
    number of words never rises again, or there are none, it is 1: every word is solid.
    """
    spectrum = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("words"))
    order = Window.orderBy("cnt")  # a row per count: at most the root of twice the windows
    near = spectrum.withColumns({"next": F.lead("cnt").over(order), "more": F.lead("words").over(order)})
    # Where the next count is missing, the valley is just behind this one.
    gap = F.col("next") > F.col("cnt") + 1
    low = F.when(gap, F.col("cnt") + 1).when(F.col("more") > F.col("words"), F.col("cnt"))
    found = near.agg(F.min(low).alias("at"), F.min("cnt").alias("least")).first()
    return int(found["at"]) if found["at"] is not None else 1


def weak_runs(reads: DataFrame, counts: DataFrame, length: int, solid: int) -> DataFrame:
    """(read_id, first, last, windows): runs of neighbouring weak windows on the forward strand.

    A wrong word can occur elsewhere and then is not weak, the more often the more words there are. A few
    solid windows between weak ones therefore do not end a run.
    """
    weak = counts.filter(F.col("cnt") < solid).select("lmer")
    at = places_of_words(reads, weak, length)
    order = Window.partitionBy("read_id").orderBy("pos")
    before = F.lag("pos").over(order)
    begins = (before.isNull() | (F.col("pos") - before > length // 2 + 1)).cast("long")
    numbered = at.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(order))
    runs = numbered.groupBy("read_id", "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    sizes = reads.select("read_id", (F.octet_length("seq") - length + 1).cast("long").alias("windows"))
    return runs.join(sizes, "read_id").select("read_id", "first", "last", "windows")


def proposals(runs: DataFrame, length: int) -> DataFrame:
    """(read_id, place, low, high): bases that may be wrong and the windows that only they make weak.

    A single wrong base has its last window beginning at the base itself and its first one length - 1
    before it. A shorter run ends with the read, or where wrong words happen to occur elsewhere, at either
    end: every base that all its windows cover is proposed, with all windows over it, so that no repair
    rests on the few words of a short run alone. In a longer run the first and the last wrong base are
    proposed, each with the windows that the other cannot reach.
    """
    size = F.col("last") - F.col("first") + 1
    early, late = F.col("first") + length - 1, F.col("last")
    span = F.lit(length)
    one = lambda place, low, high: F.struct(
        place.cast("long").alias("place"), low.cast("long").alias("low"), high.cast("long").alias("high")
    )
    over = lambda place: one(
        place, F.greatest(place - (length - 1), F.lit(0)), F.least(place, F.col("windows") - 1)
    )
    two = F.array(
        one(early, F.col("first"), F.least(F.col("first") + length - 1, F.col("last") - length)),
        one(late, F.greatest(F.col("last") - length + 1, F.col("first") + length), F.col("last")),
    )
    made = F.when(size <= span, F.transform(F.sequence(late, early), over)).otherwise(two)
    made = F.filter(made, lambda p: p["place"] < F.col("windows") + length - 1)
    return runs.select("read_id", F.explode(made).alias("p")).select("read_id", "p.*").distinct()


def repairs(reads: DataFrame, asked: DataFrame, counts: DataFrame, length: int, solid: int) -> DataFrame:
    """(read_id, place, base): accepted proposals; of several bases the one with the best weakest word.

    Ties between bases leave the place as it is.
    """
    met = asked.join(reads.select("read_id", F.col("seq").cast("binary").alias("_bytes")), "read_id")
    old = enc.base_code(F.substring("_bytes", F.col("place").cast("int") + 1, F.lit(1)).cast("string"))
    part = F.substring("_bytes", F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int") + length)
    cut = met.select(
        "read_id", "place", "low", "high", old.alias("_old"), enc.forward_digits(part).alias("_digits")
    ).withColumn("base", F.explode(F.array(*[F.lit(b) for b in range(4)]))).filter("base != _old")
    inside = (F.col("place") - F.col("low")).cast("int")
    digits = F.overlay("_digits", F.col("base").cast("string"), inside + 1)
    cut = cut.withColumn("_digits", digits.cast("binary")).withColumn(
        "_off", F.explode(F.sequence(F.lit(0), (F.col("high") - F.col("low")).cast("int")))
    )
    word = F.substring("_digits", F.col("_off") + 1, F.lit(length)).cast("string")
    tried = cut.select("read_id", "place", "base", enc.pack_digits(word).alias("lmer"))
    known = counts.filter(F.col("cnt") >= solid).select("lmer", "cnt")
    tested = tried.join(known, "lmer", "left").groupBy("read_id", "place", "base").agg(
        F.min(F.coalesce("cnt", F.lit(0))).alias("weakest")
    )
    best = tested.filter(F.col("weakest") >= solid).groupBy("read_id", "place").agg(
        F.max("weakest").alias("top"), F.max_by("base", "weakest").alias("base"),
        F.sort_array(F.collect_list("weakest"), asc=False).alias("_all"),  # three at most
    )
    return best.filter((F.size("_all") == 1) | (F.get("_all", F.lit(0)) > F.get("_all", F.lit(1)))).select(
        "read_id", "place", "base"
    )


def rewritten(reads: DataFrame, fixes: DataFrame, max_positions: int) -> DataFrame:
    """`reads` with their repairs; a read with more than `max_positions` of them stays as it is."""
    letter = F.substring(F.lit(enc.BASES), F.col("base") + 1, F.lit(1))
    # Counted before they are collected, so that no row holds more than the bound.
    few = fixes.groupBy("read_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_positions)
    by_read = fixes.join(few.select("read_id"), "read_id", "left_semi").groupBy("read_id").agg(
        F.sort_array(F.collect_list(F.struct("place", letter.alias("letter")))).alias("_fixes")
    )
    put = F.aggregate(
        F.col("_fixes"),
        F.col("seq").cast("binary"),
        lambda text, f: F.concat(
            F.substring(text, F.lit(1), f["place"].cast("int")),
            f["letter"].cast("binary"),
            F.substring(text, f["place"].cast("int") + 2, F.length(text)),
        ),
    )
    seq = F.when(F.col("_fixes").isNull(), F.col("seq")).otherwise(put.cast(reads.schema["seq"].dataType))
    return reads.join(by_read, "read_id", "left").withColumn("seq", seq).select(*reads.columns)


def correct_reads(reads: DataFrame, length: int, solid: int | None = None, max_positions: int = 4,
                  rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """`reads` (read_id, seq, ...) with wrong bases repaired; all rows and columns stay.

    `length` is the word length, `solid` the least count of a word that is believed (by default the
    valley of the first counts), `max_positions` the most bases repaired in a read by a round. Reads shorter than a word,
    null ones and rows without an id stay as they are. Ids must tell reads apart; reads are byte
    buffers, repaired bases are written as A, C, G, T.
    """
    own = scratch or Scratch(reads.sparkSession, "correction")
    least = solid
    for _ in range(rounds):
        known = reads.select("read_id", "seq").filter(F.col("read_id").isNotNull() & (F.octet_length("seq") >= length))
        known = own.write(gathered(known, length))
        counts = own.write(word_counts(known, length))
        least = valley(counts) if least is None else least
        if least <= 1:
            break
        runs = own.write(weak_runs(known, counts, length, least))
        fixes, found = own.write_counting(repairs(known, proposals(runs, length), counts, length, least), F.lit(True))
        if not found:
            break
        reads = own.write(rewritten(reads, fixes, max_positions), keep=True)
    own.drop_all()
    return reads
