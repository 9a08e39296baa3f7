"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Token counts of the cells are raked: scaled
in turn so that their sums by source, by language and by topic meet the targets, until the largest
miss is below `tolerance`; a fit that ends above it is reported with a warning. A document of a cell
is then due size * fitted tokens / tokens of its cell times: as often as the whole part says, and once
more with the rest as probability. So the sample has the target mix and about `size` times the tokens
of the corpus, whatever a single rare cell asks for. The draw is a hash of the document id: the same
rows are drawn whatever the partitioning, and again after a lost executor.

Only the table of cells is iterated on. It stays in Spark, since sources may be many.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import n_words, stored
from seqloom.storage import Scratch

SIDES = ("source", "lang", "topic")


def form_of(text: Column) -> Column:
    """A coarse topic from the form of a text: tables, records, notes, verse or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (size - F.length(F.translate(text, chars, ""))) / size
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(text.contains(" | "), "table")
        .when((size < 4000) & (share("0123456789") > 0.02), "record")
        .when(size < 600, "note")
        .when(size / lines < 150, "verse")
        .otherwise("prose")
    )


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SIDES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def softened(table: DataFrame, side: str, power: float) -> DataFrame:
    """Target shares of one side: its token shares raised to `power` and made to sum to 1."""
    sums = table.groupBy(side).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("w"))
    total = sums.agg(F.sum("w")).first()[0] or 1.0
    return sums.select(side, (F.col("w") / F.lit(total)).alias("target"))


def raked(table: DataFrame, targets: dict[str, DataFrame], cycles: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """`table` with `fitted`: tokens scaled to the target shares of each side.

    A target for a name that no cell has cannot be met; the others are scaled to the rest. Cells of
    a name without a target get 0. Each cycle is one written table. If the largest miss of the last
    cycle is above `tolerance`, a RuntimeWarning gives it: the targets then contradict each other on
    the cells that there are, or need more cycles.
    """
    scratch = Scratch(table.sparkSession, "raking")
    total = table.agg(F.sum("tokens")).first()[0] or 0
    now = table.withColumn("fitted", F.col("tokens").cast("double")).withColumn("miss", F.lit(0.0))
    known = {}
    for side, target in targets.items():
        there = target.join(table.select(side).distinct(), side)
        mass = there.agg(F.sum("target")).first()[0] or 1.0
        known[side] = scratch.write(there.select(side, (F.col("target") * total / mass).alias("goal")))
    for cycle in range(cycles):
        now = now.withColumn("miss", F.lit(0.0))
        for side, goal in known.items():
            sums = now.groupBy(side).agg(F.sum("fitted").alias("have"))
            factor = sums.join(goal, side, "left").select(
                side, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("factor")
            )
            now = now.join(factor, side).withColumn("fitted", F.col("fitted") * F.col("factor"))
            now = now.withColumn("miss", F.greatest("miss", F.abs(F.col("factor") - 1))).drop("factor")
        now = scratch.write(now)
        miss = now.agg(F.max("miss")).first()[0] or 0.0
        if miss <= tolerance:
            break
    else:
        if cycles:
            warnings.warn(
                f"raking has not converged: largest miss {miss:.3g} after {cycles} cycles, tolerance {tolerance:g}",
                RuntimeWarning,
                stacklevel=2,
            )
    done = stored(now.drop("miss"), "raked")
    scratch.drop_all()
    return done


def dues(fitted: DataFrame, size: float) -> DataFrame:
    """How often each cell's documents are due: `size` times fitted over own tokens."""
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
    return fitted.select(*SIDES, (ratio * F.lit(float(size))).alias("due"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
        cycles: int = 30, tolerance: float = 1e-3, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang", topic: Column | None = None, size: float = 1.0) -> DataFrame:
    """One row per row of `docs`: doc_id, tokens, probability, sampled, copies.

    `copies` is how often the row is in the sample, `sampled` whether it is at all, `probability` the
    chance of that; the sample has about `size` times the tokens of `docs`.

    `targets` maps source, lang and topic to tables (name, target); a side that is not given takes
    the corpus' own shares softened by `powers` (below 1 lifts what is rare). Null sources and
    languages are cells of the empty name. Null, empty and blank texts have no tokens and are never
    sampled. Rows with one id share their draw; a null id draws by its text. Empty in, empty out.
    """
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.9} | (powers or {})
    topic = form_of(F.col(text)) if topic is None else topic
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            named(source).alias("source"),
            named(lang).alias("lang"),
            F.coalesce(topic, F.lit("")).alias("topic"),
            n_words(F.col(text)).alias("tokens"),
            F.coalesce(F.xxhash64(F.lit("draw"), F.col(doc_id).cast("long")), F.lit(0)).alias("_h"),
            F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("draw"), F.col(text))).alias("_t"),
        ),
        "mixing",
    )
    table = stored(cells(rows.filter("tokens > 0")), "cells")
    wanted = {side: (targets or {}).get(side) for side in SIDES}
    wanted = {s: softened(table, s, powers[s]) if t is None else t for s, t in wanted.items()}
    due = dues(raked(table, wanted, cycles, tolerance), size)
    drawn = F.shiftrightunsigned(F.coalesce("_t", "_h"), 11) / float(2**53)
    out = rows.join(due, list(SIDES), "left").withColumn(
        "due", F.when(F.col("tokens") > 0, F.coalesce("due", F.lit(0.0))).otherwise(0.0)
    )
    whole = F.floor("due")
    copies = whole + (drawn < F.col("due") - whole).cast("long")
    return out.select(
        "doc_id", "tokens", F.least("due", F.lit(1.0)).alias("probability"), (copies > 0).alias("sampled"), copies.alias("copies")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that `mix` samples, as often as it does, all columns kept."""
    asked = mix(docs, doc_id=doc_id, **options).filter("sampled and doc_id is not null")
    ids = asked.groupBy(F.col("doc_id").alias("_drawn")).agg(F.max("copies").alias("_copies"))
    rows = docs.join(ids, F.col(doc_id).cast("long") == F.col("_drawn"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return rows.withColumn("_copy", times).select(*docs.columns)
