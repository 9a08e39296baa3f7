"""Merkle manifest of a dataset: leaves, subroots per language, one root, a proof per row.

A row's leaf is the SHA-256 of its fields, each written as byte count, colon, value (`-` if null).
Per group (language) leaves stand in the order of their ids; while several nodes remain, every two
consecutive ones become their hash, the last run being one node where their number is odd. The subroots of the groups, in the order of their names (null first), give the root likewise.

How a level is done: a row carries the node that begins at it. At level l these are the rows whose
place is a multiple of 2^l, so a node's sibling stands exactly 2^l rows before or after: `lag` and
`lead` of that fixed offset give it, masked by the node's slot in its run and by the run's length, and
the first child's row hashes the parent. A running "last value" hands each node's siblings on to all
rows under it.

How it stays small: places come from a range-partitioned, written table (rank in the file's partition
plus the rows of the group in earlier partitions), so no group is ever numbered in one task. Windows are
cut into blocks of `2 ** LEVELS` places, all levels of a block using one shuffle and one sort. The tops of the
blocks are the leaves of the next round, and its siblings are joined to the rows by (group, block),
the partitioning the rows already have. A group that holds a third of all rows is just more blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored

# Levels done in one round; a window holds 2 ** LEVELS rows.
LEVELS = 10



def field(value: Column, text: bool) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value if text else value.cast("long").cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 (lower-case hex) of the five fields of a document."""
    return F.sha2(
        F.concat(field(doc_id, False), field(source, True), field(lang, True), field(n_chars, False), field(text, True)),
        256,
    )


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def placed(nodes: DataFrame, name: str, *order: str) -> DataFrame:
    """`nodes`, which has a column `grp`, with `pos` (from 0 within `grp`, by `order`) and `n` of the group.

    Rows are dealt out by ranges of (grp, order) and written with their number in the partition, so the
    numbers are fixed before anything is derived from them; equal rows may change places.
    """
    keys = ["grp", *order]
    numbered = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_seq", F.monotonically_increasing_id()
    )
    dealt = stored(
        numbered.withColumns({"_part": F.shiftright("_seq", 33), "_at": F.col("_seq").bitwiseAND(F.lit(2**33 - 1))}).drop("_seq"), name
    )
    runs = dealt.groupBy("_part", "grp").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_part", "grp", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        F.sum("_rows").over(Window.partitionBy("grp")).alias("n"),
    )
    at = F.col("_base") + F.col("_at") - F.col("_first")
    return dealt.join(starts, ["_part", "grp"]).withColumn("pos", at).drop("_part", "_at", "_first", "_base")


def block_siblings(nodes: DataFrame, levels: int) -> DataFrame:
    """One round: `nodes` (grp, pos, n, h, ...) with block, steps (siblings inside the block) and top.

    `top` is the node that a block of 2 ** levels places becomes, `left` the nodes the group then has.
    """
    block = Window.partitionBy("grp", "block").orderBy("pos")
    rows = nodes.withColumns(
        {"block": F.shiftright("pos", levels), "left": F.expr(f"(n + {2**levels - 1}) div {2**levels}")}
    )
    rows = rows.withColumns({"h0": F.col("h")})
    for level in range(levels):
        here, size = F.col(f"h{level}"), 2**level
        slot = F.shiftright("pos", level).bitwiseAND(F.lit(1))
        # Nodes of the group at this level; the round ends early where only one is left.
        many = F.expr(f"(n + {size - 1}) div {size}")
        begins = F.pmod("pos", F.lit(size)) == 0
        rows = rows.withColumns({"_lag": F.lag(here, size).over(block), "_lead": F.lead(here, size).over(block)})
        before = F.when(slot == 1, F.col("_lag")).otherwise(F.lit(""))
        runs_on = F.shiftright("pos", level) + 1 < many
        after = F.when((slot == 0) & runs_on, F.col("_lead")).otherwise(F.lit(""))
        rows = rows.withColumn(
            f"s{level}", F.when(begins & (many > 1), F.struct(before.alias("before"), after.alias("after")))
        )
        # The parent stands at its first child's row; a group of one node is passed on as it is.
        parent = F.when(begins & (slot == 0), F.when(many > 1, hashed(here, F.col(f"s{level}.after"))).otherwise(here))
        rows = rows.withColumn(f"h{level + 1}", parent)
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = {f"s{level}": F.last(f"s{level}", ignorenulls=True).over(so_far) for level in range(levels)}
    rows = rows.withColumns({**handed, "top": F.last(f"h{levels}", ignorenulls=True).over(so_far)})
    steps = F.filter(F.array(*[F.col(f"s{level}") for level in range(levels)]), lambda s: s.isNotNull())
    return rows.withColumn("steps", steps).drop("_lag", "_lead", *[f"{c}{i}" for i in range(levels) for c in "hs"], f"h{levels}")


def climbed(nodes: DataFrame, name: str) -> DataFrame:
    """`nodes` (grp, pos, n, h, ...) with steps, all siblings up to the group's top, and `top`.

    Rounds go on until every group is one node: the number of rounds is the logarithm of the largest
    group, and each round has 2 ** LEVELS times fewer rows than the one before.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels = min(LEVELS, max(1, (largest - 1).bit_length()))
    once = stored(block_siblings(nodes, levels), f"{name}-blocks")
    if largest <= 2**levels:
        return once.drop("block", "left")
    tops = once.filter(F.pmod("pos", F.lit(2**levels)) == 0).select(
        "grp", F.col("block").alias("pos"), F.col("left").alias("n"), F.col("top").alias("h")
    )
    above = climbed(tops, f"{name}-up").select(
        "grp", F.col("pos").alias("block"), F.col("steps").alias("_above"), F.col("top").alias("_top")
    )
    joined = once.join(above, ["grp", "block"]).withColumns(
        {"steps": F.concat("steps", "_above"), "top": F.col("_top")}
    )
    return joined.drop("block", "left", "_above", "_top")


def folded(first: Column, steps: Column) -> Column:
    """The hash that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, first, lambda acc, s: hashed(s["before"], acc, s["after"]))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of the siblings, from the leaf up; of nothing if there are none."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """`leaves` (grp_name, doc_id, leaf, ...) with subroot, root and steps: the siblings up to the
    root, level by level, as structs of what stands before and after in the run, '' if nothing does.

    Groups are ordered by name, null first, then by unsigned UTF-8 bytes; leaves by doc_id, null first,
    equal ids by their leaf. Names of other columns must not be grp, pos, n, h, block, left, top or
    begin with an underscore.
    """
    # Null sorts before every name, and an ordinary key joins faster than a null-safe one.
    grp = F.coalesce(F.concat(F.lit("="), F.col("grp_name")), F.lit(""))
    at = placed(leaves.withColumns({"grp": grp, "h": F.col("leaf")}), "leaves", "doc_id", "leaf")
    inner = climbed(at, "tree").drop("pos", "n", "h").withColumnRenamed("top", "subroot")
    subroots = inner.groupBy("grp").agg(F.first("subroot").alias("h"))
    groups = placed(
        subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), "groups", "name"
    )
    outer = climbed(groups, "top").select(
        F.col("name").alias("grp"), F.col("top").alias("root"), F.col("steps").alias("_outer")
    )
    return inner.join(outer, "grp").withColumn("steps", F.concat("steps", "_outer")).drop("grp", "_outer")


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of `docs` (doc_id, source, lang, n_chars, text): one row per row of it.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. folded_root is what a reader gets
    who holds the row, with n_chars one larger where 7 divides the CRC-32 of the id, and the original
    siblings; `verified` tells whether it is the root. Null ids are no number and so never changed.
    Repeated rows are leaves of their own. Other columns are not looked at; an empty table has an empty
    manifest.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0
    doc_id, source, lang, n_chars, text = own
    made = leaf(doc_id, source, lang, n_chars, text)
    other = F.when(changed & n_chars.isNotNull(), leaf(doc_id, source, lang, n_chars.cast("long") + 1, text))
    leaves = stored(
        docs.select(
            doc_id.cast("long").alias("doc_id"), lang.alias("grp_name"), made.alias("leaf"), other.alias("changed_leaf")
        ),
        "leaf-hashes",
    )
    tree = manifest(leaves)
    end = folded(F.coalesce("changed_leaf", "leaf"), F.col("steps"))
    done = tree.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), end.alias("folded_root")
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
