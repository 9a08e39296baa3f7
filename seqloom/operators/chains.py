"""Labels, heads and ranks for a set of disjoint chains and cycles (a successor graph).

Contraction: in each round a node leaves its list when a hash of its id is larger than that of both
neighbours, which removes about a third of the nodes and never two adjacent ones. The leaving node
tells its neighbours about each other. Expansion plays the rounds back and hands label and rank from
each node to the node that left next to it. Every step is a group-by on ids that receive at most
three rows, so no key is ever hot, however long a chain is, and the total work is linear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.scan import dense_index, scan
from seqloom.storage import BROADCAST_ROWS, Scratch, dealt, lookup

# Stands for "no neighbour" inside the steps, as SQL text: the smallest LONG. Tables of links with
# this id are refused, so no list can lose a node to it.
NONE = "(-9223372036854775807L - 1L)"

# Levels of the expansion that are planned together.
LEVELS_PER_PLAN = 8


# The steps are SQL text: a round is one expression, and building it column by column would cost
# the driver more time than a small round takes to run.

# The round is the column r, not a literal, so that all rounds share one compiled plan.
LEAVES = (
    f"(prv <> {NONE} AND xxhash64(id, r) > xxhash64(prv, r)"
    f" AND (nxt = {NONE} OR xxhash64(id, r) > xxhash64(nxt, r)))"
)
FINISHED = f"(nxt = id OR (nxt = {NONE} AND prv = {NONE}))"
OPEN = f"(gone IS NULL AND NOT {FINISHED})"


def _row(id, prv="N", new_prv="N", nxt="N", new_nxt="N", dp="0L", low="N", gone="N") -> str:
    values = {
        "id": id, "prv": prv, "new_prv": new_prv, "nxt": nxt, "new_nxt": new_nxt, "dp": dp,
        "low": low, "gone": gone, "r": "r + 1",
    }
    null = "CAST(NULL AS BIGINT)"
    return "named_struct(" + ", ".join(f"'{k}', {null if v == 'N' else v}" for k, v in values.items()) + ")"


def _kept(gone: str) -> str:
    return _row("id", prv="prv", nxt="nxt", dp="dp", low="low", gone=gone)


TO_PRV = _row("prv", new_nxt="nxt", low="low")
TO_NXT = _row("nxt", new_prv="prv", dp="dp")


def _sent(stays: str, log: str) -> str:
    return (
        f"inline(CASE WHEN {stays} THEN array({_kept('gone')}) "
        f"WHEN nxt = {NONE} THEN array({log}{TO_PRV}) ELSE array({log}{TO_PRV}, {TO_NXT}) END)"
    )


SEND = _sent(f"NOT {LEAVES}", "")
SEND_AND_CARRY = _sent(f"NOT {LEAVES} OR NOT {OPEN}", _kept("r") + ", ")
MEET = (
    "coalesce(max(new_prv), max(prv)) AS prv",
    "coalesce(max(new_nxt), max(nxt)) AS nxt",
    "sum(dp) AS dp",
    "min(low) AS low",
    "max(gone) AS gone",
    "max(r) AS r",
)


def _contract(state: DataFrame, carry: bool) -> DataFrame:
    """One round: kept nodes stay, leaving nodes become messages to their neighbours.

    With `carry`, rows that are gone or finished stay in the table (column `gone` is the round a node
    left in), so that several rounds can follow each other before anything is stored.
    """
    sent = state.selectExpr(SEND_AND_CARRY if carry else SEND)
    return sent.groupBy("id").agg(*[F.expr(m) for m in MEET])


def _rounds_at_once(open_nodes: int) -> int:
    """Large states are stored after each round; small ones cost less to carry than to store."""
    return 1 if open_nodes > 200_000 else 4 if open_nodes > 30_000 else 8


def _handed(id: str, rank: str) -> str:
    return (
        f"named_struct('id', {id}, 'label', label, 'circuit', circuit, 'head', head, "
        f"'is_cycle', is_cycle, 'rank', {rank})"
    )


HAND_ON = (
    f"inline(CASE WHEN child IS NULL THEN array({_handed('id', 'rank')}) "
    f"ELSE array({_handed('id', 'rank')}, {_handed('child', 'rank + d')}) END)"
)


def _expand(known: DataFrame, left: DataFrame) -> DataFrame:
    """Give the nodes that left in one round the values of the neighbour they left to.

    At most one node leaves to each neighbour, so both sides of the join have unique keys.
    """
    child = left.selectExpr("prv AS parent", "id AS child", "dp AS d")
    return known.join(dealt(child), F.expr("id = parent"), "left").selectExpr(HAND_ON)


COLUMNS = ("id", "label", "circuit", "head", "rank", "is_cycle")


def trace_chains(
    links: DataFrame, scratch: Scratch, columns: tuple[str, ...] = COLUMNS, keep_result: bool = False
) -> DataFrame:
    """(id, label, circuit, head, rank, is_cycle) for links (id, prv, nxt), NULL for no neighbour.

    `label` is the smallest id of the chain, `circuit` the dense rank of that label, `head` the first
    node of a path (for a cycle, the node its ranks count from), `rank` the distance from the head.
    A column `dp` in `links` gives the distance from prv to id, else it is 1. A column `low` gives the smallest
    id that a node stands for, else it is its own.
    The result reads tables of `scratch`; with `keep_result` it is written and outlives them.
    """
    distance = "dp" if "dp" in links.columns else "1L"
    low = "low" if "low" in links.columns else "id"
    state = links.selectExpr(
        f"if(id = {NONE}, raise_error('the smallest LONG cannot be the id of a node'), id) AS id",
        f"coalesce(prv, {NONE}) AS prv",
        f"coalesce(nxt, {NONE}) AS nxt",
        f"CASE WHEN prv IS NULL THEN 0L ELSE {distance} END AS dp",
        f"{low} AS low",
        "CAST(NULL AS BIGINT) AS gone",
        "0L AS r",
    )
    stored, open_nodes = scratch.write_counting(state, F.expr(OPEN))
    found = []
    left: list[DataFrame] = []  # per round: the nodes that left, with the neighbour they left to
    ended = lambda t: t.where(f"gone IS NULL AND {FINISHED}").selectExpr("id", "low", f"prv <> {NONE} AS is_cycle")
    while open_nodes:
        before, at_once = stored, _rounds_at_once(open_nodes)
        state = _contract(before.where(OPEN), carry=False)
        inside = []
        for _ in range(at_once - 1):
            state = _contract(state, carry=True)
            inside.append(len(left) + 1 + len(inside))
        stored, open_nodes = scratch.write_counting(state, F.expr(OPEN))
        if at_once == 1:
            # Of a large state only these rows are read again, and the rest is in the next state too.
            # (States that hold rows of rounds inside a plan are small and stay.)
            read_again = scratch.write(before.where(f"gone IS NULL AND ({FINISHED} OR {LEAVES})"))
            scratch.drop(before)
            before = read_again
        left.append(before.where(OPEN).where(LEAVES))
        found.append(ended(before))
        left.extend(stored.where(F.col("gone") == r) for r in inside)
    found.append(ended(stored))
    roots = scratch.write(reduce(DataFrame.unionByName, found))
    # A root takes part in no later round, so all roots can be known from the last round on.
    known = scratch.write(dense_index(roots, ["low"], out="circuit")).selectExpr(
        "id", "low AS label", "circuit", "id AS head", "is_cycle", "0L AS rank"
    )
    for r in range(len(left) - 1, -1, -1):
        known = _expand(known, left[r].select("id", "prv", "dp"))
        if r and r % LEVELS_PER_PLAN == 0:
            known = scratch.write(known)
    known = known.select(*columns)
    return scratch.write(known, keep=True) if keep_result else known


def retrace_chains(chains: DataFrame, changed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, head, rank, is_cycle) after some nodes got other successors.

    `chains` is a result of `trace_chains`, `changed` has (eid, s) and permutes the successors of its
    nodes. The old chains are cut after each changed node; only the segments between the cuts are
    traced again, and every node takes its new place from its segment.
    """
    rows = changed.count()
    cuts = changed.select("eid", F.lit(1).cast("long").alias("cut"))
    cut_at = lookup(chains, cuts, "id", "eid", "left")
    cut_at = cut_at.select(
        "id", "head", "rank", "is_cycle", F.coalesce("cut", F.lit(0).cast("long")).alias("cut")
    )
    if rows > BROADCAST_ROWS:
        cut_at = scratch.write(cut_at)
    # Segments are told apart by the number of cuts before them.
    placed = scratch.write(
        scan(cut_at, "cut", ["head", "rank"], out="cuts").select(
            F.struct("head", "cuts").alias("segment"), "id", "rank", "is_cycle"
        )
    )
    segments = scratch.write(
        placed.groupBy("segment").agg(
            F.min("rank").alias("low"),
            F.max("rank").alias("high"),
            F.min_by("id", "rank").alias("first"),
            F.max_by("id", "rank").alias("last"),
            F.max("is_cycle").alias("is_cycle"),
        )
    )
    moved = changed.select(F.col("eid").alias("last"), "s", F.lit(True).alias("moved"))
    onward = (
        F.when(F.col("moved"), F.col("s"))
        .when(F.col("is_cycle"), F.col("segment.head"))
        .alias("nxt")
    )
    out = scratch.write(
        segments.join(dealt(moved), "last", "left").select(
            F.col("first").alias("id"), onward, (F.col("high") - F.col("low") + 1).alias("size")
        )
    )
    back = out.where(F.col("nxt").isNotNull()).select(
        F.col("nxt").alias("id"), F.col("id").alias("prv"), F.col("size").alias("dp")
    )
    links = out.select("id", "nxt").join(dealt(back), "id", "left")
    traced = trace_chains(links, scratch, ("id", "head", "rank", "is_cycle")).select(
        F.col("id").alias("first"), F.col("head").alias("new_head"), F.col("rank").alias("offset"),
        F.col("is_cycle").alias("in_cycle"),
    )
    place = scratch.write(
        segments.select(F.col("segment").alias("_segment"), "first", "low")
        .join(dealt(traced), "first")
        .select(
            "_segment", F.col("new_head").alias("head"), (F.col("offset") - F.col("low")).alias("shift"),
            F.col("in_cycle").alias("is_cycle"),
        )
    )
    met = lookup(placed.select("segment", "id", "rank"), place, "segment", "_segment", "inner")
    return met.select("id", "head", (F.col("rank") + F.col("shift")).alias("rank"), "is_cycle")
