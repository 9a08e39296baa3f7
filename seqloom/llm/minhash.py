"""Near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. One pass makes a sketch per document: the size and a 128-bit fingerprint of its shingle set, and
   `bands` band hashes over `bands * rows` bins. A shingle's hash decides its bin, the smallest hash
   stays; an empty bin copies the bin that a hash of (its number, attempt) names, attempt by attempt,
   until that one is not empty.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Documents that share a band hash form a bucket. A bucket makes a star: the member that meets most
   others in its buckets with each other member, so pairs grow with the members and not with their
   square. Copies changed at random places meet the text they come from most, so that is the centre.
4. Candidate pairs that sizes do not rule out are confirmed on the full sets.
5. A star can lose a link between two members that are not linked with its centre. So buckets in
   which members of different components remain stay open. For their members the shingles are
   counted that no member of another component has: these are in no intersection, so members with
   too many of them, and pairs whose other shingles are too few, cannot be links. This bound is
   exact and leaves out the far relatives of a large group, each of which would meet all others.
   Two members of one centre that are not linked with it need common shingles which the centre lacks;
   the rarest of these are joined (prefix filtering, exact), and all other such pairs are ruled out by
   what each has in common with the centre.
6. What is left of open buckets goes on with further centres (three, then twelve, and so on),
   against members of other components only, until every bucket is in one component or every
   member has been a centre. No bucket is capped.

Shingle sets are sets of 64-bit hashes. A pair of similarity s shares no band with probability
(1 - s^rows)^bands: 5e-6 at 0.8 with 40 bands of 6 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored
from seqloom.llm.graph import connected
from seqloom.storage import Scratch

CACHED_WORDS = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of a text."""

    def __init__(self, width: int):
        self.width = width
        self._words: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Bytes lower A-Z only and split at blanks, as the word definition asks."""
        found = (text or b"").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        known, get = self._words, self._words.get
        if len(known) > CACHED_WORDS:
            known.clear()
        hashes = [get(w) for w in found]
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    w = found[i]
                    hashes[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(hashes, np.uint64)
        width = min(self.width, len(found))
        n = len(h) - width + 1
        out = h[:n].copy()
        for i in range(1, width):
            out = out * _MULTIPLIER + h[i : i + n]
        return np.unique(_mix(out + np.uint64(width)))


class Sketcher:
    """Band hashes of a set of hashes by one-permutation hashing."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self._attempts: list[np.ndarray] = []
        self._salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _MULTIPLIER)

    def _block(self, i: int) -> np.ndarray:
        """Bins that attempts 64i to 64i+63 name, for every empty bin."""
        while len(self._attempts) <= i:
            first = 64 * len(self._attempts)
            attempt = np.arange(first, first + 64, dtype=np.uint64)[:, None]
            bin_ = np.arange(self.bins, dtype=np.uint64)[None, :]
            self._attempts.append(
                (_mix(_mix(attempt * _MULTIPLIER + bin_ + np.uint64(7))) % np.uint64(self.bins)).astype(np.intp)
            )
        return self._attempts[i]

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        values = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        where = (hashes % np.uint64(self.bins)).astype(np.intp)
        np.minimum.at(values, where, hashes)
        full = np.zeros(self.bins, bool)
        full[where] = True
        empty = np.flatnonzero(~full)
        if len(empty) and full.sum() == 1:
            values[:] = values[full][0]
            empty = empty[:0]
        i = 0
        while len(empty):
            named = self._block(i)[:, empty]
            hit = full[named]
            took = hit.argmax(axis=0)
            found = hit[took, np.arange(len(empty))]
            values[empty[found]] = values[named[took[found], np.flatnonzero(found)]]
            empty = empty[~found]
            i += 1
        return values

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        by_band = self.bins_of(hashes).reshape(self.bands, self.rows)
        h = self._salt.copy()
        for r in range(self.rows):
            h = _mix(h * _MULTIPLIER + by_band[:, r])
        return h.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands) per row; f1, f2 null and no bands without words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sketch = Shingles(width), Sketcher(bands, rows)
        for batch in batches:
            out = []
            for key, body in zip(batch["doc_id"], batch["text"]):
                s = shingles(body)
                if len(s):
                    f = xxhash.xxh3_128_intdigest(s.tobytes())
                    f1, f2 = np.array([f & (2**64 - 1), f >> 64], np.uint64).view(np.int64)
                    out.append((key, len(s), f1, f2, sketch(s)))
                else:
                    out.append((key, 0, None, None, []))
            made = pd.DataFrame(out, columns=["doc_id", "n_shingles", "f1", "f2", "bands"])
            yield made.astype({"doc_id": "Int64", "f1": "Int64", "f2": "Int64"})

    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return asked.mapInPandas(
        make, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    )


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the limit. `texts` has (doc_id, text)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(width)
        last, s = None, None
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                if a != last:
                    last, s = a, shingles(ta)
                t = shingles(tb)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.loc[keep, ["a", "b"]]

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    return joined.mapInPandas(check, "a long, b long").distinct()


def apart_from_centres(asking: DataFrame, texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc, label, c, central, h): per document of `asking` (doc, label, c) the shingles that its c lacks.

    Each c sends its whole set once, as rows with `central`.
    """

    def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(width)
        known, s = None, None
        for batch in batches:
            rest = []
            for td, tc in zip(batch["td"], batch["tc"]):
                if tc != known:
                    known, s = tc, shingles(tc)
                rest.append(np.setdiff1d(shingles(td), s, assume_unique=True).view(np.int64))
            yield batch[["doc", "label", "c", "central"]].assign(h=rest)

    body = texts.select(F.col("doc_id").alias("doc"), F.col("text").alias("td"))
    of_c = texts.select(F.col("doc_id").alias("c"), F.col("text").alias("tc"))
    rests = asking.filter("doc != c").join(body, "doc").join(of_c, "c").select(
        "doc", "label", "c", F.lit(False).alias("central"), "td", "tc"
    )
    wholes = asking.select(F.col("c").alias("doc")).distinct().join(body, "doc").select(
        "doc", F.col("doc").alias("label"), F.col("doc").alias("c"), F.lit(True).alias("central"), "td",
        F.lit("").cast("binary").alias("tc"),
    )
    made = rests.unionByName(wholes).mapInPandas(
        differing, "doc long, label long, c long, central boolean, h array<long>"
    )
    return scratch.write(made.select("doc", "label", "c", "central", F.explode("h").alias("h")))


def private_counts(rows: DataFrame) -> DataFrame:
    """(doc, own): shingles of a document that no document with another label has, from `apart_from_centres`.

    What any c has is taken as shared, so `own` may be too small but never too large.
    """
    held = rows.groupBy("h").agg(
        F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("central").alias("central")
    )
    private = held.filter("not central and l1 = l2").select("h")
    return rows.filter("not central").join(private, "h").groupBy("doc").agg(F.count(F.lit(1)).alias("own"))


def sharing_new(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents with one centre and other labels that share new shingles enough for a link.

    `rows` comes from `apart_from_centres`, `sizes` has (doc, n, held): the size of a set and how much of
    it the centre has. Two sets have at most the smaller `held` and their common new shingles in
    common, so a link needs a certain number of the latter. Two sets with so many in common share one
    of their rarest, all but that number less one (prefix filtering); only these are joined.
    """
    new = rows.filter("not central").select("doc", "label", "c", "h").join(sizes, "doc")
    low = sizes.join(rows.select("doc", "c").distinct(), "doc").groupBy("c").agg(F.min("n").alias("low"))
    often = new.groupBy("c", "h").agg(F.count(F.lit(1)).alias("often"))
    # The smallest partner is the smallest set with this centre, or what the limit leaves of the own size.
    partner = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    need = F.greatest(F.ceil((F.col("n") + partner) * percent / (100 + percent)) - F.col("held"), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("often", "h"))
    rare = (
        new.join(often, ["c", "h"]).join(low, "c").withColumns({"need": need, "rank": rank})
        .filter((F.col("rank") <= F.col("n") - F.col("held") - F.col("need") + 1) & (F.col("often") > 1))
        .select("c", "h", "doc", "label", "n", "held")
    )
    other = rare.select("c", "h", *[F.col(x).alias(f"{x}_") for x in ("doc", "label", "n", "held")])
    most = F.least("held", "held_") + F.least(F.col("n") - F.col("held"), F.col("n_") - F.col("held_"))
    return (
        rare.join(other, ["c", "h"])
        .filter((F.col("doc") < F.col("doc_")) & (F.col("label") != F.col("label_")))
        .filter((100 + percent) * most >= percent * (F.col("n") + F.col("n_")))
        .select(F.col("doc").alias("a"), F.col("doc_").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|; component_id is the smallest
    doc_id reachable. Texts with fewer words than `width` have one shingle, their whole sequence.
    Null, empty and blank texts have none and are linked with nothing. Rows that share a doc_id are
    one document and get one component. Rows with a null doc_id are kept and have no component.
    Other columns of `docs` are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sketch = stored(sketches(docs, width, bands, rows, doc_id, text), "sketch")
    classes = stored(
        sketch.filter("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(
            F.min("doc_id").alias("rep")
        ),
        "classes",
    )
    firsts = sketch.join(classes.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "doc_id"], "left_semi")
    members = firsts.select(
        F.explode("bands").alias("key"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n")
    )
    # A document's support is the number of others in its buckets. Copies that were changed at random
    # places share most with the text they come from, so this is what a bucket has as its centre.
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = scratch.write(members.join(sizes, "key"))
    support = shared.groupBy("doc").agg(F.sum("size").alias("support"))
    ranked = shared.join(support, "doc").select("key", "doc", "n", "support")
    best = F.max(F.struct("support", (-F.col("doc")).alias("last"), "n")).alias("best")
    centre = ranked.groupBy("key").agg(best).select(
        "key", (-F.col("best.last")).alias("c"), F.col("best.n").alias("nc"), F.col("best.support").alias("tc")
    )
    buckets = scratch.write(ranked.join(centre, "key"))
    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    pairs = (
        buckets.filter((F.col("c") != F.col("doc")) & fits(F.col("n"), F.col("nc")))
        .select(F.least("c", "doc").alias("a"), F.greatest("c", "doc").alias("b"))
        .distinct()
    )
    tested = scratch.write(pairs)
    wanted = buckets.select(F.col("doc").alias("doc_id")).distinct()
    texts = scratch.write(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).join(
            wanted, "doc_id", "left_semi"
        )
    )
    names = scratch.write(connected(scratch.write(confirmed(tested, texts, width, percent))))
    # Before anything is known of the sets: all of one may be in others, and there is no common centre.
    bounds = {"s": F.col("n"), "held": F.col("n"), "hub": F.lit(None).cast("long")}
    alive = buckets.select("key", "doc", "n", "support", "c", "tc", *[v.alias(k) for k, v in bounds.items()])
    pruned, low, high = False, 1, 4
    while True:
        named = alive.join(names.withColumnRenamed("node", "doc"), "doc", "left").select(
            "key", "doc", "n", "support", "c", "tc", *bounds, F.coalesce("label", "doc").alias("label")
        )
        mixed = named.groupBy("key").agg(
            F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("size")
        )
        mixed = mixed.filter((F.col("l1") != F.col("l2")) & (F.col("size") > low + 1)).select("key")
        opened, left = scratch.write_counting(named.join(mixed, "key"), F.lit(True))
        if not left:
            break
        if not pruned:
            # Of the centres of its buckets a document is compared with the one that meets most others.
            asking = opened.groupBy("doc", "label").agg(F.max(F.struct("tc", "c"))["c"].alias("c"))
            rows = apart_from_centres(scratch.write(asking), texts, width, scratch)
            new = rows.filter("not central").groupBy("doc", F.col("c").alias("_hub")).agg(F.count(F.lit(1)).alias("new"))
            own = scratch.write(new.join(private_counts(rows), "doc", "left"))
            alive = opened.drop("label").join(own, "doc", "left").withColumns(
                {
                    "s": F.col("n") - F.coalesce("own", F.lit(0)),
                    "held": F.col("n") - F.coalesce("new", F.lit(0)),
                    "hub": F.col("_hub"),
                }
            )
            alive = scratch.write(
                alive.filter(100 * F.col("s") >= percent * F.col("n")).select(
                    "key", "doc", "n", "support", "c", "tc", *bounds
                )
            )
            sizes = scratch.write(alive.filter("hub is not null").select("doc", "n", "held").distinct())
            pairs = scratch.write(sharing_new(rows, sizes, percent).join(tested, ["a", "b"], "left_anti"))
            tested = tested.unionByName(pairs)
            links, found = scratch.write_counting(confirmed(pairs, texts, width, percent), F.lit(True))
            if found:
                names = _merged(scratch, names, links)
            pruned, low, high = True, 0, 3
            continue
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("support"), "doc"))
        # A limit on the rank lets Spark cut each bucket before it is shuffled.
        centres = opened.withColumn("rank", rank).filter(F.col("rank") <= high).filter(F.col("rank") > low)
        centres = centres.select(
            "key", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("label").alias("la"),
            F.col("support").alias("ta"), F.col("held").alias("helda"), F.col("hub").alias("huba"),
        )
        # Pairs with one centre that share new shingles are done; the others have no more than it has of both.
        both = F.when(F.col("hub") == F.col("huba"), F.least("s", "sa", "held", "helda")).otherwise(F.least("s", "sa"))
        pairs = (
            opened.join(centres, "key")
            .filter(F.col("label") != F.col("la"))
            # Each pair once: members behind the centre in the order of centres.
            .filter((F.col("support") < F.col("ta")) | ((F.col("support") == F.col("ta")) & (F.col("doc") > F.col("a"))))
            .filter(100 * both >= percent * (F.col("n") + F.col("na") - both))
            .select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b"))
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        pairs, asked = scratch.write_counting(pairs, F.lit(True))
        if asked:
            tested = tested.unionByName(pairs)
            links, found = scratch.write_counting(confirmed(pairs, texts, width, percent), F.lit(True))
            if found:
                names = _merged(scratch, names, links)
        low, high = high, 4 * high
    by_rep = names.select(F.col("node").alias("rep"), F.col("label"))
    labelled = stored(
        classes.join(by_rep, "rep", "left").select("f1", "f2", F.coalesce("label", "rep").alias("label")),
        "labels",
    )
    scratch.drop_all()
    out = sketch.select("doc_id", "n_shingles", "f1", "f2").join(labelled, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _merged(scratch: Scratch, names: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels after further links between documents."""
    label = lambda side: names.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    between = (
        links.join(label("a"), "a", "left")
        .join(label("b"), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    outer = connected(scratch.write(between)).select(
        F.col("node").alias("label"), F.col("label").alias("outer")
    )
    new = outer.select(F.col("label").alias("node"), "label").join(
        names.select("node"), "node", "left_anti"
    )
    return scratch.write(
        names.unionByName(new).join(outer, "label", "left").select(
            "node", F.coalesce("outer", "label").alias("label")
        )
    )
