"""Whitening of embeddings: spectral divide and conquer by polar decompositions (QDWH).

The corpus is only summed: Spark reduces n vectors of d numbers to their sums (d) and to their centred
products (d * (d + 1) / 2), both exactly in integers, so the covariance does not depend on how the rows
are dealt out. What then goes to the driver has the size of the dimension, never of the corpus, and
`max_dim` bounds it.

The covariance is split without any eigenvalue routine. The unitary polar factor of V - s*I, found by
the dynamically weighted Halley iteration in its QR form (at most seven steps for any condition in
double precision), is +1 on the space of the eigenvalues above s and -1 below: (U + I) / 2 is the
spectral projector. Its range and the complement are invariant; V restricted to each is split again,
until a part is one component or a multiple of the identity. Projection of the rows is one product with
a broadcast d x k matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
EPS = np.finfo(float).eps
# Whole numbers up to here are exact in double precision.
EXACT = 2**53


def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by the QR form of the Halley iteration.

    Singular values under EPS times the largest are taken for that bound; a shift that lies on an
    eigenvalue therefore gives a factor that is not unitary, which `split` notices.
    """
    size = len(a)
    x = a / np.linalg.norm(a)
    low, eye = EPS, np.eye(size)
    for _ in range(steps):
        d = (4 * max(0.0, 1 - low * low) / low**4) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        done = np.linalg.norm(new - x) <= 10 * EPS * size and 1 - low <= 10 * EPS
        x = new
        if done:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant spaces above and below a shift; None if there is one eigenvalue only."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * EPS * size * max(abs(mean), np.abs(a).max()):
        return None
    # The mean lies strictly between the outermost eigenvalues; the median splits more evenly. A shift
    # that hits an eigenvalue is moved a little, by steps that no spectrum of this size can all hit.
    for shift in [np.median(np.diag(a)), mean, *(mean + spread / size * (0.37 * k) / size for k in range(1, 2 * size + 2))]:
        moved = a - shift * np.eye(size)
        if not np.linalg.norm(moved):
            continue
        u = polar(moved)
        if np.linalg.norm(u @ u - np.eye(size)) > 1e-9 * size:
            continue
        above = (u + np.eye(size)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < size:
            continue
        # The range of the projector: random directions, projected twice.
        start = np.random.default_rng(size).standard_normal((size, k))
        basis, _ = np.linalg.qr(above @ start)
        whole, _ = np.linalg.qr(above @ basis, mode="complete")
        return whole[:, :k], whole[:, k:]
    return None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The largest entry of a vector is positive, so that all runs give one sign.
    """
    size = len(v)
    values, vectors = [], []
    parts = [np.eye(size)]
    floor = 4 * EPS * size * np.abs(v).max(initial=0.0)
    while parts:
        basis = parts.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        found = None
        if len(a) > 1 and np.abs(a - np.diag(np.diag(a))).max() > floor:
            found = split(a)
        if found is None:
            values += list(np.diag(a))
            vectors += list(basis.T)
        else:
            parts += [basis @ f for f in found]
    order = np.argsort(-np.array(values), kind="stable")
    columns = np.array(vectors).T[:, order] if vectors else np.empty((size, 0))
    if size:
        columns, _ = np.linalg.qr(columns)
        columns *= np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(size)])
    return np.einsum("ij,ij->j", columns, v @ columns), columns


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def whole(batch: pd.Series) -> np.ndarray:
    """Rows of x = floor(1024 * c) + 100000."""
    c = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.empty((0, 0))
    x = np.floor(SCALE * c)
    if x.size and np.abs(x).max() > 2**52:
        raise OverflowError("components above 2^42 cannot be whitened")
    return x.astype(np.int64) + SHIFT


def summed(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = whole(batch["vector"])
                yield pd.DataFrame({"n": [len(x)], "sums": [x.sum(axis=0)]})

    parts = vectors.select("vector").mapInPandas(part, "n long, sums array<long>")
    rows = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    found = {r.i: (int(r.n), int(r.s)) for r in rows.collect()}
    return found[0][0], [found[i][1] for i in range(d)]


def exact_products(y: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of products of whole-numbered columns as int64 arrays, upper triangles only."""
    upper = np.triu_indices(y.shape[1])
    top = int(np.abs(y).max(initial=0))
    if top * top >= EXACT:
        raise OverflowError("components more than 2^26 steps from their mean cannot be whitened")
    rows = max(1, (EXACT - 1) // max(1, top * top))
    for at in range(0, len(y), rows):
        piece = y[at : at + rows].astype(np.float64)
        yield (piece.T @ piece)[upper].astype(np.int64)


def covariance(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, from products of vectors less the whole part of the mean, exactly."""
    middle = np.array([s // n for s in sums], np.int64)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, size = None, 0
        for batch in batches:
            if not len(batch):
                continue
            for made in exact_products(whole(batch["vector"]) - middle):
                # Each summand is under 2^53, so 512 of them stay within 64 bits.
                if size == 512:
                    yield pd.DataFrame({"products": [total]})
                    total, size = None, 0
                total, size = (made if total is None else total + made), size + 1
        if total is not None:
            yield pd.DataFrame({"products": [total]})

    parts = vectors.select("vector").mapInPandas(part, "products array<long>")
    rows = parts.select(F.posexplode("products").alias("i", "p")).groupBy("i").agg(
        F.sum(F.col("p").cast("decimal(38,0)")).alias("p")
    )
    found = {r.i: int(r.p) for r in rows.collect()}
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    v = np.empty((d, d))
    for at, (i, j) in enumerate(zip(*np.triu_indices(d))):
        v[i, j] = v[j, i] = (n * found[at] - rest[i] * rest[j]) / (n * n)
    return v


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Per row the sum of (n * y - rest)^2, exact; None beyond 64 bits."""
    about = ((n * y.astype(np.float64) - rest) ** 2).sum(axis=1)
    if about.max(initial=0) < 2**62:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    made = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in y]
    return [m if m < 2**63 else None for m in made]


def whiten(table: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding",
           max_dim: int = 4096) -> DataFrame:
    """One row per usable row of `table` and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out, as are vectors whose
    length is not the most frequent one (the smaller of two) or 0. There are as many components as the
    dimension allows, `components` at most. A component without variance (a single vector, equal rows)
    is 0 for all rows and is not part of identity_error; without any variance explained is 0.
    `deviation` is null where it does not fit 64 bits. Repeated rows count as often as they stand; null
    ids are kept; other columns are not looked at. Components above 2^42, and x-values more than 2^26
    from their mean, raise OverflowError; a dimension above `max_dim` raises ValueError.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    vectors = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    vectors = vectors.filter(usable(F.col("vector")) & (F.size("vector") > 0))
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commonest = sizes.orderBy(F.desc("n"), "d").first()
    if commonest is None:
        return table.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    d = commonest.d
    if d > max_dim:
        raise ValueError(f"vectors of {d} components; the covariance is held by one process up to {max_dim}")
    vectors = vectors.filter(F.size("vector") == d)
    n, sums = summed(vectors, d)
    v = covariance(vectors, d, n, sums)
    values, axes = eigen(v)
    k = min(components, d)
    total = float(np.trace(v))
    values, axes = values[:k], axes[:, :k]
    live = values > EPS * d * max(total, 0.0)
    weights = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    shares = np.where(live, values, 0.0) / total if total > 0 else np.zeros(k)
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], np.int64)

    def projected(batch: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        y = whole(batch) - middle
        return y, (y - rest / n) @ weights

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                _, w = projected(batch["vector"])
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pd.DataFrame({"m": [np.concatenate([first, second.ravel()])]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            y, w = projected(batch["vector"])
            far = pd.Series(deviations(y, n, rest), dtype="Int64")
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).reset_index(drop=True),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(w)),
                    "n": n,
                    "deviation": far.repeat(k).reset_index(drop=True),
                    "whitened": w.ravel(),
                    "explained": np.tile(shares, len(w)),
                }
            )

    parts = vectors.select("vector").mapInPandas(moments, "m array<double>")
    found = parts.select(F.posexplode("m").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()
    m = np.zeros(k + k * k)
    m[[r.i for r in found]] = [r.m for r in found]
    means = m[:k] / n
    off = (m[k:].reshape(k, k) / n - np.outer(means, means) - np.eye(k))[np.ix_(live, live)]
    return vectors.mapInPandas(rows, schema).withColumn("identity_error", F.lit(float(np.abs(off).max(initial=0.0))))
