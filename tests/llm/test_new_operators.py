"""Toxicity, whitening and Merkle manifest against brute force, and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import merkle, queries, toxicity, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _seq string, grp string, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [
        (1, "one é", "en", "a", 5), (2, "two", "en", "a", 3), (2, "two", "en", "a", 3), (None, "no id", "en", None, None),
        (None, "no id", "en", None, None), (4, None, None, "b", None), (5, "", "", "b", 0), (6, " \n", "fr", None, 2),
        (7, "long " * 40_000, "en", "c", 200_000), (14, "x", "ñ", "c", None),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Top of a list of hashes, and for each of them its (slot, sibling) level by level."""
    ways, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, below = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for slot in range(len(run)):
                for w in under[i + slot]:
                    ways[w].append((slot, run[1 - slot] if len(run) == 2 else ""))
            up.append(sha(*run))
            below.append(sum(under[i : i + 2], []))
        nodes, under = up, below
    return nodes[0], ways


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        n = None if r.n_chars is None else r.n_chars + more
        return sha(field(r.doc_id), field(r.source), field(r.lang), field(n), field(r.text))

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for g in names}
    inner = {g: tree([leaf(r) for r in ordered[g]]) for g in names}
    root, outer = tree([inner[g][0] for g in names])
    made = []
    for g, above in zip(names, outer):
        subroot, ways = inner[g]
        for r, way in zip(ordered[g], ways):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            end = leaf(r, int(changed))
            for slot, sibling in way + above:
                end = sha(sibling, end) if slot else sha(end, sibling)
            made.append((r.doc_id, leaf(r), subroot, root, sha(*[s for _, s in way + above]), end, end == root))
    return made


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_against_brute_force(spark, odd, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), f"text {i}", rng.choice(["en", "en", "en", "de", None, "zz", "é"]), None, i) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for table in (docs, odd, docs.limit(1)):
        held = table.collect() if table is not odd else odd.collect()
        asked = spark.createDataFrame(held, table.schema)
        got = merkle.document_manifest(asked).collect()
        assert ordered(got) == ordered(brute_manifest(held))
    assert any(not r[-1] for r in brute_manifest(docs.collect()))


def test_empty_manifest(spark, odd):
    got = merkle.document_manifest(odd.limit(0))
    assert got.count() == 0
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_eigen_against_numpy(size):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((3 * size, size)) * np.exp(rng.standard_normal(size))
    v = x.T @ x / (3 * size)
    values, axes = whitening.eigen(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-11, atol=1e-13 * values[0])
    assert np.abs(axes.T @ axes - np.eye(size)).max() < 1e-12
    assert np.abs(v @ axes - axes * values).max() < 1e-11 * values[0]


def test_eigen_of_repeated_and_missing_values():
    for v in (np.zeros((4, 4)), 3 * np.eye(5), np.diag([1.0, 1, 2, 2, 5]), np.ones((6, 6)), np.array([[0, 1.0], [1, 0]])):
        values, axes = whitening.eigen(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12)
        assert np.abs(v @ axes - axes * values).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(len(v))).max() < 1e-12


def test_polar_factor():
    a = np.random.default_rng(3).standard_normal((20, 20))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (q * np.sign(w)) @ q.T).max() < 1e-10


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(7)
    c = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(c)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, [1.0] * 11), (905, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).repartition(7)
    got = whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(1024 * c.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    w, q = np.linalg.eigh(v)
    w, q = w[::-1], q[:, ::-1]
    want = (x - s / n) @ q[:, :8] / np.sqrt(w[:8])
    mine = got.whitened.to_numpy().reshape(n, 8)
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-9
    assert got.deviation.to_numpy().reshape(n, 8)[:, 0].tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert np.allclose(got.explained.to_numpy()[:8], w[:8] / w.sum()) and (got.n == n).all()
    assert (got.component.to_numpy().reshape(n, 8) == np.arange(1, 9)).all() and got.identity_error.max() < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(make([(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.whitened, r.explained, r.deviation) for r in one] == [(None, 1, 0.0, 0.0, 0), (None, 2, 0.0, 0.0, 0)]
    twice = whitening.whiten(make([(1, [0.0, 5.0]), (1, [0.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert len(twice) == 6 and all(r.n == 3 for r in twice)
    assert {round(r.whitened, 6) for r in twice if r.component == 2} == {0.0}
    with pytest.raises(Exception, match="cannot be whitened"):
        whitening.whiten(make([(1, [1e30]), (2, [0.0])])).count()


def test_folding():
    fold = toxicity.Folder()
    plain = lambda s: [w.replace("l", "i") for w in s.split()]
    assert fold("1D10T m0r0n $tupid w0rthle55") == plain("idiot moron stupid worthless")
    assert fold("іdіоt mоrоn, clown!!! (loser)") == plain("idiot moron clown loser")
    assert fold("1oser |oser id​iot") == plain("loser loser idiot")
    # Numbers stay numbers, other scripts that are no look-alikes stay as they are.
    assert fold("45 2024 привет") == ["45", "2024", "привет"] and fold(None) == fold("") == []


def test_exceptions_and_overlaps():
    fold = toxicity.Folder()
    matcher = toxicity.Matcher({"trash ": 2.0, "idi": 1.0}, ["trash can"])
    weights = lambda text: [w for _, _, w in matcher.hits(fold(text))]
    assert weights("a trash can") == [] and weights("a trash, a trash can") == [2.0]
    assert weights("idiot idiots midi trashy") == [1.0, 1.0]
    assert toxicity.Matcher({}, []).hits(["x"]) == []


def labelled(n, seed, terms):
    """Invented texts; a third has two of `terms` and the label 1, some of them copied many times."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ka", "lo", "mi", "so") for b in ("ra", "te", "vu") for c in ("n", "st", "la", "")]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 3 == 0)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(terms)())
        rows.append((i, " ".join(w), toxic))
    copied = next(r for r in rows if r[2])
    return rows + [(n + i, copied[1] + " kopie", 1) for i in range(40)]


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(2)
    rows = labelled(900, 1, [lambda: "grumf", lambda: "zork" + rng.choice(["a", "en", "ity", "ul"])])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i].predicted == y and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    known = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5], "doc_id long, label int")
    model = toxicity.fit(docs.select("doc_id", "text"), known)
    # Copies of one toxic text teach nothing but its insults.
    assert {t for t in model.weights if t.strip() not in {toxicity.Folder().word(k) for k in toxicity.KNOWN}} == {"grumf ", "zork"}


def test_toxicity_learns_exceptions(spark):
    rows = labelled(600, 5, [lambda: "grumf"])
    rows += [(10_000 + i, f"{t} grumf cake", 0) for i, t, y in rows[:60] if not y]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_toxicity_of_odd_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 and r.predicted == 0 and r.held_out is not None for r in rows)
    known = spark.createDataFrame([(1, "you are a pathetic loser"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(known, none).collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(odd.limit(0), none).count() == 0


@pytest.mark.parametrize("name", ["op11_toxicity", "op12_whitening", "op13_merkle_manifest"])
def test_queries_on_small_tables(spark, tmp_path, name):
    """The registered queries over Parquet fixtures, as the driver calls them."""
    rows = labelled(200, 9, [lambda: "stupid", lambda: "moron"])
    docs = [(i, t, "en" if i % 3 else None, "s", len(t)) for i, t, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.standard_normal((50, 10)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op11_toxicity":
        assert {r.doc_id: r.predicted for r in got} == {i: y for i, _, y in rows}
    elif name == "op12_whitening":
        w = np.zeros((50, 8))
        for r in got:
            w[r.vec_id, r.component - 1] = r.whitened
        assert len(got) == 400 and np.abs(w.T @ w / 50 - np.eye(8)).max() < 1e-9
    else:
        held = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
        assert ordered(got) == ordered(brute_manifest(held))
