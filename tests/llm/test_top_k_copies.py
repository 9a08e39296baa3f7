"""The copies of the queries that meet the blocks of vectors never go through the driver."""

from pyspark.sql import functions as F

from seqloom.llm import topk


def test_copies_of_queries_are_not_broadcast(spark):
    made = spark.range(300).select(
        F.col("id").alias("vec_id"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: ((F.col("id") * 7 + j * 13) % 31).cast("float")).alias("embedding"),
    )
    scaled = topk.scaled(made, scale=1)
    found = topk.top_k(scaled.filter("vec_id % 100 = 0"), scaled, 2, 2, 50)
    got = [tuple(r) for r in found.collect()]
    rows = {r.vec_id: r.v for r in scaled.collect()}
    want = []
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)[:2]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
