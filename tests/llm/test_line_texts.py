"""How often the texts of lines are moved, and lines that share a hash."""

import random

from pyspark.sql import functions as F

from seqloom.llm import lines
from seqloom.storage import Scratch


def shuffled_bytes(spark):
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_lines_are_moved_once(spark):
    """Tables too large to be sent to every task are joined without another move of all texts."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(33, 127)]
    texts = ["".join(rng.choices(letters, k=6000)) for _ in range(300)]
    texts.append(texts[0][:3000] + texts[0][3001:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled_bytes(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = lines.line_report(docs, all_links=False).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [(r.doc_id, r.class_doc) for r in report if not r.kept] == [(300, 0)] and len(report) == 301
    assert shuffled_bytes(spark) - before < 1.5 * sum(map(len, texts))


def test_lines_that_share_a_hash_keep_all_their_texts(spark):
    rows = [(1, k2, f"line {k2}") for k2 in (5, 6, 7) for _ in range(40)] + [(k, 9, f"only {k}") for k in range(2, 30)] * 2
    found = spark.createDataFrame(rows, "k1 long, k2 long, line string").repartition(7)
    with Scratch(spark, "texts") as scratch:
        firsts = lines.first_texts(scratch, found)
        assert sorted(map(tuple, firsts.collect())) == sorted({(a, c) for a, _, c in rows})
        ids = spark.createDataFrame([(1,), (8,)], "k1 long")
        assert sorted(r.line for r in lines.texts_of(firsts, ids).collect()) == ["line 5", "line 6", "line 7", "only 8"]


def test_tables_in_buckets_move_the_other_side_only(spark):
    with Scratch(spark, "buckets") as scratch:
        rows = spark.range(1000).select(F.col("id").alias("k1"), F.col("id").cast("string").alias("line"))
        firsts = scratch.write_buckets(rows.groupBy("k1").agg(F.first("line").alias("line")), "k1")
        names = set(scratch._named.values())
        found = lines.texts_of(firsts, spark.range(0, 5000, 50).select(F.col("id").alias("k1")))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(int(r.line) for r in found.collect()) == list(range(0, 1000, 50))
    assert not names & {t.name for t in spark.catalog.listTables()}
