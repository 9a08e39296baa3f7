"""What the steps of loops leave to the driver and on the disks."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators.chains import trace_chains
from seqloom.operators.graph import build_graph
from seqloom.storage import CLEANUP_CONF, Scratch, lookup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chain(spark, n):
    return spark.range(n).select(
        "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("prv"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("nxt")
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookups_send_no_table_through_the_driver(spark, how):
    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumn("v", F.col("id") * 2)
    met = lookup(big, small, "k", "id", how)
    assert met.count() == (100 if how == "left" else 10)
    assert "Broadcast" not in plan(met)


def test_chains_and_arcs_send_no_table_through_the_driver(spark):
    with Scratch(spark, "test") as scratch:
        traced = trace_chains(chain(spark, 300), scratch)
        assert "SortMergeJoin" in plan(traced) and "BroadcastHashJoin" not in plan(traced)
        assert [(r["label"], r["rank"]) for r in traced.orderBy("rank").collect()] == [(0, i) for i in range(300)]
        counts = spark.createDataFrame([(6, 2), (27, 2)], "lmer long, cnt long")
        pairs = build_graph(counts, 3, scratch).numbered_arcs()
        assert pairs.count() == 2 and "BroadcastHashJoin" not in plan(pairs)


def test_a_written_step_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffled = lambda: {f for f in files().mkString("\n").split("\n") if "/shuffle_" in f}
    before, was = shuffled(), spark.conf.get(CLEANUP_CONF)
    with Scratch(spark, "test") as scratch:
        kept = scratch.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert shuffled() <= before
        assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6
    assert spark.conf.get(CLEANUP_CONF) == was


def test_large_states_of_chains_do_not_stay(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("seqloom.operators.chains._rounds_at_once", lambda n: 1 if n > 20 else 4)
    deleted = []
    monkeypatch.setattr(Scratch, "drop", lambda self, t, drop=Scratch.drop: (deleted.append(t.columns), drop(self, t))[1])
    with Scratch(spark, "test") as scratch:
        ring = spark.range(1000, 1040).select("id", ((F.col("id") + 39) % 40 + 1000).alias("prv"), ((F.col("id") + 1) % 40 + 1000).alias("nxt"))
        traced = trace_chains(chain(spark, 300).unionByName(ring), scratch)
        found = {r["id"]: (r["label"], r["circuit"], r["rank"]) for r in traced.collect()}
    assert len(found) == 340 and all(found[i] == (0, 0, i) for i in range(300))
    assert {found[i][:2] for i in range(1000, 1040)} == {(1000, 1)}
    assert sorted(found[i][2] for i in range(1000, 1040)) == list(range(40))
    assert len(deleted) >= 5 and all("nxt" in columns for columns in deleted)
