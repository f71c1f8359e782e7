"""Work folders, and samples of any size."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rxnframe import session
from rxnframe.functions.columns import hash_bucket
from rxnframe.operators import selection
from rxnframe.plans import registry
from tests.compare import assert_same, connect


def pretend(master, checkpoint=None, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: conf.update({k.replace(".", "_"): v})), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


def test_shared_folder():
    assert session.shared_root(pretend("spark://x", spark_checkpoint_dir="s3://a/")) == "s3://a"
    assert session.shared_root(pretend("spark://x", checkpoint="hdfs://b/c")) == "hdfs://b/c"
    with pytest.raises(ValueError):
        session.shared_root(pretend("yarn"))


def test_work_tables_go(spark):
    t = session.table(spark.range(5))
    assert t.count() == 5
    session.discard(t, None, spark.range(3))
    assert not spark._jvm.java.io.File(t.rxnframe_path).exists()


@pytest.mark.parametrize("n", [0, 1, 500, 4_999, 5_000, 9_000])
def test_sample_of_any_size(spark, n):
    df = spark.range(5_000).selectExpr("id", "id % 7 as _other")
    got = sorted(r.id for r in selection.sample_n(df, n, "id", 3).collect())
    want = sorted(r.id for r in df.orderBy(hash_bucket("id", 3), "id").limit(n).collect())
    assert got == want


def test_sample_with_null_keys(spark):
    df = spark.range(50).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("id"))
    assert selection.sample_n(df, 20, "id").count() == 20 and selection.sample_n(df.limit(0), 3, "id").count() == 0


#: Partitions so small that adaptive execution merges those of a union's inputs differently.
UNEVEN = {
    "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.unionOutputPartitioning": "true",
}


@pytest.mark.parametrize("name", ["e2_distance_to_set", "d16_pair_attention", "d22_shell_counts", "d23_reaction_descriptor"])
def test_graphs_stay_whole_above_unions(spark, small, name):
    own = spark.newSession()
    for key, value in UNEVEN.items():
        own.conf.set(key, value)
    assert_same(registry.queries()[name](own, small), connect(small), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["d13_edge_softmax_aggregate", "d14_self_attention", "c11_alignment_indicators"])
def test_lines_are_shuffled_once(spark, small, name):
    own = spark.newSession()
    for key, value in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        own.conf.set(key, value)
    plan = registry.queries()[name](own, small)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x and "isnull" not in x]
    assert len(moved) == 1 and plan.count("ExistingRDD") == name.startswith("c11_")  # nothing is checkpointed either; c11 reads the elements
