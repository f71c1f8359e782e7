"""Row-wise operators run unchanged on a stream."""

from pyspark.sql import functions as F

from rxnframe.functions import columns as K
from rxnframe.operators import reactions as R
from rxnframe.operators import selection as S
from rxnframe.plans import fixtures as X


def test_stateless_operators_on_a_stream(spark, small, tmp_path):
    X.reactions(spark, small).write.parquet(str(tmp_path / "in"))

    def work(df):
        df = R.split_reaction(S.filter_confidence(df, 0.2)).withColumn("key", K.entity_key(F.col("reactant"), F.col("product")))
        return S.group_split(S.filter_class(df, "smiles", "C"), "graph_id", "key", 0.3, 1)

    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = work(stream).writeStream.format("memory").queryName("splits").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("splits").collect())) == sorted(map(tuple, work(batch).collect())) != []
