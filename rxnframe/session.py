"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Joins and groupings on keys that contain graph_id reuse a partitioning by graph_id.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
#: Set whatever the session says. A union claims no partitioning: adaptive execution merges the partitions of its inputs each in its own way, after which rows of one graph lie in
#: different tasks, while a repartition by graph_id above the union would be left out as done.
NEEDED = {"spark.sql.unionOutputPartitioning": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Sets what the session has not set itself, and what right results need."""
    own = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    for key, value in NEEDED.items():
        if own.get(key) != value:
            spark.conf.set(key, value)
    return spark


def session(name: str = "rxnframe", **conf: str) -> SparkSession:
    return tune(SparkSession.builder.appName(name).config(map=conf).getOrCreate())


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder; one of our own only where all run in one machine and the session names none."""
    told = getattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    root = spark.conf.get("spark.checkpoint.dir", None) or told() or spark.conf.get("spark.rxnframe.workdir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rxnframe-")
        spark.conf.set("spark.rxnframe.workdir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/rxnframe/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage of an iteration and outlives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.rxnframe_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete work tables that nothing will read any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "rxnframe_path", None)):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; it keeps the partitioning, so that rounds of an iteration don't shuffle again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(work_dir(df.sparkSession))
    held = df.persist()  # else the rows are computed twice, once to count and once to write
    out = held.checkpoint()
    held.unpersist()
    return out
