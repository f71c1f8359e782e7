"""Stored graph tables: bucketed by graph so that joins need no shuffle, schemaless documents with typed extraction, and rows with their rejects in one write."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rxnframe.session import tune, work_dir

BUCKET_ROWS = 4_000_000
OK = "ok"


def bucket_count(rows: int, least: int = 8) -> int:
    """Buckets of at most about BUCKET_ROWS rows; a power of two, so that stores of different sizes still join by coalescing buckets."""
    n = least
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def save(df: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None, by: str = "graph_id") -> str:
    """A4: df as a table bucketed and sorted by `by`; its name. Tables with equal numbers of buckets join and group by graph without an exchange. The files go to path, else to the session's work folder."""
    spark = df.sparkSession
    name = name or f"graphs_{uuid.uuid4().hex}"
    buckets = buckets or bucket_count(df.count())
    # One task a bucket, so that a bucket is one file however many tasks the rows came from.
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path or work_dir(spark)).saveAsTable(name)
    return name


def load(spark: SparkSession, name: str) -> DataFrame:
    """A3: a stored table. The session is set to plan bucketed scans even where it can't know yet that a join will use them."""
    tune(spark)
    return spark.table(name)


def write_documents(rows: DataFrame, path: str, doc: str = "doc", by: str = "rxntype", fields: dict[str, str] | None = None) -> DataFrame:
    """JSON texts (column `doc`) as VARIANT, whatever their shapes, with some fields (name -> type, at the top level of the document) shredded into columns of their own; partitioned by the field `by`.

    Texts that are no JSON, and null ones, keep a null document in the class of null; other columns stay. Returns what read_documents gives."""
    fields = {by: "string", **(fields or {})}
    parsed = rows.withColumn(doc, F.try_parse_json(F.col(doc)))
    for name, kind in fields.items():
        parsed = parsed.withColumn(name, F.try_variant_get(F.col(doc), f"$.{name}", kind))
    parsed.write.partitionBy(by).parquet(path)
    return rows.sparkSession.read.schema(parsed.schema).parquet(path)


def read_documents(spark: SparkSession, path: str, schema: str, classes: list[str] | str | None = None, splits: list[str] | None = None, by: str = "rxntype", split: str = "split") -> DataFrame:
    """Stored documents of some classes (a list or a pattern) and splits. Only folders of these classes are read, and the split is compared in the scan; schema names the columns, the document being `variant`."""
    df = spark.read.schema(schema).parquet(path)
    if classes is not None:
        df = df.filter(F.col(by).rlike(classes) if isinstance(classes, str) else F.col(by).isin(list(classes)))
    return df if splits is None else df.filter(F.col(split).isin(list(splits)))


def extract(df: DataFrame, spec: dict[str, tuple[str, str]], doc: str = "doc") -> DataFrame:
    """Typed columns (name -> (path, type)) of the documents; a missing path, or a value that isn't of the type, is null."""
    return df.withColumns({name: F.try_variant_get(F.col(doc), where, kind) for name, (where, kind) in spec.items()})


def outcome(rules: dict[str, Column]) -> Column:
    """The first rule that a row breaks, or ok; an unknown outcome breaks none."""
    return reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rules.items(), F.when(F.lit(False), OK)).otherwise(OK)


def write_checked(df: DataFrame, path: str, stage: str, rules: dict[str, Column], key: str = "graph_id") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows that break no rule, rejects (key, stage, reason), and how many rows had each outcome, by one pass over df: one write partitioned by outcome, counted as it runs, and two readers on its folders."""
    if OK in rules:
        raise ValueError(f"a rule can't be named {OK}")
    column = "outcome"
    while column.lower() in {c.lower() for c in df.columns}:
        column += "_"
    marked = df.withColumn(column, outcome(rules))
    names = [OK, *rules]
    counted = Observation()
    marked = marked.observe(counted, *[F.count_if(F.col(column) == n).alias(f"n{i}") for i, n in enumerate(names)])
    marked.write.partitionBy(column).parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    kept = back.filter(F.col(column) == OK).select(df.columns)
    rejects = back.filter(F.col(column) != OK).select(key, F.lit(stage).alias("stage"), F.col(column).alias("reason"))
    return kept, rejects, {n: counted.get[f"n{i}"] for i, n in enumerate(names)}
