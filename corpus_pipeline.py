"""A corpus pipeline over `documents`: each stage's rows are written and read again as the next one's input.

All stages but the last return the columns of documents, n_chars following the text; columns that a stage doesn't
know pass through, those that bear the name of one of its results as well. A document that a stage cuts down to nothing goes; one
that was empty before stays. Nulls, rows that repeat an id and empty tables have the results that the operators state: an
empty table stays empty, null texts are empty documents, rows without an id are never near-duplicates. Of groups of
near-duplicates the smallest id stays, so ties don't occur.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxnframe.llm import line_dedup, near_dedup, packing, quality, substring_dedup
from rxnframe.llm.common import discard, fresh, quoted, read, table


def _beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], made: list[str], where: str) -> DataFrame:
    """Rows of an operator's result that pass `where`, with the columns of docs. Columns of docs that are named like its results (`made`) wait under other names."""
    clash = [c for c in docs.columns if c.lower() in made]
    aside = dict(zip(clash, fresh(docs, *[f"{c}_" for c in clash])))
    out = operator(docs.withColumnsRenamed(aside)).filter(where)
    if "n_removed" in made and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[quoted(aside.get(c, c)).alias(c) for c in docs.columns])


LEFT = "n_removed = 0 or length(trim(text)) > 0"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    trusted = read(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    model = quality.fit(docs, trusted)
    return _beside(docs, lambda x: quality.score(x, model), ["score", "predicted"], "predicted = 1")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: cross-site boilerplate lines go."""
    return _beside(docs, line_dedup.dedup_lines, ["n_lines", "n_removed"], LEFT)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays, the one with the smallest id."""
    drop = near_dedup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def passage_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages of 50 words or more that a smaller document holds go."""
    return _beside(docs, substring_dedup.remove_repeats, ["n_words", "n_removed"], LEFT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token pieces with their place in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_filter), ("line dedup", line_filter), ("MinHash near-dedup", near_filter), ("substring dedup", passage_filter), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's rows are deleted once the next one has written its own."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = table(stage(spark, docs, sf_dir))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
