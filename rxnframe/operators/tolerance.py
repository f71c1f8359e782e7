"""Greedy tolerance dedup of any group size: rows in arrival order, each kept if its value is farther than eps from all kept before.

The result is the lexicographically first independent set of the graph that links values at most eps apart. Of equal values only the first
to arrive counts, by an aggregate. A key of at most LIMIT values is swept by one task. Larger keys are cut into ranges of cells, each 2 eps wide, and
decided in rounds: a task sweeps the undecided values of its range by arrival, sees the neighbouring cells of the next ranges as unknown,
and decides what doesn't hang on them. Where a range is too dense for a task, a round compares the first arrivals of neighbouring cells
by joins instead and keeps those before both neighbours. Every round decides the earliest value of all at least; random arrivals take a few rounds, and a chain of
values that follow each other along the line takes as many as the ranges that it crosses, or cells where they are too dense.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.session import table

LIMIT, RANGE = 200_000, 50_000


class _Line:
    """Sorted values; tells whether any lies within eps."""

    def __init__(self, eps: float):
        self.eps, self.values = eps, []

    def near(self, x: float) -> bool:
        at = bisect_left(self.values, x)
        return any(abs(x - y) <= self.eps for y in self.values[max(0, at - 1) : at + 1])

    def add(self, x: float) -> None:
        insort(self.values, x)


def sweep(values: list[float], own: list[bool], eps: float) -> tuple[list[int], list[int]]:
    """Places of the kept and of the undecided own values of a range, all in arrival order; values that aren't own may be kept or not."""
    kept, unknown, out, later = _Line(eps), _Line(eps), [], []
    for i, x in enumerate(values):
        if kept.near(x):
            continue
        if own[i] and not unknown.near(x):
            kept.add(x)
            out.append(i)
        else:
            unknown.add(x)
            if own[i]:
                later.append(i)
    return out, later


def _without(left: DataFrame, kept: DataFrame, key: str, eps: float) -> DataFrame:
    """left (key, cell, value, order) without values within eps of kept ones (key, cell, value). Kept values lie more than eps apart, so six at most are met in a cell and its neighbours."""
    around = kept.select(F.col(key).alias("_k"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("_cell"), "value")
    around = around.groupBy("_k", "_cell").agg(F.collect_list("value").alias("_kept"))
    rest = left.join(around, left[key].eqNullSafe(around["_k"]) & (left["cell"] == around["_cell"]), "left")
    return rest.filter(F.col("_kept").isNull() | ~F.exists("_kept", lambda v: F.abs(v - F.col("value")) <= eps)).select(left.columns)


def _dense_round(left: DataFrame, key: str, eps: float) -> tuple[DataFrame, DataFrame]:
    """Values kept because they arrive first in their cell and before the first ones of both neighbours, and what stays undecided."""
    first = left.groupBy(key, "cell").agg(F.min(F.struct("order", "value")).alias("first"))
    there = first.select(F.col(key).alias("_k"), F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("_cell"), F.col("first").alias("_other"))
    beaten = first[key].eqNullSafe(there["_k"]) & (first["cell"] == there["_cell"]) & (there["_other"] < first["first"])
    kept = table(first.join(there, beaten, "left_anti").select(key, "cell", "first.value", "first.order"))
    return kept.select(key, "value", "order"), _without(left, kept, key, eps)


def _large(rows: DataFrame, key: str, eps: float) -> DataFrame:
    """Kept (key, value, order) of keys that no task may hold. rows: key, value, order, distinct values."""
    left = table(rows.withColumn("cell", F.floor(F.col("value") / (2 * eps))))
    done: list[DataFrame] = []
    while True:
        stats = left.groupBy(key).agg(F.count("*").alias("n"), F.min("cell").alias("low"), F.max("cell").alias("high"))
        stats = table(stats.withColumn("wide", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) * RANGE / F.col("n"))).cast("long")).select(F.col(key).alias("_s"), "low", "wide"))
        if stats.isEmpty():
            break
        placed = left.join(stats, left[key].eqNullSafe(stats["_s"])).drop("_s").withColumn("range", F.floor((F.col("cell") - F.col("low")) / F.col("wide")))
        most = placed.groupBy(key, "range").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most > LIMIT:
            kept, rest = _dense_round(left, key, eps)
            done.append(kept)
            left = table(rest)
            continue
        inside = F.pmod(F.col("cell") - F.col("low"), F.col("wide"))
        placed = placed.withColumn("border", (inside == 0) | (inside == F.col("wide") - 1))
        seen = F.array_compact(F.array(F.struct(F.col("range"), F.lit(True).alias("own")), F.when(inside == 0, F.struct((F.col("range") - 1).alias("range"), F.lit(False).alias("own"))), F.when(inside == F.col("wide") - 1, F.struct((F.col("range") + 1).alias("range"), F.lit(False).alias("own")))))
        halo = placed.select(key, "value", "order", "cell", "border", F.explode(seen).alias("s")).select(key, "value", "order", "cell", "border", "s.range", "s.own")
        schema = halo.select(key, "value", "order", "cell", "border", F.lit(True).alias("kept")).schema

        def decide(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["order", "value"], kind="stable").reset_index(drop=True)
            kept, later = sweep(pdf["value"].tolist(), pdf["own"].tolist(), eps)
            out = pdf.iloc[kept + later][[key, "value", "order", "cell", "border"]].copy()
            out["kept"] = [True] * len(kept) + [False] * len(later)
            return out

        told = table(halo.groupBy(key, "range").applyInPandas(decide, schema))
        done.append(told.filter("kept").select(key, "value", "order"))
        left = table(_without(told.filter("not kept").drop("kept", "border"), told.filter("kept and border"), key, eps))
    out = left.select(key, "value", "order").limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


def dedupe_greedy(df: DataFrame, key: str, value: str, order: str, eps: float) -> DataFrame:
    """Rows of each key, in the order of `order` (ties by value), whose value is farther than eps from every one kept before.

    Null, NaN and infinite values are dropped; a null key is a key; an empty table stays empty; rows that repeat a value are equal but for the first one. Columns may bear any other names."""
    x = F.col(value).cast("double")
    good = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rest = [c for c in df.columns if c not in (key, value)]
    first = F.min_by(F.struct(*rest), F.struct(order)).alias("_first")
    rows = good.groupBy(key, value).agg(first).select(key, value, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(df.columns)
    if eps <= 0:
        return rows
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > LIMIT).select(F.col(key).alias("_k"))
    many = table(many)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, value], kind="stable")
        return pdf.iloc[sweep(pdf[value].astype(float).tolist(), [True] * len(pdf), eps)[0]]

    if many.isEmpty():
        return rows.groupBy(key).applyInPandas(keep, rows.schema)
    rows = table(rows)
    is_many = rows[key].eqNullSafe(many["_k"])
    small = rows.join(many, is_many, "left_anti").groupBy(key).applyInPandas(keep, rows.schema)
    large = rows.join(many, is_many, "left_semi")
    slim = large.select(F.col(key).alias("k"), F.col(value).cast("double").alias("value"), F.col(order).alias("order"))
    kept = table(_large(slim, "k", eps)).select(F.col("k").alias("_k"), F.col("value").alias("_v"))
    return small.unionByName(large.join(kept, large[key].eqNullSafe(kept["_k"]) & (large[value].cast("double") == kept["_v"]), "left_semi"))
