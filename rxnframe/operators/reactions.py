"""Reaction-level columns over whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.functions import columns as K

HARTREE = 627.5095


def split_reaction(df: DataFrame, column: str = "smiles") -> DataFrame:
    """B1: adds reactant and product."""
    r, p = K.split_reaction(column)
    return df.withColumns({"reactant": r, "product": p})


def assign_class(df: DataFrame, mode: str, name: str = "rxntype") -> DataFrame:
    """Molecularity (of reactant and product), heavy ({n_heavy}atom) or all."""
    kinds = {"molecularity": lambda: K.molecularity_class(F.col("reactant"), F.col("product")), "heavy": lambda: F.concat(F.col("n_heavy").cast("string"), F.lit("atom")), "all": lambda: F.lit("All")}
    if mode not in kinds:
        raise ValueError(f"unknown class mode {mode}")
    return df.withColumn(name, kinds[mode]())


def reaction_energies(df: DataFrame, factor: float = HARTREE) -> DataFrame:
    """Barrier and enthalpy from g_r, g_ts, h_r and h_p, by the energy unit's factor."""
    return df.withColumns({"barrier": (F.col("g_ts") - F.col("g_r")) * factor, "enthalpy": (F.col("h_p") - F.col("h_r")) * factor})


def reverse_reactions(df: DataFrame, pairs: list[tuple[str, str]], union: bool = False) -> DataFrame:
    """Each pair of columns swapped; with union, beside the originals and marked by `reversed`."""
    swap = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    out = df.select([F.col(swap.get(c, c)).alias(c) for c in df.columns])
    if not union:
        return out
    return df.withColumn("reversed", F.lit(False)).unionByName(out.withColumn("reversed", F.lit(True)))


def bep_predict(df: DataFrame, slope: str, intercept: str, x: str, name: str = "predicted") -> DataFrame:
    """Slope * x + intercept."""
    return df.withColumn(name, F.col(slope) * F.col(x) + F.col(intercept))


def bep_fit(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Least-squares slope and intercept per class; null for classes of one point."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_standardise(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations (1 where it is 0)."""
    return train.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std") for c in columns])


def apply_standardise(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / deviation of each column."""
    out = df.crossJoin(F.broadcast(fitted))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(df.columns)


def fragment_energy(df: DataFrame, energies: DataFrame, by: str, key: str, value: str, on: str | None = None) -> DataFrame:
    """Sum of the energies of a group's fragments (column `on`, by default named as the energies' key), 0 if any is missing."""
    known = energies.select(F.col(key).alias("_k"), F.col(value).alias("_e"))
    out = df.join(known, df[on or key] == known["_k"], "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_e").alias("known"), F.sum("_e").alias("total"))
    return out.select(by, F.when(F.col("n") == F.col("known"), F.col("total")).otherwise(0.0).alias("energy"))


def missing_energies(df: DataFrame, energies: DataFrame, key: str) -> DataFrame:
    """Distinct keys without an energy."""
    return df.select(key).distinct().join(energies.select(key), key, "left_anti")


def group_by_product(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Reactions with the same canonical product."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(ids)).alias("ids"), F.count("*").alias("n"))
