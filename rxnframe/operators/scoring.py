"""Errors, losses and training logs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_BEST = 100.0


def regression_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str], batch: str | None = None) -> DataFrame:
    """Mae, mse and rmse per target name (target, prediction) and overall. With a batch column, means of batch means."""
    measures = {}
    for name, (target, predicted) in pairs.items():
        gap = F.col(predicted).cast("double") - F.col(target).cast("double")
        measures |= {f"{name}_mae": F.abs(gap), f"{name}_mse": gap * gap}
    out = df
    if batch:
        out = out.groupBy(*by, batch).agg(*[F.avg(m).alias(n) for n, m in measures.items()])
        measures = {n: F.col(n) for n in measures}
    out = out.groupBy(*by).agg(*[F.avg(m).alias(n) for n, m in measures.items()])
    mean = lambda kind: sum((F.col(f"{n}_{kind}") for n in pairs), F.lit(0.0)) / len(pairs)
    return out.withColumns({"mae": mean("mae"), "mse": mean("mse")}).withColumns({f"{n}_rmse": F.sqrt(f"{n}_mse") for n in pairs})


def weighted_loss(df: DataFrame, pairs: list[tuple[str, str]], weights: list[float], by: list[str], kind: str = "mae") -> DataFrame:
    """Sum of weight times mean error over (target, prediction) pairs."""
    if len(pairs) != len(weights):
        raise ValueError("as many weights as targets are needed")
    gaps = [F.col(p).cast("double") - F.col(t).cast("double") for t, p in pairs]
    errors = [F.avg(F.abs(g) if kind == "mae" else g * g) for g in gaps]
    return df.groupBy(*by).agg(sum((w * e for w, e in zip(weights, errors)), F.lit(0.0)).alias("loss"))


def mcc_binary(df: DataFrame, prediction: str, target: str, by: list[str], weight: Column | None = None, mask: Column | None = None) -> DataFrame:
    """1 - soft Matthews correlation from weighted soft counts; null if a margin is empty."""
    w = (weight if weight is not None else F.lit(1.0)) * (mask.cast("double") if mask is not None else F.lit(1.0))
    p, t = F.col(prediction), F.col(target)
    cells = {"tp": t * p, "fp": (1 - t) * p, "fn": t * (1 - p), "tn": (1 - t) * (1 - p)}
    out = df.groupBy(*by).agg(*[F.sum(c * w).alias(n) for n, c in cells.items()])
    tp, fp, fn, tn = (F.col(n) for n in cells)
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return out.select(*by, (1 - (tp * tn - fp * fn) / F.nullif(below, F.lit(0.0))).alias("loss"))


def mcc_multiclass(df: DataFrame, scores: str, target: str, by: list[str], classes: int, weight: Column | None = None) -> DataFrame:
    """1 - multiclass Matthews correlation of the arg max (first among equals); 1.0 if undefined. Target classes count from 0."""
    w = weight if weight is not None else F.lit(1.0)
    x = df.select(*by, F.col(target).alias("_t"), (F.array_position(scores, F.array_max(scores)) - 1).alias("_p"), w.alias("_w"))
    sums = [F.sum(F.when(F.col(c) == k, F.col("_w")).otherwise(0.0)).alias(f"{c}{k}") for c in ("_t", "_p") for k in range(classes)]
    x = x.groupBy(*by).agg(F.sum("_w").alias("n"), F.sum(F.when(F.col("_t") == F.col("_p"), F.col("_w")).otherwise(0.0)).alias("right"), *sums)
    dot = lambda a, b: sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in range(classes)), F.lit(0.0))
    n = F.col("n")
    cov, pp, tt = F.col("right") * n - dot("_p", "_t"), n * n - dot("_p", "_p"), n * n - dot("_t", "_t")
    return x.select(*by, F.when(pp * tt == 0, 1.0).otherwise(1 - cov / F.sqrt(pp * tt)).alias("loss"))


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    x = x.copy()
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8; smaller arguments step up to it."""
    x, step = x.copy(), np.zeros_like(x)
    while (small := x < 8).any():
        step[small] += np.log(x[small])
        x[small] += 1
    i = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / x - step


def dirichlet_loss(df: DataFrame, alphas: str, target: str, lam: float = 0.0, name: str = "loss") -> DataFrame:
    """Evidential loss of each row: squared error plus variance of the Dirichlet mean, plus lam times the divergence from the flat one."""
    total = F.aggregate(alphas, F.lit(0.0), lambda s, a: s + a)
    x = df.withColumn("_s", total)

    def term(a: Column, i: Column) -> Column:
        p = a / F.col("_s")
        y = (i == F.col(target)).cast("double")
        return (y - p) * (y - p) + p * (1 - p) / (F.col("_s") + 1)

    x = x.withColumn(name, F.aggregate(F.transform(alphas, term), F.lit(0.0), lambda s, a: s + a)).drop("_s")
    if not lam:
        return x

    @F.pandas_udf("double")
    def divergence(a: pd.Series, t: pd.Series) -> pd.Series:
        m = np.stack(a.to_numpy()).astype(float) if len(a) else np.zeros((0, 1))
        m[np.arange(len(m)), t.to_numpy()] = 1.0
        s, k = m.sum(1), m.shape[1]
        log = _lgamma(s) - _lgamma(m).sum(1) - math.lgamma(k)
        return pd.Series(log + ((m - 1) * (_digamma(m) - _digamma(s)[:, None])).sum(1))

    return x.withColumn(name, F.col(name) + lam * divergence(alphas, target))


def cross_entropy(logits: str, target: str) -> Column:
    """Log-sum-exp of an array of logits minus the target's logit."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) - F.get(F.col(logits), F.col(target).cast("int"))


def binary_cross_entropy(logit: str, target: str) -> Column:
    """Stable cross-entropy of one logit."""
    x = F.col(logit)
    return F.greatest(x, F.lit(0.0)) - x * F.col(target) + F.log1p(F.exp(-F.abs(x)))


def classification_loss(df: DataFrame, loss: Column, by: list[str]) -> DataFrame:
    """Mean loss per group."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def best_epochs(epochs: DataFrame, patience: int, by: list[str], epoch: str = "epoch", loss: str = "val_loss", start: float = FIRST_BEST) -> DataFrame:
    """best loss before each epoch, whether it is a new best (strictly lower), epochs since the best one, and whether training stops there (more than `patience`)."""
    w = Window.partitionBy(*by).orderBy(epoch)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = epochs.withColumn("best_before", F.least(F.lit(start), F.coalesce(F.min(loss).over(past), F.lit(start))))
    out = out.withColumn("is_best", F.col(loss) < F.col("best_before"))
    last = F.max(F.when(F.col("is_best"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("since_best", (F.col(epoch) - F.coalesce(last, F.lit(0))).cast("long"))
    return out.withColumn("stops", F.col("since_best") > patience)


def profile_barrier(frames: DataFrame, by: str, frame: str, energy: str, factor: float = 627.5) -> DataFrame:
    """barrier of an energy profile seen from its first and from its last frame."""
    top = F.max(energy)
    return frames.groupBy(by).agg((factor * (top - F.min_by(energy, frame))).alias("barrier_first"), (factor * (top - F.max_by(energy, frame))).alias("barrier_last"))
