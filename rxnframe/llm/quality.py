"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model on character-shape frequencies by the non-negative
unbiased risk  pi E_p[l(z)] + max(0, E_u[l(-z)] - pi E_p[l(-z)])  with logistic loss. The class prior pi is
estimated first: a positive-against-unlabelled model scores rows that it wasn't fitted on, and pi is the least ratio,
over cutoffs, of the unlabelled share above to the positive share above, as the lower quartile of the cutoffs that differ from the
least by no more than chance; of two folds the mean, less the chance error.

Features are centred and scaled, and the prior is read, by sums over all rows. The weights are descended on at most `positives` and `unlabelled` distinct
texts, whole, chosen by a hash of the text: documented bounds.
Null texts count as empty and get a score as well. Without positives all scores are 0.5. Repeated rows score alike; an
empty table gives an empty result; extra columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import adding, assemble, lean, local_rows, mapped, row_ranges, utf8, words

POSITIVES, UNLABELLED, CUTOFF, MERGERS, RANGE = 2500, 4500, 0.3, 16, 1 << 18
_SHAPE = np.zeros(256, np.int64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[[9, 11, 12, 13, 32]], _SHAPE[10] = 1, 2, 3, 4, 5
_SHAPE[128:192], _SHAPE[192:] = 6, 7
_PLAIN = [i for i in range(33, 127) if not _SHAPE[i]]
_SHAPE[_PLAIN] = np.arange(len(_PLAIN)) + 8
SHAPES = len(_PLAIN) + 8
EXTRA = 5
WIDTH = SHAPES * SHAPES + EXTRA


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of byte-shape pair frequencies, the text's length, words and lines on a log scale, and the shares of words that repeat the one before or one of the three before."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, WIDTH), np.float32)
    if len(data):
        shape = _SHAPE[data]
        row = np.repeat(np.arange(n), size)
        pair = shape * SHAPES
        pair[:-1] += shape[1:]
        pair[off[1:][size > 0] - 1] -= pair[off[1:][size > 0] - 1] % SHAPES
        out[:, :-EXTRA] = np.bincount(row * (WIDTH - EXTRA) + pair, minlength=n * (WIDTH - EXTRA)).reshape(n, -1)
        out[:, -2] = np.log1p(np.bincount(row[shape == 4], minlength=n)) / 10
        out[:, -1] = np.log1p(np.bincount(row[shape == 5], minlength=n)) / 10
        _, _, first, h = words(data, off)
        of, count = local_rows(first), np.maximum(1, np.diff(first))
        same = [np.append(np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (of[k:] == of[:-k])) for k in (1, 2, 3)]
        out[:, -4] = np.bincount(of, same[0], minlength=n) / count
        out[:, -5] = np.bincount(of, same[0] | same[1] | same[2], minlength=n) / count
    out[:, :-EXTRA] = np.sqrt(out[:, :-EXTRA] / np.maximum(1, size)[:, None])
    out[:, -3] = np.log1p(size) / 10
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slope(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float | None) -> np.ndarray:
    """Gradient of the risk at weights w; where the negative part is under 0, of that part turned round, which brings it back. No prior: positives against unlabelled, plainly."""
    zp, zu = p @ w[:-1].astype(p.dtype) + w[-1], u @ w[:-1].astype(u.dtype) + w[-1]
    gp, gu = (_sigmoid(zp) - 1) / len(p), _sigmoid(zu) / len(u)  # of l(z) on positives and l(-z) on unlabelled
    if prior is not None:
        back = _sigmoid(zp) / len(p)  # of l(-z) on positives
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = (prior * (gp - back), gu) if negative >= 0 else (prior * back, -gu)
    gp, gu = gp.astype(p.dtype), gu.astype(u.dtype)
    return np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights with a bias at the end, by Adam."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = slope(p, u, w, prior)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def cuts_of(p: np.ndarray, w: np.ndarray, odd: int) -> np.ndarray:
    """Sorted scores of the positives that a fold's model wasn't fitted on: the cutoffs to measure its prior at."""
    return np.sort(p[odd::2] @ w[:-1].astype(p.dtype) + p.dtype.type(w[-1]))


def fold_prior(z: np.ndarray, above: np.ndarray, n: int) -> tuple[float, float]:
    """Best-bin estimate from the sorted scores of held-out positives and the number of n held-out unlabelled rows at or above each, and the chance error of the shares."""
    keep = max(1, int(len(z) * 0.9))
    slack = np.sqrt(np.log(20) / 2 / len(z)) + np.sqrt(np.log(20) / 2 / n)
    qp, qu = 1 - np.searchsorted(z, z[:keep], "left") / len(z), above[:keep] / n
    ratio = qu / qp
    best = np.argmin((qu + slack) / qp)
    alike = (np.abs(ratio - ratio[best]) <= slack) & (qp >= 0.2)  # as low as the best one, but for chance
    return float(np.quantile(ratio[alike], 0.25) if alike.any() else ratio[best]), float(slack)


def estimate_prior(folds: list[tuple[float, float]]) -> float:
    """The class prior's lower confidence limit: the mean of both folds' estimates less their chance error.

    A prior that is too high leaves no risk to the negatives and makes every document a positive, one that is somewhat low does little harm."""
    if len(folds) < 2:
        return 0.5
    return float(np.clip(np.mean([x - slack for x, slack in folds]), 0.05, 0.95))


class Model:
    def __init__(self, centre: np.ndarray | None = None, scale: np.ndarray | None = None, prior: float = 0.5, w: np.ndarray | None = None):
        """w: weights of centred and scaled features with a bias at the end; without any, all scores are 0.5."""
        self.centre, self.scale, self.prior, self.weights = centre, scale, prior, np.zeros(WIDTH + 1)
        if w is not None:
            self.weights = np.append(w[:-1] / scale, w[-1] - (w[:-1] * centre / scale).sum())

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _sigmoid(features(data, off) @ self.weights[:-1].astype(np.float32) + self.weights[-1])


def _share(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most `bound` distinct texts, those with the least hashes of a text; about nine tenths of the bound where there are more, so that no sort over all rows is needed."""
    share = min(1.0, 0.9 * bound / max(1, rows.count()))
    key = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40))
    near = rows.select("text", key.alias("_at")).filter(F.col("_at") <= int(share * (1 << 40)))
    last = near.select("_at").distinct().orderBy("_at").limit(bound).agg(F.max("_at")).first()[0]  # numbers only; texts stay spread
    return near.filter(F.col("_at") <= (-1 if last is None else last)).groupBy("_at").agg(F.min("text").alias("text")).select("text")


def _sums(docs: DataFrame, make, width: int) -> np.ndarray:
    """The sum of make(features, fold) over all rows of docs, by a few tasks after one for each partition; fold is a hash bit of the text."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            data, off = utf8(batch, "text")
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for a, b in row_ranges(off, RANGE):
                total += make(features(data[off[a] : off[b]], off[a : b + 1] - off[a]), fold[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["raw"])

    def merge(batches):
        total = np.zeros(width)
        for batch in batches:
            for raw in batch.column("raw"):
                total += np.frombuffer(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["raw"])

    rows = docs.select("text", F.pmod(F.xxhash64("text", F.lit(31)), F.lit(2)).cast("int").alias("fold"))
    few = lean(rows).mapInArrow(run, "raw binary").repartition(MERGERS).mapInArrow(merge, "raw binary").collect()  # MERGERS rows
    return sum((np.frombuffer(bytes(r[0])) for r in few), np.zeros(width))


def _features(rows: DataFrame) -> np.ndarray:
    """Features of the rows' texts, made where the texts are and in an order of their own, so that a fit is the same each time. What comes to the driver doesn't depend on the texts' lengths."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            for a, b in row_ranges(off, RANGE):
                packed = [zlib.compress(x.tobytes(), 1) for x in features(data[off[a] : off[b]], off[a : b + 1] - off[a])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["packed"])

    got = sorted(bytes(r[0]) for r in lean(rows.select("text")).mapInArrow(run, "packed binary").collect())
    return np.stack([np.frombuffer(zlib.decompress(x), np.float32) for x in got]) if got else np.zeros((0, WIDTH), np.float32)


def fit(docs: DataFrame, trusted: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs (doc_id, text): unlabelled text; trusted (doc_id): ids of positives among them.

    Centre and scale of the features, and the shares of unlabelled rows above each cutoff that the prior is read from, are sums over all rows of docs. Weights are descended on
    samples of at most `positives` and `unlabelled` distinct texts, which are documented bounds."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct()
    p, u = _features(_share(docs.join(ids, "doc_id", "left_semi"), positives, 5)), _features(_share(docs, unlabelled, 9))
    if not len(p) or not len(u):
        return Model()
    total = _sums(docs, lambda x, _: np.concatenate([[len(x)], x.sum(0, dtype=float), np.square(x, dtype=float).sum(0)]), 2 * WIDTH + 1)
    n, mean = total[0], total[1 : WIDTH + 1] / total[0]
    centre = mean.astype(np.float32)
    scale = (np.sqrt(np.maximum(0, total[WIDTH + 1 :] / n - mean * mean)) + 0.02).astype(np.float32)
    p, u = (p - centre) / scale, (u - centre) / scale
    folds = []
    if len(p) > 1 and len(u) > 1:
        bit = np.arange(len(u)) % 2
        ws = [descend(p[1 - odd :: 2], u[bit != odd], None) for odd in (0, 1)]
        zs = [cuts_of(p, w, odd) for odd, w in enumerate(ws)]

        def above(x: np.ndarray, fold: np.ndarray) -> np.ndarray:
            x, out = (x - centre) / scale, []
            for odd in (0, 1):
                z = np.sort(x[fold == odd] @ ws[odd][:-1].astype(np.float32) + np.float32(ws[odd][-1]))
                out += [[len(z)], len(z) - np.searchsorted(z, zs[odd], "left")]
            return np.concatenate(out).astype(float)

        got = _sums(docs, above, len(zs[0]) + len(zs[1]) + 2)
        for odd in (0, 1):
            here = got[odd * (len(zs[0]) + 1) :]
            if here[0]:
                folds.append(fold_prior(zs[odd], here[1 : len(zs[odd]) + 1], int(here[0])))
    prior = estimate_prior(folds)
    return Model(centre, scale, prior, descend(p, u, prior, steps=400, rate=0.01, decay=1e-3))


def score(df: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= cutoff)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep, schema = adding(df, "score double, predicted int")

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            s = np.concatenate([shared.value.score(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in row_ranges(off, RANGE)] or [np.zeros(0)])
            yield assemble(batch, keep, {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= cutoff).astype(np.int32), pa.int32())})

    return mapped(df, run, schema)
