"""Exact top-k inner products by MaxScore.

Components become integers, floor(1024 * x). A dimension is a term: its posting list holds every row's component, and a query's
term scores the product of both components. Every query first gets a floor, its k-th best exact score against a fixed
sample of rows (`SEEDS` values at most), which is a lower bound of its k-th best score over all rows, and carries it along.
In each shard its terms are split: the weakest ones are non-essential while together they cannot reach the threshold,
by the smaller of the sum of their greatest scores and the product of norms. Postings of the essential terms are traversed;
the best rows so far raise the threshold; rows whose partial score plus the open bound still competes (the bound is the
row's own: the norm of what is left of it times that of the query) probe the other terms, strongest first, a few at a time, and drop
out as soon as they no longer compete; what survives is scored exactly. Shards merge by rank.

Rows come in shards and queries in blocks of at most `VALUES` components, as large as a task's memory allows, because each block meets
each shard once; tables too small for that are cut into one shard for each core. Vectors that are null, empty or hold
null or non-finite components take no part; only vectors of equal length are compared. Ties go to the smaller vec_id. Rows that
repeat an id are ranked each, as candidates and as queries. An empty table gives an empty result; extra columns are ignored. Scores
are exact below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxnframe.llm.common import table

VALUES, SEEDS, LEAST, PROBES = 1 << 21, 1 << 17, 2048, 8


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of rows that can take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


class Postings:
    """Rows of a shard by dimension; `scored` and `seen` count exact scores and rows met, for reports."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.lists = np.ascontiguousarray(x.T)
        self.squares = self.lists**2
        self.norm = self.squares.sum(0)
        self.longest = float(self.norm.max(initial=0.0)) ** 0.5
        self.high, self.low = (f(self.lists, axis=1, initial=0.0) for f in (np.max, np.min))
        self.scored = self.seen = 0

    def top(self, own: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of another id than `own`, without those that score less than `floor`."""
        most = np.maximum(q * self.high, q * self.low)
        terms = np.argsort(np.maximum(most, np.abs(q) * self.longest / max(1, len(q)) ** 0.5), kind="stable")
        summed, length = np.cumsum(most[terms]), np.sqrt(np.cumsum(q[terms] ** 2))
        least = floor
        split = int(np.searchsorted(np.minimum(summed, length * self.longest), least, "left")) if least > 0 else 0
        essential = np.sort(terms[split:])
        partial = q[essential] @ self.lists[essential]
        rest = self.norm - self.squares[essential].sum(0) if split else np.zeros(len(self.ids))
        open_sum, open_length = (summed[split - 1], length[split - 1]) if split else (0.0, 0.0)
        other = self.ids != own
        self.seen += len(other)
        ceiling = partial + np.minimum(open_sum, open_length * np.sqrt(np.maximum(rest, 0)))
        alive = np.flatnonzero(other & (ceiling >= least - 0.5))  # whole numbers: half of one is room for rounding
        if len(alive) > 4 * k:  # the most promising rows raise the threshold
            best = alive[np.argpartition(-ceiling[alive], k - 1)[: 2 * k]]
            scores = self.x[best] @ q
            self.scored += len(best)
            least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
            alive = alive[ceiling[alive] >= least - 0.5]
        partial, rest = partial[alive], rest[alive]
        while split and len(alive):
            some = terms[max(0, split - PROBES) : split]
            split = max(0, split - PROBES)
            cells = self.x[alive[:, None], some]
            partial, rest = partial + cells @ q[some], rest - (cells * cells).sum(1)
            open_sum, open_length = (summed[split - 1], length[split - 1]) if split else (0.0, 0.0)
            keep = partial + np.minimum(open_sum, open_length * np.sqrt(np.maximum(rest, 0))) >= least - 0.5
            alive, partial, rest = alive[keep], partial[keep], rest[keep]
        scores = self.x[alive] @ q
        self.scored += len(alive)
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def _floors(seeds: list[tuple[int, list[float]]], k: int):
    """Queries (key, vec_id, width, vector) with floor, the k-th best score among the seeds of other ids."""
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(v) for _, v in seeds}:
        some = [(i, v) for i, v in seeds if len(v) == n]
        by_width[n] = np.array([i for i, _ in some]), np.array([v for _, v in some])

    def run(batches):
        for pdf in batches:
            floors = np.full(len(pdf), -np.inf)
            for j, (own, v) in enumerate(zip(pdf["vec_id"], pdf["vector"])):
                ids, x = by_width.get(len(v), (np.zeros(0, int), None))
                other = ids != own
                if other.sum() >= k:
                    scores = x[other] @ np.asarray(v)
                    floors[j] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pdf.assign(floor=floors)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score; a query's own id is no candidate."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        return valid_vectors(df).select("vec_id", F.size("vector").alias("width"), F.transform("vector", lambda x: F.floor(x * 1024).cast("double")).alias("vector"))

    vectors = whole(vectors)
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max("width"), F.lit(1)).alias("width")).first()
    most, cores = max(1, VALUES // size.width), spark.sparkContext.defaultParallelism
    shards = max(1, -(-size.n // most), min(cores, -(-size.n // LEAST)))
    n_seeds = max(k + 1, SEEDS // size.width)
    seeds = [tuple(r) for r in vectors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_seeds).collect()]  # a bounded sample: it sets thresholds, never results
    asked = whole(queries).withColumn("key", F.monotonically_increasing_id()).select("key", "vec_id", "width", "vector")
    asked = table(asked.mapInPandas(_floors(seeds, k), "key long, vec_id long, width int, vector array<double>, floor double"))
    blocks = max(1, -(-asked.count() // most))
    place = lambda df, mine, by, n, other, m: df.withColumn(mine, F.expr(f"pmod(xxhash64({by}), {n}L)")).withColumn(other, F.explode(F.expr(f"sequence(0L, {m - 1}L)")))
    keys = ["width", "shard", "block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            rows = Postings(right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy()))
            for key, own, q, floor in zip(left["key"], left["vec_id"], left["vector"], left["floor"]):
                ids, scores = rows.top(own, np.asarray(q), k, floor)
                out.append(pd.DataFrame({"key": key, "query_id": own, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    left = place(asked, "block", "key", blocks, "shard", shards)
    right = place(vectors, "shard", "vec_id, vector", shards, "block", blocks)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 10) -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""
