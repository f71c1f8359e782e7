"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of WIDTH dimensions. Cosine >= t means squared distance <= 2 (1 - t), so in
at least one block the squared distance is within that block's proportional share of the budget. Each block is joined by
range on a grid of its first two coordinates with cells as wide as the block's radius: a row is at home in its cell and
probes half of the neighbouring cells, so a pair meets once. Candidates within the block's budget are verified exactly by
cosine in double precision, in the first block that finds them. Crowded cells are split into tiles: rows at
home are dealt to chunks and probes to turns, and every chunk meets every turn. Tiles hold a fixed share of all rows, so that work is even
and a row is sent as often in a larger table, until a tile is as large as a task's memory allows (CHUNK components); beyond that, on vectors
without structure, rows sent grow with a cell's size. A task returns link counts and one label for each row, never pairs.

Equal vectors collapse to their smallest id first and count with their number. Vectors that are null, empty, zero or
hold null or non-finite components link with nothing: n_links 0, their own component; so do they where another row of their id has a vector. Only vectors of equal length are
compared. Rows with a null id have a null component. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, table
from rxnframe.llm.components import components

WIDTH, CHUNK, SHARE, LEAST, SLICE = 16, 1 << 19, 16, 512, 512
HALF = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


@cache
def rotation(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).normal(size=(n, n)))[0]


def blocks_of(n: int) -> list[slice]:
    m = max(1, n // WIDTH)
    edge = np.linspace(0, n, m + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def budgets(n: int, t: float) -> np.ndarray:
    """Squared-distance share of each block, with room for rounding."""
    return np.array([2 * (1 - t) * (b.stop - b.start) / n for b in blocks_of(n)]) * (1 + 1e-9) + 1e-12


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(vectors: DataFrame, t: float) -> DataFrame:
    """Adds cells: block, x, y and home of every visit."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            out = [[] for _ in lists]
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_width.setdefault(len(v), []).append(i)
            for n, rows in by_width.items():
                y = _units(np.array([lists[i] for i in rows])) @ rotation(n)
                for b, (part, budget) in enumerate(zip(blocks_of(n), budgets(n, t))):
                    at = np.floor(y[:, part][:, :2] / budget**0.5).astype(np.int64)
                    if at.shape[1] == 1:
                        at = np.hstack([at, np.zeros_like(at)])
                    for i, (p, q) in zip(rows, at.tolist()):
                        out[i] += [{"block": b, "x": p + dx, "y": q + dy, "home": not (dx or dy)} for dx, dy in HALF]
            cells = pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("home", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return vectors.mapInArrow(run, "id long, n long, vector array<double>, cells array<struct<block: int, x: long, y: long, home: boolean>>")


def _compare(block: int, t: float, home, probe):
    """Weighted link counts of both sides and local labels. Sides are (id, n, own, unit vectors, rotated)."""
    parts, limit = blocks_of(home[3].shape[1]), budgets(home[3].shape[1], t)
    here = parts[block]
    ps, hs = [], []
    hy = home[4][:, here]
    hn = (hy * hy).sum(1)
    for a in range(0, len(probe[0]), SLICE):
        py = probe[4][a : a + SLICE, here]
        d = (py * py).sum(1)[:, None] + hn - 2 * py @ hy.T
        p, h = np.nonzero(d <= limit[block] + 1e-9)
        p += a
        keep = ~probe[2][p] | (probe[0][p] < home[0][h])  # of a cell with itself each pair once
        p, h = p[keep], h[keep]
        for s in range(0, len(p), 1 << 15):
            x, y = p[s : s + (1 << 15)], h[s : s + (1 << 15)]
            gap = (probe[4][x] - home[4][y]) ** 2
            ok = gap[:, here].sum(1) <= limit[block]
            for j in range(block):
                ok &= gap[:, parts[j]].sum(1) > limit[j]
            x, y = x[ok], y[ok]
            ok = (probe[3][x] * home[3][y]).sum(1) >= t
            ps.append(x[ok])
            hs.append(y[ok])
    if not ps:
        return []
    p, h = np.concatenate(ps), np.concatenate(hs)
    if not len(p):
        return []
    ids = np.concatenate([probe[0][p], home[0][h]])
    nodes, flat = np.unique(ids, return_inverse=True)
    u, v = flat[: len(p)], flat[len(p) :]
    count = np.bincount(flat, np.concatenate([home[1][h], probe[1][p]]), minlength=len(nodes)).astype(np.int64)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [nodes, count, nodes[label]]


def usable(column: str) -> Column:
    """Whether an array<double> can have a direction: not null, empty or zero, and all of it finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, t: float = 0.95) -> DataFrame:
    """df (vec_id, embedding) -> vec_id, n_links, component_id, kept for each row."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    digest = F.when(usable("vector") & F.col("vec_id").isNotNull(), F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256))
    rows = table(rows.withColumn("digest", digest))
    good = rows.filter("digest is not null")
    sets = table(good.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    vectors = good.join(sets, [good.digest == sets.digest, good.vec_id == sets.id]).select("id", "n", "vector").dropDuplicates(["id", "vector"])
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    chunk = max(1, min(CHUNK // size.width, max(LEAST, size.n // SHARE)))
    cells = table(_cells(vectors, t).select("id", "n", "vector", F.size("vector").alias("width"), F.explode("cells").alias("c")).select("id", "n", "vector", "width", "c.*"))
    key = ["width", "block", "x", "y"]
    crowd = table(cells.groupBy(*key).agg(F.ceil(F.count_if("home") / chunk).alias("chunks"), F.ceil(F.count("*") / (2 * chunk)).alias("turns")).filter("chunks > 0"))
    visits = cells.join(crowd, key)
    homes = visits.filter("home").withColumn("chunk", F.expr("pmod(xxhash64(id), chunks)")).withColumn("turn", F.explode(F.expr("sequence(0L, turns - 1)"))).withColumn("side", F.lit(0))
    probes = visits.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("turn", F.expr("pmod(xxhash64(id, 5), turns)")).withColumn("side", F.lit(1))
    key = [*key, "chunk", "turn"]
    meet = homes.select(*key, "side", "home", "id", "n", "vector").unionByName(probes.select(*key, "side", "home", "id", "n", "vector"))

    def run(batches):
        at, home, probe = None, [], []
        schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])

        def side(found):
            x = np.concatenate([f[3] for f in found])
            u = _units(x)
            return *(np.concatenate([f[i] for f in found]) for i in range(3)), u, u @ rotation(x.shape[1])

        def done():
            if home and probe and (got := _compare(at[1], t, side(home), side(probe))):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*key, "side")], 1)
            ids, n, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "home"))
            flat = batch.column("vector").flatten().to_numpy()
            start = np.cumsum(np.append(0, keys[:, 0]))
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for a, b in zip(cut, [*cut[1:], len(keys)]):
                if at != (k := tuple(keys[a, :-1].tolist())):
                    yield from done()
                    at, home, probe = k, [], []
                (probe if keys[a, -1] else home).append((ids[a:b], n[a:b], own[a:b].astype(bool), flat[start[a] : start[b]].reshape(b - a, -1)))
        yield from done()

    found = table(meet.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "id long, links long, label long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "id")
    labels = table(sets.join(links, "id", "left").join(classes, "id", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    known = good.select("vec_id", "digest").join(labels, "digest").select("vec_id", "n_links", "component_id")
    rest = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def sql(t: float = 0.95) -> str:
    return f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {t}),
r as (select a as node, a as seen from l union select r.node, l.b from r join l on r.seen = l.a),
c as (select node, min(seen) as component from r group by node),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component, e.vec_id)::bigint as component_id, coalesce(c.component, e.vec_id) = e.vec_id as kept
from embeddings e left join c on e.vec_id = c.node left join n on e.vec_id = n.a"""
