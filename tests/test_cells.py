"""Neighbours within a radius by cells against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxnframe.operators import geometry

COORDS = "graph_id long, frame int, node long, element string, x double, y double, z double"


def cloud(seed, frames=6, most=120):
    rnd = random.Random(seed)
    return [(g, f, v, rnd.choice("HCNO"), rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.uniform(-2, 2)) for g in range(frames) for f in (0, 1) for v in range(rnd.randint(1, most))]


def brute(rows, radius):
    out = set()
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2] and sum((p - q) ** 2 for p, q in zip(a[4:], b[4:])) ** 0.5 < radius:
                out.add((*a[:2], a[2], b[2]))
    return out


@pytest.mark.parametrize("small", [64, 1])
def test_near_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(geometry, "SMALL", small)
    rows = cloud(small)
    got = [(r.graph_id, r.frame, r.node_i, r.node_j) for r in geometry.near_pairs(spark.createDataFrame(rows, COORDS), 1.7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 1.7)


@pytest.mark.parametrize("small", [64, 1])
def test_within(spark, monkeypatch, small):
    monkeypatch.setattr(geometry, "SMALL", small)
    rows = cloud(9)
    df = spark.createDataFrame(rows, COORDS)
    got = [(r.graph_id, r.frame, *sorted((r.node_i, r.node_j))) for r in geometry.within(df.filter("element = 'H'"), df.filter("element <> 'H'"), 2.5).collect()]
    kind = {r[:3]: r[3] == "H" for r in rows}
    assert sorted(got) == sorted(x for x in brute(rows, 2.5) if kind[(*x[:2], x[2])] != kind[(*x[:2], x[3])])


def test_odd_coordinates_are_near_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 1, "C", 0.0, 0.0, 0.0), (1, 0, 2, "C", nan, 0.0, 0.0), (1, 0, 3, "C", None, 0.0, 0.0), (1, 0, 4, "C", inf, 0.0, 0.0), (1, 0, 5, "C", 0.1, 0.0, 0.0), (None, 0, 1, "C", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, COORDS)
    assert [(r.node_i, r.node_j) for r in geometry.near_pairs(df, 1.0).collect()] == [(1, 5)]
    assert geometry.near_pairs(df.limit(0), 1.0).count() == 0
    assert {(r.node_i, r.node_j) for r in geometry.within(df, df, 1.0).collect()} == {(1, 5), (5, 1)}


def test_a_frame_of_a_hundred_thousand_atoms(spark):
    """A grid: each atom has its six neighbours, and the rows that the join makes stay a small multiple of the atoms."""
    n = 46
    df = spark.range(n**3).selectExpr("1L as graph_id", "0 as frame", "id as node", "'C' as element", f"double(id % {n}) as x", f"double((id div {n}) % {n}) as y", f"double(id div {n * n}) as z")
    assert geometry.near_pairs(df, 1.2).count() == 3 * n * n * (n - 1)


def test_frames_are_spread(spark):
    df = spark.range(4000).selectExpr("1L as graph_id", "0 as frame", "id as node", "'C' as element", "double(id % 40) as x", "double(id div 40) as y", "0D as z")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = geometry._in_cells(df, 1.5, ["graph_id", "frame"], False).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2500


def test_segment_distances_of_many_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(-2, 3, (4, 200, 3)).astype(float)  # touching, parallel and empty segments among them
    p[2, ::5, 1] = np.nan
    got = geometry.segment_distances(*p)
    df = spark.createDataFrame([(k, *[None if x != x else float(x) for x in p[:, k].ravel()]) for k in range(200)], "k long, " + ", ".join(f"c{i} double" for i in range(12)))
    d = geometry.segment_distance(*[[F.col(f"c{3 * e + i}") for i in range(3)] for e in range(4)])
    want = np.array([np.nan if r.d is None else r.d for r in df.select("k", d.alias("d")).orderBy("k").collect()])
    np.testing.assert_allclose(got, want, atol=1e-12)
