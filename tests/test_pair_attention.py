"""Blockwise pair attention against the dense formula."""

import math
import random

import pytest

from rxnframe.operators import attention

NODES, PAIRS = "graph_id long, node long, q array<double>, k array<double>, v array<double>", "graph_id long, node long, other long, e double, g double"


def case(sizes, width, seed=1):
    rnd = random.Random(seed)
    vec = lambda: [rnd.uniform(-3, 3) for _ in range(width)]
    nodes = [(g, v * 3, vec(), vec(), vec()) for g, n in enumerate(sizes) for v in range(n)]
    pairs = [(g, a * 3, b * 3, rnd.uniform(-40, 40), rnd.uniform(-2, 2)) for g, n in enumerate(sizes) for a in range(n) for b in range(n)]
    rnd.shuffle(pairs)
    return nodes, pairs


def dense(nodes, pairs, width, scale):
    at = {(g, v): x for g, v, *x in nodes}
    rows = {}
    for g, a, b, e, gate in pairs:
        rows.setdefault((g, a), []).append((b, e, 1 / (1 + math.exp(-gate))))
    out = {}
    for (g, a), found in rows.items():
        logit = [min(5, max(-5, sum(x * y for x, y in zip(at[g, a][0], at[g, b][1])) / math.sqrt(width))) + e for b, e, _ in found]
        top = max(logit)
        w = [math.exp(x - top) for x in logit]
        factor = math.log1p(sum(s for _, _, s in found)) if scale else 1
        out[g, a] = [sum(x * s * at[g, b][2][d] for x, (b, _, s) in zip(w, found)) / sum(w) * factor for d in range(width)]
    return out


@pytest.mark.parametrize("held", ["10000", "13", "1"])
@pytest.mark.parametrize("scale", [False, True])
def test_against_the_dense_formula(spark, held, scale):
    nodes, pairs = case([1, 5, 0, 9, 3, 30 if held != "1" else 4], 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    try:
        got = {(r.graph_id, r.node): r.h for r in attention.pair_attention(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, PAIRS), 3, scale_degree=scale).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = dense(nodes, pairs, 3, scale)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for x in want for a, b in zip(got[x], want[x]))


def test_edges_and_plan(spark):
    nodes, pairs = case([2], 2)
    n, p = spark.createDataFrame([*nodes, (None, 1, [1.0] * 2, [1.0] * 2, [1.0] * 2), (5, 1, [1.0] * 2, [1.0] * 2, [1.0] * 2)], NODES), spark.createDataFrame([*pairs, (0, 0, 99, 0.0, 0.0), (0, 0, 3, None, 0.0), (None, 0, 0, 0.0, 0.0), (7, 1, 1, 0.0, 0.0)], PAIRS)
    out = attention.pair_attention(n, p, 2)
    want = dense(nodes, pairs, 2, False)
    assert {(r.graph_id, r.node): [round(x, 9) for x in r.h] for r in out.collect()} == {k: [round(x, 9) for x in v] for k, v in want.items()}
    plan = attention.pair_attention(n, p, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert attention.pair_attention(n.limit(0), p.limit(0), 2).count() == 0
