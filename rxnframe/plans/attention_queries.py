"""Queries for attention layers, readout and batches, with weights from a formula."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rxnframe.operators import attention as A
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte
from rxnframe.plans.registry import query

HEADS, WIDTH, H, FW = 2, 2, 3, 2


def weights(rows: int, cols: int, k: int) -> list[list[float]]:
    return [[math.sin(7 * i + j + k) for j in range(cols)] for i in range(rows)]


W_EDGE, W_NODE = weights(HEADS * WIDTH, 2 * H + FW, 0), weights(HEADS * WIDTH, H, 1)
W_ATTN, W_SELF = weights(HEADS, WIDTH, 2), weights(HEADS, WIDTH, 3)
W_OLD, W_NEW = weights(4, H, 4), weights(4, 4, 5)
BIAS = [math.sin(0.1), math.sin(-0.2), math.sin(0.3), math.sin(0.05)]
_ATTN = [sum(c) for c in zip(*W_ATTN)]
_SELF = [sum(c) for c in zip(*W_SELF)]


def _shared(spark, sf):
    return X.shared_nodes(spark, sf, "l_quantity", "l_discount", "l_tax")


def _nodes(spark, sf, n=None):
    d = lambda c: F.col(c).cast("double")
    return (X.nodes(spark, sf) if n is None else n).select("graph_id", "node", F.array(d("l_quantity") / 50, d("l_discount"), d("l_tax")).alias("h"), (F.col("l_partkey") % 2).cast("double").alias("w"))


def _edges(spark, sf, side="r", n=None):
    tail = _nodes(spark, sf, n).select("graph_id", F.col("node").alias("v"), "w")
    return X.directed(spark, sf, side, n).join(tail, ["graph_id", "v"]).select("graph_id", "u", "v", F.array(F.col("ord").cast("double"), "w").alias("f"))


def _wide(df, column, width, keep=("graph_id", "node")):
    return df.select(*keep, *[F.round(F.col(column)[j], 6).alias(f"x{j}") for j in range(width)])


def _lin(row: list[float], names: list[str]) -> str:
    return "(" + " + ".join(f"({w!r}::double) * {n}" for w, n in zip(row, names)) + ")"


def _leaky(x: str) -> str:
    return f"(case when {x} >= 0 then {x} else 0.01::double * {x} end)"


_ND = "select graph_id, node, l_quantity::double / 50 as a, l_discount::double as b, l_tax::double as c, (l_partkey % 2)::double as w from n"
_ED = "select d.graph_id, d.u, d.v, d.ord::double as p, t.w as q, s.a as sa, s.b as sb, s.c as sc, t.a as ta, t.b as tb, t.c as tc from rd d join nd s on d.graph_id = s.graph_id and d.u = s.node join nd t on d.graph_id = t.graph_id and d.v = t.node"
_EDP = _ED.replace("from rd d", "from pd d")
_FO = "select graph_id, u, v, p, q, " + ", ".join(f"{_leaky(_lin(W_EDGE[i], ['sa', 'sb', 'sc', 'p', 'q', 'ta', 'tb', 'tc']))} as f{i}" for i in range(4)) + " from ed"
_SC = "select graph_id, u, v, " + ", ".join(f"{_lin(_ATTN, [f'f{2 * i}', f'f{2 * i + 1}'])} as l{i}" for i in range(HEADS)) + " from fo"
_Z = "select graph_id, node, " + ", ".join(f"{_lin(W_NODE[i], ['a', 'b', 'c'])} as z{i}" for i in range(4)) + " from nd"
_SUMS = ", ".join(f"round(sum(exp(l{i // 2} - m{i // 2}) * t * z{i}) / sum(exp(l{i // 2} - m{i // 2})), 6) as x{i}" for i in range(4))
_AG = f"select graph_id, node, {_SUMS} from (select *, max(l0) over w as m0, max(l1) over w as m1 from r window w as (partition by graph_id, node)) group by all"
_BASE = dict(nd=_ND, ed=_ED, fo=_FO, sc=_SC, z=_Z)


@query("d13_edge_softmax_aggregate", cte("rd", **_BASE, r="select sc.graph_id, sc.v as node, l0, l1, 1.0 as t, z0, z1, z2, z3 from sc join z on sc.graph_id = z.graph_id and sc.u = z.node") + _AG)
def d13(spark, sf):
    n = _shared(spark, sf)
    return _wide(A.edge_softmax_aggregate(_nodes(spark, sf, n), _edges(spark, sf, n=n), W_NODE, W_EDGE, W_ATTN, HEADS, H), "h", 4)


_HOW = {"sum": "sum({0})", "mean": "avg({0})", "max": "max({0})", "softmax_sum": "sum(exp(l - top) * {0}) / sum(exp(l - top))"}
_MS = "select graph_id, v as node, p * sa as m0, p * sb as m1, p * sc as m2, q - p as l, max(q - p) over (partition by graph_id, v) as top from ed"


@query("d13_reduce_messages", cte("rd", nd=_ND, ed=_ED, ms=_MS) + " union all ".join(f"select '{how}' as how, graph_id, node, " + ", ".join(f"round({x.format(f'm{j}')}, 6) as x{j}" for j in range(3)) + " from ms group by graph_id, node" for how, x in _HOW.items()))
def d13_reduce(spark, sf):
    n = _shared(spark, sf)
    source = _nodes(spark, sf, n).select("graph_id", F.col("node").alias("u"), "h")
    x = _edges(spark, sf, n=n).join(source, ["graph_id", "u"])
    order, kind = F.col("f")[0], F.col("f")[1]
    messages = x.select("graph_id", F.col("v").alias("node"), F.transform("h", lambda c: c * order).alias("m"), (kind - order).alias("logit"))
    parts = [_wide(A.reduce_messages(messages, 3, how), "h", 3).withColumn("how", F.lit(how)) for how in _HOW]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_ZL = "select graph_id, node, " + ", ".join(f"{_leaky(f'z{i}')} as z{i}" for i in range(4)) + " from z"
_OWN = "select graph_id, node, " + ", ".join(f"{_lin(_SELF, [f'z{2 * i}', f'z{2 * i + 1}'])} as l{i}" for i in range(HEADS)) + ", 2.0 as t, z0, z1, z2, z3 from zl"


@query("d14_self_attention", cte("rd", **_BASE, zl=_ZL, r=f"select sc.graph_id, sc.v as node, l0, l1, 1.0 as t, z0, z1, z2, z3 from sc join zl on sc.graph_id = zl.graph_id and sc.u = zl.node union all {_OWN}") + _AG)
def d14(spark, sf):
    n = _shared(spark, sf)
    return _wide(A.edge_softmax_aggregate(_nodes(spark, sf, n), _edges(spark, sf, n=n), W_NODE, W_EDGE, W_ATTN, HEADS, H, True, W_SELF), "h", 4)


_NEWP = [_lin(W_NEW[i], ["z0", "z1", "z2", "z3"]) for i in range(4)]
_OLDP = [_lin(W_OLD[i], ["a", "b", "c"]) for i in range(4)]
_GATE = [f"(1 / (1 + exp(-({a} + {b} + ({BIAS[i]!r}::double)))))" for i, (a, b) in enumerate(zip(_NEWP, _OLDP))]


@query("d15_combine_residual", cte("n", nd=_ND, z=_Z) + "select graph_id, node, " + ", ".join(f"round(z{i} + {_OLDP[i]}, 5) as v1_{i}, round(2 * z{i}, 5) as v2_{i}, round(greatest(z{i} + z{3 - i}, 0), 5) as skip_{i}, round({_GATE[i]} * {_NEWP[i]} + (1 - {_GATE[i]}) * {_OLDP[i]}, 5) as gate_{i}" for i in range(4)) + " from nd join z using (graph_id, node)")
def d15(spark, sf):
    x = A.dense(_nodes(spark, sf), "h", W_NODE, [0.0] * 4, None, "z")
    z, h = F.col("z"), F.col("h")
    x = x.withColumns({"v1": A.combine_residual("v1", z, h, W_OLD), "v2": A.combine_residual("v2", z, z), "skip": A.combine_residual("skip", z, F.reverse(z)), "gate": A.combine_residual("gate", z, h, W_OLD, W_NEW, BIAS)})
    return x.select("graph_id", "node", *[F.round(F.col(k)[i], 5).alias(f"{k}_{i}") for i in range(4) for k in ("v1", "v2", "skip", "gate")])


_PA = "select s.graph_id, s.node, greatest(-5.0, least(5.0, (s.z0 * t.z1 + s.z1 * t.z0) / sqrt(2.0::double))) + (case when abs(s.node - t.node) = 1 then 0.5 else 0 end) as l, 1 / (1 + exp(-((s.node + t.node) % 3)::double)) as g, t.z2, t.z3 from z s join z t using (graph_id)"


@query("d16_pair_attention", cte("n", nd=_ND, z=_Z, pa=_PA, m="select *, max(l) over (partition by graph_id, node) as m from pa") + "select graph_id, node, round(sum(exp(l - m) * g * z2) / sum(exp(l - m)) * ln(1 + sum(g)), 6) as x0, round(sum(exp(l - m) * g * z3) / sum(exp(l - m)) * ln(1 + sum(g)), 6) as x1 from m group by all")
def d16(spark, sf):
    x = A.dense(_nodes(spark, sf), "h", W_NODE, [0.0] * 4, None, "z")
    z = F.col("z")
    n = x.select("graph_id", "node", F.slice(z, 1, 2).alias("q"), F.array(z[1], z[0]).alias("k"), F.slice(z, 3, 2).alias("v"))
    ids = x.select("graph_id", "node")
    pairs = ids.join(ids.withColumnRenamed("node", "other"), "graph_id")
    pairs = pairs.withColumns({"e": F.when(F.abs(F.col("node") - F.col("other")) == 1, 0.5).otherwise(0.0), "g": ((F.col("node") + F.col("other")) % 3).cast("double")})
    return _wide(A.pair_attention(n, pairs, 2, scale_degree=True), "h", 2)


@query("d17_dense", cte("n", nd=_ND) + "select graph_id, node, " + ", ".join(f"round({_leaky('(' + _lin(W_NODE[i], ['a', 'b', 'c']) + f' + ({BIAS[i]!r}::double))')}, 6) + 0.0::double as x{i}" for i in range(4)) + " from nd")
def d17(spark, sf):
    return _wide(A.dense(_nodes(spark, sf), "h", W_NODE, BIAS), "out", 4)


@query("d17_dense_gelu")
def d17_gelu(spark, sf):
    return _wide(A.dense(_nodes(spark, sf), "h", W_NODE, BIAS, "gelu"), "out", 4)


_RO = "select graph_id, sum(a) as a, sum(b) as b, sum(c) as c from nd group by graph_id"
_RE = "select graph_id, sum(p) as p, sum(q) as q from ed group by graph_id"


@query("d18_readout", cte("rd", nd=_ND, ed=_ED, ro=_RO, re=_RE) + "select graph_id, round(a, 6) as x0, round(b, 6) as x1, round(c, 6) as x2, coalesce(p, 0.0)::double as x3, coalesce(q, 0.0)::double as x4 from ro left join re using (graph_id)")
def d18(spark, sf):
    return _wide(A.readout(_nodes(spark, sf), _edges(spark, sf), H, FW), "h", 5, ("graph_id",))


@query("d19_merge_sides", cte("rd", "pd", nd=_ND, e1=_ED, e2=_EDP, r="select graph_id, sum(p) as p, sum(q) as q from e1 group by graph_id", s="select graph_id, sum(p) as p, sum(q) as q from e2 group by graph_id") + "select graph_id, s.p - r.p as d0, s.q - r.q as d1, r.p as c0, r.q as c1, s.p as c2, s.q as c3 from r join s using (graph_id)")
def d19(spark, sf):
    r, p = (A.sum_vectors(_edges(spark, sf, side), "f", FW).withColumnRenamed("f", "h") for side in "rp")
    diff = A.merge_sides(r, p, ["graph_id"]).withColumnRenamed("h", "d")
    both = A.merge_sides(r, p, ["graph_id"], mode="concat").withColumnRenamed("h", "c")
    return diff.join(both, "graph_id").select("graph_id", *[F.col("d")[j].alias(f"d{j}") for j in range(2)], *[F.col("c")[j].alias(f"c{j}") for j in range(4)])


@query("d25_attention_rows", cte("rd", **_BASE, zl=_ZL, o=_OWN) + "select graph_id, u, v, round(sqrt(l0 * l0 + l1 * l1), 6) as score from sc union all select graph_id, node, node, round(sqrt(l0 * l0 + l1 * l1), 6) from o")
def d25(spark, sf):
    nodes = _nodes(spark, sf)
    z = A.dense(nodes, "h", W_NODE, [0.0] * 4, "leaky_relu", "z")
    vector = F.array(*map(F.lit, _SELF))
    own = z.select("graph_id", "node", F.array(*[A.dot(F.slice("z", 1 + 2 * i, 2), vector) for i in range(HEADS)]).alias("logits"))
    out = A.attention_rows(A.edge_scores(nodes, _edges(spark, sf), W_EDGE, W_ATTN, HEADS, H), own)
    return out.withColumn("score", F.round("score", 6))


_SIZES = "select graph_id, count(*) as n_nodes from n group by graph_id"
_SLOT = "select graph_id, n_nodes, (row_number() over (order by graph_id) - 1) // 50 as slot from g"


@query("f5_batch_graphs", cte("n", g=_SIZES, s=_SLOT, k="select *, count(*) over (partition by slot) as k from s") + "select graph_id, n_nodes, coalesce(sum(n_nodes) over (partition by slot order by graph_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", slot as batch_id from k where k = 50")
def f5(spark, sf):
    sizes = X.atoms(spark, sf).groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    return A.batch_graphs(sizes, 50, drop_last=True)


@query("f5_unbatch", cte("n") + "select graph_id, node from n")
def f5_inverse(spark, sf):
    atoms = X.atoms(spark, sf)
    batches = A.batch_graphs(atoms.groupBy("graph_id").agg(F.count("*").alias("n_nodes")), 50, buckets=16)
    union = atoms.join(batches, "graph_id").select("batch_id", (F.col("offset") + F.col("node") - 1).alias("place"))
    return A.unbatch(union, batches).select("graph_id", "node")
