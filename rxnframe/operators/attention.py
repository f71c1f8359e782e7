"""Message passing with fixed weights, as joins and grouped sums, and graph batches.

nodes: graph_id, node, h array<double>. edges: graph_id, u (source), v (target), f array<double>. Weights are lists of rows.
A dense layer over [h_u, f, h_v] is split into three products, so that each node is projected once, before the join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.functions.columns import dot, matrix_vector
from rxnframe.session import tune

Matrix = list[list[float]]
RANGE = 1 << 20


def leaky(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(0.01 * x)


def _columns(w: Matrix, a: int, b: int) -> Matrix:
    return [row[a:b] for row in w]


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for x in arrays[1:]:
        out = F.zip_with(out, x, lambda p, q: p + q)
    return out


def edge_scores(nodes: DataFrame, edges: DataFrame, w_edge: Matrix, w_attn: Matrix, heads: int, h_width: int, more: Column | None = None) -> DataFrame:
    """Edges with f_out (heads * width values) and logits (one per head): edge layer, leaky ReLU, then the row sum of the attention matrix as one vector shared by all heads. more: an expression of source nodes that edges get as z."""
    width, f_width = len(w_edge) // heads, len(w_edge[0]) - 2 * h_width
    source = nodes.select("graph_id", F.col("node").alias("u"), matrix_vector(_columns(w_edge, 0, h_width), F.col("h")).alias("_a"), *([] if more is None else [more.alias("z")]))
    target = nodes.select("graph_id", F.col("node").alias("v"), matrix_vector(_columns(w_edge, h_width + f_width, len(w_edge[0])), F.col("h")).alias("_c"))
    x = edges.join(source, ["graph_id", "u"]).join(target, ["graph_id", "v"])
    own = matrix_vector(_columns(w_edge, h_width, h_width + f_width), F.col("f"))
    x = x.withColumn("f_out", F.transform(_add(F.col("_a"), own, F.col("_c")), leaky)).drop("_a", "_c")
    vector = F.array(*[F.lit(float(s)) for s in np.asarray(w_attn).sum(0)])
    return x.withColumn("logits", F.array(*[dot(F.slice("f_out", 1 + i * width, width), vector) for i in range(heads)]))


def edge_softmax_aggregate(nodes: DataFrame, edges: DataFrame, w_node: Matrix, w_edge: Matrix, w_attn: Matrix, heads: int, h_width: int, self_loop: bool = False, w_self: Matrix | None = None) -> DataFrame:
    """Node features after one attention layer, flat (heads * width). Softmax over the incoming edges of a node, per head.

    self_loop: the node's own score (its projected features times the row sum of w_self) joins the softmax, and its own weighted term is
    added once more. Nodes without incoming edges are left out unless self_loop is set.
    """
    width, every = len(w_node) // heads, [(i, j) for i in range(heads) for j in range(len(w_node) // heads)]
    projected = matrix_vector(w_node, F.col("h"))
    projected = F.transform(projected, leaky) if self_loop else projected
    rows = edge_scores(nodes, edges, w_edge, w_attn, heads, h_width, projected).select("graph_id", F.col("v").alias("node"), "logits", "z")
    around = Window.partitionBy("graph_id", "node")  # the sums below reuse its partitioning
    rows = rows.withColumns({f"m{i}": F.max(F.col("logits")[i]).over(around) for i in range(heads)})
    weight = [F.exp(F.col("logits")[i] - F.col(f"m{i}")) for i in range(heads)]
    sums = [F.max(f"m{i}").alias(f"m{i}") for i in range(heads)] + [F.sum(w).alias(f"s{i}") for i, w in enumerate(weight)]
    sums += [F.sum(weight[i] * F.col("z")[i * width + j]).alias(f"v{i}_{j}") for i, j in every]
    out = rows.groupBy("graph_id", "node").agg(*sums)
    if self_loop:  # a node's own term joins what its edges sum up to: both shrink to the greater logit
        vector = F.array(*[F.lit(float(s)) for s in np.asarray(w_self).sum(0)])
        new = nodes.select("graph_id", "node", projected.alias("z"))
        new = new.withColumns({f"l{i}": dot(F.slice("z", 1 + i * width, width), vector) for i in range(heads)})
        known = new.filter("graph_id is not null").join(out, ["graph_id", "node"], "left")  # the filter is that of the joins above, so Spark reads and shuffles the nodes once for all
        out = known.unionByName(new.filter("graph_id is null"), allowMissingColumns=True)
        top = [F.greatest(f"l{i}", f"m{i}") for i in range(heads)]  # of the two the one that there is
        shrink = [F.exp(F.col(f"m{i}") - top[i]) for i in range(heads)]
        own = [F.exp(F.col(f"l{i}") - top[i]) for i in range(heads)]
        both = lambda x, y: F.coalesce(x + y, x, y)
        total = [both(F.col(f"s{i}") * shrink[i], own[i]).alias(f"s{i}") for i in range(heads)]
        value = [both(F.col(f"v{i}_{j}") * shrink[i], 2 * own[i] * F.col("z")[i * width + j]).alias(f"v{i}_{j}") for i, j in every]
        out = out.select("graph_id", "node", *total, *value)
    return out.select("graph_id", "node", F.array(*[F.col(f"v{i}_{j}") / F.col(f"s{i}") for i, j in every]).alias("h"))


def reduce_messages(messages: DataFrame, width: int, how: str = "sum") -> DataFrame:
    """Messages (graph_id, node, m array of `width`, and for softmax_sum logit) brought together at their node: sum, mean, max, or softmax_sum, in which each counts with its softmax weight."""
    key, part = ["graph_id", "node"], lambda j: F.col("m")[j]
    if how in ("sum", "mean", "max"):
        out = messages.groupBy(*key).agg(*[{"sum": F.sum, "mean": F.avg, "max": F.max}[how](part(j)).alias(f"_{j}") for j in range(width)])
        return out.select(*key, F.array(*[F.col(f"_{j}") for j in range(width)]).alias("h"))
    if how != "softmax_sum":
        raise ValueError(f"unknown reduce {how}")
    x = messages.withColumn("_w", F.exp(F.col("logit") - F.max("logit").over(Window.partitionBy(*key))))
    out = x.groupBy(*key).agg(F.sum("_w").alias("_s"), *[F.sum(F.col("_w") * part(j)).alias(f"_{j}") for j in range(width)])
    return out.select(*key, F.array(*[F.col(f"_{j}") / F.col("_s") for j in range(width)]).alias("h"))


def edge_weights(scored: DataFrame, heads: int) -> DataFrame:
    """Softmax weights of scored edges (graph_id, u, v, logits) over each target's incoming edges."""
    w = Window.partitionBy("graph_id", "v")
    exps = [F.exp(F.col("logits")[i] - F.max(F.col("logits")[i]).over(w)) for i in range(heads)]
    x = scored.withColumns({f"_e{i}": e for i, e in enumerate(exps)})
    return x.withColumn("weights", F.array(*[F.col(f"_e{i}") / F.sum(f"_e{i}").over(w) for i in range(heads)])).drop(*[f"_e{i}" for i in range(heads)])


def combine_residual(mode: str, new: Column, old: Column, w_old: Matrix | None = None, w_new: Matrix | None = None, bias: list[float] | None = None) -> Column:
    """v1 adds the projected old value, v2 the old value, skip is relu of their sum, gate mixes both projections by a sigmoid."""
    if mode == "v1":
        return _add(new, matrix_vector(w_old, old))
    if mode == "v2":
        return _add(new, old)
    if mode == "skip":
        return F.transform(_add(new, old), lambda x: F.greatest(x, F.lit(0.0)))
    if mode != "gate":
        raise ValueError(f"unknown residual mode {mode}")
    a, b = matrix_vector(w_new, new), matrix_vector(w_old, old)
    total = _add(a, b, F.array(*[F.lit(float(x)) for x in bias])) if bias else _add(a, b)
    gate = F.transform(total, lambda x: 1 / (1 + F.exp(-x)))
    pairs = F.arrays_zip(gate.alias("g"), a.alias("a"), b.alias("b"))
    return F.transform(pairs, lambda t: t.g * t.a + (1 - t.g) * t.b)


class _Running:
    """Nodes of the graphs at hand with their running softmax: greatest logit, sum of weights, gated weighted values and sum of gates."""

    def __init__(self, graph: np.ndarray, node: np.ndarray, x: np.ndarray, width: int):
        self.graph, self.node, self.x, self.width = graph, node, x, width
        self.top, self.total, self.degree, self.value = np.full(len(node), -np.inf), np.zeros(len(node)), np.zeros(len(node)), np.zeros((len(node), width))

    def joined(self, other: _Running) -> _Running:
        out = object.__new__(_Running)
        out.width = self.width
        for c in ("graph", "node", "x", "top", "total", "degree", "value"):
            setattr(out, c, np.concatenate([getattr(self, c), getattr(other, c)]))
        return out

    def taken(self, rows: np.ndarray) -> _Running:
        out = object.__new__(_Running)
        out.width = self.width
        for c in ("graph", "node", "x", "top", "total", "degree", "value"):
            setattr(out, c, getattr(self, c)[rows])
        return out

    def places(self, graph: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of the nodes, -1 for those that aren't there; nodes are sorted."""
        if not len(self.node):
            return np.full(len(node), -1)
        low = min(self.node.min(), node.min(initial=0))
        wide = int(max(self.node.max(), node.max(initial=0)) - low) + 1
        known, want = self.graph * wide + self.node - low, graph * wide + node - low
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        return np.where(known[at] == want, at, -1)

    def add(self, i: np.ndarray, j: np.ndarray, e: np.ndarray, g: np.ndarray, clip: tuple[float, float]) -> None:
        """A block of pairs: what came before shrinks to the new greatest logit, then the block's weights join it."""
        w = self.width
        logit = np.clip((self.x[i, :w] * self.x[j, w : 2 * w]).sum(1) / math.sqrt(w), *clip) + e
        gate = 1 / (1 + np.exp(-g))
        top = self.top.copy()
        np.maximum.at(top, i, logit)
        with np.errstate(invalid="ignore"):
            shrink = np.where(np.isfinite(self.top), np.exp(self.top - top), 0.0)
        self.top, self.total = top, self.total * shrink
        self.value *= shrink[:, None]
        weight = np.exp(logit - top[i])
        np.add.at(self.total, i, weight)
        np.add.at(self.degree, i, gate)
        np.add.at(self.value, i, (weight * gate)[:, None] * self.x[j, 2 * w :])


def pair_attention(nodes: DataFrame, pairs: DataFrame, width: int, clip: tuple[float, float] = (-5.0, 5.0), scale_degree: bool = False) -> DataFrame:
    """Dense gated attention inside each graph. nodes: q, k, v arrays of `width`; pairs: graph_id, node, other, e (bias), g (gate), for every ordered pair.

    Nodes and pairs move once, by graph_id, and no pair is joined: a partition runs through its pairs in blocks, with a running maximum and sum for each node, so a task holds the nodes of
    the graphs of one batch and one batch of pairs. Nodes without pairs have no row; pairs of unknown nodes or with null bias or gate are left out, as are rows without a graph; an empty table gives no rows."""
    wide = T.ArrayType(T.DoubleType())
    x = F.concat(*[F.col(c).cast(wide) for c in "qkv"])
    long = lambda c: F.col(c).cast("long")
    a = nodes.filter("graph_id is not null and node is not null").select("graph_id", F.lit(0).alias("kind"), long("node").alias("node"), F.lit(None).cast("long").alias("other"), x.alias("x"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("double").alias("g"))
    b = pairs.filter("graph_id is not null and node is not null and other is not null and e is not null and g is not null")
    b = b.select("graph_id", F.lit(1).alias("kind"), long("node").alias("node"), long("other").alias("other"), F.lit(None).cast(wide).alias("x"), F.col("e").cast("double"), F.col("g").cast("double"))
    schema = T.StructType([T.StructField("graph_id", nodes.schema["graph_id"].dataType), T.StructField("node", T.LongType()), T.StructField("h", wide)])

    def told(ids: list, r: _Running) -> pa.RecordBatch:
        some = r.total > 0
        h = r.value[some] / r.total[some, None] * (np.log1p(r.degree[some, None]) if scale_degree else 1.0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(h) * width + 1, width), pa.int32()), pa.array(h.ravel()))
        names = pa.array([ids[k] for k in r.graph[some].tolist()], kind_of[0])
        return pa.RecordBatch.from_arrays([names, pa.array(r.node[some]), lists], names=["graph_id", "node", "h"])

    kind_of: list = [None]

    def run(batches):
        held, name = None, None  # the last graph's nodes, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("graph_id")
            kind_of[0] = col.type
            new = np.append(True, pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False))
            graph, ids = np.cumsum(new) - 1, col.filter(pa.array(new)).to_pylist()
            if held is not None and ids[0] != name:
                yield told([name], held)
                held = None
            is_node = batch.column("kind").to_numpy() == 0
            flat = batch.column("x").filter(pa.array(is_node)).flatten().to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy()
            here = _Running(graph[is_node], node[is_node], flat.reshape(-1, 3 * width), width)
            here = here if held is None else held.joined(here)
            order = np.lexsort((here.node, here.graph))
            here = here.taken(order)
            p = ~is_node
            other = batch.column("other").fill_null(0).to_numpy()
            i, j = here.places(graph[p], node[p]), here.places(graph[p], other[p])
            good = (i >= 0) & (j >= 0)
            if good.any():
                e, g = (batch.column(c).fill_null(0.0).to_numpy()[p][good] for c in "eg")
                here.add(i[good], j[good], e, g, clip)
            yield told(ids, here.taken(np.flatnonzero(here.graph < graph[-1])))
            held, name = here.taken(np.flatnonzero(here.graph == graph[-1])), ids[-1]
            held.graph = np.zeros(len(held.graph), np.int64)
        if held is not None:
            yield told([name], held)

    tune(nodes.sparkSession)
    return a.unionByName(b).repartition("graph_id").sortWithinPartitions("graph_id", "kind", "other").mapInArrow(run, schema)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by its series of positive terms; beyond 6 it is 1 in double precision."""
    a = np.minimum(np.abs(x), 6.0)
    term = total = a.astype(float)
    for n in range(1, 120):
        term = term * 2 * a * a / (2 * n + 1)
        total = total + term
    return np.sign(x) * 2 / math.sqrt(math.pi) * np.exp(-a * a) * total


def dense(df: DataFrame, column: str, weights: Matrix, bias: list[float], activation: str | None = "leaky_relu", name: str = "out") -> DataFrame:
    """Fixed dense layer with leaky ReLU, GELU or nothing. GELU runs vectorised in Python (Spark SQL has no erf); the others are built-in expressions."""
    if activation in (None, "leaky_relu"):
        out = _add(matrix_vector(weights, F.col(column)), F.array(*[F.lit(float(b)) for b in bias]))
        return df.withColumn(name, F.transform(out, leaky) if activation else out)
    if activation != "gelu":
        raise ValueError(f"unknown activation {activation}")
    w, b = np.asarray(weights, float), np.asarray(bias, float)
    @F.pandas_udf("array<double>")
    def layer(x: pd.Series) -> pd.Series:
        z = (np.stack(x.to_numpy()) @ w.T + b) if len(x) else np.zeros((0, len(b)))
        return pd.Series(list(z * 0.5 * (1 + erf(z / math.sqrt(2)))))

    return df.withColumn(name, layer(column))


def sum_vectors(df: DataFrame, column: str, width: int, by: str = "graph_id") -> DataFrame:
    """Element sums of an array column per group."""
    sums = df.groupBy(by).agg(*[F.sum(F.col(column)[j]).alias(f"_{j}") for j in range(width)])
    return sums.select(by, F.array(*[F.col(f"_{j}") for j in range(width)]).alias(column))


def readout(nodes: DataFrame, edges: DataFrame, h_width: int, f_width: int) -> DataFrame:
    """Graph vector: node sums followed by edge sums (0 for graphs without edges)."""
    n, e = sum_vectors(nodes, "h", h_width), sum_vectors(edges, "f", f_width)
    none = F.array(*[F.lit(0.0)] * f_width)
    return n.join(e, "graph_id", "left").select("graph_id", F.concat("h", F.coalesce("f", none)).alias("h"))


def merge_sides(left: DataFrame, right: DataFrame, keys: list[str], column: str = "h", mode: str = "difference") -> DataFrame:
    """Right minus left, or left followed by right, of rows aligned by the keys."""
    x = left.join(right.select(*keys, F.col(column).alias("_r")), keys)
    if mode == "difference":
        value = F.zip_with("_r", column, lambda p, r: p - r)
    elif mode == "concat":
        value = F.concat(column, "_r")
    else:
        raise ValueError(f"unknown merge mode {mode}")
    return x.withColumn(column, value).drop("_r")


def attention_rows(edges: DataFrame, selfs: DataFrame) -> DataFrame:
    """Sparse attention map: norm over heads of each edge's scores, and the nodes' own scores on the diagonal."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    off = edges.filter("u <> v").select("graph_id", "u", "v", norm("logits").alias("score"))
    return off.unionByName(selfs.select("graph_id", F.col("node").alias("u"), F.col("node").alias("v"), norm("logits").alias("score")))


def batch_graphs(graphs: DataFrame, size: int, drop_last: bool = False, buckets: int = 1) -> DataFrame:
    """graphs (graph_id, n_nodes) -> batch_id and offset of the graph's nodes in the batch's disjoint union, in the order of graph_id.

    Graphs are numbered by a two-pass rank over ranges of ids, so no window spans all graphs. With buckets, batches form
    within graph_id modulo buckets, and each bucket has a short batch of its own for drop_last to drop.
    """
    ranges = max(1, -(-graphs.count() // RANGE))
    bounds = sorted(set(graphs.approxQuantile("graph_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("graph_id"))) if bounds else F.lit(0)
    x = graphs.withColumn("bucket", F.pmod(F.col("graph_id"), F.lit(buckets))).withColumn("_own", F.coalesce("bucket", F.lit(-1))).withColumn("_part", part)
    sizes = x.groupBy("_own", "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_own").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_own", "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_own", "_part").orderBy("graph_id")) + F.col("_before")
    x = x.join(F.broadcast(before), ["_own", "_part"]).withColumn("slot", F.floor((place - 1) / size)).drop("_own", "_part", "_before")
    w = Window.partitionBy("bucket", "slot").orderBy("graph_id")
    x = x.withColumn("offset", F.coalesce(F.sum("n_nodes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if drop_last:
        x = x.withColumn("_k", F.count("*").over(Window.partitionBy("bucket", "slot"))).filter(F.col("_k") == size).drop("_k")
    return x.withColumn("batch_id", F.col("slot") * buckets + F.col("bucket")).drop("bucket", "slot")


def unbatch(nodes: DataFrame, batches: DataFrame) -> DataFrame:
    """batched nodes (batch_id, place) -> graph_id and the node's number in its graph, from 1."""
    x = nodes.join(batches, "batch_id").filter((F.col("place") >= F.col("offset")) & (F.col("place") < F.col("offset") + F.col("n_nodes")))
    return x.withColumn("node", F.col("place") - F.col("offset") + 1).drop("offset", "n_nodes")
