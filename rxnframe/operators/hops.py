"""Hop distances by bit-parallel breadth-first search: one shuffle by graph_id, then one pass over whole graphs.

Each atom holds a set of bits, one for each source that reaches it. A round ors the sets of an atom's neighbours into its own, for all atoms and
sources of a batch at once; the bits that are new came in that many hops. Graphs of like size share a batch, and the sources of a large graph are taken in
blocks, so memory follows atoms times WORDS whatever a graph's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.operators.pergraph import Graphs, graph_rows, over_graphs

WORDS, FAR = 16, 100


def spread(bits: np.ndarray, i: np.ndarray, start: np.ndarray, j: np.ndarray) -> np.ndarray:
    """bits (atoms x words) with those of neighbours: bonds i -> j, i sorted, start: where each i begins."""
    out = bits.copy()
    if len(i):
        out[i[start]] |= np.bitwise_or.reduceat(bits[j], start, axis=0)
    return out


def _places(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bit numbers of set bits."""
    row, byte = np.nonzero(new.view(np.uint8))
    value = np.ascontiguousarray(new).view(np.uint8)[row, byte]
    k, bit = np.nonzero(np.unpackbits(value[:, None], axis=1, bitorder="little"))
    return row[k], byte[k] * 8 + bit


def search(g: Graphs, source: np.ndarray, max_hops: int | None):
    """Yields (source atoms, atoms, hops) of all atoms that each marked atom reaches, itself included at 0 hops."""
    begin, size = g.rank()
    number = np.cumsum(source) - source  # sources before each atom
    number = number - (number[begin] if len(g) else 0)  # within its graph
    many = np.zeros(len(g), np.int64)
    np.add.at(many, begin, source.astype(np.int64))
    many = many[begin] if len(g) else many
    words = np.minimum(WORDS, 1 << np.ceil(np.log2(np.maximum(1, -(-many // 64)))).astype(np.int64))
    for w in np.unique(words[many > 0]).tolist():
        for block in range(int(-(-many[words == w].max() // (64 * w)))):
            low = block * 64 * w
            atoms = np.flatnonzero((words == w) & (many > low))
            local = np.full(len(g), -1)
            local[atoms] = np.arange(len(atoms))
            mine = local[g.i] >= 0
            i, j = local[g.i[mine]], local[g.j[mine]]
            start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            bits = np.zeros((len(atoms), w), np.uint64)
            from_here = atoms[source[atoms] & (number[atoms] >= low) & (number[atoms] < low + 64 * w)]
            at = number[from_here] - low
            bits[local[from_here], at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
            by_bit = np.full(len(g), -1)  # atom of the k-th source of the graph that begins here, held at begin + k
            by_bit[begin[from_here] + at] = from_here
            new, hops = bits, 0
            while True:
                row, bit = _places(new)
                if not len(row):
                    break
                yield by_bit[begin[atoms[row]] + bit], atoms[row], np.full(len(row), hops, np.int32)
                if max_hops is not None and hops >= max_hops:
                    break
                after = spread(bits, i, start, j)
                new, bits, hops = after & ~bits, after, hops + 1


def _schema(atoms: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("graph_id", atoms.schema["graph_id"].dataType), *[T.StructField(n, t) for n, t in more]])


def _with_seeds(atoms: DataFrame, bonds: DataFrame, seeds: DataFrame) -> DataFrame:
    marks = seeds.filter("graph_id is not null and node is not null").select("graph_id", F.col("node").cast("long"), F.col("node").cast("long").alias("near"), F.lit("").alias("label"), F.lit(None).cast("long").alias("weight"), F.lit(True).alias("seed"))
    return graph_rows(atoms, bonds, seed=F.lit(False)).unionByName(marks)


def _seeded(t: pa.Table) -> tuple[Graphs, np.ndarray]:
    """The graphs of rows with seeds among them, and which atoms are seeds."""
    mark = np.asarray(t["seed"].combine_chunks().fill_null(False))
    g, marked = Graphs(t.filter(pa.array(~mark))), t.filter(pa.array(mark))
    source = np.zeros(len(g), bool)
    if len(g) and len(marked):
        names = dict(zip(g.id_of(g.first).to_pylist(), g.graph[g.first].tolist()))
        graph = np.array([names.get(x, -1) for x in marked["graph_id"].to_pylist()], np.int64)
        at = g._place(graph[graph >= 0], marked["node"].to_numpy()[graph >= 0])
        source[at[at >= 0]] = True
    return g, source


def hops_from(bonds: DataFrame, atoms: DataFrame, seeds: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """graph_id, source, node, hops of every atom that a source reaches in up to max_hops bonds; sources are the atoms named by seeds (graph_id, node), or all.

    bonds are directed. Rows without a graph or node, loops and bonds to nodes without an atom are left out; repeats are harmless; an empty table gives no rows."""
    schema = _schema(atoms, ("source", T.LongType()), ("node", T.LongType()), ("hops", T.IntegerType()))
    some = seeds is not None
    rows = _with_seeds(atoms, bonds, seeds) if some else graph_rows(atoms, bonds)

    def run(t: pa.Table):
        g, source = _seeded(t) if some else (Graphs(t), None)
        if not len(g):
            return
        if source is None:
            source = np.ones(len(g), bool)
        for s, v, h in search(g, source, max_hops):
            for k in range(0, len(s), 1 << 18):
                a, b = s[k : k + (1 << 18)], v[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([g.id_of(b), pa.array(g.node[a]), pa.array(g.node[b]), pa.array(h[k : k + (1 << 18)])], names=["graph_id", "source", "node", "hops"])

    return over_graphs(rows, run, schema)


def graph_distances(bonds: DataFrame, atoms: DataFrame, max_hops: int | None = None, unreachable: int = FAR) -> DataFrame:
    """graph_id, u, v, hops between all ordered pairs of a graph's atoms, `unreachable` for those that max_hops bonds don't join. One shuffle, no join."""
    schema = _schema(atoms, ("u", T.LongType()), ("v", T.LongType()), ("hops", T.IntegerType()))

    def run(t: pa.Table):
        g = Graphs(t)
        if not len(g):
            return
        begin, size = g.rank()
        out = np.append(0, np.cumsum(size))  # where the row of each atom's distances begins
        for a, b in _slices(g.first, size[g.first] ** 2, len(g)):
            hops = np.full(out[b] - out[a], unreachable, np.int32)
            for s, v, h in search(_part(g, a, b), np.ones(b - a, bool), max_hops):
                hops[out[s + a] - out[a] + v + a - begin[s + a]] = h
            u = np.repeat(np.arange(a, b), size[a:b])
            v = np.arange(len(u)) - np.repeat(out[a:b] - out[a], size[a:b]) + begin[u]
            for k in range(0, len(u), 1 << 18):
                p, q = u[k : k + (1 << 18)], v[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([g.id_of(p), pa.array(g.node[p]), pa.array(g.node[q]), pa.array(hops[k : k + (1 << 18)])], names=["graph_id", "u", "v", "hops"])

    return over_graphs(graph_rows(atoms, bonds), run, schema)


def _slices(first: np.ndarray, cost: np.ndarray, n: int, limit: int = 1 << 23):
    """Ranges of atoms that hold whole graphs of about `limit` pairs; a larger graph stands alone."""
    edge, total, start = first.tolist() + [n], 0, 0
    for k, c in enumerate(cost.tolist()):
        if total and total + c > limit:
            yield edge[start], edge[k]
            start, total = k, 0
        total += c
    if start < len(cost):
        yield edge[start], n


def _part(g: Graphs, a: int, b: int) -> Graphs:
    """The graphs of atoms a to b - 1."""
    if (a, b) == (0, len(g)):
        return g
    out = object.__new__(Graphs)
    out.rows, out.graph, out.node, out.ids = g.rows[a:b], g.graph[a:b], g.node[a:b], g.ids
    out.first = g.first[(g.first >= a) & (g.first < b)] - a
    mine = (g.i >= a) & (g.i < b)
    out.i, out.j, out.weight = g.i[mine] - a, g.j[mine] - a, g.weight[mine]
    return out


def distance_to_set(bonds: DataFrame, atoms: DataFrame, seeds: DataFrame, unreachable: int = FAR) -> DataFrame:
    """graph_id, node, hops from each atom to the nearest seed (graph_id, node), `unreachable` where none is."""
    schema = _schema(atoms, ("node", T.LongType()), ("hops", T.IntegerType()))

    def run(t: pa.Table):
        g, source = _seeded(t)
        if not len(g):
            return
        seen = np.zeros((len(g), 1), np.uint64)
        seen[source] = 1
        hops = np.where(seen[:, 0] > 0, 0, unreachable).astype(np.int32)
        start = np.flatnonzero(np.append(True, g.i[1:] != g.i[:-1])) if len(g.i) else np.zeros(0, np.int64)
        far = 0
        while True:
            after, far = spread(seen, g.i, start, g.j), far + 1
            new = (after & ~seen)[:, 0] > 0
            if not new.any():
                break
            hops[new], seen = far, after
        every = np.arange(len(g))
        yield pa.RecordBatch.from_arrays([g.id_of(every), pa.array(g.node), pa.array(hops)], names=["graph_id", "node", "hops"])

    return over_graphs(_with_seeds(atoms, bonds, seeds), run, schema)


def bond_distances(bonds: DataFrame, atoms: DataFrame, changed: DataFrame, unreachable: int = FAR) -> DataFrame:
    """graph_id, nearest and farthest of the hops between two changed bonds (graph_id, u, v), least over their ends; 0 and 0 for a single changed bond."""
    c = changed.select("graph_id", "u", "v").distinct()
    ends = c.select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    near = hops_from(bonds, atoms, ends)
    at = lambda tag: c.select("graph_id", F.struct("u", "v").alias(tag), F.explode(F.array("u", "v")).alias(f"n{tag}"))
    pairs = at("a").join(at("b"), "graph_id").filter("a < b").join(near.select("graph_id", F.col("source").alias("na"), F.col("node").alias("nb"), "hops"), ["graph_id", "na", "nb"], "left")
    apart = pairs.groupBy("graph_id", "a", "b").agg(F.coalesce(F.min("hops"), F.lit(unreachable)).alias("d"))
    out = apart.groupBy("graph_id").agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"))
    return c.select("graph_id").distinct().join(out, "graph_id", "left").fillna(0, ["nearest", "farthest"])
