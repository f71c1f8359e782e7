"""Rings inside two-connected blocks, and sums over self-avoiding walks: one shuffle by graph_id, then one pass over whole graphs.

Fragments with fewer bonds than atoms hold no ring and are left alone. Of the others, chains that hang on them are stripped and the rest is cut at
bridges and cut atoms, so no path ever starts on a bond of a tree. A block with as many bonds as atoms is one ring. In larger blocks chordless paths grow from
their smallest atom over sets of bits: an atom next to an inner one is barred, and one too far from the start to close the ring within max_size is not tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.operators.pergraph import Graphs, graph_rows, over_graphs

WALKS = 1 << 20


def blocks(near: dict[int, set[int]]) -> list[set[int]]:
    """Atoms of the two-connected blocks of three atoms or more; near: neighbours of each atom, and is used up."""
    ends = [v for v in near if len(near[v]) == 1]
    while ends:
        v = ends.pop()
        for w in near.pop(v, ()):
            near[w].discard(v)
            if len(near[w]) == 1:
                ends.append(w)
    found, at, low, place = [], {}, {}, {}
    for root in near:
        if root in at or not near[root]:
            continue
        at[root] = low[root] = len(at)
        path, stack = [root], [(root, -1, iter(near[root]))]
        while stack:
            v, up, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if up >= 0:
                    low[up] = min(low[up], low[v])
                    if low[v] >= at[up]:
                        k = place[v]
                        block = {up, *path[k:]}
                        del path[k:]
                        if len(block) > 2:
                            found.append(block)
            elif w not in at:
                at[w] = low[w] = len(at)
                place[w] = len(path)
                path.append(w)
                stack.append((w, v, iter(near[w])))
            elif w != up:
                low[v] = min(low[v], at[w])
    return found


def chordless(near: list[int], max_size: int) -> list[list[int]]:
    """Chordless cycles of up to max_size atoms of a block as walks from the smallest atom towards its smaller neighbour; near: neighbours as bits."""
    found: list[list[int]] = []
    n = len(near)
    for s in range(n - 2):
        higher = ((1 << n) - 1) & ~((1 << (s + 1)) - 1)
        far, layer, seen, d = [max_size + 1] * n, near[s] & higher, near[s] & higher, 1
        while layer:
            after, x = 0, layer
            while x:
                w = (x & -x).bit_length() - 1
                x &= x - 1
                far[w] = d
                after |= near[w]
            layer = after & higher & ~seen
            seen |= layer
            d += 1
        first = near[s] & higher
        stack = []
        x = first
        while x:
            a = (x & -x).bit_length() - 1
            x &= x - 1
            stack.append(([s, a], 1 << a))
        while stack:
            path, barred = stack.pop()
            last, size = path[-1], len(path)
            x = near[last] & higher & ~barred
            while x:
                w = (x & -x).bit_length() - 1
                x &= x - 1
                if size + far[w] > max_size:
                    continue
                if near[w] >> s & 1:
                    if w > path[1]:
                        found.append([*path, w])
                elif w != path[1]:
                    stack.append(([*path, w], barred | near[last] | 1 << w))
    return found


def rings_of(near: dict[int, set[int]], max_size: int) -> list[list[int]]:
    """Chordless cycles of one fragment; near: neighbours of each atom."""
    kept = {v: set(x) for v, x in near.items()}
    found = []
    for block in blocks({v: set(x) for v, x in near.items()}):
        order = sorted(block)
        place = {v: k for k, v in enumerate(order)}
        inside = [kept[v] & block for v in order]
        if all(len(x) == 2 for x in inside):
            if len(order) <= max_size:
                v, walk = min(inside[0]), [order[0]]
                while v != order[0]:
                    walk.append(v)
                    v = next(w for w in kept[v] & block if w != walk[-2])
                found.append(walk)
            continue
        bits = [sum(1 << place[w] for w in x) for x in inside]
        found += [[order[k] for k in walk] for walk in chordless(bits, max_size)]
    return found


def find_rings(bonds: DataFrame, max_size: int = 20) -> DataFrame:
    """graph_id, ring and size of rings of up to max_size atoms that hold no smaller ring, as ordered walks from the smallest node towards its smaller ring neighbour.

    bonds are directed: both orientations are there. Null ids, loops and repeated bonds are harmless; a graph without rings has no row, and so has an empty table."""
    node = bonds.schema["u"].dataType
    schema = T.StructType([T.StructField("graph_id", bonds.schema["graph_id"].dataType), T.StructField("ring", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType())])

    def run(t: pa.Table):
        g = Graphs(t, implied=True)
        part = g.fragments()
        surplus = np.bincount(part[g.i], minlength=len(g)) // 2 - np.bincount(part, minlength=len(g)) + 1
        cyclic = surplus[part[g.i]] > 0
        near: dict[int, dict[int, set[int]]] = {}
        for k, i, j in zip(part[g.i[cyclic]].tolist(), g.i[cyclic].tolist(), g.j[cyclic].tolist()):
            near.setdefault(k, {}).setdefault(i, set()).add(j)
        rings = [r for x in near.values() for r in rings_of(x, max_size)]
        if rings:
            flat, size = np.array([v for r in rings for v in r]), np.array([len(r) for r in rings], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(g.node[flat]))
            yield pa.RecordBatch.from_arrays([g.id_of(np.array([r[0] for r in rings])), lists, pa.array(size)], names=["graph_id", "ring", "size"])

    out = over_graphs(graph_rows(None, bonds.select("graph_id", "u", "v")), run, schema)
    return out.withColumn("ring", F.col("ring").cast(T.ArrayType(node)))


def walk_sums(g: Graphs, mass: np.ndarray, beta: float, gens: int) -> np.ndarray:
    """For each atom the sum of end masses * beta * 0.1**depth over self-avoiding walks of up to gens bonds. At most about WALKS walks are held at once for each depth."""
    out = mass * beta
    degree = np.bincount(g.i, minlength=len(g))
    first = np.append(0, np.cumsum(degree))
    begin, size = g.rank()
    words = 1 << np.ceil(np.log2(np.maximum(1, -(-size // 64)))).astype(np.int64)
    for w in np.unique(words).tolist():
        atoms = np.flatnonzero(words == w)
        local = np.arange(len(g)) - begin
        bits = np.zeros((len(atoms), w), np.uint64)
        bits[np.arange(len(atoms)), local[atoms] // 64] = np.uint64(1) << (local[atoms] % 64).astype(np.uint64)
        todo = [(1, atoms, atoms, bits)]
        limit = max(1, WALKS // w)
        while todo:
            depth, source, end, seen = todo.pop()
            many = degree[end]
            if many.sum() > limit and len(end) > 1:
                half = len(end) // 2
                todo += [(depth, source[half:], end[half:], seen[half:]), (depth, source[:half], end[:half], seen[:half])]
                continue
            row = np.repeat(np.arange(len(end)), many)
            step = g.j[np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(many))[:-1], many) + np.repeat(first[end], many)]
            word, bit = local[step] // 64, np.uint64(1) << (local[step] % 64).astype(np.uint64)
            free = seen[row, word] & bit == 0
            row, step, word, bit = row[free], step[free], word[free], bit[free]
            if not len(row):
                continue
            np.add.at(out, source[row], mass[step] * beta * 0.1**depth)
            if depth < gens:
                seen = seen[row]
                seen[np.arange(len(row)), word] |= bit
                todo.append((depth + 1, source[row], step, seen))
    return out


def atom_hash(bonds: DataFrame, atoms: DataFrame, alpha: float = 100.0, beta: float = 0.1, gens: int = 10) -> DataFrame:
    """graph_id, node, hash: alpha * degree + sum of end masses * beta * 0.1**depth over self-avoiding walks of up to gens steps. atoms has mass (null: 0); bonds are directed, parallel ones count once."""
    schema = T.StructType([T.StructField("graph_id", atoms.schema["graph_id"].dataType), T.StructField("node", T.LongType()), T.StructField("hash", T.DoubleType())])

    def run(t: pa.Table):
        g = Graphs(t)
        if not len(g):
            return
        mass = t["mass"].combine_chunks().fill_null(0.0).to_numpy()[g.rows]
        total = walk_sums(g, mass.astype(float), beta, gens) + alpha * np.bincount(g.i, minlength=len(g))
        every = np.arange(len(g))
        yield pa.RecordBatch.from_arrays([g.id_of(every), pa.array(g.node), pa.array(total)], names=["graph_id", "node", "hash"])

    out = over_graphs(graph_rows(atoms, bonds.select("graph_id", "u", "v"), mass=F.col("mass").cast("double")), run, schema)
    return out.withColumn("hash", F.round("hash", 6))
