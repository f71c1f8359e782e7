"""Whole graphs in one pass: one shuffle by graph_id, then Arrow tables that never cut a graph, with atoms and bonds as arrays of numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.session import tune

#: Rows handed to a function at once, but for a larger graph.
ROWS = 20_000


def graph_rows(atoms: DataFrame | None, bonds: DataFrame, label: list[str] | None = None, order: str | None = None, **more) -> DataFrame:
    """One frame of atoms (near null; none where atoms are implied by bonds) and directed bonds: graph_id, node, near, label, weight and further columns of atoms, given as expressions. Rows without a graph, node or end are left out; nodes are whole numbers."""
    weight = F.col(order).cast("long") if order else F.lit(1).cast("long")
    b = bonds.filter("graph_id is not null and u is not null and v is not null").select("graph_id", F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("near"), F.lit("").alias("label"), weight.alias("weight"))
    if atoms is None:
        return b
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in label or []]) if label else F.lit("")
    a = atoms.filter("graph_id is not null and node is not null").select("graph_id", F.col("node").cast("long"), F.lit(None).cast("long").alias("near"), text.alias("label"), F.lit(None).cast("long").alias("weight"), *[c.alias(n) for n, c in more.items()])
    return a.unionByName(b, allowMissingColumns=True)


def over_graphs(rows: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """run over tables of whole graphs, each with about ROWS rows or one larger graph."""

    def batches(source):
        held: list[pa.Table] = []
        size = 0
        for batch in source:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= ROWS:
                t = pa.concat_tables(held)
                n = pc.index(t["graph_id"], t["graph_id"][len(t) - 1]).as_py()  # sorted: where the last graph begins
                if n:
                    yield from run(t.slice(0, n).combine_chunks())
                    held, size = [t.slice(n)], len(t) - n
                else:
                    held = [t]
        if size:
            yield from run(pa.concat_tables(held).combine_chunks())

    tune(rows.sparkSession)
    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(batches, schema)


class Graphs:
    """Atoms and bonds of some whole graphs as arrays: graph of each atom, its node and place; bonds (i, j, weight) between places, distinct, without loops and bonds to nodes that have no atom."""

    def __init__(self, t: pa.Table, implied: bool = False):
        """implied: the atoms are those from which a bond starts; there are no rows of atoms."""
        ids = t["graph_id"].combine_chunks()
        start = np.append(True, pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, bool)
        graph = np.cumsum(start) - 1
        node = t["node"].to_numpy()
        near = t["near"].combine_chunks()
        is_atom = np.asarray(near.is_null())
        named = np.ones(len(node), bool) if implied else is_atom
        order = np.flatnonzero(named)[np.lexsort((node[named], graph[named]))]
        new = np.append(True, (np.diff(graph[order]) != 0) | (np.diff(node[order]) != 0)) if len(order) else np.zeros(0, bool)
        self.rows = order[new]  # of repeated atoms the first row
        self.graph, self.node = graph[self.rows], node[self.rows]
        self.first = np.flatnonzero(np.append(True, np.diff(self.graph) != 0)) if len(self.rows) else np.zeros(0, np.int64)
        self.ids = ids
        b = np.flatnonzero(~is_atom)
        far = near.fill_null(0).to_numpy()[b]
        i, j = self._place(graph[b], node[b]), self._place(graph[b], far)
        weight = t["weight"].combine_chunks().fill_null(0).to_numpy()[b]
        good = (i >= 0) & (j >= 0) & (i != j)
        e = np.unique(np.stack([i[good], j[good], weight[good]], 1), axis=0) if good.any() else np.zeros((0, 3), np.int64)
        self.i, self.j, self.weight = e[:, 0], e[:, 1], e[:, 2]

    def _place(self, graph: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Atoms' places, -1 for those that aren't there."""
        if not len(self.rows):
            return np.full(len(graph), -1)
        low = min(self.node.min(), node.min(initial=0))
        width = int(max(self.node.max(), node.max(initial=0)) - low) + 1
        known = self.graph * width + (self.node - low)
        want = graph * width + (node - low)
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        return np.where(known[at] == want, at, -1)

    def __len__(self) -> int:
        return len(self.rows)

    def id_of(self, atoms: np.ndarray) -> pa.Array:
        """graph_id of each atom."""
        return self.ids.take(pa.array(self.rows[atoms]))

    def rank(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each atom's graph begins, and how many atoms it has."""
        size = np.diff(np.append(self.first, len(self)))
        return np.repeat(self.first, size), np.repeat(size, size)

    def fragments(self) -> np.ndarray:
        """The first atom reachable from each."""
        label = np.arange(len(self))
        while len(self.i):
            new = label.copy()
            np.minimum.at(new, label[self.i], label[self.j])
            np.minimum.at(new, self.i, label[self.j])
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        return label


def codes(labels: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64-bit digests of strings; equal strings have equal ones in every task."""
    d = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "big") for x in d.dictionary.to_pylist()] or [0], np.uint64)
    return own[d.indices.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def neighbour_sums(colour: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each atom the sum of scrambled (colour, bond weight) of its neighbours: equal for equal multisets. i is sorted."""
    out = np.zeros(n, np.uint64)
    if len(i):
        part = mix(colour[j] * np.uint64(0x9E3779B97F4A7C15) + mix(weight.astype(np.int64).view(np.uint64)))
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        out[i[start]] = np.add.reduceat(part, start)
    return out


def refined(colour: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One round of colour refinement."""
    return mix(colour * np.uint64(0xC2B2AE3D27D4EB4F) + neighbour_sums(colour, i, j, weight, len(colour)))
