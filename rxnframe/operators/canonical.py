"""Canonical labels and keys of graphs that don't depend on how their atoms are numbered.

All fragments of a batch are refined together: an atom's colour becomes a digest of its own and its neighbours' colours, until a fragment has no more
colours than before. A fragment whose atoms all differ then is in order. Elsewhere the smallest set of atoms of one colour is told apart by individualising one after another and
refining again; of all orders found this way the one with the least description counts. Atoms that hang on the same neighbours need no trial, and a
repeated description shows a symmetry, which spares the trials that it maps to earlier ones. A fragment's key is a digest of its description (labels in order, bonds between
places), so equal keys mean isomorphic fragments. A graph's key is made of its fragments' sorted keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.operators.pergraph import Graphs, codes, graph_rows, over_graphs, refined

MISSING = "InChI_NA"
Adjacency = list[dict[int, int]]


def _stable(colour: list[int], near: Adjacency) -> list[int]:
    """Colours as ranks, refined by exact neighbour multisets until nothing splits."""
    count = len(set(colour))
    while True:
        told = [(colour[v], tuple(sorted((colour[w], o) for w, o in near[v].items()))) for v in range(len(near))]
        rank = {x: k for k, x in enumerate(sorted(set(told)))}
        colour = [rank[x] for x in told]
        if len(rank) == count:
            return colour
        count = len(rank)


def _describe(colour: list[int], label: list[str], near: Adjacency) -> tuple:
    """Labels in the order of (discrete) colours and the bonds between places."""
    at = {c: k for k, c in enumerate(sorted(colour))}
    place = [at[c] for c in colour]
    by = sorted(range(len(colour)), key=lambda v: place[v])
    return tuple(label[v] for v in by), tuple(sorted((min(place[v], place[w]), max(place[v], place[w]), o) for v in range(len(near)) for w, o in near[v].items() if v < w))


class _Search:
    """Depth first over individualised atoms, with the symmetries found so far."""

    def __init__(self, label: list[str], near: Adjacency):
        self.label, self.near = label, near
        self.best: tuple | None = None
        self.first: tuple | None = None  # description, order and path of the leaf that symmetries are told by
        self.symmetries: list[list[int]] = []

    def _orbit(self, v: int, path: list[int]) -> set[int]:
        """Atoms that known symmetries which hold the path in place map v to."""
        fixing = [g for g in self.symmetries if all(g[p] == p for p in path)]
        orbit, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for g in fixing:
                if g[x] not in orbit:
                    orbit.add(g[x])
                    todo.append(g[x])
        return orbit

    def run(self, colour: list[int], path: list[int]) -> int:
        """Visits all leaves that may matter; the depth to go back to."""
        colour = _stable(colour, self.near)
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            cells.setdefault(c, []).append(v)
        split = [c for c in cells if len(cells[c]) > 1]
        if not split:
            return self._leaf(colour, path)
        cell = cells[min(split, key=lambda c: (len(cells[c]), c))]
        own = {v: {w: o for w, o in self.near[v].items() if w not in cell} for v in cell}
        apart = all(not (self.near[v].keys() & set(cell)) for v in cell)
        if apart and all(own[v] == own[cell[0]] for v in cell):
            cell = cell[:1]  # the same neighbours: any order is as good
        tried: set[int] = set()
        for v in cell:
            if v in tried:
                continue
            back = self.run([2 * c + (u != v) for u, c in enumerate(colour)], [*path, v])
            if back < len(path):
                return back
            tried |= self._orbit(v, path)
            for u in list(tried):
                tried |= self._orbit(u, path)
        return len(path)

    def _leaf(self, colour: list[int], path: list[int]) -> int:
        told = _describe(colour, self.label, self.near)
        order = sorted(range(len(colour)), key=lambda v: colour[v])
        if self.best is None or told < self.best[0]:
            self.best = (told, order, path)
            if self.first is None:
                self.first = self.best
            return len(path)
        for known in (self.first, self.best):
            if told == known[0]:
                g = [0] * len(order)
                for a, b in zip(known[1], order):
                    g[a] = b
                self.symmetries.append(g)
                return next(k for k, (a, b) in enumerate(zip(known[2], path)) if a != b)
        return len(path)


def describe(label: list[str], near: Adjacency, colour: list[int]) -> tuple[tuple, list[int]]:
    """The canonical description of a connected graph and its atoms in canonical order."""
    if len(set(colour)) == len(colour):
        return _describe(colour, label, near), sorted(range(len(colour)), key=lambda v: colour[v])
    rank = {c: k for k, c in enumerate(sorted(set(colour)))}
    search = _Search(label, near)
    search.run([rank[c] for c in colour], [])
    return search.best[0], search.best[1]


def stable_colours(g: Graphs, colour: np.ndarray) -> np.ndarray:
    """Colours after refinement. Each fragment stops on its own, so its colours don't depend on what else is in a batch."""
    part = g.fragments()
    count = np.zeros(len(g), np.int64)
    live = np.ones(len(g), bool)
    while live.any():
        new = refined(colour, g.i, g.j, g.weight)
        o = np.lexsort((new, part))
        fresh = np.append(True, (np.diff(part[o]) != 0) | (new[o][1:] != new[o][:-1]))
        now = np.bincount(part[o][fresh], minlength=len(g))
        live &= now[part] > count[part]
        colour = np.where(live, new, colour)
        count = now
    return colour


def canonical_labels(atoms: DataFrame, bonds: DataFrame, label: tuple[str, ...] = ("element", "charge"), order: str | None = "ord") -> DataFrame:
    """graph_id, node, fragment (its smallest node), place (from 0, the same in every numbering up to symmetry) and fragment_key of each atom.

    bonds are directed. Atoms without a graph or node are left out, of repeated ones one counts; a null label is a label of its own; an empty table gives no rows."""
    types = {f.name: f.dataType for f in atoms.select("graph_id").schema}
    schema = T.StructType([T.StructField("graph_id", types["graph_id"])] + [T.StructField(n, t) for n, t in (("node", T.LongType()), ("fragment", T.LongType()), ("place", T.IntegerType()), ("fragment_key", T.StringType()))])

    def run(t: pa.Table):
        g = Graphs(t)
        if not len(g):
            return
        text = t["label"].combine_chunks().take(pa.array(g.rows))
        colour = stable_colours(g, codes(text))
        part = g.fragments()
        by = np.argsort(part, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(part[by]) != 0))
        local = np.empty(len(g), np.int64)
        local[by] = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
        near: Adjacency = [{} for _ in range(len(g))]
        for i, j, w in zip(g.i.tolist(), local[g.j].tolist(), g.weight.tolist()):
            near[i][j] = near[i].get(j, 0) * 1_000_003 + w  # parallel bonds, sorted by weight, count together
        labels, colours = text.to_pylist(), colour.tolist()
        place, keys = np.empty(len(g), np.int32), [""] * len(g)
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(g)]):
            own = by[a:b].tolist()
            told, order = describe([labels[v] for v in own], [near[v] for v in own], [colours[v] for v in own])
            key = hashlib.sha256(repr(told).encode()).hexdigest()[:32]
            for k, v in enumerate(order):
                place[own[v]], keys[own[v]] = k, key
        every = np.arange(len(g))
        yield pa.RecordBatch.from_arrays([g.id_of(every), pa.array(g.node), pa.array(g.node[part]), pa.array(place), pa.array(keys, pa.string())], names=[f.name for f in schema])

    return over_graphs(graph_rows(atoms, bonds, list(label), order), run, schema)


def fragment_keys(labels: DataFrame) -> DataFrame:
    """graph_id, fragment, fragment_key and n_atoms of each fragment of canonical_labels."""
    return labels.groupBy("graph_id", "fragment").agg(F.first("fragment_key").alias("fragment_key"), F.count("*").alias("n_atoms"))


def graph_keys(labels: DataFrame) -> DataFrame:
    """graph_id, graph_key (digest of the sorted fragment keys) and skeleton (their first 14 characters, sorted and joined by -)."""
    keys = F.array_sort(F.collect_list("fragment_key"))
    out = fragment_keys(labels).groupBy("graph_id").agg(keys.alias("k"))
    return out.select("graph_id", F.substring(F.sha2(F.array_join("k", "."), 256), 1, 32).alias("graph_key"), F.array_join(F.array_sort(F.transform("k", lambda x: F.substring(x, 1, 14))), "-").alias("skeleton"))


def reaction_keys(ids: DataFrame, reactants: DataFrame, products: DataFrame) -> DataFrame:
    """graph_id and entity_key `R>>P` of both sides' graph keys (as from graph_keys); a side without a key is InChI_NA."""
    r, p = (x.select("graph_id", F.col("graph_key").alias(n)) for x, n in ((reactants, "r"), (products, "p")))
    out = ids.select("graph_id").distinct().join(r, "graph_id", "left").join(p, "graph_id", "left")
    return out.select("graph_id", F.concat(F.coalesce("r", F.lit(MISSING)), F.lit(">>"), F.coalesce("p", F.lit(MISSING))).alias("entity_key"))
