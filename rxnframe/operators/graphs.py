"""Operators on whole graphs: fragments, ring flags and junctions, canonical order, electron bookkeeping and descriptors. Distances are in hops, rings and walk sums in rings.

Bonds are directed (both orientations). A graph's rows meet once, by graph_id; there are no rounds of joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.operators.hops import bond_distances, distance_to_set, graph_distances, hops_from  # noqa: F401
from rxnframe.operators.rings import atom_hash, find_rings  # noqa: F401


def _fragments(graph: np.ndarray, node: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For rows (graph, node, near or -1), numbered from 0 upwards in each batch: the smallest node reachable. Links to nodes without a row of their own are ignored."""
    own = near < 0
    width = int(max(node.max(), near.max())) + 1
    known, at = np.unique(graph[own] * width + node[own], return_inverse=True)
    a, b = graph[~own] * width + node[~own], graph[~own] * width + near[~own]
    i, j = (np.minimum(np.searchsorted(known, x), max(0, len(known) - 1)) for x in (a, b))
    there = (known[i] == a) & (known[j] == b) if len(known) else np.zeros(len(a), bool)
    i, j = i[there], j[there]
    label = np.arange(len(known))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for side in (i, j):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return known[label[at]] % width
        label = new


def components(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Each atom's fragment, named by its smallest node; isolated atoms are their own, and so are atoms without a graph.

    One shuffle by graph_id, then one pass over each partition: whole graphs of a batch are labelled together, a graph that a batch
    cuts waits for the next one. Ids may be of any type that sorts; a task holds one batch and one graph."""
    types = {f.name: f.dataType for f in atoms.select("graph_id", "node").schema}
    named = F.col("graph_id").isNotNull() & F.col("node").isNotNull()
    rows = atoms.filter(named).select("graph_id", "node", F.lit(None).cast(types["node"]).alias("near"))
    rows = rows.unionByName(bonds.filter("graph_id is not null and u is not null and v is not null").select("graph_id", F.col("u").cast(types["node"]).alias("node"), F.col("v").cast(types["node"]).alias("near")))
    rows = rows.repartition("graph_id").sortWithinPartitions("graph_id")
    schema = T.StructType([T.StructField("graph_id", types["graph_id"]), T.StructField("node", types["node"]), T.StructField("component", types["node"])])

    def label(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        graph = pc.rank(t["graph_id"], tiebreaker="dense").to_numpy().astype(np.int64)
        names = pa.chunked_array([*t["node"].chunks, *t["near"].chunks]).combine_chunks().unique().drop_null()
        names = names.take(pc.sort_indices(names))
        node = pc.index_in(t["node"], names).to_numpy().astype(np.int64)
        near = pc.fill_null(pc.index_in(t["near"], names), -1).to_numpy().astype(np.int64)
        low = _fragments(graph, node, near)
        own = pa.array(near < 0)
        cols = [t["graph_id"].filter(own).combine_chunks(), t["node"].filter(own).combine_chunks(), names.take(pa.array(low))]
        return pa.RecordBatch.from_arrays(cols, names=["graph_id", "node", "component"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            last = held["graph_id"][len(held) - 1]
            n = pc.index(held["graph_id"], last).as_py()  # sorted: where the last graph begins
            if n:
                yield label(held.slice(0, n))
                held = held.slice(n)
        if held is not None and len(held):
            yield label(held)

    out = rows.mapInArrow(run, schema)
    return out.unionByName(atoms.filter(~named).select("graph_id", "node", F.col("node").alias("component")))


def ring_atoms(rings: DataFrame) -> DataFrame:
    """Atoms on some ring."""
    return rings.select("graph_id", F.explode("ring").alias("node")).distinct()


def ring_flags(rings: DataFrame, atoms: DataFrame) -> DataFrame:
    """in_ring of each atom."""
    return atoms.select("graph_id", "node").join(ring_atoms(rings).withColumn("in_ring", F.lit(True)), ["graph_id", "node"], "left").fillna(False, ["in_ring"])


def ring_bond_flags(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """in_ring of each bond: both ends lie on one ring."""
    a = rings.select("graph_id", F.col("ring").alias("_ring"), F.explode("ring").alias("u"))
    both = a.select("graph_id", "u", F.explode("_ring").alias("v")).distinct().withColumn("in_ring", F.lit(True))
    return edges.select("graph_id", "u", "v").join(both, ["graph_id", "u", "v"], "left").fillna(False, ["in_ring"])


def ring_neighbours(rings: DataFrame) -> DataFrame:
    """each ring atom with the atoms before and after it; ring_id counts a graph's rings by their walks."""
    own = rings.withColumn("ring_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("size", "ring")))
    x = own.select("graph_id", "ring_id", "size", F.posexplode("ring").alias("pos", "node"))
    w = Window.partitionBy("graph_id", "ring_id").orderBy("pos")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumns({"before": F.coalesce(F.lag("node").over(w), F.last("node").over(full)), "after": F.coalesce(F.lead("node").over(w), F.first("node").over(full))})


def walk_bonds(rings: DataFrame) -> DataFrame:
    """Bonds along the rings' walks: graph_id, ring_id, u < v."""
    x = ring_neighbours(rings)
    return x.select("graph_id", "ring_id", F.least("node", "after").alias("u"), F.greatest("node", "after").alias("v"))


def ring_junctions(rings: DataFrame) -> DataFrame:
    """E5: atoms that are spiro (the one atom two rings share) or bridgehead (ends of the path of more than one bond that two rings share)."""
    x = ring_neighbours(rings).select("graph_id", "ring_id", "node")
    y = x.withColumnRenamed("ring_id", "other")
    shared = x.join(y, ["graph_id", "node"]).filter("ring_id < other").groupBy("graph_id", "ring_id", "other").agg(F.collect_list("node").alias("atoms"))
    spiro = shared.filter(F.size("atoms") == 1).select("graph_id", F.col("atoms")[0].alias("node"), F.lit("spiro").alias("kind"))
    b = walk_bonds(rings)
    c = b.withColumnRenamed("ring_id", "other")
    common = b.join(c, ["graph_id", "u", "v"]).filter("ring_id < other").withColumn("n", F.count("*").over(Window.partitionBy("graph_id", "ring_id", "other"))).filter("n > 1")
    ends = common.select("graph_id", "ring_id", "other", F.explode(F.array("u", "v")).alias("node")).groupBy("graph_id", "ring_id", "other", "node").count().filter("count = 1")
    return spiro.unionByName(ends.select("graph_id", "node", F.lit("bridgehead").alias("kind"))).distinct()


def canonical_order(hashes: DataFrame, parts: DataFrame) -> DataFrame:
    """Place of each atom: fragments by their greatest hash, atoms by hash, all descending; later fragments and nodes first among equals."""
    x = hashes.join(parts, ["graph_id", "node"]).withColumn("top", F.max("hash").over(Window.partitionBy("graph_id", "component")))
    order = [F.desc("top"), F.desc("component"), F.desc("hash"), F.desc("node")]
    return x.select("graph_id", "node", "hash", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)).alias("place"))


def electron_counts(bonds: DataFrame, atoms: DataFrame, elements: DataFrame, key=("graph_id",)) -> DataFrame:
    """Electrons, deficiency, excess and formal charge of each atom. atoms: element and own (unbound electrons); key tells structures apart."""
    key = [*key, "node"]
    used = bonds.withColumnRenamed("u", "node").groupBy(*key).agg(F.sum("ord").alias("bonded"))
    x = atoms.join(used, key, "left").fillna(0, ["bonded"]).join(elements.select("element", "octet", "valence", "electronegativity"), "element")
    e = F.col("own") + 2 * F.col("bonded")
    return x.withColumns({"electrons": e, "deficiency": F.least(e - F.col("octet"), F.lit(0)), "excess": F.greatest(e - F.col("octet"), F.lit(0)), "formal": F.col("valence") - F.col("own") - F.col("bonded")})


def ring_aromaticity(rings: DataFrame, bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Aromatic of each ring: 1, 0 or -1 (antiaromatic). atoms: own (unbound electrons)."""
    x = ring_neighbours(rings)
    order = bonds.groupBy("graph_id", F.col("u").alias("node"), F.col("v").alias("_to")).agg(F.max("ord").alias("_o"))
    for side in ("before", "after"):
        x = x.join(order.withColumnsRenamed({"_to": side, "_o": f"o_{side}"}), ["graph_id", "node", side], "left")
    total = bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.sum("ord").alias("bonded"))
    x = x.join(total, ["graph_id", "node"], "left").join(atoms.select("graph_id", "node", "own"), ["graph_id", "node"]).fillna(0)
    own, before, after = F.col("own"), F.col("o_before"), F.col("o_after")
    pi = F.when(before >= 2, 0).when(after >= 2, 2).when(own == 1, 1).when(own >= 2, 2).otherwise(0)
    able = (own > 0) | (before > 1) | (after > 1) | (own + F.col("bonded") < 4)
    out = x.groupBy("graph_id", "ring_id").agg(F.first("size").alias("size"), F.bool_and(able).alias("able"), F.sum(pi).alias("pi"))
    kind = F.when(~F.col("able") | (F.col("pi") % 2 != 0), 0).when(F.col("pi") % 4 == 0, -1).otherwise(1)
    return out.select("graph_id", "ring_id", "size", kind.alias("aromatic"))


def structure_score(counts: DataFrame, aromatic: DataFrame | None = None, key=("graph_id",), charge: str | None = None) -> DataFrame:
    """Weighted score of each structure, lower is better; with a charge column, normalised by it as if on the most or least electronegative atom."""
    key, en = [*key], F.col("electronegativity")
    formal = F.when(F.col("formal") > 0, F.col("formal") * en).otherwise(0.9 * F.col("formal") * en)
    aggs = [(-F.sum(F.col("deficiency") * en) + 0.1 * F.sum("excess") + 0.1 * F.sum(formal)).alias("score")]
    if charge:
        aggs += [F.sum(charge).alias("_q"), F.min(en).alias("_low"), F.max(en).alias("_high")]
    out = counts.groupBy(*key).agg(*aggs)
    if aromatic is not None:
        rings = aromatic.groupBy(*key).agg(F.sum(F.col("aromatic") * 12 / F.col("size")).alias("_a"))
        out = out.join(rings, key, "left").withColumn("score", F.col("score") - 2 * F.coalesce("_a", F.lit(0.0))).drop("_a")
    if charge:
        out = out.withColumn("score", F.col("score") - F.when(F.col("_q") > 0, F.col("_low")).otherwise(F.col("_high")) * F.col("_q") * 0.1).drop("_q", "_low", "_high")
    return out


def shell_counts(bonds: DataFrame, atoms: DataFrame, seeds: DataFrame, vocabulary=("C", "N", "O", "H"), shells: int = 3) -> DataFrame:
    """Atoms of each element at 0, 1 ... hops from each seed, an atom counting once for each seed."""
    near = hops_from(bonds, atoms, seeds, shells - 1)
    x = near.join(atoms.select("graph_id", "node", "element"), ["graph_id", "node"])
    counts = [F.count_if((F.col("hops") == h) & (F.col("element") == e)).alias(f"s{h}_{e}") for h in range(shells) for e in vocabulary]
    return x.groupBy("graph_id").agg(*counts)


def reaction_descriptor(parts: list[DataFrame], extra: list[str] | None = None, name: str = "descriptor") -> DataFrame:
    """The numeric columns of each part side by side in one array per graph; a graph must be in every part."""
    first, columns = parts[0], []
    for p in parts:
        columns += [c for c, t in p.dtypes if c != "graph_id" and t != "boolean"]
    for p in parts[1:]:
        first = first.join(p, "graph_id")
    return first.select("graph_id", F.array(*[F.col(c).cast("double") for c in [*columns, *(extra or [])]]).alias(name))
