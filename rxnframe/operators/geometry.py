"""Geometry over coordinate tables: graph_id, frame, node, element, x, y, z.

Neighbours within a radius are found by cells: in frames of more than SMALL atoms each atom meets the atoms of the 27 cells around it, cells being as wide as the radius, and
cells of one frame are spread over tasks; smaller frames compare all their atoms where they are. Atoms whose coordinates are null, NaN or infinite are near nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxnframe.operators.nodes import HETERO

XYZ = ("x", "y", "z")
SMALL = 64


def _moved(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    """df with node and the other columns renamed by a suffix, but for the keys."""
    return df.select(*keep, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keep])


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{c}_{a}") - F.col(f"{c}_{b}")) ** 2 for c in XYZ), F.lit(0.0)))


def pairs(coords: DataFrame, keys=("graph_id", "frame")) -> DataFrame:
    """Unordered pairs of a frame's atoms with their distance d."""
    keys = [*keys]
    return _moved(coords, "i", keys).join(_moved(coords, "j", keys), keys).filter("node_i < node_j").withColumn("d", distance("i", "j"))


def _large(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of small and of large frames, with finite coordinates."""
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in XYZ]
    sized = df.filter(finite[0] & finite[1] & finite[2]).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return sized.filter(F.col("_n") <= SMALL).drop("_n"), sized.filter(F.col("_n") > SMALL).drop("_n")


def _cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / radius)


def _in_cells(df: DataFrame, radius: float, keys: list[str], around: bool) -> DataFrame:
    """df by cells; with around, each row in its own and all neighbouring ones."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    for c in XYZ:
        df = df.withColumn(f"_s{c}", step).withColumn(f"_c{c}", _cell(c, radius) + F.col(f"_s{c}")).drop(f"_s{c}") if around else df.withColumn(f"_c{c}", _cell(c, radius))
    return df.repartition(*keys, *[f"_c{c}" for c in XYZ])  # a large frame is spread, whatever it was grouped by before


def within(left: DataFrame, right: DataFrame, radius: float, keys=("graph_id", "frame")) -> DataFrame:
    """Pairs of a left and a right atom of one frame, not the same, that are nearer than the radius, with their distance d; columns end in _i and _j. The left side decides which frames are large."""
    keys = [*keys]
    size = left.groupBy(*keys).agg(F.count("*").alias("_k")).join(right.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    big = size.filter(F.col("_k") * F.col("_m") > SMALL * SMALL).select(*keys)
    a, b = (x.filter(sum((F.col(c) * 0 for c in XYZ), F.lit(0.0)) == 0) for x in (left, right))  # finite
    near = _moved(a.join(big, keys, "left_anti"), "i", keys).join(_moved(b, "j", keys), keys)
    cells = [*keys, *[f"_c{c}" for c in XYZ]]
    far = _moved(_in_cells(a.join(big, keys, "left_semi"), radius, keys, False), "i", cells).join(_moved(_in_cells(b.join(big, keys, "left_semi"), radius, keys, True), "j", cells), cells).drop(*cells[len(keys) :])
    out = near.unionByName(far).withColumn("d", distance("i", "j"))
    return out.filter((F.col("d") < radius) & (F.col("node_i") != F.col("node_j")))


def near_pairs(coords: DataFrame, radius: float, keys=("graph_id", "frame")) -> DataFrame:
    """Unordered pairs (node_i < node_j) of a frame's atoms that are nearer than the radius, with their distance d. Work follows atoms and found pairs, not the square of a frame."""
    keys = [*keys]
    small, large = _large(coords, keys)
    near = pairs(small, keys)
    cells = [*keys, *[f"_c{c}" for c in XYZ]]
    far = _moved(_in_cells(large, radius, keys, False), "i", cells).join(_moved(_in_cells(large, radius, keys, True), "j", cells), cells)
    far = far.filter("node_i < node_j").drop(*cells[len(keys) :]).withColumn("d", distance("i", "j"))
    return near.unionByName(far).filter(F.col("d") < radius)


def perceive_bonds(coords: DataFrame, elements: DataFrame, scale: float = 1.2, hydrogen_scale: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Bonds (graph_id, frame, u < v, d) of atoms nearer than scale * (r_i + r_j), and frames (graph_id, frame) rejected because an atom exceeds its most bonds."""
    dim = elements.select("element", "radius", "most")
    known = coords.join(dim, "element")
    reach = dim.agg(F.max(2 * F.col("radius") * F.when(F.col("element") == "H", max(scale, hydrogen_scale)).otherwise(scale))).first()[0] or 1.0
    p = near_pairs(known, reach)
    near = F.when((F.col("element_i") == "H") & (F.col("element_j") == "H"), F.lit(max(scale, hydrogen_scale))).otherwise(F.lit(scale))
    b = p.filter((F.col("d") > 0) & (F.col("d") < near * (F.col("radius_i") + F.col("radius_j"))))
    ends = b.select("graph_id", "frame", F.explode(F.array(F.struct(F.col("node_i").alias("node"), F.col("most_i").alias("most")), F.struct(F.col("node_j").alias("node"), F.col("most_j").alias("most")))).alias("e"))
    over = ends.groupBy("graph_id", "frame", "e.node").agg(F.count("*").alias("n"), F.max("e.most").alias("most")).filter("n > most")
    bonds = b.select("graph_id", "frame", F.col("node_i").alias("u"), F.col("node_j").alias("v"), "d")
    return bonds, over.select("graph_id", "frame").distinct()


def hbond_contacts(coords: DataFrame, bonds: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Hydrogens with one bond, to N, O or F, and other unbonded N, O or F atoms nearer than the tolerance. bonds are directed."""
    bonds = bonds.select("graph_id", "u", "v")
    one = bonds.groupBy("graph_id", "u").agg(F.count("*").alias("k"), F.first("v").alias("v")).filter("k = 1")
    hetero = coords.filter(F.col("element").isin(*HETERO))
    h = coords.filter("element = 'H'").join(one.select("graph_id", F.col("u").alias("node"), F.col("v").alias("host")), ["graph_id", "node"])
    h = h.join(hetero.select("graph_id", "frame", F.col("node").alias("host")), ["graph_id", "frame", "host"], "left_semi").drop("host")
    keys = ["graph_id", "frame"]
    x = within(h, hetero, tolerance, keys)
    x = x.select(*keys, F.col("node_i").alias("u"), F.col("node_j").alias("v"), "d")
    return x.join(bonds, ["graph_id", "u", "v"], "left_anti").select(*keys, "u", "v", "d")


def fragments_close(coords: DataFrame, components: DataFrame, factor: float | None = None) -> DataFrame:
    """Close is true when every pair of fragments has its centres within factor * (r_1 + r_2); the factor follows sizes unless given; single fragments are close."""
    keys = ["graph_id", "frame"]
    own = coords.join(components.select("graph_id", "node", "component"), ["graph_id", "node"])
    centre = own.groupBy(*keys, "component").agg(*[F.avg(c).alias(f"c{c}") for c in XYZ], F.count("*").alias("size"))
    spread = own.join(centre, [*keys, "component"]).groupBy(*keys, "component").agg(F.max(F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in XYZ), F.lit(0.0)))).alias("radius"))
    frag = centre.join(spread, [*keys, "component"])
    total = frag.groupBy(*keys).agg(F.sum("size").alias("atoms"), F.min("size").alias("least"))
    auto = F.when(F.col("least") < 3, 4.0).when(F.col("least") < 5, 3.0).when(F.col("atoms") > 12, 1.5).otherwise(2.0)
    a, b = _moved(frag, "i", keys), _moved(frag, "j", keys)
    p = a.join(b, keys).filter("component_i < component_j").join(total, keys)
    d = F.sqrt(sum(((F.col(f"c{c}_i") - F.col(f"c{c}_j")) ** 2 for c in XYZ), F.lit(0.0)))
    far = p.groupBy(*keys).agg(F.bool_and(d <= (F.lit(factor) if factor else auto) * (F.col("radius_i") + F.col("radius_j"))).alias("close"))
    return total.select(*keys).join(far, keys, "left").fillna(True, ["close"])


def segment_distance(a0: list[Column], a1: list[Column], b0: list[Column], b1: list[Column]) -> Column:
    """Shortest distance between two segments: the least of the distances from each end to the other segment and, where the closest points of the lines lie inside both, theirs."""
    sub = lambda p, q: [x - y for x, y in zip(p, q)]
    dot = lambda p, q: sum((x * y for x, y in zip(p, q)), F.lit(0.0))
    clamp = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))

    def to_segment(p, q0, q1):
        d = sub(q1, q0)
        t = clamp(F.coalesce(dot(sub(p, q0), d) / F.nullif(dot(d, d), F.lit(0.0)), F.lit(0.0)))
        gap = sub(p, [x + t * y for x, y in zip(q0, d)])
        return dot(gap, gap)

    u, v, w = sub(a1, a0), sub(b1, b0), sub(a0, b0)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    den = uu * vv - uv * uv
    s, t = (uv * vw - vv * uw) / F.nullif(den, F.lit(0.0)), (uu * vw - uv * uw) / F.nullif(den, F.lit(0.0))
    gap = [x + s * y - t * z for x, y, z in zip(w, u, v)]
    cross = F.when((den > 1e-12) & s.between(0, 1) & t.between(0, 1), dot(gap, gap))
    return F.sqrt(F.least(to_segment(a0, b0, b1), to_segment(a1, b0, b1), to_segment(b0, a0, a1), to_segment(b1, a0, a1), cross))


def segment_distances(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """segment_distance of many pairs at once, as rows of three coordinates; missing ones are NaN."""
    dot = lambda p, q: (p * q).sum(1)

    def to_segment(p, q0, q1):
        d = q1 - q0
        t = np.clip(np.nan_to_num(dot(p - q0, d) / dot(d, d)), 0, 1)
        gap = p - (q0 + t[:, None] * d)
        return dot(gap, gap)

    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, w = a1 - a0, b1 - b0, a0 - b0
        uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
        den = uu * vv - uv * uv
        s, t = (uv * vw - vv * uw) / den, (uu * vw - uv * uw) / den
        gap = w + s[:, None] * u - t[:, None] * v
        inside = (den > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        least = np.where(inside, dot(gap, gap), np.nan)
        for x in (to_segment(a0, b0, b1), to_segment(a1, b0, b1), to_segment(b0, a0, a1), to_segment(b1, a0, a1)):
            least = np.fmin(least, x)
    return np.sqrt(least)


def _keyed(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by these columns, and which rows of that order begin a new value."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([np.diff(c[order]) != 0 for c in columns], 0)
    return order, new


def _places(atoms: tuple[np.ndarray, np.ndarray, np.ndarray], group: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Places of nodes by graph and frame (group) among the atoms (group, node and place of each), -1 for those that aren't there."""
    known, name, at = atoms
    order, _ = _keyed(np.append(known, group), np.append(name, node), np.append(np.zeros(len(name)), np.ones(len(node))))
    own = order < len(name)
    last = np.maximum.accumulate(np.where(own, np.arange(len(order)), -1))[~own] if len(order) else np.zeros(0, np.int64)
    asked = order[~own] - len(name)
    asked, found = asked[last >= 0], order[last[last >= 0]]
    good = (known[found] == group[asked]) & (name[found] == node[asked])
    out = np.full(len(node), -1)
    out[asked[good]] = at[found[good]]
    return out


class _Bonds:
    """Bonds of graphs with the places of their ends among the atoms, in the order of graph, frame, u, v; those with an end that isn't there are left out."""

    def __init__(self, atoms: tuple[np.ndarray, np.ndarray, np.ndarray], group: np.ndarray, u: np.ndarray, v: np.ndarray):
        order, _ = _keyed(group, u, v)
        self.group, self.u, self.v = group[order], u[order], v[order]
        self.i, self.j = _places(atoms, self.group, self.u), _places(atoms, self.group, self.v)
        good = (self.i >= 0) & (self.j >= 0)
        for c in ("group", "u", "v", "i", "j"):
            setattr(self, c, getattr(self, c)[good])


def _met(a: _Bonds, b: _Bonds, limit: int = 1 << 19):
    """Yields places (in a, in b) of all pairs of bonds of one graph and frame, about `limit` at a time."""
    low, high = np.searchsorted(b.group, a.group), np.searchsorted(b.group, a.group, "right")
    many = high - low
    total = np.append(0, np.cumsum(many))
    start = 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        k = np.repeat(np.arange(start, stop), many[start:stop])
        yield k, low[k] + np.arange(len(k)) - (total[k] - total[start])
        start = stop


def alignment_indicators(coords: DataFrame, bonds_r: DataFrame, bonds_p: DataFrame, elements: DataFrame, default: float = 2.0) -> DataFrame:
    """C11: per graph: mass-weighted deviation of the two frames (0 reactant, 1 product), longest changing bond without and with hydrogen, nearest other bond to a changing bond without and with hydrogen, and the crossing distance of two broken or two formed bonds in a hydrogen-free change. A broken bond is measured in the product frame, a formed one in the reactant frame.

    One graph's atoms and bonds form a row; a task takes many graphs at once, and their pairs of bonds in blocks. elements, one row a symbol, goes to all tasks. Missing coordinates count as no distance; nodes are whole numbers and stand once in a frame."""
    long = lambda c: F.col(c).cast("long").alias(c)
    mass = F.broadcast(elements.select("element", F.col("mass").cast("double").alias("mass")))
    c = coords.filter("frame in (0, 1) and node is not null").join(mass, "element", "left")
    kind = F.when(F.col("element") == "H", 1).when(F.col("element").isNotNull(), 0).otherwise(-1).cast("long").alias("kind")
    whole = lambda df, name, *x: df.filter("graph_id is not null").groupBy("graph_id").agg(F.collect_list(F.struct(*x)).alias(name))
    bonds = lambda df, name: whole(df.filter("u is not null and v is not null"), name, long("u"), long("v"))
    double = [F.col(x).cast("double").alias(x) for x in ("mass", *XYZ)]
    rows = whole(c, "c", long("frame"), long("node"), kind, *double).join(bonds(bonds_r, "r"), "graph_id", "left").join(bonds(bonds_p, "p"), "graph_id", "left")
    names = ("rmsd", "max_bond", "max_h_bond", "min_cross", "min_h_cross", "path_cross")
    schema = T.StructType([T.StructField("graph_id", coords.schema["graph_id"].dataType), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep, values = _indicators(batch, default)
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").filter(pa.array(keep)), *[pa.array(v[keep], from_pandas=True) for v in values]], names=["graph_id", *names])

    return rows.mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Graph of each item of a list column, and the items' fields; missing numbers are NaN."""
    col = batch.column(name)
    graph = pc.list_parent_indices(col).to_numpy()
    items = col.flatten()
    return graph, {f.name: pc.struct_field(items, [f.name]).to_numpy(zero_copy_only=False) for f in items.type}


def _indicators(batch: pa.RecordBatch, default: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which graphs have a row, and the six indicators of all."""
    n = batch.num_rows
    graph, c = _flat(batch, "c")
    at = np.stack([c[x] for x in XYZ], 1)
    order, _ = _keyed(graph * 2 + c["frame"], c["node"])
    atoms = ((graph * 2 + c["frame"])[order], c["node"][order], order)
    sides = []
    for name in "rp":
        g, b = _flat(batch, name)
        order, new = _keyed(g, b["u"], b["v"])
        sides.append([x[order][new] for x in (g, b["u"], b["v"])])
    every = [np.concatenate(x) for x in zip(*sides)]
    of_p = np.arange(len(every[0])) >= len(sides[0][0])
    order, new = _keyed(*every)
    alone = np.zeros(len(order), bool)
    alone[order] = new & np.append(new[1:], True)
    a = _Bonds(atoms, every[0][alone] * 2 + ~of_p[alone], every[1][alone], every[2][alone])
    b = _Bonds(atoms, every[0] * 2 + of_p, every[1], every[2])
    hydrogen = (c["kind"][a.i] == 1) | (c["kind"][a.j] == 1)
    plain = (c["kind"][a.i] == 0) & (c["kind"][a.j] == 0)
    best = lambda f, fill, where, k, x: (out := np.full(n, fill), f.at(out, k[where], x[where]), np.where(np.isinf(out), np.nan, out))[2]
    length, mine = np.sqrt(((at[a.i] - at[a.j]) ** 2).sum(1)), a.group // 2
    found = {name: best(np.fmax, -np.inf, test, mine, length) for name, test in (("max", plain), ("max_h", hydrogen))}
    near = np.full(len(a.group), np.inf)
    path = np.full(n, np.inf)
    for x, y in _met(a, b):
        free = (b.u[y] != a.u[x]) & (b.u[y] != a.v[x]) & (b.v[y] != a.u[x]) & (b.v[y] != a.v[x])
        x, y = x[free], y[free]
        np.fmin.at(near, x, segment_distances(at[a.i[x]], at[a.j[x]], at[b.i[y]], at[b.j[y]]))
    found |= {name: best(np.fmin, np.inf, test, mine, near) for name, test in (("min", plain), ("min_h", hydrogen))}
    first = np.flatnonzero(np.append(True, np.diff(a.group) != 0)) if len(a.group) else np.zeros(0, np.int64)
    x = first[np.diff(np.append(first, len(a.group))) == 2]  # frames of two changing bonds
    np.fmin.at(path, mine[x], segment_distances(at[a.i[x]], at[a.j[x]], at[a.i[x + 1]], at[a.j[x + 1]]))
    any_h = np.zeros(n, bool)
    any_h[mine[hydrogen]] = True
    # Deviation: atoms of frame 0 with a mass that are in frame 1 as well.
    zero = np.flatnonzero((c["frame"] == 0) & ~np.isnan(c["mass"]))
    pair = _places(atoms, graph[zero] * 2 + 1, c["node"][zero])
    zero, pair = zero[pair >= 0], pair[pair >= 0]
    d2 = ((at[zero] - at[pair]) ** 2).sum(1)
    there = ~np.isnan(d2)
    total, weight, some = (np.bincount(graph[zero][k], w[k], n) for k, w in ((there, c["mass"][zero] * d2), (slice(None), c["mass"][zero]), (there, np.ones(len(zero)))))
    with np.errstate(divide="ignore", invalid="ignore"):
        rmsd = np.where(some > 0, np.sqrt(total / weight), np.nan)
    keep = np.zeros(n, bool)
    keep[mine] = True
    both = np.zeros(n, bool)
    both[graph[zero]] = True
    told = [np.where(np.isnan(found[k]), default, found[k]) for k in ("max", "max_h", "min", "min_h")]
    return keep & both, [rmsd, *told, np.where(any_h, default, np.minimum(default, path))]


def geometry_deviation(coords: DataFrame, elements: DataFrame, bonds: DataFrame | None = None, least: float = 0.2) -> DataFrame:
    """Rmsd and mass_rmsd of frames 0 and 1 without superposition and, with bonds, the sum of bond-length changes over `least`."""
    c = coords.select("graph_id", "frame", "node", "element", *XYZ)
    a, b = (c.filter(F.col("frame") == k).drop("frame") for k in (0, 1))
    both = _moved(a, "i", ["graph_id", "node", "element"]).join(_moved(b.drop("element"), "j", ["graph_id", "node"]), ["graph_id", "node"])
    both = both.join(elements.select("element", "mass"), "element")
    d2 = distance("i", "j") ** 2
    out = both.groupBy("graph_id").agg(F.sqrt(F.avg(d2)).alias("rmsd"), F.sqrt(F.sum(F.col("mass") * d2) / F.sum("mass")).alias("mass_rmsd"))
    if bonds is None:
        return out
    x = bonds.select("graph_id", "u", "v")
    for end in "uv":
        for tag, side in (("0", a), ("1", b)):
            x = x.join(side.select("graph_id", F.col("node").alias(end), *[F.col(k).alias(f"{k}_{end}{tag}") for k in XYZ]), ["graph_id", end])
    change = F.abs(distance("u0", "v0") - distance("u1", "v1"))
    total = x.groupBy("graph_id").agg(F.sum(F.when(change > least, change).otherwise(0.0)).alias("bond_change"))
    return out.join(total, "graph_id", "left").fillna(0.0, ["bond_change"])


def motion_indicators(coords: DataFrame, modes: DataFrame, elements: DataFrame, targets: DataFrame, scale: float = 1.8, step: float = 0.5) -> DataFrame:
    """along a mode (mx, my, mz per atom), pairs within scale * (r_i + r_j) rank by how much their distance changes (to 9 digits, ties by node). Per graph: mean and least change of the target pairs (0 for one out of range), the sum of non-target changes ranked above the worst target, and the longest target pair."""
    keys = ["graph_id"]
    at = coords.join(modes, ["graph_id", "node"]).join(elements.select("element", "radius"), "element")
    at = at.select("graph_id", "node", "radius", *XYZ, "mx", "my", "mz")
    t = targets.select("graph_id", F.col("u").alias("node_i"), F.col("v").alias("node_j")).distinct().withColumn("target", F.lit(True))
    reach = 2 * scale * (elements.agg(F.max("radius")).first()[0] or 1.0)
    aimed = _moved(at, "i", keys).join(t.drop("target"), ["graph_id", "node_i"]).join(_moved(at, "j", keys), ["graph_id", "node_j"]).filter("node_i < node_j")
    close = near_pairs(at, reach, keys).drop("d")
    p = close.join(t.drop("target"), ["graph_id", "node_i", "node_j"], "left_anti").unionByName(aimed)
    gap = lambda s: F.sqrt(sum(((F.col(f"{c}_i") + s * F.col(f"m{c}_i") - F.col(f"{c}_j") - s * F.col(f"m{c}_j")) ** 2 for c in XYZ), F.lit(0.0)))
    p = p.withColumns({"d": gap(0.0), "change": F.round(F.abs(gap(step) - gap(-step)), 9)})
    p = p.join(t, ["graph_id", "node_i", "node_j"], "left").fillna(False, ["target"])
    near = (F.col("d") > 0) & (F.col("d") < scale * (F.col("radius_i") + F.col("radius_j")))
    p = p.filter(near | F.col("target")).withColumn("near", near).withColumn("change", F.when(F.col("near"), F.col("change")).otherwise(0.0))
    order = Window.partitionBy("graph_id").orderBy(F.desc("near"), F.desc("change"), "node_i", "node_j")
    p = p.withColumn("rank", F.when(F.col("near"), F.row_number().over(order)).otherwise(1 << 30))
    worst = p.withColumn("worst", F.max(F.when(F.col("target"), F.col("rank"))).over(Window.partitionBy("graph_id"))).filter(F.col("worst").isNotNull())
    mine = F.when(F.col("target"), F.col("change"))
    return worst.groupBy("graph_id").agg(F.avg(mine).alias("mean_target"), F.min(mine).alias("least_target"), F.sum(F.when(~F.col("target") & (F.col("rank") < F.col("worst")), F.col("change")).otherwise(0.0)).alias("unexpected"), F.max(F.when(F.col("target"), F.col("d"))).alias("longest"))
