"""Atom-level features from atom tables (graph_id, node, element, charge) and directed bond tables (graph_id, u, v, ord)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


HEAVY = "element <> 'H'"
HETERO = ("N", "O", "F")


def order_atoms(atoms: DataFrame, number: str) -> DataFrame:
    """Dense node ids from 1 in the order of a map number."""
    return atoms.withColumn("node", F.row_number().over(Window.partitionBy("graph_id").orderBy(number)))


def neighbour_counts(bonds: DataFrame, atoms: DataFrame, vocabulary=("H", "C", "N", "O")) -> DataFrame:
    """C4: numbers of neighbours of each element; isolated atoms get 0."""
    far = bonds.select("graph_id", "u", "v").join(atoms.select("graph_id", F.col("node").alias("v"), "element"), ["graph_id", "v"])
    counts = far.groupBy("graph_id", F.col("u").alias("node")).agg(*[F.count_if(F.col("element") == e).alias(f"n_{e}") for e in vocabulary])
    return atoms.select("graph_id", "node").join(counts, ["graph_id", "node"], "left").fillna(0)


def check_balance(left: DataFrame, right: DataFrame) -> DataFrame:
    """graph_id and balanced: both sides hold the same element under every map number."""
    a = left.select("graph_id", "node", F.col("element").alias("r_element"))
    b = right.select("graph_id", "node", F.col("element").alias("p_element"))
    both = a.join(b, ["graph_id", "node"], "full_outer")
    return both.groupBy("graph_id").agg(F.bool_and(F.col("r_element").eqNullSafe(F.col("p_element"))).alias("balanced"))


def check_vocabulary(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Atoms whose element the dimension table lacks."""
    return atoms.join(elements.select("element").distinct(), "element", "left_anti")


def element_features(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Atoms with the element table's number and mass; null for unknown elements."""
    return atoms.join(elements.select("element", "number", "mass"), "element", "left")


def bond_polarity(bonds: DataFrame, atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Absolute difference of the ends' electronegativity, an unknown one counting 0."""
    value = atoms.join(elements.select("element", "electronegativity"), "element", "left").select("graph_id", "node", F.coalesce("electronegativity", F.lit(0.0)).alias("en"))
    for end in "uv":
        bonds = bonds.join(value.select("graph_id", F.col("node").alias(end), F.col("en").alias(f"en_{end}")), ["graph_id", end])
    return bonds.withColumn("polarity", F.abs(F.col("en_u") - F.col("en_v")))


def degrees(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Number of bonds of each atom, 0 included."""
    d = bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    return atoms.join(d, ["graph_id", "node"], "left").fillna(0, ["degree"])


def adjacency(bonds: DataFrame) -> DataFrame:
    """Sorted distinct neighbours and degree of each bonded atom."""
    return bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"), F.countDistinct("v").alias("degree"))


def motif_flags(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Nine local motifs of each atom, from one pass over its neighbours' elements and degrees."""
    known = degrees(bonds, atoms.select("graph_id", "node", "element"))
    far = known.select("graph_id", F.col("node").alias("v"), F.col("element").alias("far"), F.col("degree").alias("far_degree"))
    el, d = F.col("far"), F.col("far_degree")
    counts = {"o_end": (el == "O") & (d == 1), "o_any": el == "O", "c_any": el == "C", "c_end": (el == "C") & (d == 1), "c_two": (el == "C") & (d == 2), "os_end": el.isin("O", "S") & (d == 1), "cn_any": el.isin("C", "N")}
    seen = bonds.select("graph_id", "u", "v").join(far, ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node")).agg(*[F.count_if(t).alias(n) for n, t in counts.items()])
    x = known.join(seen, ["graph_id", "node"], "left").fillna(0, list(counts))
    e, c = F.col("element"), F.col
    flags = {
        "nitro": (e == "N") & (c("o_end") == 2),
        "sulfoxide": (e == "S") & (c("o_end") == 1) & (c("c_any") == 2),
        "sulfonyl": (e == "S") & (c("o_end") == 2) & (c("c_any") == 2),
        "phosphate": (e == "P") & (c("o_any") == 4) & (c("degree") == 4) & (c("o_end") > 0),
        "cyano": (e == "N") & (c("degree") <= 1) & (c("c_two") == 1),
        "isocyano": (e == "N") & (c("degree") <= 1) & (c("c_end") == 1),
        "frag_sulfoxide": (e == "S") & (c("o_end") >= 1) & (c("degree") == 3),
        "frag_sulfonyl": (e == "S") & (c("o_end") >= 2) & (c("degree") == 4),
        "frag_ethenone": (e == "C") & (c("os_end") == 1) & (c("cn_any") == 1) & (c("degree") == 2),
    }
    return x.select("graph_id", "node", *[t.alias(n) for n, t in flags.items()])


def lone_pairs(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Valence shell minus bond orders (aromatic counts 2), hydrogens and radicals. Optional columns: bonds.aromatic, atoms.hydrogens, atoms.radicals."""
    order = F.when(F.col("aromatic"), 2).otherwise(F.col("ord")) if "aromatic" in bonds.columns else F.col("ord")
    used = bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.sum(order).alias("bonded"))
    shell = F.when(F.col("element") == "H", 1).when(F.col("element") == "P", 10).when(F.col("element") == "S", 12).otherwise(8)
    spare = [F.coalesce(F.col(c), F.lit(0)) for c in ("hydrogens", "radicals") if c in atoms.columns]
    left = shell - F.coalesce("bonded", F.lit(0)) - sum(spare, F.lit(0))
    return atoms.join(used, ["graph_id", "node"], "left").withColumn("lone_pairs", left).drop("bonded")


def radicals(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Radical electrons by the diagonal rule: with fewer than 8 electrons all unbound ones (`own`), else one if their number is odd and the graph's charge isn't negative."""
    used = bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.sum("ord").alias("bonded"))
    total = atoms.groupBy("graph_id").agg(F.sum("charge").alias("total_charge"))
    x = atoms.join(used, ["graph_id", "node"], "left").join(total, "graph_id").withColumn("bonded", F.coalesce("bonded", F.lit(0)))
    odd = (F.pmod("own", F.lit(2)) == 1) & (F.col("total_charge") >= 0)
    value = F.when(2 * F.col("bonded") + F.col("own") < 8, F.col("own")).when(odd, 1).otherwise(0)
    return x.withColumn("radicals", value).drop("bonded", "total_charge")


def radical_flags(atoms: DataFrame) -> DataFrame:
    """Radical electrons of each graph (an unknown count as 1) and the radical and biradical flags."""
    out = atoms.groupBy("graph_id").agg(F.sum(F.coalesce("radicals", F.lit(1))).alias("n_radicals"))
    return out.withColumns({"is_radical": F.col("n_radicals") > 0, "is_biradical": F.col("n_radicals") == 2})


def hbond_flags(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Acceptor is N, O or F; donor is an acceptor with a hydrogen."""
    near = neighbour_counts(bonds, atoms, ("H",))
    acceptor = F.col("element").isin(*HETERO)
    return atoms.select("graph_id", "node", "element").join(near, ["graph_id", "node"]).select("graph_id", "node", acceptor.alias("acceptor"), (acceptor & (F.col("n_H") > 0)).alias("donor"))


def composition(atoms: DataFrame, vocabulary=("C", "N", "O", "H")) -> DataFrame:
    """Heavy atoms and counts of the vocabulary's elements."""
    return atoms.groupBy("graph_id").agg(F.count_if(F.expr(HEAVY)).alias("n_heavy"), *[F.count_if(F.col("element") == e).alias(f"n_{e}") for e in vocabulary])


def bond_pair_counts(edges: DataFrame, atoms: DataFrame, vocabulary=("C", "N", "O", "H")) -> DataFrame:
    """Bonds per unordered element pair; a graph with another pair is marked rejected."""
    pairs = [(a, b) for i, a in enumerate(vocabulary) for b in vocabulary[i:]]
    known = atoms.select("graph_id", "node", "element")
    x = edges.select("graph_id", "u", "v")
    for end in "uv":
        x = x.join(known.select("graph_id", F.col("node").alias(end), F.col("element").alias(f"e_{end}")), ["graph_id", end])
    a, b = F.col("e_u"), F.col("e_v")
    tests = {f"{p}{q}": ((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in pairs}
    listed = a.isin(*vocabulary) & b.isin(*vocabulary)
    return x.groupBy("graph_id").agg(*[F.count_if(t).alias(n) for n, t in tests.items()], (~F.bool_and(listed)).alias("rejected"))


def rotatable_bonds(edges: DataFrame, bonds: DataFrame, ring_bonds: DataFrame) -> DataFrame:
    """Single bonds off all rings whose ends both have another bond and no triple bond."""
    ends = bonds.groupBy("graph_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.max("ord").alias("top"))
    x = edges.filter("ord = 1").join(ring_bonds.select("graph_id", "u", "v"), ["graph_id", "u", "v"], "left_anti")
    for end in "uv":
        good = ends.filter("degree > 1 and top < 3").select("graph_id", F.col("node").alias(end))
        x = x.join(good, ["graph_id", end], "left_semi")
    return x.select("graph_id", "u", "v")


#: Widths of the feature groups: node groups first, then edge groups; those in OPTIONAL are off by default.
NODE_WIDTHS: Mapping[str, int] = {"element": 2, "neighbours": 4, "reactive": 1, "ring": 1, "charge": 1, "aromatic": 1, "chiral": 3, "hybrid": 4, "radical": 2, "spiro": 1, "bridgehead": 1, "hbond": 2, "electronegativity": 1}
EDGE_WIDTHS: Mapping[str, int] = {"bond_type": 5, "ring": 1, "bond_order": 5, "conjugated": 1, "stereo": 3, "rotatable": 2}
OPTIONAL = {"radical", "spiro", "bridgehead", "hbond", "electronegativity", "rotatable"}


def feature_width(kind: str, drop=(), add=(), full_hybrid: bool = False, only_hydrogen: bool = False) -> int:
    """Width of the assembled vector for the group switches."""
    widths = dict(NODE_WIDTHS if kind == "node" else EDGE_WIDTHS)
    if kind == "node":
        widths |= {"hybrid": 9 if full_hybrid else 4, "neighbours": 1 if only_hydrogen else 4}
    return sum(w for g, w in widths.items() if g not in drop and (g not in OPTIONAL or g in add))


def assemble_features(df: DataFrame, groups: Mapping[str, Column], drop=(), add=(), name: str = "features") -> DataFrame:
    """Concatenates the switched-on groups, each an array or number, into one array<double>."""
    on = [g for g in groups if g not in drop and (g not in OPTIONAL or g in add)]
    return df.withColumn(name, F.concat(*[groups[g].cast("array<double>") for g in on]) if on else F.array().cast("array<double>"))


def flag_out_of_range(df: DataFrame, column: str, limit: float = 50.0) -> DataFrame:
    """Suspicious is true where some value of an array column exceeds the limit."""
    return df.withColumn("suspicious", F.coalesce(F.exists(column, lambda x: x > limit), F.lit(False)))


