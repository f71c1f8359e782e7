"""Bond tables: graph_id, u, v, ord. Undirected tables hold u < v once; directed ones hold both orientations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["graph_id", "u", "v"]


def directed(bonds: DataFrame) -> DataFrame:
    """Both orientations of each bond, read once and partitioned as they were."""
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return bonds.withColumn("_way", ways).select(*[F.col(f"_way.{c}") if c in ("u", "v") else F.col(c) for c in bonds.columns])


def edge_union(bonds_r: DataFrame, bonds_p: DataFrame) -> DataFrame:
    """Bonds of either side with r_order and p_order, 0 where a side lacks the bond."""
    r = bonds_r.select(*KEY, F.col("ord").alias("r_order"))
    p = bonds_p.select(*KEY, F.col("ord").alias("p_order"))
    return r.join(p, KEY, "full_outer").fillna(0, ["r_order", "p_order"])


def classify_bond_change(edges: DataFrame, scheme: str = "wide") -> DataFrame:
    """r_class and p_class. wide: T1 same, T3/T4 lost or gained, T2 raised, T5 lowered; four: no T5; three: T0 same, T1 order change, T2 lost on the product side."""
    r, p = F.col("r_order"), F.col("p_order")
    if scheme == "three":
        kind = F.when(r == p, "T0").when(p == 0, "T2").otherwise("T1")
        return edges.withColumns({"r_class": kind, "p_class": kind})
    if scheme not in ("wide", "four"):
        raise ValueError(f"unknown scheme {scheme}")
    changed = F.when(r < p, "T2").otherwise("T5" if scheme == "wide" else "T2")

    def side(own: Column, other: Column) -> Column:
        return F.when(r == p, "T1").when(own == 0, "T4").when(other == 0, "T3").otherwise(changed)

    return edges.withColumns({"r_class": side(r, p), "p_class": side(p, r)})


def connection_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bonds of one table only: change is broken (first) or formed (second)."""
    a, b = first.select(*KEY), second.select(*KEY)
    broken = a.join(b, KEY, "left_anti").withColumn("change", F.lit("broken"))
    return broken.unionByName(b.join(a, KEY, "left_anti").withColumn("change", F.lit("formed")))


def reactive_summary(edges: DataFrame) -> DataFrame:
    """D3: changed, formed, broken, raised and lowered bonds ('u-v', sorted) and the atoms involved, per graph; broken means order 0 in the product."""
    r, p = F.col("r_order"), F.col("p_order")
    pair = F.struct("u", "v")
    kinds = {"changed": r != p, "formed": (r == 0) & (p > 0), "broken": (r > 0) & (p == 0), "raised": (r > 0) & (p > r), "lowered": (p > 0) & (p < r)}
    lists = [F.array_sort(F.collect_list(F.when(test, pair))).alias(name) for name, test in kinds.items()]
    out = edges.groupBy("graph_id").agg(*lists)
    involved = F.array_sort(F.array_distinct(F.flatten(F.transform("changed", lambda x: F.array(x.u, x.v)))))
    named = {k: F.transform(k, lambda x: F.concat_ws("-", x.u.cast("string"), x.v.cast("string"))) for k in kinds}
    return out.withColumn("involved", involved).withColumns(named)


def bond_change_class(edges: DataFrame) -> DataFrame:
    """b{n}f{m}, the numbers of bonds whose order falls and rises."""
    delta = F.col("p_order") - F.col("r_order")
    out = edges.groupBy("graph_id").agg(F.count_if(delta < 0).alias("n_down"), F.count_if(delta > 0).alias("n_up"))
    return out.withColumn("rxntype", F.concat(F.lit("b"), F.col("n_down").cast("string"), F.lit("f"), F.col("n_up").cast("string")))


def profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Graphs and rows per class."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct("graph_id").alias("n_graphs"))


def compare_endpoints(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Found, expected (graph_id, u, v, one row per bond and end, both orientations) -> difference and verdict.

    Graphs of either table count; 0 means intended, 2 intended with one bond different, anything else unintended.
    """
    signed = found.select(*KEY, F.lit(1).alias("w")).unionByName(expected.select(*KEY, F.lit(-1).alias("w")))
    diff = signed.groupBy(*KEY).agg(F.abs(F.sum("w")).alias("d")).groupBy("graph_id").agg(F.sum("d").alias("difference"))
    verdict = F.when(F.col("difference") == 0, "intended").when(F.col("difference") == 2, "intended (1 bond diff)").otherwise("unintended")
    return diff.withColumn("verdict", verdict)


def group_by_change(changes: DataFrame) -> DataFrame:
    """Graphs with the same sorted set of connection changes."""
    mark = F.concat(F.when(F.col("change") == "broken", "-").otherwise("+"), F.col("u").cast("string"), F.lit("~"), F.col("v").cast("string"))
    keys = changes.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(mark)), " ").alias("change_key"))
    return group_ids(keys, "change_key", "graph_id")


def group_ids(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Sorted ids per key, with their number."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(ids)).alias("ids"), F.count("*").alias("n"))


def grouped_rows(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Key, id and n (ids of the key) as rows, for groups of any size: counts come from an aggregate and no list is built. A key that many rows share splits in the join."""
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    return df.select(key, ids).join(n, df[key].eqNullSafe(n["_key"])).drop("_key")
