"""Graph, reaction and text views of the driver's tables, and the same views as SQL.

Every view covers the whole table. Graph = order, node = line of an order in the order of its full key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxnframe.operators import edges as E
from rxnframe.session import tune

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
ELEMENTS = ["H", "C", "N", "O", "C", "H", "S", "F"]
# Symbol, number, mass, covalent radius, Pauling electronegativity, valence electrons, octet, most bonds.
DIMENSION = [
    ("H", 1, 1.00794, 0.39, 2.20, 1, 2, 2),
    ("C", 6, 12.011, 0.757, 2.55, 4, 8, 4),
    ("N", 7, 14.00674, 0.700, 3.04, 5, 8, 4),
    ("O", 8, 15.9994, 0.658, 3.44, 6, 8, 2),
    ("S", 16, 32.066, 1.064, 2.58, 6, 8, None),
    ("F", 9, 18.9984032, 0.668, 3.98, 7, 8, 1),
    ("P", 15, 30.973762, 1.117, 2.19, 5, 8, None),
    ("Cl", 17, 35.4527, 1.044, 3.16, 7, 8, 1),
]
DIM_SCHEMA = "element string, number int, mass double, radius double, electronegativity double, valence int, octet int, most int"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSION, DIM_SCHEMA)


def nodes(spark: SparkSession, sf_dir: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """ties: columns that order lines which are alike in all of ORDER."""
    li = read(spark, sf_dir, "lineitem").select(*dict.fromkeys(["l_orderkey", *ORDER, "l_discount", "l_tax"]))
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy(*dict.fromkeys([*ORDER, *ties]))).cast("long")
    kind = F.element_at(F.array(*map(F.lit, ELEMENTS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    return li.withColumnRenamed("l_orderkey", "graph_id").withColumn("node", number).withColumn("element", kind).withColumn("charge", (F.col("l_suppkey") % 3 - 1).cast("long"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("graph_id", "node", "element", "charge")


def shared_nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Nodes with these columns and those that bonds need, for queries that read them many times: as numbers depend on all the columns, each reading needs them all, and Spark shuffles the lines once for all readings."""
    need = dict.fromkeys(["graph_id", "node", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", *columns])
    return nodes(spark, sf_dir, tuple(c for c in columns if c.startswith("l_"))).select(*need)


def bonds(spark: SparkSession, sf_dir: str, side: str, n: DataFrame | None = None) -> DataFrame:
    """side r or p; u < v. n: nodes as from shared_nodes."""
    n = nodes(spark, sf_dir) if n is None else n
    flags, order, chord = (("A", "R"), "l_linenumber", (0,)) if side == "r" else (("A", "N"), "l_partkey", (0, 1))
    chain = F.when((F.col("node") >= 2) & F.col("l_returnflag").isin(*flags), F.struct((F.col("node") - 1).alias("u"), F.col("node").alias("v"), (1 + F.col(order) % 3).cast("long").alias("ord")))
    jump = F.when((F.col("node") >= 3) & (F.col("l_suppkey") % 4).isin(*chord), F.struct((F.col("node") - 2).alias("u"), F.col("node").alias("v"), F.lit(1).cast("long").alias("ord")))
    return n.select("graph_id", F.explode(F.array_compact(F.array(chain, jump))).alias("b")).select("graph_id", "b.*")


def directed(spark: SparkSession, sf_dir: str, side: str, n: DataFrame | None = None) -> DataFrame:
    return E.directed(bonds(spark, sf_dir, side, n))


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edge_union(bonds(spark, sf_dir, "r"), bonds(spark, sf_dir, "p"))


def coords(spark: SparkSession, sf_dir: str, n: DataFrame | None = None) -> DataFrame:
    """Frame 0 and frame 1 (x moved by the discount) of every graph. n: nodes as from shared_nodes."""
    n = (nodes(spark, sf_dir) if n is None else n).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    x = F.col("node").cast("double") + F.when(F.col("frame") == 1, F.col("l_discount").cast("double")).otherwise(0.0)
    return n.select("graph_id", "frame", "node", "element", F.round(x, 6).alias("x"), (F.col("l_suppkey") % 5).cast("double").alias("y"), F.round((F.col("l_partkey") % 7) / 10.0, 6).alias("z"))


def reactions(spark: SparkSession, sf_dir: str, token: str = "plain") -> DataFrame:
    """graph_id and smiles `R>>P` of graphs with both sides; confidence. token: plain, md5, or pairs (two nodes to a fragment)."""
    n = nodes(spark, sf_dir)
    sign = F.when(F.col("charge") > 0, "+").when(F.col("charge") < 0, "-").otherwise("")
    text = F.md5(F.col("l_partkey").cast("string")) if token == "md5" else F.concat("element", sign)

    def joined(test, sep="."):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("node", text.alias("t"))))), lambda x: x.t), sep)

    if token == "pairs":
        n = n.withColumn("pair", F.floor((F.col("node") + 1) / 2))
        two = n.groupBy("graph_id", "pair").agg(joined(F.lit(True), "").alias("t"))
        side = lambda odd: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pair") % 2 == odd, F.struct("pair", "t")))), lambda x: x.t), ".")
        out = two.groupBy("graph_id").agg(side(1).alias("r"), side(0).alias("p"))
    else:
        out = n.groupBy("graph_id").agg(joined(F.col("node") % 2 == 1).alias("r"), joined(F.col("node") % 2 == 0).alias("p"), F.max(F.when(F.col("node") == 1, F.col("l_discount").cast("double") * 10)).alias("confidence"))
    return out.filter("r <> '' and p <> ''").withColumn("smiles", F.concat("r", F.lit(">>"), "p")).drop("r", "p")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, key (sorted element symbols), DE, DH, and energies of nodes 1 to 3."""
    price = F.col("l_extendedprice").cast("double")
    pick = lambda k: F.max(F.when(F.col("node") == k, price))
    return nodes(spark, sf_dir).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list("element")), "").alias("key"), F.max(price).alias("DE"), F.sum(F.col("l_quantity").cast("double")).alias("DH"),
        pick(1).alias("g_r"), pick(2).alias("g_ts"), pick(3).alias("g_p"),
    )


_CASE = "case l_partkey % 8 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ELEMENTS)) + " end"
_SIGN = "case when charge > 0 then '+' when charge < 0 then '-' else '' end"
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "n": ((), f"select l_orderkey as graph_id, row_number() over (partition by l_orderkey order by {', '.join(ORDER)}) as node, {_CASE} as element, (l_suppkey % 3 - 1)::bigint as charge, * exclude (l_orderkey) from lineitem"),
    "rb": (("n",), "select graph_id, node - 1 as u, node as v, (1 + l_linenumber % 3)::bigint as ord from n where node >= 2 and l_returnflag in ('A', 'R') union all select graph_id, node - 2, node, 1 from n where node >= 3 and l_suppkey % 4 = 0"),
    "pb": (("n",), "select graph_id, node - 1 as u, node as v, (1 + l_partkey % 3)::bigint as ord from n where node >= 2 and l_returnflag in ('A', 'N') union all select graph_id, node - 2, node, 1 from n where node >= 3 and l_suppkey % 4 in (0, 1)"),
    "rd": (("rb",), "select graph_id, u, v, ord from rb union all select graph_id, v, u, ord from rb"),
    "pd": (("pb",), "select graph_id, u, v, ord from pb union all select graph_id, v, u, ord from pb"),
    "eu": (("rb", "pb"), "select graph_id, u, v, coalesce(r.ord, 0) as r_order, coalesce(p.ord, 0) as p_order from rb r full join pb p using (graph_id, u, v)"),
    "dim": ((), "select * from (values " + ", ".join("('%s', %d, %r::double, %r::double, %r::double, %d, %d, %s)" % (*d[:7], d[7] or "null") for d in DIMENSION) + ") t(element, number, mass, radius, electronegativity, valence, octet, most)"),
    "co": (("n",), "select graph_id, f.frame, node, element, round(node::double + case when frame = 1 then l_discount::double else 0 end, 6) as x, (l_suppkey % 5)::double as y, round((l_partkey % 7) / 10.0, 6)::double as z from n, (values (0), (1)) f(frame)"),
    "rx": (("n",), f"select graph_id, r || '>>' || p as smiles, confidence from (select graph_id, string_agg(element || {_SIGN}, '.' order by node) filter (where node % 2 = 1) as r, string_agg(element || {_SIGN}, '.' order by node) filter (where node % 2 = 0) as p, max(case when node = 1 then l_discount::double * 10 end) as confidence from n group by graph_id) where r <> '' and p <> ''"),
    "rm": (("n",), "select graph_id, string_agg(md5(l_partkey::varchar), '.' order by node) filter (where node % 2 = 1) as r, string_agg(md5(l_partkey::varchar), '.' order by node) filter (where node % 2 = 0) as p from n group by graph_id"),
    "tg": (("n",), "select graph_id, string_agg(element, '' order by element) as key, max(l_extendedprice::double) as DE, sum(l_quantity::double) as DH, max(case when node = 1 then l_extendedprice::double end) as g_r, max(case when node = 2 then l_extendedprice::double end) as g_ts, max(case when node = 3 then l_extendedprice::double end) as g_p from n group by graph_id"),
}


#: Views that several others read: computed once in a query.
SHARED = ("n", "rb", "pb", "co")


def cte(*names: str, recursive: bool = False, **more: str) -> str:
    """`with` clause of the named views, what they need, and further ones given as SQL."""
    order: dict[str, str] = {}

    def add(name: str) -> None:
        for need in PARTS[name][0]:
            add(need)
        order.setdefault(name, PARTS[name][1])

    for name in names:
        add(name)
    return ("with recursive " if recursive else "with ") + ", ".join(f"{k} as {'materialized ' * (k in SHARED)}({v})" for k, v in (order | more).items()) + " "
