"""Queries over atoms and their neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxnframe.functions import columns as K
from rxnframe.operators import edges as E
from rxnframe.operators import nodes as N
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte
from rxnframe.plans.registry import query

_NB = "select d.graph_id, d.u as node, count(*) filter (where n.element = 'H') as n_H, count(*) filter (where n.element = 'C') as n_C, count(*) filter (where n.element = 'N') as n_N, count(*) filter (where n.element = 'O') as n_O from rd d join n on d.graph_id = n.graph_id and d.v = n.node group by all"
_COALESCE = "coalesce(n_H, 0) as n_H, coalesce(n_C, 0) as n_C, coalesce(n_N, 0) as n_N, coalesce(n_O, 0) as n_O"


@query("c4_neighbour_counts", cte("rd", nb=_NB) + f"select n.graph_id, n.node, {_COALESCE} from n left join nb using (graph_id, node)")
def c4(spark, sf):
    return N.neighbour_counts(X.directed(spark, sf, "r"), X.atoms(spark, sf))


@query("g3_order_atoms", cte("n") + "select graph_id, map_no, row_number() over (partition by graph_id order by map_no)::int as node from (select graph_id, node * 7 % 17 + 17 * node as map_no from n)")
def g3(spark, sf):
    a = X.atoms(spark, sf).select("graph_id", (F.col("node") * 7 % 17 + 17 * F.col("node")).alias("map_no"))
    return N.order_atoms(a, "map_no")


_SIDES = dict(a="select graph_id, node, element from n where l_quantity::double < 45", b="select graph_id, node, case when l_tax::double > 0.07 then 'O' else element end as element from n where l_quantity::double < 48")


@query("b9_check_balance", cte("n", **_SIDES) + "select graph_id, bool_and(a.element is not distinct from b.element) as balanced from a full join b using (graph_id, node) group by graph_id")
def b9(spark, sf):
    n, q = X.nodes(spark, sf), F.col("l_quantity").cast("double")
    left = n.filter(q < 45).select("graph_id", "node", "element")
    right = n.filter(q < 48).select("graph_id", "node", F.when(F.col("l_tax").cast("double") > 0.07, "O").otherwise(F.col("element")).alias("element"))
    return N.check_balance(left, right)


@query("b10_check_vocabulary", cte("n") + "select graph_id, node, element from n where element not in ('H', 'C', 'N', 'O')")
def b10(spark, sf):
    return N.check_vocabulary(X.atoms(spark, sf), X.elements(spark).filter("number <= 8")).select("graph_id", "node", "element")


@query("b11_flag_out_of_range", cte("n") + "select graph_id, node, l_quantity::double > 45 or l_linenumber * 10 > 45 as suspicious from n")
def b11(spark, sf):
    n = X.nodes(spark, sf).withColumn("atom_f", F.array(F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 10).cast("double")))
    return N.flag_out_of_range(n, "atom_f", 45.0).select("graph_id", "node", "suspicious")


@query("b18_one_hot", cte("n") + "select graph_id, node, (element = 'C')::int || ',' || (element = 'N')::int || ',' || (element = 'O')::int as plain, case when element in ('C', 'N') then (element = 'C')::int || ',' || (element = 'N')::int || ',0' else '0,0,1' end as defaulted from n")
def b18(spark, sf):
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return X.atoms(spark, sf).select("graph_id", "node", text(K.one_hot("element", ["C", "N", "O"])).alias("plain"), text(F.concat(K.one_hot("element", ["C", "N"]), F.array(F.lit(0)))).alias("_x"), "element").withColumn(
        "defaulted", F.when(F.col("element").isin("C", "N"), F.col("_x")).otherwise(text(K.one_hot("element", ["C", "N", "?"], [0, 0, 1])))
    ).drop("_x", "element")


@query("b19_element_features", cte("n", "dim") + "select graph_id, node, element, number, mass from n left join dim using (element)")
def b19(spark, sf):
    return N.element_features(X.atoms(spark, sf), X.elements(spark)).select("graph_id", "node", "element", "number", "mass")




@query("b20_assemble_features", cte("rd", "dim", nb=_NB) + f"select n.graph_id, n.node, d.number || ',' || floor(d.mass)::int || ',' || coalesce(n_H, 0) || ',' || coalesce(n_C, 0) || ',' || coalesce(n_N, 0) || ',' || coalesce(n_O, 0) || ',' || charge || ',' || case when element in ('C', 'N') then '1,0,0' else '0,0,1' end as features, d.number || ',' || floor(d.mass)::int || ',' || charge as ablated, 10::bigint as width from n join dim d using (element) left join nb using (graph_id, node)")
def b20(spark, sf):
    a = N.element_features(X.atoms(spark, sf), X.elements(spark))
    a = a.join(N.neighbour_counts(X.directed(spark, sf, "r"), X.atoms(spark, sf)), ["graph_id", "node"])
    groups = {"element": F.array("number", "mass"), "neighbours": F.array("n_H", "n_C", "n_N", "n_O"), "charge": F.array("charge"), "chiral": K.one_hot(F.when(F.col("element").isin("C", "N"), 1).otherwise(3), [1, 2, 3])}
    out = N.assemble_features(a, groups)
    out = N.assemble_features(out, groups, drop=("neighbours", "chiral"), name="ablated")
    text = lambda c: F.array_join(F.col(c).cast("array<int>").cast("array<string>"), ",")
    return out.select("graph_id", "node", text("features").alias("features"), text("ablated").alias("ablated"), F.size("features").cast("long").alias("width"))


@query("b21_bond_polarity", cte("rb", "dim", e="select graph_id, node, coalesce(electronegativity, 0.0) as en from n left join (select * from dim where element <> 'F') using (element)") + "select rb.graph_id, rb.u, rb.v, round(abs(a.en - b.en), 6)::double as polarity from rb join e a on rb.graph_id = a.graph_id and rb.u = a.node join e b on rb.graph_id = b.graph_id and rb.v = b.node")
def b21(spark, sf):
    out = N.bond_polarity(X.bonds(spark, sf, "r"), X.atoms(spark, sf), X.elements(spark).filter("element <> 'F'"))
    return out.select("graph_id", "u", "v", F.round("polarity", 6).alias("polarity"))


@query("e8_adjacency", cte("rd") + "select graph_id, u as node, string_agg(distinct v, ',' order by v) as neighbours, count(distinct v) as degree from rd group by all")
def e8(spark, sf):
    return N.adjacency(X.directed(spark, sf, "r")).select("graph_id", "node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"), "degree")


_MOTIF = cte(
    "rd", dg="select graph_id, u as node, count(*) as degree from rd group by all", k="select graph_id, node, element, coalesce(degree, 0) as degree from n left join dg using (graph_id, node)",
    s="""select d.graph_id, d.u as node, count(*) filter (where element = 'O' and degree = 1) as o_end, count(*) filter (where element = 'O') as o_any, count(*) filter (where element = 'C') as c_any,
 count(*) filter (where element = 'C' and degree = 1) as c_end, count(*) filter (where element = 'C' and degree = 2) as c_two, count(*) filter (where element in ('O', 'S') and degree = 1) as os_end,
 count(*) filter (where element in ('C', 'N')) as cn_any from rd d join k on d.graph_id = k.graph_id and d.v = k.node group by all""",
)


@query("e7_motif_flags", _MOTIF + """select graph_id, node, coalesce(element = 'N' and o_end = 2, false) as nitro, coalesce(element = 'S' and o_end = 1 and c_any = 2, false) as sulfoxide,
 coalesce(element = 'S' and o_end = 2 and c_any = 2, false) as sulfonyl, coalesce(element = 'P' and o_any = 4 and degree = 4 and o_end > 0, false) as phosphate,
 coalesce(element = 'N' and degree <= 1 and c_two = 1, false) as cyano, coalesce(element = 'N' and degree <= 1 and c_end = 1, false) as isocyano,
 coalesce(element = 'S' and o_end >= 1 and degree = 3, false) as frag_sulfoxide, coalesce(element = 'S' and o_end >= 2 and degree = 4, false) as frag_sulfonyl,
 coalesce(element = 'C' and os_end = 1 and cn_any = 1 and degree = 2, false) as frag_ethenone from k left join s using (graph_id, node)""")
def e7(spark, sf):
    return N.motif_flags(X.directed(spark, sf, "r"), X.atoms(spark, sf))


_OWN = "select graph_id, node, element, charge, l_linenumber % 4 as own from n"
_BO = "select graph_id, u as node, sum(ord)::bigint as bonded from rd group by all"
_RAD = "select a.*, case when 2 * coalesce(bonded, 0) + own < 8 then own when own % 2 = 1 and t >= 0 then 1 else 0 end::bigint as radicals from a left join bo using (graph_id, node) join (select graph_id, sum(charge) as t from n group by graph_id) using (graph_id)"


def _radicals(spark, sf):
    own = X.nodes(spark, sf).select("graph_id", "node", "element", "charge", (F.col("l_linenumber") % 4).alias("own"))
    return N.radicals(X.directed(spark, sf, "r"), own)


@query("e11_lone_pairs", cte("rd", a=_OWN, bo=_BO, r=_RAD) + "select graph_id, node, radicals, (case element when 'H' then 1 when 'P' then 10 when 'S' then 12 else 8 end - coalesce(bonded, 0) - radicals)::bigint as lone_pairs from r left join bo using (graph_id, node)")
def e11(spark, sf):
    out = N.lone_pairs(X.directed(spark, sf, "r"), _radicals(spark, sf))
    return out.select("graph_id", "node", F.col("radicals").cast("long").alias("radicals"), F.col("lone_pairs").cast("long").alias("lone_pairs"))


@query("b8_radical_flags", cte("rd", a=_OWN, bo=_BO, r=_RAD) + "select graph_id, sum(coalesce(case when node <= 9 then radicals end, 1))::bigint as n_radicals, n_radicals > 0 as is_radical, n_radicals = 2 as is_biradical from r group by graph_id")
def b8(spark, sf):
    known = _radicals(spark, sf).withColumn("radicals", F.when(F.col("node") <= 9, F.col("radicals")).cast("long"))
    return N.radical_flags(known)


@query("c9_hbond_flags", cte("rd", nb=_NB) + "select n.graph_id, n.node, element in ('N', 'O', 'F') as acceptor, element in ('N', 'O', 'F') and coalesce(n_H, 0) > 0 as donor from n left join nb using (graph_id, node)")
def c9(spark, sf):
    return N.hbond_flags(X.directed(spark, sf, "r"), X.atoms(spark, sf))


@query("d20_composition", cte("n") + "select graph_id, count(*) filter (where element <> 'H') as n_heavy, count(*) filter (where element = 'C') as n_C, count(*) filter (where element = 'N') as n_N, count(*) filter (where element = 'O') as n_O, count(*) filter (where element = 'H') as n_H from n group by graph_id")
def d20(spark, sf):
    return N.composition(X.atoms(spark, sf))


_PAIRS = ["CC", "CN", "CO", "CH", "NN", "NO", "NH", "OO", "OH", "HH"]
PAIR_SQL = ", ".join(f"count(*) filter (where (a.element = '{p[0]}' and b.element = '{p[1]}') or (a.element = '{p[1]}' and b.element = '{p[0]}')) as {p}" for p in _PAIRS)


@query("d21_bond_pair_counts", cte("eu") + f"select e.graph_id, {PAIR_SQL}, not bool_and(a.element in ('C', 'N', 'O', 'H') and b.element in ('C', 'N', 'O', 'H')) as rejected from (select * from eu where (r_order = 0) <> (p_order = 0)) e join n a on e.graph_id = a.graph_id and e.u = a.node join n b on e.graph_id = b.graph_id and e.v = b.node group by e.graph_id")
def d21(spark, sf):
    changes = E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p"))
    return N.bond_pair_counts(changes, X.atoms(spark, sf))
