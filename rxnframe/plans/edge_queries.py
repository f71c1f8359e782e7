"""Queries over bond tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxnframe.operators import edges as E
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte
from rxnframe.plans.registry import query

_CLASSES = """select *, case when r_order = p_order then 'T1' when r_order = 0 then 'T4' when p_order = 0 then 'T3' when r_order < p_order then 'T2' else 'T5' end as r_class,
 case when r_order = p_order then 'T1' when p_order = 0 then 'T4' when r_order = 0 then 'T3' when r_order < p_order then 'T2' else 'T5' end as p_class from eu"""


@query("c1_edge_union", cte("eu") + "select graph_id, u, v, r_order, p_order from eu")
def c1(spark, sf):
    return X.edge_table(spark, sf)


@query("c2_classify_bond_change", cte("eu", ec=_CLASSES) + "select graph_id, u, v, r_class, p_class from ec")
def c2(spark, sf):
    return E.classify_bond_change(X.edge_table(spark, sf)).select("graph_id", "u", "v", "r_class", "p_class")


@query("c2_bond_change_profile", cte("eu", ec=_CLASSES) + "select r_class, p_class, count(*) as n_bonds, count(distinct graph_id) as n_graphs from ec group by all")
def c2_profile(spark, sf):
    return E.classify_bond_change(X.edge_table(spark, sf)).groupBy("r_class", "p_class").agg(F.count("*").alias("n_bonds"), F.countDistinct("graph_id").alias("n_graphs"))


@query("c2_other_schemes", cte("eu") + """select graph_id, u, v, case when r_order = p_order then 'T1' when r_order = 0 then 'T4' when p_order = 0 then 'T3' else 'T2' end as four,
 case when r_order = p_order then 'T0' when p_order = 0 then 'T2' else 'T1' end as three from eu""")
def c2_schemes(spark, sf):
    four = E.classify_bond_change(X.edge_table(spark, sf), "four").withColumnRenamed("r_class", "four").drop("p_class")
    return E.classify_bond_change(four, "three").select("graph_id", "u", "v", "four", F.col("r_class").alias("three"))


@query("c3_connection_changes", cte("eu") + "select graph_id, u, v, case when p_order = 0 then 'broken' else 'formed' end as change from eu where (r_order = 0) <> (p_order = 0)")
def c3(spark, sf):
    return E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p"))


def _pairs(test: str) -> str:
    return f"coalesce(string_agg(u || '-' || v, ',' order by u, v) filter (where {test}), '')"


@query("d3_reactive_summary", cte("eu") + f"""select graph_id, {_pairs('r_order <> p_order')} as changed, {_pairs('r_order = 0 and p_order > 0')} as formed, {_pairs('r_order > 0 and p_order = 0')} as broken,
 {_pairs('r_order > 0 and p_order > r_order')} as raised, {_pairs('p_order > 0 and p_order < r_order')} as lowered,
 (select coalesce(string_agg(x, ',' order by x), '') from (select distinct unnest(coalesce(flatten(list([e.u, e.v]) filter (where r_order <> p_order)), [])) as x)) as involved from eu e group by graph_id""")
def d3(spark, sf):
    out = E.reactive_summary(X.edge_table(spark, sf))
    return out.select("graph_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("changed", "formed", "broken", "raised", "lowered", "involved")])


@query("d4_bond_change_class", cte("eu") + "select graph_id, n_down, n_up, 'b' || n_down || 'f' || n_up as rxntype from (select graph_id, count(*) filter (where p_order < r_order) as n_down, count(*) filter (where p_order > r_order) as n_up from eu group by graph_id)")
def d4(spark, sf):
    return E.bond_change_class(X.edge_table(spark, sf))


@query("d26_profile", cte("eu", b="select graph_id, 'b' || count(*) filter (where p_order < r_order) || 'f' || count(*) filter (where p_order > r_order) as rxntype from eu group by graph_id") + "select rxntype, count(*) as n_rows, count(distinct graph_id) as n_graphs from b group by rxntype")
def d26(spark, sf):
    return E.profile(E.bond_change_class(X.edge_table(spark, sf)), ["rxntype"])


@query("d2_group_by_change", cte("rb", "pb", c="select graph_id, '-' || u || '~' || v as m from rb anti join pb using (graph_id, u, v) union all select graph_id, '+' || u || '~' || v from pb anti join rb using (graph_id, u, v)", k="select graph_id, string_agg(m, ' ' order by m) as change_key from c group by graph_id") + "select change_key, string_agg(graph_id, ',' order by graph_id) as ids, count(*) as n from k group by change_key")
def d2_change(spark, sf):
    out = E.group_by_change(E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p")))
    return out.select("change_key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query("c7_compare_endpoints", cte("rd", "pd", s="select graph_id, u, v, 1 as w from rd union all select graph_id, u, v, -1 from pd", d="select graph_id, sum(d)::bigint as difference from (select graph_id, u, v, abs(sum(w)) as d from s group by all) group by graph_id") + "select graph_id, difference, case difference when 0 then 'intended' when 2 then 'intended (1 bond diff)' else 'unintended' end as verdict from d")
def c7(spark, sf):
    return E.compare_endpoints(X.directed(spark, sf, "r"), X.directed(spark, sf, "p"))
