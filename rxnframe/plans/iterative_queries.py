"""Queries over distances, fragments, rings, hashes and structure scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxnframe.operators import edges as E
from rxnframe.operators import graphs as G
from rxnframe.operators import nodes as N
from rxnframe.operators import selection as S
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte
from rxnframe.plans.node_queries import PAIR_SQL
from rxnframe.plans.registry import query

_WALK = "select graph_id, node as source, node, 0 as hops from n union select w.graph_id, w.source, d.v, w.hops + 1 from w join rd d on w.graph_id = d.graph_id and w.node = d.u where w.hops < 40"
_DIST = "select graph_id, source, node, min(hops) as hops from w group by all"
_SEEDS = "select distinct graph_id, unnest([u, v]) as node from eu where (r_order = 0) <> (p_order = 0)"


def _seeds(spark, sf):
    changed = E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p"))
    return changed.select("graph_id", F.explode(F.array("u", "v")).alias("node")).distinct()


@query("e1_graph_distances", cte("rd", recursive=True, w=_WALK, di=_DIST) + "select a.graph_id, a.node as u, b.node as v, coalesce(di.hops, 100)::int as hops from n a join n b using (graph_id) left join di on a.graph_id = di.graph_id and a.node = di.source and b.node = di.node")
def e1(spark, sf):
    return G.graph_distances(X.directed(spark, sf, "r"), X.atoms(spark, sf))


@query("e2_distance_to_set", cte("rd", "eu", recursive=True, s=_SEEDS, w="select graph_id, node, 0 as hops from s union select w.graph_id, d.v, w.hops + 1 from w join rd d on w.graph_id = d.graph_id and w.node = d.u where w.hops < 40", di="select graph_id, node, min(hops) as hops from w group by all") + "select graph_id, node, coalesce(hops, 100)::int as hops from n left join di using (graph_id, node)")
def e2(spark, sf):
    return G.distance_to_set(X.directed(spark, sf, "r"), X.atoms(spark, sf), _seeds(spark, sf))


_REACH = "select graph_id, node as source, node from n union select w.graph_id, w.source, d.v from w join rd d on w.graph_id = d.graph_id and w.node = d.u"
_PART = "select graph_id, node, min(source) as component from w group by all"


@query("e3_components", cte("rd", recursive=True, w=_REACH) + _PART)
def e3(spark, sf):
    return G.components(X.directed(spark, sf, "r"), X.atoms(spark, sf))


_RING_SIZE = 20
_NEAR = "select graph_id, u as v, list(v) as near from rd group by all"
_PATHS = f"""select graph_id, [u, v] as path, false as closed from rd where u < v union all
 select p.graph_id, list_append(p.path, d.v), list_contains(a.near, p.path[1]) from p join rd d on p.graph_id = d.graph_id and p.path[-1] = d.u join near a on d.graph_id = a.graph_id and d.v = a.v
 where not p.closed and len(p.path) < {_RING_SIZE} and d.v > p.path[1] and not list_contains(p.path, d.v)
 and (len(list_intersect(a.near, p.path)) = 1 or (list_contains(a.near, p.path[1]) and len(list_intersect(a.near, p.path)) = 2))"""
_RINGS = "select graph_id, path as ring, len(path) as size, row_number() over (partition by graph_id order by len(path), path) as ring_id from p where closed and len(path) >= 3 and path[2] < path[-1]"
_R = dict(near=_NEAR, p=_PATHS, rings=_RINGS)


def _rings(spark, sf):
    return G.find_rings(X.directed(spark, sf, "r"))


@query("e4_find_rings", cte("rd", recursive=True, **_R) + "select graph_id, array_to_string(ring, '-') as ring, size::int as size from rings")
def e4(spark, sf):
    return _rings(spark, sf).select("graph_id", F.array_join(F.col("ring").cast("array<string>"), "-").alias("ring"), "size")


@query("e4_ring_flags", cte("rd", recursive=True, **_R, a="select distinct graph_id, unnest(ring) as node from rings") + "select graph_id, node, a.node is not null as in_ring from n left join a using (graph_id, node)")
def e4_flags(spark, sf):
    return G.ring_flags(_rings(spark, sf), X.atoms(spark, sf))


_WITHIN = "select distinct graph_id, u, unnest(ring) as v from (select graph_id, ring, unnest(ring) as u from rings)"


@query("e4_ring_bond_flags", cte("rd", "eu", recursive=True, **_R, b=_WITHIN) + "select graph_id, u, v, b.u is not null as in_ring from eu left join b using (graph_id, u, v)")
def e4_bonds(spark, sf):
    return G.ring_bond_flags(_rings(spark, sf), X.edge_table(spark, sf))


_AT = "select graph_id, ring_id, size, unnest(range(1, size + 1)) as i, unnest(ring) as node, ring from rings"
_STEP = "select graph_id, ring_id, size, node, ring[case when i = 1 then size else i - 1 end] as before, ring[case when i = size then 1 else i + 1 end] as after from at_"


@query("f4_ring_neighbours", cte("rd", recursive=True, **_R, at_=_AT, st=_STEP) + "select graph_id, ring_id::int as ring_id, node, before, after from st")
def f4(spark, sf):
    return G.ring_neighbours(_rings(spark, sf)).select("graph_id", "ring_id", "node", "before", "after")


_JUNCTION = dict(
    at_=_AT, st=_STEP, sh="select a.graph_id, a.ring_id, b.ring_id as other, list(a.node) as atoms from st a join st b on a.graph_id = b.graph_id and a.node = b.node and a.ring_id < b.ring_id group by all",
    wb="select graph_id, ring_id, least(node, after) as u, greatest(node, after) as v from st",
    cb="select a.graph_id, a.ring_id, b.ring_id as other, a.u, a.v, count(*) over (partition by a.graph_id, a.ring_id, b.ring_id) as k from wb a join wb b on a.graph_id = b.graph_id and a.u = b.u and a.v = b.v and a.ring_id < b.ring_id",
    en="select graph_id, ring_id, other, node from (select graph_id, ring_id, other, unnest([u, v]) as node from cb where k > 1) group by all having count(*) = 1",
)


@query("e5_ring_junctions", cte("rd", recursive=True, **_R, **_JUNCTION) + "select distinct graph_id, atoms[1] as node, 'spiro' as kind from sh where len(atoms) = 1 union select distinct graph_id, node, 'bridgehead' from en")
def e5(spark, sf):
    return G.ring_junctions(_rings(spark, sf))


_HASH = dict(
    ms="select graph_id, node, mass from n join dim using (element)",
    w="select graph_id, node, [node] as path, mass as m, 0 as depth from ms union all select w.graph_id, w.node, list_append(w.path, d.v), ms.mass, w.depth + 1 from w join rd d on w.graph_id = d.graph_id and w.path[-1] = d.u join ms on d.graph_id = ms.graph_id and d.v = ms.node where w.depth < 10 and not list_contains(w.path, d.v)",
    hs="select w.graph_id, w.node, round(100.0 * coalesce(k, 0) + sum(m * 0.1 * pow(0.1::double, depth)), 6) as hash from w left join (select graph_id, u as node, count(distinct v) as k from rd group by all) g using (graph_id, node) group by w.graph_id, w.node, k",
)


def _hashes(spark, sf):
    atoms = N.element_features(X.atoms(spark, sf), X.elements(spark))
    return G.atom_hash(X.directed(spark, sf, "r"), atoms)


@query("e6_atom_hash", cte("rd", "dim", recursive=True, **_HASH) + "select graph_id, node, hash from hs")
def e6(spark, sf):
    return _hashes(spark, sf)


@query("e6_canonical_order", cte("rd", "dim", recursive=True, **_HASH, w2=_REACH.replace("from w join", "from w2 w join"), pt=_PART.replace("from w ", "from w2 "), t="select *, max(hash) over (partition by graph_id, component) as top from hs join pt using (graph_id, node)") + "select graph_id, node, hash, row_number() over (partition by graph_id order by top desc, component desc, hash desc, node desc)::int as place from t")
def e6_order(spark, sf):
    return G.canonical_order(_hashes(spark, sf), G.components(X.directed(spark, sf, "r"), X.atoms(spark, sf)))


_BOTH = "select 'r' as structure, * from rd union all select 'p', * from pd"
_OWN = "select graph_id, node, element, charge, l_linenumber % 4 as own from n"
_EC = "select s.structure, o.*, octet, valence, electronegativity as en, (own + 2 * coalesce(b, 0)) as e, coalesce(b, 0) as b from own o cross join (values ('r'), ('p')) s(structure) join dim using (element) left join (select structure, graph_id, u as node, sum(ord)::bigint as b from both_ group by all) using (structure, graph_id, node)"


def _own(spark, sf):
    return X.nodes(spark, sf).select("graph_id", "node", "element", "charge", (F.col("l_linenumber") % 4).cast("long").alias("own"))


def _counts(spark, sf):
    """Electron counts of the two structures of each graph."""
    both = X.directed(spark, sf, "r").withColumn("structure", F.lit("r")).unionByName(X.directed(spark, sf, "p").withColumn("structure", F.lit("p")))
    atoms = _own(spark, sf).withColumn("structure", F.explode(F.array(F.lit("r"), F.lit("p"))))
    return G.electron_counts(both, atoms, X.elements(spark), ("structure", "graph_id"))


@query("e9_electron_counts", cte("rd", "pd", "dim", both_=_BOTH, own=_OWN, ec=_EC) + "select structure, graph_id, node, e::bigint as electrons, least(e - octet, 0)::bigint as deficiency, greatest(e - octet, 0)::bigint as excess, (valence - own - b)::bigint as formal from ec")
def e9(spark, sf):
    return _counts(spark, sf).select("structure", "graph_id", "node", *[F.col(c).cast("long").alias(c) for c in ("electrons", "deficiency", "excess", "formal")])


_AROMA = dict(
    at_=_AT, st=_STEP,
    ar="""select graph_id, ring_id, size, case when not bool_and(able) or sum(pi) % 2 <> 0 then 0 when sum(pi) % 4 = 0 then -1 else 1 end as aromatic from (
 select st.graph_id, st.ring_id, st.size, own > 0 or b.ord > 1 or a.ord > 1 or own + t.b < 4 as able, case when b.ord >= 2 then 0 when a.ord >= 2 then 2 when own = 1 then 1 when own >= 2 then 2 else 0 end as pi
 from st join own o using (graph_id, node) join rd b on st.graph_id = b.graph_id and st.node = b.u and st.before = b.v join rd a on st.graph_id = a.graph_id and st.node = a.u and st.after = a.v
 join (select graph_id, u as node, sum(ord) as b from rd group by all) t on st.graph_id = t.graph_id and st.node = t.node) group by all""",
)


@query("e9_ring_aromaticity", cte("rd", recursive=True, own=_OWN, **_R, **_AROMA) + "select graph_id, ring_id::int as ring_id, size::int as size, aromatic from ar")
def e9_rings(spark, sf):
    return G.ring_aromaticity(_rings(spark, sf), X.directed(spark, sf, "r"), _own(spark, sf))


_SCORE = "select structure, graph_id, -sum(least(e - octet, 0) * en) + 0.1 * sum(greatest(e - octet, 0)) + 0.1 * sum(case when valence - own - b > 0 then (valence - own - b) * en else 0.9 * (valence - own - b) * en end) as raw, sum(charge) as q, min(en) as low, max(en) as high from ec group by all"
_FINAL = "select structure, graph_id, raw::double - 2 * coalesce(s, 0) - case when q > 0 then low else high end * q * 0.1 as score from sc left join (select 'r' as structure, graph_id, sum(aromatic * 12 / size::double) as s from ar group by graph_id) using (structure, graph_id)"
_SC = cte("rd", "pd", "dim", recursive=True, both_=_BOTH, own=_OWN, ec=_EC, **_R, **_AROMA, sc=_SCORE, fs=_FINAL)


def _scores(spark, sf):
    aromatic = G.ring_aromaticity(_rings(spark, sf), X.directed(spark, sf, "r"), _own(spark, sf)).withColumn("structure", F.lit("r"))
    return G.structure_score(_counts(spark, sf), aromatic, ("structure", "graph_id"), "charge")


@query("e9_structure_score", _SC + "select structure, graph_id, round(score, 6) as score from fs")
def e9_score(spark, sf):
    return _scores(spark, sf).select("structure", "graph_id", F.round("score", 6).alias("score"))


@query("e9_best_structure", _SC + "select graph_id, arg_min(structure, (round(score, 6), structure)) as structure, min(round(score, 6)) as score from fs group by graph_id")
def e9_best(spark, sf):
    x = _scores(spark, sf).withColumn("score", F.round("score", 6))
    return S.first_per_key(x, ["graph_id"], ["score", "structure"])


@query("b15_filter_score", _SC + "select structure, graph_id, round(score, 6) as score from fs where round(score, 6) <= 5")
def b15(spark, sf):
    return S.filter_score(_scores(spark, sf).withColumn("score", F.round("score", 6)).select("structure", "graph_id", "score"))


@query("e10_rotatable_bonds", cte("rd", recursive=True, **_R, inr=_WITHIN, ends="select graph_id, u as node, count(*) as degree, max(ord) as top from rd group by all") + "select rb.graph_id, rb.u, rb.v from rb join ends a on rb.graph_id = a.graph_id and rb.u = a.node join ends b on rb.graph_id = b.graph_id and rb.v = b.node where ord = 1 and a.degree > 1 and b.degree > 1 and a.top < 3 and b.top < 3 and not exists (select 1 from inr where inr.graph_id = rb.graph_id and inr.u = rb.u and inr.v = rb.v)")
def e10(spark, sf):
    edges = X.bonds(spark, sf, "r")
    on_ring = G.ring_bond_flags(_rings(spark, sf), edges).filter("in_ring")
    return N.rotatable_bonds(edges, X.directed(spark, sf, "r"), on_ring)


_SHELL = ", ".join(f"count(*) filter (where hops = {h} and element = '{e}') as s{h}_{e}" for h in range(3) for e in "CNOH")
_SH = dict(s=_SEEDS, w="select graph_id, node as source, node, 0 as hops from s union select w.graph_id, w.source, d.v, w.hops + 1 from w join rd d on w.graph_id = d.graph_id and w.node = d.u where w.hops < 2", di=_DIST, sh=f"select graph_id, {_SHELL} from di join n using (graph_id, node) group by graph_id")


@query("d22_shell_counts", cte("rd", "eu", recursive=True, **_SH) + "select * from sh")
def d22(spark, sf):
    return G.shell_counts(X.directed(spark, sf, "r"), X.atoms(spark, sf), _seeds(spark, sf))


_DESC = "n_heavy, n_C, n_N, n_O, n_H, n_down, n_up, CC, CN, CO, CH, NN, NO, NH, OO, OH, HH, " + ", ".join(f"s{h}_{e}" for h in range(3) for e in "CNOH")


_BETWEEN = dict(
    ch="select graph_id, u, v from eu where (r_order = 0) <> (p_order = 0)", w3=_SH["w"].replace("from w join", "from w3 w join").replace("w.hops < 2", "w.hops < 40"), d3=_DIST.replace("from w ", "from w3 "),
    en="select graph_id, u, v, unnest([u, v]) as node from ch", pq="select a.graph_id, a.u, a.v, b.u as bu, b.v as bv, coalesce(min(hops), 100) as d from en a join en b on a.graph_id = b.graph_id and (a.u, a.v) < (b.u, b.v) left join d3 on d3.graph_id = a.graph_id and d3.source = a.node and d3.node = b.node group by all",
    bd="select c.graph_id, coalesce(min(d), 0) as nearest, coalesce(max(d), 0) as farthest from (select distinct graph_id from ch) c left join pq using (graph_id) group by c.graph_id",
)


@query("d23_reaction_descriptor", cte("rd", "eu", recursive=True, **_SH, cp="select graph_id, count(*) filter (where element <> 'H') as n_heavy, count(*) filter (where element = 'C') as n_C, count(*) filter (where element = 'N') as n_N, count(*) filter (where element = 'O') as n_O, count(*) filter (where element = 'H') as n_H from n group by graph_id",
    bc="select graph_id, count(*) filter (where p_order < r_order) as n_down, count(*) filter (where p_order > r_order) as n_up from eu group by graph_id",
    bp=f"select e.graph_id, {PAIR_SQL}, not bool_and(a.element in ('C', 'N', 'O', 'H') and b.element in ('C', 'N', 'O', 'H')) as rejected from (select * from eu where (r_order = 0) <> (p_order = 0)) e join n a on e.graph_id = a.graph_id and e.u = a.node join n b on e.graph_id = b.graph_id and e.v = b.node group by e.graph_id", **_BETWEEN)
    + f"select graph_id, concat_ws(',', {_DESC}, nearest, farthest) as descriptor from cp join bc using (graph_id) join bp using (graph_id) join sh using (graph_id) join bd using (graph_id) where not rejected")
def d23(spark, sf):
    atoms, edges = X.atoms(spark, sf), X.edge_table(spark, sf)
    changed = E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p"))
    pairs = N.bond_pair_counts(changed, atoms).filter("not rejected")
    shells = G.shell_counts(X.directed(spark, sf, "r"), atoms, _seeds(spark, sf))
    out = G.reaction_descriptor([N.composition(atoms), E.bond_change_class(edges).drop("rxntype"), pairs, shells, G.bond_distances(X.directed(spark, sf, "r"), atoms, changed)])
    return out.select("graph_id", F.array_join(F.col("descriptor").cast("array<int>").cast("array<string>"), ",").alias("descriptor"))
