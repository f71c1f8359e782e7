"""Queries over coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rxnframe.functions import columns as K
from rxnframe.operators import edges as E
from rxnframe.operators import geometry as M
from rxnframe.operators import graphs as G
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte
from rxnframe.plans.registry import query

_PAIRS = "select a.graph_id, a.frame, a.node as u, b.node as v, a.element as eu, b.element as ev, da.radius + db.radius as rr, da.most as mu, db.most as mv, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as d from co a join co b on a.graph_id = b.graph_id and a.frame = b.frame and a.node < b.node join dim da on a.element = da.element join dim db on b.element = db.element"
_BOND = "select * from pr where d > 0 and d < rr * case when eu = 'H' and ev = 'H' then 1.5 else 1.2 end"


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("c5_perceive_bonds", cte("co", "dim", pr=_PAIRS, b=_BOND) + "select graph_id, frame, u, v, round(d, 6) as d from b")
def c5(spark, sf):
    return _round(M.perceive_bonds(X.coords(spark, sf), X.elements(spark))[0], "d")


@query("c5_rejected_frames", cte("co", "dim", pr=_PAIRS, b=_BOND, e="select graph_id, frame, u as node, mu as most from b union all select graph_id, frame, v, mv from b") + "select distinct graph_id, frame from (select graph_id, frame, node from e group by graph_id, frame, node, most having count(*) > most)")
def c5_rejects(spark, sf):
    return M.perceive_bonds(X.coords(spark, sf), X.elements(spark))[1]


@query("c8_hbond_contacts", cte("co", "rd", one="select graph_id, u, min(v) as host from rd group by all having count(*) = 1",
    h="select c.* from co c join one o on c.graph_id = o.graph_id and c.node = o.u join n on n.graph_id = c.graph_id and n.node = o.host where c.element = 'H' and n.element in ('N', 'O', 'F')",
    x="select h.graph_id, h.frame, h.node as u, c.node as v, sqrt((h.x-c.x)*(h.x-c.x) + (h.y-c.y)*(h.y-c.y) + (h.z-c.z)*(h.z-c.z)) as d from h join co c on h.graph_id = c.graph_id and h.frame = c.frame and c.element in ('N', 'O', 'F')")
    + "select graph_id, frame, u, v, round(d, 6) as d from x anti join rd using (graph_id, u, v) where d < 2.5")
def c8(spark, sf):
    return _round(M.hbond_contacts(X.coords(spark, sf), X.directed(spark, sf, "r")), "d")


_REACH = "select graph_id, node as source, node from n union select w.graph_id, w.source, d.v from w join rd d on w.graph_id = d.graph_id and w.node = d.u"


@query("c10_fragments_close", cte("co", "rd", recursive=True, w=_REACH, pt="select graph_id, node, min(source) as component from w group by all",
    o="select co.*, component from co join pt using (graph_id, node)", c="select graph_id, frame, component, avg(x) as cx, avg(y) as cy, avg(z) as cz, count(*) as size from o group by all",
    f="select graph_id, frame, component, cx, cy, cz, size, max(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) as radius from o join c using (graph_id, frame, component) group by all",
    t="select graph_id, frame, sum(size) as atoms, min(size) as least from f group by all",
    p="select a.graph_id, a.frame, sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) <= case when least < 3 then 4.0 when least < 5 then 3.0 when atoms > 12 then 1.5 else 2.0 end * (a.radius + b.radius) as near from f a join f b on a.graph_id = b.graph_id and a.frame = b.frame and a.component < b.component join t on a.graph_id = t.graph_id and a.frame = t.frame")
    + "select graph_id, frame, coalesce(near, true) as close from t left join (select graph_id, frame, bool_and(near) as near from p group by all) using (graph_id, frame)")
def c10(spark, sf):
    return M.fragments_close(X.coords(spark, sf), G.components(X.directed(spark, sf, "r"), X.atoms(spark, sf)))


@query("c11_alignment_indicators")
def c11(spark, sf):
    n = X.shared_nodes(spark, sf, "l_discount", "element")
    out = M.alignment_indicators(X.coords(spark, sf, n), X.bonds(spark, sf, "r", n), X.bonds(spark, sf, "p", n), X.elements(spark))
    return _round(out, "rmsd", "max_bond", "max_h_bond", "min_cross", "min_h_cross", "path_cross")


_DEV = "select a.graph_id, sqrt(avg(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2))) as rmsd, sqrt(sum(mass * (pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2))) / sum(mass)) as mass_rmsd from co a join co b on a.graph_id = b.graph_id and a.node = b.node and a.frame = 0 and b.frame = 1 join dim on a.element = dim.element group by a.graph_id"
_LEN = "select rb.graph_id, rb.u, rb.v, c.frame, sqrt(pow(c.x-d.x, 2) + pow(c.y-d.y, 2) + pow(c.z-d.z, 2)) as d from rb join co c on rb.graph_id = c.graph_id and rb.u = c.node join co d on rb.graph_id = d.graph_id and rb.v = d.node and c.frame = d.frame"


@query("d24_geometry_deviation", cte("co", "rb", "dim", dv=_DEV, ln=_LEN, bc="select a.graph_id, sum(case when abs(a.d - b.d) > 0.02 then abs(a.d - b.d) else 0 end) as bond_change from ln a join ln b on a.graph_id = b.graph_id and a.u = b.u and a.v = b.v and a.frame = 0 and b.frame = 1 group by a.graph_id") + "select graph_id, round(rmsd, 6) as rmsd, round(mass_rmsd, 6) as mass_rmsd, coalesce(round(bond_change, 6), 0.0)::double as bond_change from dv left join bc using (graph_id)")
def d24(spark, sf):
    return _round(M.geometry_deviation(X.coords(spark, sf), X.elements(spark), X.bonds(spark, sf, "r"), 0.02), "rmsd", "mass_rmsd", "bond_change")


_ENV = "(1 / d + -28.0::double * pow(d, 5) + 48.0::double * pow(d, 6) + -21.0::double * pow(d, 7))"


@query("b26_radial_basis", cte("co", "dim", pr=_PAIRS, s="select graph_id, frame, u, v, d / 5.0 as d from pr") + "select graph_id, frame, u, v, " + ", ".join(f"round(case when d > 0 and d < 1 then {_ENV} * sin({k} * pi() * d) else 0 end, 6) + 0.0::double as b{k}" for k in (1, 2, 3)) + " from s")
def b26(spark, sf):
    p = M.pairs(X.coords(spark, sf)).withColumn("b", K.radial_basis(F.col("d"), 3, 5.0))
    return p.select("graph_id", "frame", F.col("node_i").alias("u"), F.col("node_j").alias("v"), *[F.round(F.col("b")[k - 1], 6).alias(f"b{k}") for k in (1, 2, 3)])


_MODE = "select graph_id, node, l_discount::double * sin(1.0::double) as mx, l_tax::double * sin(2.0::double) as my, (l_quantity::double - 25) / 50 * sin(3.0::double) as mz from n"
_MOVE = """select a.graph_id, a.node as u, b.node as v, da.radius + db.radius as rr, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) as d,
 abs(sqrt(pow(a.x + 0.5*p.mx - b.x - 0.5*q.mx, 2) + pow(a.y + 0.5*p.my - b.y - 0.5*q.my, 2) + pow(a.z + 0.5*p.mz - b.z - 0.5*q.mz, 2)) - sqrt(pow(a.x - 0.5*p.mx - b.x + 0.5*q.mx, 2) + pow(a.y - 0.5*p.my - b.y + 0.5*q.my, 2) + pow(a.z - 0.5*p.mz - b.z + 0.5*q.mz, 2))) as c
 from co a join co b on a.graph_id = b.graph_id and a.frame = 0 and b.frame = 0 and a.node < b.node join md p on a.graph_id = p.graph_id and a.node = p.node join md q on b.graph_id = q.graph_id and b.node = q.node join dim da on a.element = da.element join dim db on b.element = db.element"""


@query("f2_motion_indicators", cte("co", "eu", "dim", md=_MODE, mv=_MOVE, tg_="select distinct graph_id, u, v, true as target from eu where (r_order = 0) <> (p_order = 0)",
    j="select mv.*, coalesce(target, false) as target, d > 0 and d < 1.8 * rr as near from mv left join tg_ using (graph_id, u, v)", k="select graph_id, u, v, d, target, near, case when near then round(c, 9) else 0 end as c from j where near or target",
    r="select *, case when near then row_number() over (partition by graph_id order by near desc, c desc, u, v) else 1 << 30 end as rank from k",
    s="select *, max(case when target then rank end) over (partition by graph_id) as worst from r")
    + "select graph_id, round(avg(case when target then c end), 6) as mean_target, round(min(case when target then c end), 6) as least_target, round(sum(case when not target and rank < worst then c else 0 end), 6) as unexpected, round(max(case when target then d end), 6) as longest from s where worst is not null group by graph_id")
def f2(spark, sf):
    d = lambda c: F.col(c).cast("double")
    modes = X.nodes(spark, sf).select("graph_id", "node", (d("l_discount") * math.sin(1)).alias("mx"), (d("l_tax") * math.sin(2)).alias("my"), ((d("l_quantity") - 25) / 50 * math.sin(3)).alias("mz"))
    targets = E.connection_changes(X.bonds(spark, sf, "r"), X.bonds(spark, sf, "p"))
    out = M.motion_indicators(X.coords(spark, sf).filter("frame = 0").drop("frame"), modes, X.elements(spark), targets)
    return _round(out, "mean_target", "least_target", "unexpected", "longest")
