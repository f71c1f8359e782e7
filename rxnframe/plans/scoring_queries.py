"""Queries for energies, errors, losses and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from rxnframe.operators import reactions as R
from rxnframe.operators import scoring as S
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte, read
from rxnframe.plans.registry import query


def _rounded(df, digits=6):
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("b22_reaction_energies", cte("tg") + 'select graph_id, round((g_ts - g_r) / 1000 * 627.5095, 4) as barrier, round((g_p - g_r) / 1000 * 627.5095, 4) as enthalpy from tg where g_p is not null')
def b22(spark, sf):
    t = X.targets(spark, sf).filter("g_p is not null").select("graph_id", *[(F.col(a) / 1000).alias(b) for a, b in (("g_ts", "g_ts"), ("g_r", "g_r"), ("g_p", "h_p"), ("g_r", "h_r"))])
    return _rounded(R.reaction_energies(t).select("graph_id", "barrier", "enthalpy"), 4)


@query("b24_bep_predict", cte("tg", f='select key, regr_slope("DE", "DH") as s, regr_intercept("DE", "DH") as i from tg group by key having count(distinct "DH") > 1') + 'select graph_id, key, round(s * "DH" + i, 3) as predicted from tg join f using (key)')
def b24(spark, sf):
    t = X.targets(spark, sf).select("graph_id", "key", "DE", "DH")
    many = t.groupBy("key").agg(F.countDistinct("DH").alias("k")).filter("k > 1").select("key")
    fit = R.bep_fit(t.join(many, "key", "left_semi"), "key", "DE", "DH")
    return R.bep_predict(t.join(fit, "key"), "slope", "intercept", "DH").select("graph_id", "key", F.round("predicted", 3).alias("predicted"))


@query("b25_standardise", cte("tg", m='select avg("DE") as a, stddev_pop("DE") as b, avg("DH") as c, stddev_pop("DH") as d from tg where graph_id % 5 > 0') + 'select graph_id, round(("DE" - a) / b, 6) as "DE", round(("DH" - c) / d, 6) as "DH" from tg, m')
def b25(spark, sf):
    t = X.targets(spark, sf).select("graph_id", "DE", "DH")
    return _rounded(R.apply_standardise(t, R.fit_standardise(t.filter("graph_id % 5 > 0"), ["DE", "DH"]), ["DE", "DH"]))


_ORD = "select o_orderpriority as rtype, o_orderkey, o_totalprice / 1000 as t1, (o_totalprice + (o_custkey % 101 - 50)) / 1000 as p1, (o_custkey % 37)::double as t2, (o_custkey % 37 + o_orderkey % 7 - 3)::double as p2, o_orderkey // 50 as batch from orders"


def _orders(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("rtype"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("t1"), ((F.col("o_totalprice") + (c % 101 - 50)) / 1000).alias("p1"),
        (c % 37).cast("double").alias("t2"), (c % 37 + k % 7 - 3).cast("double").alias("p2"), F.expr("o_orderkey div 50").alias("batch"),
    )


_M = "avg(abs(p1 - t1)) as de_mae, avg((p1 - t1) * (p1 - t1)) as de_mse, avg(abs(p2 - t2)) as dh_mae, avg((p2 - t2) * (p2 - t2)) as dh_mse"
_OUT = "select rtype, round(de_mae, 6) as de_mae, round(de_mse, 6) as de_mse, round(dh_mae, 6) as dh_mae, round(dh_mse, 6) as dh_mse, round((de_mae + dh_mae) / 2, 6) as mae, round((de_mse + dh_mse) / 2, 6) as mse, round(sqrt(de_mse), 6) as de_rmse, round(sqrt(dh_mse), 6) as dh_rmse from m"
_TARGETS = {"de": ("t1", "p1"), "dh": ("t2", "p2")}


@query("d7_regression_metrics", f"with o as ({_ORD}), m as (select rtype, {_M} from o group by rtype) {_OUT}")
def d7(spark, sf):
    return _rounded(S.regression_metrics(_orders(spark, sf), _TARGETS, ["rtype"]))


@query("d7_batch_metrics", f"with o as ({_ORD}), b as (select rtype, batch, {_M} from o group by all), m as (select rtype, avg(de_mae) as de_mae, avg(de_mse) as de_mse, avg(dh_mae) as dh_mae, avg(dh_mse) as dh_mse from b group by rtype) {_OUT}")
def d7_batches(spark, sf):
    return _rounded(S.regression_metrics(_orders(spark, sf), _TARGETS, ["rtype"], "batch"))


@query("d8_weighted_loss", f"with o as ({_ORD}) select rtype, round(0.7 * avg(abs(p1 - t1)) + 0.3 * avg(abs(p2 - t2)), 6) as loss from o group by rtype")
def d8(spark, sf):
    return _rounded(S.weighted_loss(_orders(spark, sf), [("t1", "p1"), ("t2", "p2")], [0.7, 0.3], ["rtype"]))


_LAB = "select lang, quality, toxic, n_chars, 1 / (1 + exp(-(n_chars % 97 - 48) / 20.0::double)) as p, [(n_chars % 3)::double, (n_chars % 5)::double / 2, (n_chars % 7)::double / 3] as logits, (quality + toxic)::int as k, (n_chars % 97 - 48) / 20.0::double as x from labels join documents using (doc_id)"


def _labelled(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    x = (n % 97 - 48) / F.lit(20.0)
    return d.select("lang", "quality", "toxic", "n_chars", (1 / (1 + F.exp(-x))).alias("p"), F.array((n % 3).cast("double"), (n % 5) / F.lit(2.0), (n % 7) / F.lit(3.0)).alias("logits"), (F.col("quality") + F.col("toxic")).alias("k"), x.alias("x"))


_W = "select *, case when n_chars % 2 = 0 then 1.0::double else 0.5 end * (n_chars > 100)::int as w from l"


@query("d9_mcc_binary", f"with l as ({_LAB}), m as ({_W}), c as (select lang, sum(quality * p * w) as tp, sum((1 - quality) * p * w) as fp, sum(quality * (1 - p) * w) as fn, sum((1 - quality) * (1 - p) * w) as tn from m group by lang) select lang, round(1 - (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as loss from c")
def d9(spark, sf):
    w = F.when(F.col("n_chars") % 2 == 0, 1.0).otherwise(0.5)
    return _rounded(S.mcc_binary(_labelled(spark, sf), "p", "quality", ["lang"], w, F.col("n_chars") > 100))


@query("d10_mcc_multiclass", f"""with l as ({_LAB}), a as (select lang, k, list_position(logits, list_max(logits)) - 1 as g from l),
c as (select lang, count(*)::double as n, count(*) filter (where k = g) as r, count(*) filter (where k = 0) as t0, count(*) filter (where k = 1) as t1, count(*) filter (where k = 2) as t2, count(*) filter (where g = 0) as p0, count(*) filter (where g = 1) as p1, count(*) filter (where g = 2) as p2 from a group by lang)
select lang, round(case when (n*n-p0*p0-p1*p1-p2*p2) * (n*n-t0*t0-t1*t1-t2*t2) = 0 then 1.0 else 1 - (r*n-p0*t0-p1*t1-p2*t2) / sqrt((n*n-p0*p0-p1*p1-p2*p2) * (n*n-t0*t0-t1*t1-t2*t2)) end, 6)::double as loss from c""")
def d10(spark, sf):
    return _rounded(S.mcc_multiclass(_labelled(spark, sf), "logits", "k", ["lang"], 3))


_DIR = "select lang, n_chars, k, list_transform(logits, lambda x: x + 1) as al from l"
_SOS = "list_sum(list_transform(range(0, 3), lambda i: pow((i = k)::int - al[i + 1] / list_sum(al), 2) + al[i + 1] / list_sum(al) * (1 - al[i + 1] / list_sum(al)) / (list_sum(al) + 1)))"


@query("d11_dirichlet_loss", f"with l as ({_LAB}), d as ({_DIR}) select lang, round(avg({_SOS}), 6) as loss from d group by lang")
def d11(spark, sf):
    x = _labelled(spark, sf).withColumn("al", F.transform("logits", lambda v: v + 1))
    return _rounded(S.dirichlet_loss(x, "al", "k").groupBy("lang").agg(F.avg("loss").alias("loss")))


@query("d11_dirichlet_loss_divergence")
def d11_lam(spark, sf):
    x = _labelled(spark, sf).withColumn("al", F.transform("logits", lambda v: v + 1))
    return _rounded(S.dirichlet_loss(x, "al", "k", lam=0.2).groupBy("lang").agg(F.avg("loss").alias("loss")))


@query("d12_classification_loss", f"with l as ({_LAB}) select lang, round(avg(ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[k + 1]), 6) as cross_entropy, round(avg(greatest(x, 0) - x * toxic + ln(1 + exp(-abs(x)))), 6) as binary_cross_entropy from l group by lang")
def d12(spark, sf):
    x = _labelled(spark, sf)
    a = S.classification_loss(x, S.cross_entropy("logits", "k"), ["lang"]).withColumnRenamed("loss", "cross_entropy")
    b = S.classification_loss(x, S.binary_cross_entropy("x", "toxic"), ["lang"]).withColumnRenamed("loss", "binary_cross_entropy")
    return _rounded(a.join(b, "lang"))


_EP = "select user_id, row_number() over (partition by user_id order by ts, event_id) as epoch, value as val_loss from events"


def _epochs(spark, sf):
    e = read(spark, sf, "events")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("epoch"), F.col("value").alias("val_loss"))


@query("f1_best_epochs", f"with e as ({_EP}), b as (select *, least(100.0::double, coalesce(min(val_loss) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding), 100.0)) as best_before from e), c as (select *, val_loss < best_before as is_best from b), d as (select *, epoch - coalesce(max(case when is_best then epoch end) over (partition by user_id order by epoch), 0) as since_best from c) select *, since_best > 20 as stops from d")
def f1(spark, sf):
    return S.best_epochs(_epochs(spark, sf), 20, ["user_id"])


@query("f3_profile_barrier", f"with e as ({_EP}) select user_id, round(627.5 * (max(val_loss) - arg_min(val_loss, epoch)), 4) as barrier_first, round(627.5 * (max(val_loss) - arg_max(val_loss, epoch)), 4) as barrier_last from e group by user_id")
def f3(spark, sf):
    return _rounded(S.profile_barrier(_epochs(spark, sf), "user_id", "epoch", "val_loss"), 4)


@query("c6_fragment_energy", cte("n", e="select p_partkey, p_retailprice from part where p_size <= 40") + "select graph_id, case when count(*) = count(p_partkey) then round(sum(p_retailprice), 2) else 0.0 end::double as energy from n left join e on l_partkey = p_partkey group by graph_id")
def c6(spark, sf):
    energies = read(spark, sf, "part").filter("p_size <= 40").select("p_partkey", "p_retailprice")
    return _rounded(R.fragment_energy(X.nodes(spark, sf).select("graph_id", "l_partkey"), energies, "graph_id", "p_partkey", "p_retailprice", on="l_partkey"), 2)


@query("c6_missing_energies", "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size <= 40)")
def c6_missing(spark, sf):
    energies = read(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return R.missing_energies(read(spark, sf, "lineitem").select("l_partkey"), energies, "l_partkey")
