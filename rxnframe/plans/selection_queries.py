"""Queries for keys, filters, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxnframe.functions import columns as K
from rxnframe.operators import edges as E
from rxnframe.operators import nodes as N
from rxnframe.operators import reactions as R
from rxnframe.operators import selection as S
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte, read
from rxnframe.plans.registry import query

_SIDES = "select graph_id, smiles, split_part(smiles, '>>', 1) as reactant, split_part(smiles, '>>', 2) as product, string_split(split_part(smiles, '>>', 1), '.') as rf, string_split(split_part(smiles, '>>', 2), '.') as pf, confidence from rx"


def _rx(spark, sf):
    return R.split_reaction(X.reactions(spark, sf))


@query("b1_split_reaction", cte("rx", s=_SIDES) + "select graph_id, reactant, product from s")
def b1(spark, sf):
    return _rx(spark, sf).select("graph_id", "reactant", "product")


@query("b2_molecularity_class", cte("rx", s=_SIDES) + "select graph_id, 'R' || len(rf) || 'P' || len(pf) as both_sides, 'R' || len(rf) as one_side from s")
def b2(spark, sf):
    r, p = F.col("reactant"), F.col("product")
    return _rx(spark, sf).select("graph_id", K.molecularity_class(r, p).alias("both_sides"), K.molecularity_class(r).alias("one_side"))


@query("b3_assign_class", cte("rx", s=_SIDES, h="select graph_id, count(*) filter (where element <> 'H') as n_heavy from n group by graph_id") + "select graph_id, n_heavy || 'atom' as heavy, 'All' as every, 'R' || len(rf) || 'P' || len(pf) as molecularity from s join h using (graph_id)")
def b3(spark, sf):
    df = _rx(spark, sf).join(N.composition(X.atoms(spark, sf)), "graph_id")
    for mode, name in (("heavy", "heavy"), ("all", "every"), ("molecularity", "molecularity")):
        df = R.assign_class(df, mode, name)
    return df.select("graph_id", "heavy", "every", "molecularity")


@query("b4_entity_key", cte("n", s="select graph_id, string_agg(element, '.' order by element) filter (where node % 2 = 1) as r, string_agg(element, '.' order by element) filter (where node % 2 = 0) as p from n group by graph_id") + "select graph_id, coalesce(r, 'InChI_NA') || '>>' || coalesce(p, 'InChI_NA') as entity_key from s")
def b4(spark, sf):
    side = lambda k: F.array_join(F.collect_list(F.when(F.col("node") % 2 == k, F.col("element"))), ".")
    df = X.atoms(spark, sf).groupBy("graph_id").agg(side(1).alias("r"), side(0).alias("p"))
    return df.select("graph_id", K.entity_key(F.col("r"), F.col("p")).alias("entity_key"))


_ACTIVE = "array_to_string(list_sort(list_filter({a}, lambda x: not list_contains({b}, x))), '.')"


@query("b5_reaction_index", cte("rx", s=_SIDES, k=f"select graph_id, {_ACTIVE.format(a='rf', b='pf')} as a, {_ACTIVE.format(a='pf', b='rf')} as b from s") + "select graph_id, least(a, b) || '>>' || greatest(a, b) as reaction_index from k")
def b5(spark, sf):
    return _rx(spark, sf).select("graph_id", K.reaction_index(F.col("reactant"), F.col("product")).alias("reaction_index"))


@query("b6_skeleton_key", cte("rm") + "select graph_id, array_to_string(list_sort(list_transform(string_split(r, '.'), lambda x: x[1:14])), '-') as skeleton from rm where r is not null and p is not null")
def b6(spark, sf):
    df = R.split_reaction(X.reactions(spark, sf, "md5"))
    return df.select("graph_id", K.skeleton_key(F.col("reactant")).alias("skeleton"))


_PAIRED = "select graph_id, ceil(node / 2)::int as pair, string_agg(element || case when charge > 0 then '+' when charge < 0 then '-' else '' end, '' order by node) as t from n group by all"


@query("b7_is_zwitterion", cte("n", q=_PAIRED, k="select graph_id, bool_or(pair % 2 = 1) and bool_or(pair % 2 = 0) as two, bool_or(contains(t, '+') and contains(t, '-')) filter (where pair % 2 = 1) as z from q group by graph_id") + "select graph_id, z as zwitterion from k where two")
def b7(spark, sf):
    df = R.split_reaction(X.reactions(spark, sf, "pairs"))
    return df.select("graph_id", K.is_zwitterion(F.col("reactant")).alias("zwitterion"))


@query("b12_exclude_ids", "select doc_id, lang from documents where doc_id not in (select doc_id from labels where quality = 0)")
def b12(spark, sf):
    bad = read(spark, sf, "labels").filter("quality = 0")
    return S.exclude_ids(read(spark, sf, "documents").select("doc_id", "lang"), bad, "doc_id")


@query("b13_filter_class", "select o_orderkey, o_orderpriority, 'list' as how from orders where o_orderpriority in ('1-URGENT', '2-HIGH') union all select o_orderkey, o_orderpriority, 'pattern' from orders where regexp_matches(o_orderpriority, '^[45]')")
def b13(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.filter_class(o, "o_orderpriority", ["1-URGENT", "2-HIGH"]).withColumn("how", F.lit("list")).unionByName(S.filter_class(o, "o_orderpriority", "^[45]").withColumn("how", F.lit("pattern")))


def _bucket(key: str, seed: int | str = 0) -> str:
    text = f"{key}::varchar" if seed == 0 else f"'{seed}:' || {key}::varchar"
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _three(bucket: str, holdout: float) -> str:
    a, b = int((1 << 32) * (1 - holdout)), int((1 << 32) * (1 - holdout / 2))
    return f"case when {bucket} < {a} then 'train' when {bucket} < {b} then 'val' else 'test' end"


@query("b14_select_split", f"select doc_id, split from (select doc_id, {_three(_bucket('doc_id', 3), 0.3)} as split from documents) where split in ('val', 'test')")
def b14(spark, sf):
    return S.select_split(S.random_split3(read(spark, sf, "documents"), "doc_id", 0.3, 3), "valtest")


_CONV = "select graph_id, bool_or(l_returnflag = 'N') as finished, count(*) filter (where l_linenumber = 1) = 1 as single_mode, max(l_extendedprice::double) - min(l_extendedprice::double) as barrier from n group by graph_id"


@query("b16_filter_converged", cte("n", k=_CONV) + "select graph_id, round(barrier, 6) as barrier from k where finished and single_mode and barrier <= 40005")
def b16(spark, sf):
    price = F.col("l_extendedprice").cast("double")
    df = X.nodes(spark, sf).groupBy("graph_id").agg(F.bool_or(F.col("l_returnflag") == "N").alias("finished"), (F.count_if(F.col("l_linenumber") == 1) == 1).alias("single_mode"), (F.max(price) - F.min(price)).alias("barrier"))
    return S.filter_barrier(S.filter_converged(df), 40000.0).select("graph_id", F.round("barrier", 6).alias("barrier"))


@query("b17_dummy_encode", "select event_id, coalesce(value, 0)::double as value, " + ", ".join(f"(event_type = '{v}')::int as is_{v}" for v in ("click", "view", "purchase")) + " from events")
def b17(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"))
    return S.dummy_encode(e, "event_type", ["click", "view", "purchase"]).drop("event_type")


@query("b23_reverse_reactions", cte("rx", s=_SIDES) + "select graph_id, reactant, product, false as reversed from s union all select graph_id, product, reactant, true from s")
def b23(spark, sf):
    return R.reverse_reactions(_rx(spark, sf).select("graph_id", "reactant", "product"), [("reactant", "product")], union=True)


@query("b27_path_id", "select o_orderkey, o_orderkey::varchar as id from orders")
def b27(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat_ws("/", F.lit("data"), "o_orderpriority", F.concat(F.col("o_orderkey").cast("string"), F.lit(".json"))).alias("path"))
    return o.select("o_orderkey", K.path_id("path").alias("id"))


@query("b28_filter_confidence", cte("rx") + "select graph_id, smiles, confidence from rx where confidence >= 0.10")
def b28(spark, sf):
    return S.filter_confidence(X.reactions(spark, sf)).select("graph_id", "smiles", "confidence")


@query("a8_first_per_key", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def a8(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return S.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("d1_keep_lowest", cte("tg") + 'select key, graph_id, "DE", "DH" from (select *, row_number() over (partition by key order by "DE", graph_id) as k from tg) where k = 1')
def d1(spark, sf):
    return S.keep_lowest(X.targets(spark, sf).select("key", "graph_id", "DE", "DH"), "key", "DE", "graph_id")


@query("d2_group_by_product", cte("rx", s=_SIDES, k="select graph_id, array_to_string(list_sort(pf), '.') as product_key from s") + "select product_key, string_agg(graph_id, ',' order by graph_id) as ids, count(*) as n from k group by product_key")
def d2(spark, sf):
    df = _rx(spark, sf).select("graph_id", K.side_key(F.col("product")).alias("product_key"))
    return R.group_by_product(df, "product_key", "graph_id").select("product_key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query("d2_grouped_rows", cte("rx", s=_SIDES, k="select graph_id, array_to_string(list_sort(pf), '.') as product_key from s") + "select product_key, graph_id, count(*) over (partition by product_key) as n from k")
def d2_rows(spark, sf):
    df = _rx(spark, sf).select("graph_id", K.side_key(F.col("product")).alias("product_key"))
    return E.grouped_rows(df, "product_key", "graph_id")


@query("d5_dedupe_within_gap", cte("tg") + 'select key, graph_id, "DE" from (select key, graph_id, "DE", lag("DE") over (partition by key order by "DE", graph_id) as b from tg) where b is null or "DE" - b > 250')
def d5(spark, sf):
    return S.dedupe_within(X.targets(spark, sf).select("key", "graph_id", "DE"), "key", "DE", "graph_id", 250.0, "gap")


#: Graphs kept of each key, in order of arrival: a fold over the key's graphs that takes one whose DE is farther than 250 from all taken before.
_GREEDY = """select key, list_reduce(list([struct_pack(g := graph_id, e := "DE")] order by graph_id), lambda kept, x: case when list_min(list_transform(kept, lambda y: abs(y.e - x[1].e))) > 250 then list_concat(kept, x) else kept end) as kept from tg group by key"""


@query("d5_dedupe_within_greedy", cte("tg", k=_GREEDY) + 'select key, s.g as graph_id, s.e as "DE" from (select key, unnest(kept) as s from k)')
def d5_greedy(spark, sf):
    return S.dedupe_within(X.targets(spark, sf).select("key", "graph_id", "DE"), "key", "DE", "graph_id", 250.0)


@query("d6_build_registry", cte("tg", k=_GREEDY) + """select key as reaction_index, case when len(list_filter(kept, lambda s: s.g % 3 = 0)) > 0 then 'intended' else 'unintended' end as rtype, len(kept)::int as n_states, array_to_string(list_transform(kept, lambda s: s.g), ',') as sources from k""")
def d6(spark, sf):
    t = X.targets(spark, sf).select(F.col("key").alias("reaction_index"), F.when(F.col("graph_id") % 3 == 0, "intended").otherwise("unintended").alias("rtype"), F.col("graph_id").cast("string").alias("source"), F.col("DE").alias("energy"), F.col("graph_id").alias("arrival"))
    out = S.build_registry(t, 250.0)
    return out.select("reaction_index", "rtype", F.size("states").alias("n_states"), F.array_join(F.transform("states", lambda x: x.source), ",").alias("sources"))


@query("d27_distinct_arrays", cte("n", k="select graph_id, string_agg(element, ',' order by node) as elements from n group by graph_id") + "select len(elements)::int as width, elements, min(graph_id) as first_index from k group by all")
def d27(spark, sf):
    arr = F.transform(F.array_sort(F.collect_list(F.struct("node", "element"))), lambda x: x.element)
    df = X.atoms(spark, sf).groupBy("graph_id").agg(arr.alias("elements")).withColumn("width", F.length(F.array_join("elements", ",")))
    return S.distinct_arrays(df, ["width"], "elements", "graph_id").select("width", F.array_join("elements", ",").alias("elements"), "first_index")


@query("g2_sample_n", f"select doc_id, lang from documents order by {_bucket('doc_id', 7)}, doc_id limit 100")
def g2(spark, sf):
    return S.sample_n(read(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id", 7)


@query("g4_top_k", "select o_custkey, o_orderkey, k::int as rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3")
def g4(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("h1_merge_datasets", "select doc_id, lang, n_chars from documents where lang is not null")
def h1(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return S.merge_datasets(d.filter("lang = 'en'"), d.filter("lang in ('fr', 'de')").select("n_chars", "lang", "doc_id"), d.filter("lang not in ('en', 'fr', 'de')"))


@query("h2_union_ids", f"with s as (select doc_id, {_three(_bucket('doc_id', 3), 0.3)} as split from documents) select doc_id from s where split = 'train' union select doc_id from s where split = 'val'")
def h2(spark, sf):
    d = S.random_split3(read(spark, sf, "documents"), "doc_id", 0.3, 3)
    return S.union_ids("doc_id", S.select_split(d, "train"), S.select_split(d, "val"))


@query("h3_fragment_sets", cte("rx", s=_SIDES) + "select graph_id, array_to_string(list_sort(list_distinct(list_filter(rf, lambda x: not list_contains(pf, x)))), '.') as only_r, array_to_string(list_sort(list_distinct(list_intersect(rf, pf))), '.') as shared from s")
def h3(spark, sf):
    r, p = K.fragments(F.col("reactant")), K.fragments(F.col("product"))
    return _rx(spark, sf).select("graph_id", F.array_join(F.array_sort(F.array_except(r, p)), ".").alias("only_r"), F.array_join(F.array_sort(F.array_intersect(r, p)), ".").alias("shared"))


@query("i1_random_split3", f"select o_orderkey, {_three(_bucket('o_orderkey', 5), 0.2)} as split from orders")
def i1(spark, sf):
    return S.random_split3(read(spark, sf, "orders"), "o_orderkey", 0.2, 5)


@query("i1_random_split3_exact", f"with r as (select doc_id, row_number() over (order by {_bucket('doc_id', 5)}, doc_id) as k, count(*) over () as n from documents), c as (select *, floor(n * (1 - 0.2::double)) as a from r) select doc_id, case when k <= a then 'train' when k <= a + floor((n - a) / 2) then 'val' else 'test' end as split from c")
def i1_exact(spark, sf):
    return S.random_split3(read(spark, sf, "documents"), "doc_id", 0.2, 5, exact=True)


@query("i2_kfold_split", f"with b as (select o_orderkey, {_bucket('o_orderkey', 2)} as b from orders) select o_orderkey, f.fold, case when b >= {int((1 << 32) * 0.9)} then 'test' when b % 5 + 1 = f.fold then 'val' else 'train' end as split from b, (values (1), (2), (3), (4), (5)) f(fold)")
def i2(spark, sf):
    return S.kfold_split(read(spark, sf, "orders"), "o_orderkey", 5, 2)


_PRE = "select doc_id, case doc_id % 4 when 0 then 'val' when 1 then 'test' when 2 then 'other' else 'train' end as f1, case doc_id % 5 when 0 then 'val' else 'train' end as f2 from documents"


@query("i3_preset_split", f"with p as ({_PRE}) select doc_id, 1 as fold, f1 as split from p where f1 <> 'other' union all select doc_id, 2, f2 from p")
def i3(spark, sf):
    d = F.col("doc_id")
    p = read(spark, sf, "documents").select("doc_id", F.when(d % 4 == 0, "val").when(d % 4 == 1, "test").when(d % 4 == 2, "other").otherwise("train").alias("fold1Split"), F.when(d % 5 == 0, "val").otherwise("train").alias("fold2Split"))
    return S.preset_split(p, "doc_id", ["fold1Split", "fold2Split"])


@query("i4_group_split", cte("tg") + f"select graph_id, key, {_three(_bucket('key', 4), 0.3)} as split from tg")
def i4(spark, sf):
    return S.group_split(X.targets(spark, sf), "graph_id", "key", 0.3, 4)


@query("i4_cluster_split")
def i4_cluster(spark, sf):
    return S.cluster_split(read(spark, sf, "embeddings").filter("embedding is not null"), "vec_id", "embedding", 12, 0.3, 1)


_REP = _bucket("(f.fold + 10) || ':' || doc_id")


@query("i5_repeated_split", f"select doc_id, f.fold, {_three(_REP, 0.2)} as split from documents, (values (1), (2), (3)) f(fold)")
def i5(spark, sf):
    return S.repeated_split(read(spark, sf, "documents"), "doc_id", 3, 0.2, 10)


@query("i6_attach_split", f"select o_orderkey, o_custkey, case when o_custkey % 7 > 0 then {_three(_bucket('o_orderkey', 5), 0.2)} end as split from orders")
def i6(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.attach_split(o, S.random_split3(o.filter("o_custkey % 7 > 0"), "o_orderkey", 0.2, 5), "o_orderkey")
