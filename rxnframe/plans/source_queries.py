"""Queries for sources and sinks: what a table becomes when written and read again, and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxnframe.operators import edges as E
from rxnframe.operators import nodes as N
from rxnframe.operators import selection as S
from rxnframe.operators.neighbours import knn_join
from rxnframe.plans import fixtures as X
from rxnframe.plans.fixtures import cte, read
from rxnframe.plans.registry import query
from rxnframe.session import work_dir
from rxnframe.sources import lines as L
from rxnframe.sources import records as R
from rxnframe.sources import store as K
from rxnframe.sources import text as T


@query("a1_read_reactions", cte("rx") + "select graph_id, smiles, confidence, 'csv' as source from rx union all select graph_id, smiles, confidence, 'tsv' from rx")
def a1(spark, sf):
    rx, schema = X.reactions(spark, sf).select("graph_id", "smiles", "confidence"), "graph_id long, smiles string, confidence double"
    out = []
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        path = f"{work_dir(spark)}.{kind}"
        rx.write.csv(path, header=True, sep=sep)
        out.append(R.read_reactions(spark, path, schema).withColumn("source", F.lit(kind)))
    return out[0].unionByName(out[1])


@query("a2_select_targets", cte("tg") + 'select graph_id, key, "DE", "DH" from tg')
def a2(spark, sf):
    t = X.targets(spark, sf)
    return R.select_targets(t, "DE", ["DH"], ("graph_id", "key"))


def _records(spark, sf):
    t = X.targets(spark, sf).select("graph_id", "key", "DE").join(E.bond_change_class(X.edge_table(spark, sf)).select("graph_id", "rxntype"), "graph_id")
    return t


_REC = cte("tg", "eu", b="select graph_id, 'b' || count(*) filter (where p_order < r_order) || 'f' || count(*) filter (where p_order > r_order) as rxntype from eu group by graph_id", rec='select graph_id, key, "DE", rxntype from tg join b using (graph_id)')


@query("a3_read_graphs", _REC + "select * from rec where rxntype in ('b1f1', 'b0f2', 'b2f0')")
def a3(spark, sf):
    path = work_dir(spark)
    R.write_graphs(_records(spark, sf), path)
    return R.read_graphs(spark, path, "graph_id long, key string, DE double, rxntype string", ["b1f1", "b0f2", "b2f0"])


@query("a4_write_graphs", _REC + "select * from rec")
def a4(spark, sf):
    path = work_dir(spark)
    R.write_graphs(_records(spark, sf), path)
    return spark.read.schema("graph_id long, key string, DE double, rxntype string").parquet(path)


@query("a4_bucketed_store", cte("eu") + "select graph_id, u, v, r_order, p_order from eu")
def a4_store(spark, sf):
    n = X.shared_nodes(spark, sf)
    r, p = (K.load(spark, K.save(X.bonds(spark, sf, side, n))) for side in "rp")
    return E.edge_union(r, p)


@query("a5_class_catalogue", _REC + "select rxntype, count(*) as n from rec group by rxntype")
def a5(spark, sf):
    return R.class_catalogue(_records(spark, sf))


@query("a6_to_eav", "select user_id, event_id, key, value from (select user_id, event_id, event_type, props as payload from events) unpivot (value for key in (event_type, payload))")
def a6(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("props").alias("payload"))
    return R.to_eav(e, ["user_id", "event_id"], ["event_type", "payload"])


@query("a7_from_eav", "select event_id, user_id, event_type, value, (props::json ->> 'k')::int as k from events")
def a7(spark, sf):
    e = read(spark, sf, "events").withColumn("props", F.from_json("props", "k int"))
    eav = R.to_eav(e, ["event_id"], ["user_id", "event_type", "value", "props"])
    out = R.from_eav(eav, ["event_id"], {"user_id": "long", "event_type": "string", "value": "double", "props": "struct<k: int>"})
    return out.select("event_id", "user_id", "event_type", "value", F.col("props.k").alias("k"))


_BUCKET = "('0x' || substr(md5('3:' || graph_id::varchar), 1, 8))::bigint"


@query("a9_read_documents", _REC + f"select graph_id, key, rxntype, split from (select *, case when {_BUCKET} < {int((1 << 32) * 0.7)} then 'train' when {_BUCKET} < {int((1 << 32) * 0.85)} then 'val' else 'test' end as split from rec) where split in ('val', 'test') and regexp_matches(rxntype, '^b[12]f')")
def a9(spark, sf):
    rec = _records(spark, sf)
    path = work_dir(spark)
    S.attach_split(rec, S.random_split3(rec, "graph_id", 0.3, 3), "graph_id").drop("DE").write.json(path)
    return R.read_graphs(spark, path, "graph_id long, key string, rxntype string, split string", "^b[12]f", ["val", "test"], format="json")


_SHAPED = "select event_id, event_type as rxntype, case when event_id % 4 > 0 then case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end end as split, case when event_id % 2 = 0 then value end as energy, event_id % 7 as first from events"


@query("a9_document_store", f"select event_id, rxntype, split, energy, case when event_id % 5 > 0 then first end as first from ({_SHAPED}) where rxntype in ('click', 'purchase') and split in ('train', 'test')")
def a9_store(spark, sf):
    k = F.col("event_id")
    split = F.when(k % 4 > 0, F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test"))
    known = [F.col("event_type").alias("rxntype"), split.alias("split"), F.when(k % 2 == 0, F.col("value").cast("double")).alias("DE")]
    # One record in five has words where the others have numbers.
    text = F.when(k % 5 > 0, F.to_json(F.struct(*known, F.array(k % 7, k).alias("u")))).otherwise(F.to_json(F.struct(*known, F.array(F.lit("none")).alias("u"), F.struct(k.alias("id")).alias("who"))))
    path = work_dir(spark)
    K.write_documents(read(spark, sf, "events").select("event_id", text.alias("doc")), path, fields={"split": "string"})
    some = K.read_documents(spark, path, "event_id long, doc variant, split string, rxntype string", ["click", "purchase"], ["train", "test"])
    return K.extract(some, {"energy": ("$.DE", "double"), "first": ("$.u[0]", "long")}).drop("doc")


_NOTE = "select graph_id, frame, printf('energy: %.4f q %d', max(l_extendedprice::double) + frame, sum(charge)::bigint) as comment from n, (values (0), (1)) f(frame) group by graph_id, frame"
_TXT = "select graph_id, string_agg(part, chr(10) order by frame) as text from (select graph_id, frame, count(*) || chr(10) || comment || chr(10) || string_agg(printf('%s %.6f %.6f %.6f', element, x, y, z), chr(10) order by node) as part from co join nt using (graph_id, frame) group by graph_id, frame, comment) group by graph_id"


def _texts(spark, sf):
    n = X.nodes(spark, sf).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    note = n.groupBy("graph_id", "frame").agg(F.max(F.col("l_extendedprice").cast("double")).alias("e"), F.sum("charge").alias("q"))
    note = note.select("graph_id", "frame", F.format_string("energy: %.4f q %d", F.col("e") + F.col("frame"), F.col("q")).alias("comment"))
    return T.format_frames(X.coords(spark, sf), note)


@query("a19_format_frames", cte("co", nt=_NOTE, t=_TXT) + "select graph_id, text from t")
def a19(spark, sf):
    return _texts(spark, sf)


@query("a10_explode_frames", cte("co") + "select graph_id, frame, node, element, x, y, z from co where graph_id % 10 > 0")
def a10(spark, sf):
    broken = F.when(F.col("graph_id") % 10 == 0, F.concat("text", F.lit("\nX"))).otherwise(F.col("text"))
    return T.explode_frames(_texts(spark, sf).withColumn("text", broken))[0]


@query("a10_read_frames", cte("co") + "select element, frame % 2 as side, count(*) as n, round(sum(x), 4) as x, round(sum(y), 4) as y, round(sum(z), 4) as z from co group by all")
def a10_files(spark, sf):
    path = work_dir(spark)
    _texts(spark, sf).select("text").write.text(path)  # frames of many graphs in each file
    coords = L.read_frames(spark, path)[0]
    return coords.groupBy("element", (F.col("frame") % 2).cast("long").alias("side")).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"])


@query("a10_frame_rejects", "select distinct l_orderkey as graph_id, 'frames' as stage, 'line count' as reason from lineitem where l_orderkey % 10 = 0")
def a10_rejects(spark, sf):
    broken = F.when(F.col("graph_id") % 10 == 0, F.concat("text", F.lit("\nX"))).otherwise(F.col("text"))
    return T.explode_frames(_texts(spark, sf).withColumn("text", broken))[1]


@query("a11_frame_energies", cte("n") + "select graph_id, frame, round(max(l_extendedprice::double) + frame, 4) as energy, sum(charge)::int as charge from n, (values (0), (1)) f(frame) group by graph_id, frame")
def a11(spark, sf):
    return T.frame_energies(_texts(spark, sf))


_LINES = "lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"


@query("a12_extract_log_facts", f"with {_LINES}, x as (select *, lead(line, 2) over (partition by doc_id order by line_no) as later from lines) select doc_id, bool_or(regexp_matches(line, 'License')) as licensed, arg_max(try_cast(regexp_extract(line, '([0-9]+)', 1) as double), line_no) filter (where regexp_matches(line, '([0-9]+)')) as last_number, count(*) filter (where regexp_matches(line, '^The ')) as n_the, coalesce(arg_max(coalesce(try_cast(regexp_extract(later, '([0-9]+)', 1) as double), -1), line_no) filter (where regexp_matches(line, 'the')) >= 100, false) as far_number from x group by doc_id")
def a12(spark, sf):
    lines = T.number_lines(read(spark, sf, "documents"), "doc_id")
    return T.extract_log_facts(lines, "doc_id", {"licensed": "License"}, {"last_number": "([0-9]+)"}, {"n_the": "^The "}, ("far_number", "the", 2, "([0-9]+)", 100.0))


@query("a13_read_energies", "select substr(md5((p_partkey % 150)::varchar), 1, 14) as key, max(p_partkey)::double as e_0, arg_max(p_size, p_partkey)::double as h, arg_max(p_retailprice, p_partkey)::double as f, arg_max(p_size * 2, p_partkey)::double as spe from part group by all")
def a13(spark, sf):
    p = read(spark, sf, "part")
    line = F.concat_ws("  ", F.md5((F.col("p_partkey") % 150).cast("string")), "p_partkey", "p_size", F.col("p_retailprice").cast("double").cast("string"), (F.col("p_size") * 2).cast("string"))
    return T.read_energies(p.select(F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("a14_read_element_table", "select 'E' || translate(p_partkey::varchar, '0123456789', 'abcdefghij') as element, p_partkey::int as number, case when p_size % 5 = 0 then 0.0 else p_size end::double as electronegativity from part")
def a14(spark, sf):
    p = read(spark, sf, "part")
    symbol = F.concat(F.lit("E"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"))
    value = F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.col("p_size").cast("string"))
    return T.read_element_table(p.select(F.concat_ws(" ", value, F.lit("#"), "p_partkey", symbol).alias("line")))


_FOLD = f"with b as (select o_orderkey, ('0x' || substr(md5('2:' || o_orderkey::varchar), 1, 8))::bigint as b from orders) select o_orderkey as graph_id, case when b >= {int((1 << 32) * 0.9)} then 'test' when b % 5 + 1 = 2 then 'val' else 'train' end as split, 2 as fold from b"


@query("a15_splits", _FOLD)
def a15(spark, sf):
    path = work_dir(spark)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("graph_id"))
    R.write_splits(S.kfold_split(o, "graph_id", 5, 2), path)
    return R.read_splits(spark, path, fold=2)


@query("a16_read_exclude", "select o_orderkey::varchar as id from orders where o_orderkey % 3 = 0 union all select 'order ' || o_orderkey from orders where o_orderkey % 3 = 1")
def a16(spark, sf):
    k = F.col("o_orderkey").cast("string")
    o = read(spark, sf, "orders")
    line = F.when(o.o_orderkey % 3 == 0, F.concat(F.lit("data/"), "o_orderpriority", F.lit("/"), k, F.lit(".json"))).when(o.o_orderkey % 3 == 1, F.concat(F.lit("order "), k)).otherwise("")
    return R.read_exclude(o.select(line.alias("line")))


_RULES = "select graph_id, case when n_heavy = 0 then 'no heavy atom' when n_H > 3 then 'too many hydrogens' end as reason from (select graph_id, count(*) filter (where element <> 'H') as n_heavy, count(*) filter (where element = 'H') as n_H from n group by graph_id)"


def _split(spark, sf):
    rules = {"no heavy atom": F.col("n_heavy") == 0, "too many hydrogens": F.col("n_H") > 3}
    return K.write_checked(N.composition(X.atoms(spark, sf)), work_dir(spark), "build", rules)


@query("a17_rejects", cte("n", k=_RULES) + "select graph_id, 'build' as stage, reason from k where reason is not null")
def a17(spark, sf):
    return _split(spark, sf)[1]


@query("a17_outcomes", cte("n", k=_RULES) + "select coalesce(reason, 'ok') as outcome, count(*) as n from k group by 1")
def a17_counts(spark, sf):
    return spark.createDataFrame([(k, n) for k, n in _split(spark, sf)[2].items() if n], "outcome string, n long")


@query("a17_accepted", cte("n", k=_RULES) + "select graph_id from k where reason is null")
def a17_ok(spark, sf):
    return _split(spark, sf)[0].select("graph_id")


@query("a18_write_results", cte("tg") + """select graph_id, key, "DE" as pred, '[' || (graph_id % 7) || ',' || (graph_id % 5) || ']' as embedding from tg""")
def a18(spark, sf):
    path = work_dir(spark)
    t = X.targets(spark, sf).select("graph_id", "key", F.col("DE").alias("pred"), F.array(F.col("graph_id") % 7, F.col("graph_id") % 5).alias("embedding"))
    R.write_results(t, path)
    return spark.read.csv(path, header=True, schema="graph_id long, key string, pred double, embedding string", escape='"')


@query("c12_knn_join", "with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null), p as (select a.vec_id, b.vec_id as neighbour, list_distance(a.e, b.e) as d from v a join v b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by vec_id order by d, neighbour)::int as rank from p) select vec_id, neighbour, round(d, 6) as distance, rank from r where rank <= 5")
def c12(spark, sf):
    return knn_join(read(spark, sf, "embeddings"), 5).withColumn("distance", F.round("distance", 6))


@query("c12_knn_cosine", "with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null), p as (select a.vec_id, b.vec_id as neighbour, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by vec_id order by 1 - s, neighbour)::int as rank from p) select vec_id, neighbour, round(1 - s, 6) as distance, rank from r where rank <= 3")
def c12_cosine(spark, sf):
    return knn_join(read(spark, sf, "embeddings"), 3, metric="cosine").withColumn("distance", F.round("distance", 6))
