"""Bucketed stores, documents of any shape, checked writes, and large files read by ranges."""

import json

import pytest
from pyspark.sql import functions as F

from rxnframe.operators import edges as E
from rxnframe.operators import nodes as N
from rxnframe.operators import selection as S
from rxnframe.plans import fixtures as X
from rxnframe.sources import lines, store, text


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_graphs_join_without_exchange(spark, small, no_broadcast):
    r, p = (store.load(spark, store.save(E.directed(X.bonds(spark, small, side)), buckets=4)) for side in "rp")
    atoms = store.load(spark, store.save(X.atoms(spark, small), buckets=4))
    splits = store.load(spark, store.save(S.random_split3(X.atoms(spark, small), "graph_id"), buckets=4))
    union = E.edge_union(r, p)
    counts = N.neighbour_counts(r, atoms, ["H", "C", "N", "O"])
    labelled = S.attach_split(atoms, splits, "graph_id")
    for df in (union, counts, labelled):
        assert "Exchange" not in plan(df) and "bucket" in plan(df).lower()
    assert union.count() == E.edge_union(E.directed(X.bonds(spark, small, "r")), E.directed(X.bonds(spark, small, "p"))).count()
    assert labelled.filter("split is null").isEmpty() and labelled.count() == X.atoms(spark, small).count()


def test_bucket_counts():
    assert store.bucket_count(0) == 8 and store.bucket_count(store.BUCKET_ROWS * 8) == 8 and store.bucket_count(store.BUCKET_ROWS * 9) == 16


DOCS = [
    (1, json.dumps({"rxntype": "b1f1", "split": "train", "DE": 1.5, "u": [1, 2], "who": {"a": "x"}})), (2, json.dumps({"rxntype": "b1f1", "split": "val", "DE": "2.5"})),
    (3, json.dumps({"rxntype": "b0f2", "DE": None, "u": "none"})), (4, json.dumps([1, 2])), (5, "{broken"), (6, None), (7, json.dumps({"rxntype": "b2f0", "split": "val", "big": 2**70, "text": "é\n"})),
]


def test_documents_of_any_shape(spark, tmp_path):
    path = str(tmp_path / "docs")
    back = store.write_documents(spark.createDataFrame(DOCS, "graph_id long, doc string"), path, fields={"split": "string"})
    rows = {r.graph_id: r for r in back.select("graph_id", "rxntype", "split", F.to_json("doc").alias("json")).collect()}
    for k, t in DOCS:
        try:
            want = json.loads(t) if t is not None else None
        except ValueError:
            want = None
        assert (json.loads(rows[k].json) if rows[k].json else None) == want
        assert rows[k].rxntype == (want.get("rxntype") if isinstance(want, dict) else None)
    schema = "graph_id long, doc variant, split string, rxntype string"
    some = store.read_documents(spark, path, schema, ["b1f1", "b2f0"], ["val"])
    assert sorted(r.graph_id for r in some.select("graph_id").collect()) == [2, 7]
    told = plan(some)
    assert "PartitionFilters: [" in told and "rxntype" in told.split("PartitionFilters")[1] and "In(split" in told.split("PushedFilters")[1] or "EqualTo(split" in told.split("PushedFilters")[1]
    assert [r.graph_id for r in store.read_documents(spark, path, schema, "^b0").select("graph_id").collect()] == [3]
    got = {r.graph_id: (r.energy, r.second, r.who) for r in store.extract(back, {"energy": ("$.DE", "double"), "second": ("$.u[1]", "int"), "who": ("$.who.a", "string")}).select("graph_id", "energy", "second", "who").collect()}
    assert got[1] == (1.5, 2, "x") and got[2] == (2.5, None, None) and got[3] == (None, None, None) and got[6] == (None, None, None)


def test_one_pass_for_rows_and_rejects(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).select(F.col("id").alias("graph_id"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("x"), F.lit("mine").alias("outcome")).repartition(3)
    df = df.mapInArrow(see, df.schema)
    kept, rejects, counts = store.write_checked(df, str(tmp_path / "out"), "build", {"too large": F.col("x") > 80, "1": F.col("x") % 10 == 3})
    assert seen.value == 100 and kept.columns == ["graph_id", "x", "outcome"]
    got = {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()}
    assert got == {k: n for k, n in counts.items() if k != "ok"} and counts["ok"] == kept.count() and sum(counts.values()) == 100
    assert {r.stage for r in rejects.collect()} == {"build"} and kept.filter("x is null").count() == 12
    assert seen.value == 100
    empty = store.write_checked(df.limit(0), str(tmp_path / "none"), "build", {"1": F.col("x") > 0})
    assert empty[0].count() == 0 and empty[2] == {"ok": 0, "1": 0}
    with pytest.raises(ValueError):
        store.write_checked(df, str(tmp_path / "bad"), "build", {"ok": F.lit(True)})


@pytest.fixture()
def ranges(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "150"), ("spark.sql.files.openCostInBytes", "10")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def frame(n, tag, comment="energy: 1 q 0"):
    return [str(n), comment, *[f"C {tag}.{k} {k}.5 -1e-3" for k in range(n)]]


def test_lines_of_one_file_by_many_tasks(spark, tmp_path, ranges):
    want = [f"line {i} " + "x" * (i % 37) if i % 5 else "" for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    (tmp_path / "b.txt").write_text("one\ntwo")
    (tmp_path / "c.txt").write_text("")
    assert spark.read.text(str(tmp_path / "a.txt")).select(F.spark_partition_id()).distinct().count() > 10
    got = lines.read_lines(spark, str(tmp_path)).collect()
    assert [r.line for r in sorted((r for r in got if r.file.endswith("a.txt")), key=lambda r: r.line_no)] == want
    assert sorted((r.line_no, r.line) for r in got if r.file.endswith("b.txt")) == [(0, "one"), (1, "two")]
    assert sorted(r.line_no for r in got if r.file.endswith("a.txt")) == list(range(400))


def test_frames_of_one_file_equal_the_whole_text(spark, tmp_path, ranges):
    body = [x for k in range(60) for x in frame(1 + k % 7, k, str(k) if k % 4 == 0 else f"comment {k}")]
    (tmp_path / "t.xyz").write_text("\n".join(body) + "\n")
    coords, rejects = lines.read_frames(spark, str(tmp_path / "t.xyz"))
    got = sorted((r.frame, r.node, r.element, r.x, r.y, r.z) for r in coords.collect())
    assert got == sorted((k, v + 1, "C", float(f"{k}.{v}"), v + 0.5, -1e-3) for k in range(60) for v in range(1 + k % 7)) and rejects.count() == 0
    same = [x for k in range(20) for x in frame(3, k)]
    (tmp_path / "s.xyz").write_text("\n".join(same))
    whole = text.explode_frames(spark.createDataFrame([(1, "\n".join(same))], "graph_id long, text string"))[0]
    ours = lines.read_frames(spark, str(tmp_path / "s.xyz"))[0]
    pick = lambda df: sorted(tuple(r) for r in df.select("frame", "node", "element", "x", "y", "z").collect())
    assert pick(whole) == pick(ours)


def test_broken_frames_are_rejected(spark, tmp_path, ranges):
    body = ["stray", *frame(2, 1), "3", "short", "C 1 2 3", *frame(2, 2), "2", "bad", "C 1 x 3", "C 1 2 3", "", "2", "end", "C 1 2 3"]
    (tmp_path / "t.xyz").write_text("\n".join(body))
    coords, rejects = lines.read_frames(spark, str(tmp_path / "t.xyz"))
    assert sorted({r.frame for r in coords.collect()}) == [0, 2]
    told = sorted((r.line_no, r.reason) for r in rejects.collect())
    assert (0, "outside frames") in told and {n for n, x in told if x == "broken frame"} == {5, 12, 17}


def test_frames_are_not_broadcast(spark, tmp_path):
    (tmp_path / "t.xyz").write_text("\n".join(x for k in range(40) for x in frame(2, k)))
    own = spark.newSession()  # its broadcast threshold is Spark's usual one
    coords = lines.read_frames(own, str(tmp_path / "t.xyz"))[0]
    assert coords.count() == 80
    assert "Broadcast" not in coords._jdf.queryExecution().executedPlan().toString()
