"""Greedy tolerance dedup against a serial loop."""

import random

import pytest

from rxnframe.operators import selection, tolerance
from tests.compare import assert_same, connect


def serial(rows, eps):
    """ids kept, from rows (key, value, arrival)."""
    kept, out = {}, set()
    for k, v, a in sorted((r for r in rows if r[1] is not None and r[1] == r[1]), key=lambda r: (r[2], r[1])):
        if all(abs(v - x) > eps for x in kept.setdefault(k, [])):
            kept[k].append(v)
            out.add((k, v, a))
    return out


def cases(kind, n, seed=3):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["a", "b", None, *"cdefgh"]) if kind == "keys" else "a"
    if kind == "chain":  # each follows the one before by a little less than eps
        return [("a", i * 0.7, i) for i in range(n)]
    if kind == "back":
        return [("a", -i * 0.45, i) for i in range(n)]
    if kind == "equal":
        return [("a", 5.0, i) for i in range(n)]
    if kind == "dense":
        return [("a", rnd.random() * 6, i) for i in range(n)]
    return [(key(), round(rnd.uniform(-n / 8, n / 8), 2), i) for i in rnd.sample(range(10 * n), n)]


@pytest.mark.parametrize("kind", ["keys", "random", "chain", "back", "equal", "dense"])
@pytest.mark.parametrize("limit", [200_000, 60])
def test_equals_serial_loop(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(tolerance, "LIMIT", limit)
    monkeypatch.setattr(tolerance, "RANGE", 25)
    rows = cases(kind, 500)
    df = spark.createDataFrame(rows, "key string, value double, arrival long")
    got = {tuple(r) for r in selection.dedupe_within(df, "key", "value", "arrival", 1.0).collect()}
    assert got == serial(rows, 1.0)


def test_one_key_with_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'a' as key", "pmod(id * 7919, 1000003) / 4.0 as value", "pmod(id * 104729, 1000000) as arrival")
    from bisect import bisect_left, insort

    kept = []
    for _, v in sorted((i * 104729 % 1_000_000, i * 7919 % 1_000_003 / 4.0) for i in range(n)):
        at = bisect_left(kept, v)
        if all(abs(v - x) > 3 for x in kept[max(0, at - 1) : at + 1]):
            insort(kept, v)
    got = [r.value for r in selection.dedupe_within(df, "key", "value", "arrival", 3.0).select("value").collect()]
    assert sorted(got) == kept


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", None, 0, "x"), ("a", nan, 1, "x"), ("a", inf, 2, "x"), ("a", 1.0, 4, "late"), ("a", 1.0, 3, "early"), (None, 1.0, 5, "x"), ("a", 1.5, 6, "x")], "key string, value double, arrival long, kept string")
    assert {(r.key, r.value, r.kept) for r in selection.dedupe_within(df, "key", "value", "arrival", 1.0).collect()} == {("a", 1.0, "early"), (None, 1.0, "x")}
    assert {(r.key, r.value) for r in selection.dedupe_within(df, "key", "value", "arrival", 0.0).collect()} == {("a", 1.0), (None, 1.0), ("a", 1.5)}
    assert selection.dedupe_within(df.limit(0), "key", "value", "arrival", 1.0).count() == 0


def test_registry_keeps_what_only_a_dropped_state_is_near_to(spark):
    rows = [("i", "unintended", "s0", 0.0, 0), ("i", "intended", "s1", 0.006, 1), ("i", "unintended", "s2", 0.012, 2)]
    out = selection.build_registry(spark.createDataFrame(rows, "reaction_index string, rtype string, source string, energy double, arrival long")).collect()
    assert [(r.rtype, [(s.ts_ind, s.source) for s in r.states]) for r in out] == [("unintended", [(0, "s0"), (1, "s2")])]


@pytest.mark.parametrize("name", ["d5_dedupe_within_greedy", "d6_build_registry"])
def test_queries_on_the_middle_tables(spark, name):
    from rxnframe.plans import registry

    sf = "/root/testdata/sf0.01"
    assert_same(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])
