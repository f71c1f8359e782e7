"""Distances, rings and walk sums of whole graphs in one pass, against plain searches, with graphs cut by batches and larger than a word of bits."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rxnframe.operators import graphs as G
from rxnframe.operators import hops, rings
from tests.test_canonical import cage, drawn, frames, ring, union

ATOMS, BONDS = "graph_id long, node long, element string, charge long", "graph_id long, u long, v long, ord long"


def neighbours(graph):
    labels, edges = graph
    near = {v: set() for v in range(len(labels))}
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    return near


def bfs(near, sources):
    seen, layer, d = {s: 0 for s in sources}, set(sources), 0
    while layer:
        d += 1
        layer = {w for v in layer for w in near[v]} - seen.keys()
        seen |= dict.fromkeys(layer, d)
    return seen


def chain(n):
    return ["C"] * n, {(i, i + 1): 1 for i in range(n - 1)}


def some(seed, n=30):
    rnd = random.Random(seed)
    return [drawn(rnd, rnd.randint(1, 14), rnd.randint(0, 16)) for _ in range(n)] + [chain(150), ring(70), (["C"], {}), union(chain(40), chain(65))]


@pytest.mark.parametrize("words", [16, 1])
def test_distances(spark, monkeypatch, words):
    graphs = some(1)
    atoms, bonds = frames(spark, graphs)
    got = {(r.graph_id, r.u, r.v): r.hops for r in hops.graph_distances(bonds, atoms).collect()}
    want = {}
    for k, g in enumerate(graphs):
        near = neighbours(g)
        for s in near:
            d = bfs(near, [s])
            want |= {(k, s, v): d.get(v, 100) for v in near}
    assert got == want
    few = {(r.graph_id, r.u, r.v): r.hops for r in hops.graph_distances(bonds, atoms, max_hops=3, unreachable=-1).collect()}
    assert few == {x: d if d <= 3 else -1 for x, d in want.items()}


def test_distances_in_blocks_of_sources(monkeypatch):
    """A graph with more sources than a block of bits holds."""
    import numpy as np

    monkeypatch.setattr(hops, "WORDS", 1)
    g = object.__new__(hops.Graphs)
    n = 200
    g.rows, g.graph, g.node, g.first = np.arange(n), np.zeros(n, int), np.arange(n), np.array([0])
    e = sorted([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)])
    g.i, g.j, g.weight = (np.array(x) for x in (*zip(*e), np.ones(len(e), int)))
    out = {}
    for s, v, h in hops.search(g, np.arange(n) % 2 == 0, None):
        out |= {(a, b): c for a, b, c in zip(s.tolist(), v.tolist(), h.tolist())}
    assert out == {(a, b): abs(a - b) for a in range(0, n, 2) for b in range(n)}


def test_seeds(spark):
    graphs = some(2)
    atoms, bonds = frames(spark, graphs)
    rnd = random.Random(5)
    seeds = [(k, v) for k, (labels, _) in enumerate(graphs) for v in range(len(labels)) if rnd.random() < 0.2] + [(0, 999), (999, 0), (None, 1), (1, None)]
    df = spark.createDataFrame(seeds + seeds[:3], "graph_id long, node long")
    mine = {k: [v for g, v in seeds if g == k and v is not None and v < len(graphs[k][0])] for k in range(len(graphs))}
    near = {(r.graph_id, r.node): r.hops for r in hops.distance_to_set(bonds, atoms, df).collect()}
    found = {(r.graph_id, r.source, r.node): r.hops for r in hops.hops_from(bonds, atoms, df, 4).collect()}
    want_near, want = {}, {}
    for k, g in enumerate(graphs):
        d = bfs(neighbours(g), mine[k])
        want_near |= {(k, v): d.get(v, 100) for v in range(len(g[0]))}
        for s in mine[k]:
            want |= {(k, s, v): h for v, h in bfs(neighbours(g), [s]).items() if h <= 4}
    assert near == want_near and found == want


def test_bond_distances(spark):
    atoms, bonds = frames(spark, [chain(10), union(chain(3), chain(3))])
    changed = spark.createDataFrame([(0, 0, 1), (0, 4, 5), (0, 8, 9), (1, 0, 1), (1, 3, 4), (2, 0, 1)], "graph_id long, u long, v long")
    got = {r.graph_id: (r.nearest, r.farthest) for r in hops.bond_distances(bonds, atoms, changed).collect()}
    assert got == {0: (3, 7), 1: (100, 100), 2: (0, 0)}


def chordless(graph, most):
    near, found = neighbours(graph), set()
    for size in range(3, most + 1):
        for c in itertools.combinations(near, size):
            inside = {v: near[v] & set(c) for v in c}
            if all(len(x) == 2 for x in inside.values()) and len(bfs(inside, [c[0]])) == size:
                walk, v = [c[0]], min(inside[c[0]])
                while v != c[0]:
                    walk.append(v)
                    v = next(w for w in inside[v] if w != walk[-2])
                found.add(tuple(walk))
    return found


def test_rings_against_all_subsets(spark):
    rnd = random.Random(4)
    graphs = [drawn(rnd, rnd.randint(3, 10), rnd.randint(3, 15)) for _ in range(60)] + [cage(4), ring(9), union(ring(4), chain(5), cage(3))]
    got: dict[int, set] = {}
    for r in rings.find_rings(frames(spark, graphs)[1], 9).collect():
        got.setdefault(r.graph_id, set()).add(tuple(r.ring))
        assert r.size == len(r.ring)
    for k, g in enumerate(graphs):
        assert got.get(k, set()) == chordless(g, 9)


def fullerene():
    """60 atoms, three bonds each: 12 rings of five and 20 of six, from the truncated icosahedron's coordinates."""
    phi = (1 + 5**0.5) / 2
    base = [(0, 1, 3 * phi), (1, 2 + phi, 2 * phi), (phi, 2, 2 * phi + 1)]
    points = {tuple(round(s * x, 6) + 0.0 for s, x in zip(signs, (b[k % 3], b[(k + 1) % 3], b[(k + 2) % 3]))) for b in base for k in range(3) for signs in itertools.product((1, -1), repeat=3)}
    points = sorted(points)
    edges = {(i, j): 1 for i, j in itertools.combinations(range(60), 2) if abs(sum((a - b) ** 2 for a, b in zip(points[i], points[j])) - 4) < 1e-3}
    return ["C"] * 60, edges


def test_cage_of_sixty_atoms(spark):
    g = fullerene()
    assert len(g[1]) == 90
    out = rings.find_rings(frames(spark, [g])[1], 20)
    sizes = {r["size"]: r["count"] for r in out.groupBy("size").count().collect()}
    assert sizes[5] == 12 and sizes[6] == 20 and 7 not in sizes and max(sizes) <= 20


def test_trees_and_odd_rows(spark):
    bonds = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1), (None, 1, 2, 1), (1, 1, 1, 1), (2, None, 1, 1)], BONDS)
    assert rings.find_rings(bonds).count() == 0 and rings.find_rings(bonds.limit(0)).count() == 0
    twenty = frames(spark, [ring(20), ring(21)])[1]
    assert [r["size"] for r in rings.find_rings(twenty).collect()] == [20]


def walks(near, mass, a, gens):
    total, layer = mass[a] * 0.1, [(a,)]
    for depth in range(1, gens + 1):
        layer = [(*p, w) for p in layer for w in near[p[-1]] if w not in p]
        total += sum(mass[p[-1]] * 0.1 * 0.1**depth for p in layer)
    return total


@pytest.mark.parametrize("held", [1 << 20, 8])
def test_walk_sums(spark, held):
    graphs = [*some(6, 12)[:-4], cage(5), chain(70)]
    atoms, bonds = frames(spark, graphs)
    atoms = atoms.withColumn("mass", (F.col("node") % 5 + 1).cast("double"))
    if held == 8:
        import numpy as np

        g = object.__new__(rings.Graphs)
        near = neighbours(cage(5))
        e = sorted((v, w) for v in near for w in near[v])
        g.rows, g.graph, g.node, g.first = np.arange(10), np.zeros(10, int), np.arange(10), np.array([0])
        g.i, g.j, g.weight = (np.array(x) for x in (*zip(*e), np.ones(len(e), int)))
        before, rings.WALKS = rings.WALKS, 8
        out = rings.walk_sums(g, np.arange(10.0), 0.1, 6)
        rings.WALKS = before
        assert all(abs(out[v] - walks(near, list(range(10)), v, 6)) < 1e-9 for v in near)
        return
    for r in rings.atom_hash(bonds, atoms, gens=6).collect():
        near = neighbours(graphs[r.graph_id])
        assert abs(r.hash - 100 * len(near[r.node]) - walks(near, {v: v % 5 + 1 for v in near}, r.node, 6)) < 2e-6


def test_one_shuffle_and_no_round(spark):
    atoms, bonds = frames(spark, [ring(5)])
    for df in (hops.graph_distances(bonds, atoms), rings.find_rings(bonds), hops.distance_to_set(bonds, atoms, atoms), G.atom_hash(bonds, atoms.withColumn("mass", F.lit(1.0)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_graphs_cut_by_batches(spark):
    from rxnframe.operators import pergraph

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        graphs = some(9)
        atoms, bonds = frames(spark, graphs)
        assert hops.graph_distances(bonds, atoms).count() == sum(len(x[0]) ** 2 for x in graphs)
        assert {tuple(r.ring) for r in rings.find_rings(bonds, 9).filter("graph_id < 20").collect()} == {w for g in graphs[:20] for w in chordless(g, 9)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert pergraph.ROWS > 0
