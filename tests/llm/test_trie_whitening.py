"""Conversation tries and whitening against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxnframe.llm import conversation_trie as trie
from rxnframe.llm import entry, whitening
from tests.compare import assert_same, connect

TURNS = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def head(c):
    return zlib.crc32(str(c).encode()) % 6


def sequences(rows):
    """conv_id -> its rebuilt turns, from rows (conv_id, turn, role, text) without equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: head(c)] + t[head(c) :] for c, t in own.items()}


def brute(seqs):
    """Nodes of a dict of sequences, by walking every prefix."""
    members = defaultdict(list)
    for c, t in seqs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p))))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    )


def got(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def query(df):
    c = F.col("conv_id")
    return trie.prefix_trie(trie.rebuilt(df, c - c % 100, (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")))


def talk(n, seed, long=0):
    """Conversations that share first turns, copies of one conversation, turnless rebuilt ones, null turns, and some of `long` turns."""
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-300, 900), n):
        size = rnd.randint(1, 7) if not long or rnd.random() < 0.9 else rnd.randint(long // 2, long)
        same = rnd.random() < 0.4
        for t in range(size):
            text = "hi" if same else rnd.choice(["é", "", None, "no no", "🙂🙂"])
            rows.append((c, None if t == 0 and rnd.random() < 0.3 else t, rnd.choice(["user", None]) if not same else "user", text))
    return rows


@pytest.mark.parametrize("shard,long", [(1 << 14, 0), (8, 0), (40, 60)])
def test_trie_against_brute_force(spark, monkeypatch, shard, long):
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = talk(300, shard, long)
    assert got(query(spark.createDataFrame(rows, TURNS))) == brute(sequences(rows))


def test_one_large_group_of_copies_splits(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 64)
    rows = [(c, t, "user", "same" if c < 700 or t < 2 else str(c)) for c in range(1000) for t in range(4)]
    df = spark.createDataFrame(rows, TURNS)
    seqs = {c: [("user", "same" if c < 700 or t < 2 else str(c)) for t in range(4)] for c in range(1000)}
    assert got(trie.prefix_trie(trie.turn_ids(df))) == brute(seqs)
    flat = trie.turn_ids(df).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.id)), "")).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    sizes = [r.n for r in trie._shards(flat).select("n").collect()]
    assert len(sizes) > 20 and max(sizes) < 200 and sum(sizes) == 1000


def test_trie_edges(spark):
    df = spark.createDataFrame([(None, 1, "user", "lost"), (7, None, None, None), (8, 0, "user", "x" * 200_000)], TURNS)
    for c in ("turns", "part", "ends", "seq", "base", "h"):
        df = df.withColumn(c, F.lit("mine"))
    seqs = {7: [("", "")], 8: [("user", "x" * 200_000)]}
    assert got(trie.prefix_trie(trie.turn_ids(df))) == brute(seqs)
    rebuilt = {c: ([] + t[head(c) :]) for c, t in seqs.items()}
    assert got(query(df)) == brute(rebuilt)  # the base conversation is absent, so turns are lost and conversations may be turnless
    assert query(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 0, "a", "b"), (1, 0, "a", "b")], TURNS)
    assert got(trie.prefix_trie(trie.turn_ids(twice))) == brute({1: [("a", "b"), ("a", "b")]})


def test_role_and_text_are_told_apart(spark):
    df = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "1:a", "b"), (4, 0, "1", ":ab")], TURNS)
    assert trie.prefix_trie(trie.turn_ids(df)).filter("depth = 1").count() == 4


def test_op11_matches_sql_on_the_middle_tables(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(entry.op11_conversation_trie(spark, sf), connect(sf), entry.SQL["op11_conversation_trie"])


# Whitening


def expected(vectors, k=8):
    x = np.floor(np.array(vectors, float) * 1024) + 100_000
    xi, n = x.astype(np.int64), len(x)
    c = x - xi.sum(0) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    return ((n * xi - xi.sum(0)) ** 2).sum(1), c @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_op13(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    dev, white, share = expected([r.embedding for r in rows])
    out = {(r.vec_id, r.component): r for r in entry.op13_embedding_whitening(spark, small).collect()}
    assert len(out) == 8 * len(rows)
    for i, r in enumerate(rows):
        for j in range(8):
            o = out[r.vec_id, j + 1]
            assert (o.n, o.deviation) == (len(rows), dev[i])
            assert abs(o.explained / share[j] - 1) < 1e-9 and o.identity_error < 1e-9
    signs = [np.sign(sum(out[r.vec_id, j + 1].whitened * white[i, j] for i, r in enumerate(rows))) for j in range(8)]
    assert max(abs(out[r.vec_id, j + 1].whitened - signs[j] * white[i, j]) for i, r in enumerate(rows) for j in range(8)) < 1e-8


@pytest.mark.parametrize("n", [1, 2, 5, 8, 33])
def test_eigenpairs(n):
    rnd = np.random.default_rng(n)
    scale = 10.0 ** -np.arange(n)[::-1].clip(0, 6)
    a = rnd.normal(size=(n, n)) * scale[:, None]
    a = a @ a.T
    low, pivot = whitening.cholesky(a)
    assert np.allclose(low @ low.T, a[np.ix_(pivot, pivot)], rtol=1e-12)
    values, vectors = whitening.jacobi(low, pivot)
    assert np.allclose(values[0], np.linalg.eigvalsh(a)[-1], rtol=1e-12) and (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: the least eigenvalue is 1e-12 of the largest and still right to ten digits."""
    d = np.array([1e6, 1.0, 1e-6])
    core = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    values, _ = whitening.jacobi(*whitening.cholesky(core * np.outer(d, d) ** 0.5))
    from fractions import Fraction  # characteristic polynomial in exact numbers, by bisection

    m = [[Fraction(float(x)) for x in row] for row in core * np.outer(d, d) ** 0.5]

    def det(t):
        a = [[m[i][j] - (t if i == j else 0) for j in range(3)] for i in range(3)]
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    lo, hi = Fraction(0), Fraction(float(values[2])) * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if det(mid) > 0 else (lo, mid)
    assert abs(values[2] / float(lo) - 1) < 1e-10


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rnd = np.random.default_rng(2)
    good = rnd.normal(size=(40, 3)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 2.0]), (93, [1.0, inf, 2.0]), (94, []), (95, [1.0, 2.0]), (None, good[0]), (0, good[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("mine")).withColumn("n", F.lit("mine")).withColumn("component", F.lit(1))
    kept = [*good, good[0], good[0]]
    dev, white, share = expected(kept)
    out = whitening.whiten(df).collect()
    assert len(out) == len(kept) * 3 and {r.vec_id for r in out} == {*range(40), None}
    for r in out:
        if r.vec_id is not None:
            assert int(r.deviation) == dev[r.vec_id] and abs(abs(r.whitened) - abs(white[r.vec_id, r.component - 1])) < 1e-9
    flat = spark.createDataFrame([(i, [1.0, float(i % 3), 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    assert whitening.whiten(flat.filter("vec_id = 0")).count() == 0
    assert whitening.whiten(flat.limit(0)).count() == 0 and whitening.whiten(flat.filter("vec_id < 0")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(x), 0.5]) for i, x in enumerate([4e9, -4e9, 3e9, 1.0])]
    out = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()}
    xs = [[int(1024 * x) + 100_000 for x in v] for _, v in rows]
    s = [sum(c) for c in zip(*xs)]
    assert out == {i: sum((4 * a - b) ** 2 for a, b in zip(x, s)) for i, x in enumerate(xs)} and max(out.values()) > 1 << 63
