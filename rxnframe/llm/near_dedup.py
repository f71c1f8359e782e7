"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass makes each document's distinct shingle hashes, a digest of that set and a MinHash signature.
   Equal sets collapse to the smallest id before anything else.
2. Signature bands give buckets. Every document is first compared with one of its buckets' smallest ids, that with which it shares most
   bands, which links near copies to classes in linear time.
3. What candidates are left shares a bucket, but no class. In each bucket with several classes the members outside its largest
   one meet all members, as ids and signatures in tiles of TILE members, so a bucket of near copies costs its own size. A
   pair counts in the first band that it shares.
4. Signatures are compared batch by batch; a pair is dropped as soon as the posterior probability of the wanted
   similarity falls under MISS. Only documents with a survivor in a tile fetch their texts, once for a part of the tile, and are
   verified on full shingle sets, the likeliest pairs first, unless links of that part connect their classes already. Pairs are
   never sent, and no link between classes is lost.

A bucket without a large class still compares its members outside it with all of them by signature, so that work grows with
the square of a bucket of documents that resemble each other without being near-duplicates; rows sent grow with 1 / TILE of it.

Null or wordless texts have no shingles and link with nothing. Rows with a null id are not compared and have a null
component. Rows that repeat an id are one node. Extra columns are ignored, an empty table gives an empty result.

Bands follow from the wanted similarity: a pair that just reaches it shares no band with probability LOST at most.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, lean, mix, rolling, row_ranges, table, utf8, words
from rxnframe.llm.components import components

ROWS, BANDS, BATCH, MISS = 6, 20, 24, 1e-6
LOST, MINIMA = 1e-4, 128
BLOCK, TILE, PART = 64, 512, 128


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row; the whole sequence if it is shorter."""
    _, _, first, h = words(data, off, lower=True)
    roll = rolling(h, k)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            out.append(mix(rolling(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@cache
def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima of each non-empty set, as 32-bit numbers."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    for k, m in enumerate(_multipliers(n)):
        out[:, k] = np.minimum.reduceat(flat * m, at) >> np.uint64(32)
    return out


SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def sketch(docs: DataFrame, k: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles and, unless there are none, digest, band keys and signature."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            for a, b in row_ranges(off):
                sets = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, keys, sig = ([None] * len(sets) for _ in range(3))
                if full:
                    some = [sets[i] for i in full]
                    s = signatures(some, rows * bands)
                    flat, at = np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
                    d = np.stack([np.add.reduceat(mix(flat ^ np.uint64(c)), at) for c in (0, 0x5DEECE66D)], 1)
                    weights = _multipliers(rows)
                    band = mix((s.astype(np.uint64).reshape(len(some), bands, rows) * weights).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    for i, x, y, z in zip(full, d, band.tolist(), s):
                        digest[i], keys[i], sig[i] = x.tobytes(), y, z.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "bands", "signature"],
                )

    return lean(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


@cache
def least_matches(n: int, t: float, miss: float) -> int:
    """Fewest of n equal minima at which P(similarity >= t) is at least `miss`, from a uniform prior."""
    tail, m = 0.0, -1
    while tail < miss:
        m += 1
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
    return m


@cache
def banding(percent: int) -> tuple[int, int]:
    """Rows and bands at which a pair of similarity percent / 100 shares no band with probability LOST at most: the longest bands that MINIMA minima allow, else bands of one."""
    found = 1, 1
    for rows in range(1, MINIMA + 1):
        hit = (max(percent, 1) / 100) ** rows
        bands = ceil(log(LOST) / log1p(-hit)) if hit < 1 else 1
        if rows == 1 or rows * bands <= MINIMA:
            found = rows, bands
    return found


def surviving(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures x, each with its own one or the only one of y: the numbers of those that stay likely after every batch, and their equal minima."""
    at, n = np.arange(len(x)), x.shape[1]
    same = np.zeros(len(x), np.int64)
    for a in range(0, n, BATCH):
        same += (x[at, a : a + BATCH] == (y[at, a : a + BATCH] if len(y) > 1 else y[:, a : a + BATCH])).sum(1)
        keep = same >= least_matches(min(n, a + BATCH), percent / 100, MISS)
        at, same = at[keep], same[keep]
    return at, same


def near_size(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that survive their signatures."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            some = np.flatnonzero(near_size(n, m, percent))
            x, y = (_matrix(batch.column(c).take(pa.array(some))) for c in ("s_a", "s_b")) if len(some) else (np.zeros((0, BATCH), np.uint32),) * 2
            yield batch.select(["a", "b"]).take(pa.array(some[surviving(x, y, percent)[0]] if len(some) else some))

    out = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return lean(out).mapInArrow(run, "a long, b long")


def meet_texts(rows: DataFrame, key: list[str], k: int, percent: int) -> DataFrame:
    """Links (a, b) of rows (key, id, class, probe, partners, text) that share a key: probes with those of their partners that are not in their class yet, on full shingle sets. A task holds the other side of one key."""

    def run(batches):
        at, sets, up = None, {}, {}

        def find(i):
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        for batch in batches:
            data, off = utf8(batch, "text")
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            ids, kind, probe, partners = (batch.column(c).to_pylist() for c in ("id", "class", "probe", "partners"))
            links = []
            for a, b in row_ranges(off):
                for i, own in zip(range(a, b), shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)):
                    if keys[i] != at:
                        at, sets, up = keys[i], {}, {}
                    if not probe[i]:
                        sets.setdefault(ids[i], []).append((kind[i], own))
                        continue
                    for j in partners[i]:
                        for other_kind, other in sets.get(j, ()):
                            if find(kind[i]) == find(other_kind):
                                continue
                            both = len(np.intersect1d(own, other, assume_unique=True)) if near_size(len(own), len(other), percent) else 0
                            if both and 100 * both >= percent * (len(own) + len(other) - both):
                                up[find(kind[i])] = find(other_kind)
                                links.append((ids[i], j))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return lean(rows.repartition(*key).sortWithinPartitions(*key, "probe")).mapInArrow(run, "a long, b long")


def star_links(stars: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among pairs (a, b) of a document and a bucket's smallest id. A hot b meets its partners in blocks."""
    pairs = table(prune(stars, nodes, percent))
    crowds = table(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    placed = pairs.join(crowds, "b").select("b", F.expr("pmod(xxhash64(a), blocks)").alias("block"), "a")
    both = F.inline(F.expr("array(struct(a as id, b as partner), struct(b as id, cast(null as bigint) as partner))"))
    rows = placed.select(F.col("b").alias("crowd"), "block", both).groupBy("crowd", "block", "id", F.col("partner").isNotNull().alias("probe")).agg(F.collect_set("partner").alias("partners"))
    rows = rows.withColumn("class", F.col("id")).join(texts, "id")
    out = table(meet_texts(rows, ["crowd", "block"], k, percent))
    discard(pairs, crowds)
    return out


PARTS = "band long, block long, chunk long, part int, id long, class long, probe boolean, partners array<long>"


def bucket_links(members: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes. members (id, band, which): buckets, and which of the bands they belong to; a pair counts in the first band that it shares."""
    own = members.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    own = table(own)
    counts = own.groupBy("band", "class").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.max_by("class", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).filter("all > most")
    tiles = table(mixed.select("band", "main", F.ceil(F.col("all") / TILE).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / TILE).alias("chunks")))
    rows = own.join(tiles, "band").join(nodes.select("id", "n", "signature"), "id")
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(id), blocks)")).withColumn("chunk", F.expr("pmod(xxhash64(id, 3), chunks)"))
    # A member is at home in its block for every chunk of probes; one outside the largest class probes every block.
    home = F.expr("transform(sequence(0L, chunks - 1), c -> struct(block as block, c as chunk, false as probe))")
    probe = F.when(F.col("class") != F.col("main"), F.expr("transform(sequence(0L, blocks - 1), b -> struct(b as block, chunk as chunk, true as probe))"))
    key = ["band", "block", "chunk"]
    inner = (F.col("class") == F.col("main")).alias("inner")
    meet = rows.select("band", "which", "id", "class", inner, "n", "signature", F.inline(F.concat(home, F.coalesce(probe, F.filter(home, lambda _: F.lit(False))))))
    shape = banding(percent)[::-1]

    def candidates(batches):
        at, home, probe = None, [], []
        schema = pa.schema([(c, pa.int64()) for c in key] + [("part", pa.int32()), ("id", pa.int64()), ("class", pa.int64()), ("probe", pa.bool_()), ("partners", pa.list_(pa.int64()))])

        def done():
            if not home or not probe:
                return
            which, ids, kind, inner, n = (np.concatenate([x[c] for x in home]) for c in range(5))
            sig = np.concatenate([x[5] for x in home])
            out: list[tuple] = []
            used: dict[int, set[int]] = {}
            for turn, (i, c, m, s) in enumerate(row for some in probe for row in zip(some[1].tolist(), some[2].tolist(), some[4].tolist(), some[5])):
                near = np.flatnonzero((kind != c) & (inner | (ids > i)) & near_size(n, np.int64(m), percent))  # of two outside the largest class once
                got, same = surviving(sig[near], s[None], percent)
                equal = (sig[near[got]].reshape(-1, *shape) == s.reshape(shape)).all(2)
                first = (equal.argmax(1) == which[0]) | ~equal.any(1)
                got = near[got[first]][np.argsort(-same[first], kind="stable")]
                for base in np.unique(got // PART).tolist():
                    some, part = got[got // PART == base], base * TILE + turn // PART
                    used.setdefault(part, set()).update(some.tolist())
                    out.append((part, i, c, True, ids[some].tolist()))
            out += [(part, int(ids[j]), int(kind[j]), False, None) for part, js in used.items() for j in sorted(js)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(out), pa.int64()) for x in at), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[3:]))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "probe")], 1)
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("which", "id", "class", "inner", "n")]
            cols[3] = cols[3].astype(bool)
            sig = _matrix(batch.column("signature"))
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
            for a, b in zip(cut, [*cut[1:], len(keys)]):
                if at != (now := tuple(keys[a, :3].tolist())):
                    yield from done()
                    at, home, probe = now, [], []
                (probe if keys[a, 3] else home).append([*(c[a:b] for c in cols), sig[a:b]])
        yield from done()

    parts = table(lean(meet.repartition(*key).sortWithinPartitions(*key, "probe")).mapInArrow(candidates, PARTS))
    key = [*key, "part"]
    out = table(meet_texts(parts.join(texts, "id"), key, k, percent))
    discard(own, tiles, parts)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text); linked if 100 * |A and B| >= percent * |A or B|."""
    rows = table(sketch(docs, k, *banding(percent)))
    some = rows.filter("doc_id is not null and digest is not null")
    sets = table(some.groupBy("digest").agg(F.min("doc_id").alias("id")))
    nodes = some.select("digest", F.col("doc_id").alias("id"), "bands").join(sets, ["digest", "id"]).dropDuplicates(["digest", "id"])
    nodes = table(nodes.select("id", "bands"))
    member = nodes.select("id", F.posexplode("bands").alias("which", "band"))
    buckets = table(member.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("band", "low"))
    members = table(member.join(buckets, "band"))
    shared = members.filter("id <> low").groupBy(F.col("id").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("bands"))
    stars = shared.groupBy("a").agg(F.max_by("b", "bands").alias("b"))
    wanted = members.select("id").distinct()
    texts = table(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.hint("merge"), "id"))  # the same way at every size
    some = table(some.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature").join(wanted, "id"))
    links = star_links(stars, some, texts, k, percent)
    more = bucket_links(members.select("id", "which", "band"), some, components(links), texts, k, percent)
    classes = components(links.unionByName(more))
    discard(nodes, buckets, members, texts, some)
    labels = table(sets.join(classes.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")))
    keyed = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = keyed.join(labels, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
