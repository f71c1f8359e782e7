"""Removal of long word passages that a smaller document already holds, on a De Bruijn graph of token k-mers.

Words `[^\\x20\\x09-\\x0D]+` are hashed. Every window of `window` words holds k-mers of window // 3 words; the least of their
hashes is the window's edge, so equal windows lie on one edge wherever they occur. Consecutive windows of a document on one
edge are a step of that document: one record (document, place, number of windows, edge, hash of all its words).

1. Edges that two documents share are kept, and with them their steps. Equal steps are one node, with the place of its
   least document as source coordinates. An edge with one node only doesn't branch there.
2. Nodes are linked as documents run through them. A link that is its first node's only way out and its second one's
   only way in, at source coordinates that run on, doesn't branch; such links compact into paths by pointer doubling.
   A document's steps along one path compact into one span.
3. On edges with several nodes single windows decide: those of each node's least document are compared by hash, and
   the least document of each window is its source.
4. Words of paths and of windows' sources are cut out at their source coordinates and sent to the spans. A document
   loses a span only if its own words equal these, so no chance of the hashes removes a word.

All of this is joins and grouped minima that combine before the shuffle; joins are on written tables, so that a hot edge, node
or passage splits by skew handling. What is gathered for one document is bounded by its own words.

Windows are judged on the input. Null or short texts keep all their words. Rows without an id neither remove nor lose
anything. Rows that repeat an id do not remove each other's words; those with one id and one text are treated alike.
Passages within one document stay. Extra columns stay whatever their names; an empty table gives an empty result.
Columns named n_words or n_removed are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxnframe.llm.common import adding, assemble, discard, fresh, lean, local_rows, mapped, quoted, rolling, row_ranges, span_hashes, table, utf8, words

ROW = 1 << 32  # a place is the row's 32-bit key and the word's number
CHUNK = 64  # words of a source that travel together
STEPS = "doc long, at long, n int, edge long, node long"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


def _runs(flag: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of flagged positions; goes_on[i]: i continues i - 1."""
    inner = flag.copy()
    inner[0] = False
    inner[1:] &= flag[:-1] & goes_on[1:]
    last = flag.copy()
    last[:-1] &= ~inner[1:]
    return np.flatnonzero(flag & ~inner), np.flatnonzero(last) + 1


def steps(docs: DataFrame, window: int) -> DataFrame:
    """docs (doc, row, text) -> a record for each run of windows on one edge."""
    k = max(1, window // 3)

    def cut(data, off, doc, row_key):
        _, _, first, h = words(data, off)
        n = len(h) - window + 1
        if n < 1:
            return None
        row = local_rows(first)
        whole = row[:n] == row[window - 1 :]
        if not whole.any():
            return None
        edge = _least(rolling(h, k), window - k + 1)[:n]
        goes_on = np.ones(n, bool)
        goes_on[1:] = (row[1:n] == row[: n - 1]) & (edge[1:] == edge[:-1])
        s, e = _runs(whole, goes_on)
        node = span_hashes(h, s, e + window - 1) ^ (e - s).astype(np.uint64)
        at = row_key[row[s]] * ROW + (s - first[row[s]])
        return doc[row[s]], at, (e - s).astype(np.int32), edge[s].view(np.int64), node.view(np.int64)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "row"))
            for a, b in row_ranges(off):
                got = cut(data[off[a] : off[b]], off[a : b + 1] - off[a], doc[a:b], key[a:b])
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["doc", "at", "n", "edge", "node"])

    return lean(docs).mapInArrow(run, STEPS)


def repeated_steps(records: DataFrame) -> DataFrame:
    """Steps on edges that several documents share, with the source (src, src_at) and greatest document (top) of their node, and whether the edge branches."""
    edges = table(records.groupBy("edge").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("edge"))
    shared = table(records.join(edges, "edge"))
    nodes = table(shared.groupBy("edge", "node").agg(F.min("doc").alias("src"), F.min_by("at", "doc").alias("src_at"), F.max("doc").alias("top")))
    several = table(nodes.groupBy("edge").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("edge", F.lit(True).alias("branches")))
    out = table(shared.join(nodes, ["edge", "node"]).join(several, "edge", "left").withColumn("branches", F.coalesce("branches", F.lit(False))))
    discard(edges, shared, nodes, several)
    return out


def paths(found: DataFrame) -> DataFrame:
    """Repeated nodes that follow another one without a branch: (src, src_at, head), head being the source place at which their path begins."""
    held = found.filter("src < top")
    a = held.select("doc", (F.col("at") + F.col("n")).alias("at"), F.col("src").alias("a"), F.col("src_at").alias("a_at"), (F.col("src_at") + F.col("n")).alias("a_end"))
    b = held.select("doc", "at", F.col("src").alias("b"), F.col("src_at").alias("b_at"))
    links = table(a.join(b, ["doc", "at"]).select("a", "a_at", "a_end", "b", "b_at").distinct())
    one_out = links.groupBy("a", "a_at").agg(F.count("*").alias("ways"), F.max("b").alias("b"), F.max("b_at").alias("b_at"), F.max("a_end").alias("a_end")).filter("ways = 1 and a = b and a_end = b_at")
    one_in = links.groupBy("b", "b_at").agg(F.count("*").alias("ways")).filter("ways = 1")
    jumps = table(one_out.join(one_in.select("b", "b_at"), ["b", "b_at"]).select(F.col("b").alias("src"), F.col("b_at").alias("src_at"), F.col("a_at").alias("head")))
    discard(links)
    while True:  # jumps grow fivefold in a round; source places only fall, so there is no cycle
        one = jumps.select("src", F.col("src_at").alias("head"), F.col("head").alias("next"))
        far = jumps.withColumn("was", F.col("head"))
        for _ in range(4):
            far = far.join(one, ["src", "head"], "left").select("src", "src_at", "was", F.coalesce("next", "head").alias("head"))
        far = table(far)
        discard(jumps)
        jumps = far
        if far.filter("head <> was").isEmpty():
            return jumps


def compact(rows: DataFrame, by: list[str], step: Column) -> DataFrame:
    """Rows (doc, at and those of `by`) whose places run on or overlap, `step` long each, as one row with at and end."""
    order = Window.partitionBy("doc", *by).orderBy("at")
    new = F.when(F.col("at") > F.coalesce(F.max(F.col("at") + step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 62))), 1).otherwise(0)
    runs = rows.withColumn("fresh", new).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", *by, "run").agg(F.min("at").alias("at"), F.max(F.col("at") + step).alias("end")).drop("run")


def path_spans(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Spans of windows (doc, at, end, src, slice, shift) along paths; slice is the place where the path begins in its source, shift the way from a place to its source."""
    later = found.filter("doc > src").select("doc", "at", "n", "src", "src_at")
    on = table(later.join(heads, ["src", "src_at"], "left").select("doc", "at", "n", "src", F.coalesce("head", "src_at").alias("slice"), (F.col("src_at") - F.col("at")).alias("shift")))
    return table(compact(on, ["src", "slice", "shift"], F.col("n")))


WINDOWS = "kind int, doc long, at long, edge long, window long, slice long, chunk int, words binary"


def source_words(docs: DataFrame, found: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """From the texts: windows of branching edges in their nodes' least documents (kind 0), and the words of paths and of runs of such windows in chunks of CHUNK words (kind 1)."""
    wanted = found.filter("branches and doc = src").select("doc", "at", "n", F.lit(0).alias("kind"), "edge")
    used = spans.groupBy("src", "slice").agg(F.max(F.col("end") + F.col("shift")).alias("stop"))
    wanted = wanted.unionByName(used.select(F.col("src").alias("doc"), F.col("slice").alias("at"), (F.col("stop") - F.col("slice")).cast("int").alias("n"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("edge")))
    row = F.expr(f"at div {ROW}L").alias("row")  # keys are not negative
    marks = wanted.withColumn("row", row).groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n", "kind", "edge")).alias("marks"))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            lists = batch.column("marks")
            for a, b in row_ranges(off):
                part = data[off[a] : off[b]]
                s, e, first, h = words(part, off[a : b + 1] - off[a])
                raw, hashes = part.tobytes(), rolling(h, window).view(np.int64)
                for i in range(a, b):
                    base, zero = int(first[i - a]), int(key[i]) * ROW
                    found: tuple[list, ...] = ([], [], [], [], [], [])
                    runs: list[list[int]] = []
                    todo = sorted(((m["at"] - zero, m["n"], m["kind"], m["edge"]) for m in lists[i].as_py()), key=lambda m: (m[2], m[0]))
                    for at, n, kind, edge in todo:
                        if kind:
                            runs.append([at, at + n])
                            continue
                        if runs and at <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], at + n)
                        else:
                            runs.append([at, at + n])
                        for x, y in zip(found, (range(at, at + n), [edge] * n, hashes[base + at : base + at + n].tolist(), [runs[-1][0]] * n)):
                            x.extend(y)
                    m = len(found[0])
                    parts = [(x, c, min(x + (c + 1) * CHUNK, y + window - 1)) for x, y in runs for c in range(-(-(y + window - 1 - x) // CHUNK))]
                    r = len(parts)
                    blobs = [b" ".join([raw[p:q] for p, q in zip(s[base + x + c * CHUNK : base + y].tolist(), e[base + x + c * CHUNK : base + y].tolist())]) for x, c, y in parts]
                    cols = [
                        pa.array([0] * m + [1] * r, pa.int32()), pa.array([int(doc[i])] * (m + r), pa.int64()), pa.array([zero + x for x in found[0]] + [zero + x for x, _, _ in parts], pa.int64()),
                        pa.array(found[1] + [0] * r, pa.int64()), pa.array(found[2] + [0] * r, pa.int64()), pa.array([zero + x for x in found[3]] + [zero + x for x, _, _ in parts], pa.int64()),
                        pa.array([None] * m + [c for _, c, _ in parts], pa.int32()), pa.array([None] * m + blobs, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "doc", "at", "edge", "window", "slice", "chunk", "words"])

    return table(lean(docs.join(marks, ["doc", "row"])).mapInArrow(run, WINDOWS))


def window_spans(windows: DataFrame) -> DataFrame:
    """Spans of windows on branching edges whose least document is another one."""
    least = windows.groupBy("edge", "window").agg(F.min("doc").alias("src"), F.min_by("at", "doc").alias("src_at"), F.min_by("slice", "doc").alias("slice"), F.max("doc").alias("top")).filter("src < top")
    least = table(least.drop("top"))
    hits = table(windows.select("doc", "at", "edge", "window").join(least, ["edge", "window"]).filter("doc > src").select("doc", "at", "src", "slice", (F.col("src_at") - F.col("at")).alias("shift")))
    out = table(compact(hits, ["src", "slice", "shift"], F.lit(1)))
    discard(least, hits)
    return out


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text) -> a row (doc, row, spans) for each row with repeats; row is a 32-bit key of the text.

    spans: array<struct<chunk, words, places>>; words are a chunk of a source's path, places array<struct<of, at, end, skip>> say which windows of the
    row repeat the path's words (from the word `at` up to before `end`), and how many of them to skip; of tells paths apart. A row gets
    the chunks that its own spans touch and no others, so what it is sent is bounded by its own length."""
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("row"), "text")
    records = table(steps(docs, window))
    found = repeated_steps(records)
    discard(records)
    heads = paths(found)
    along = path_spans(found, heads)
    taken = source_words(docs, found, along, window)
    discard(found, heads)
    short = window_spans(taken.filter("kind = 0"))
    at, skip = F.expr(f"at % {ROW}L"), F.col("at") + F.col("shift") - F.col("slice")
    spans = along.unionByName(short).withColumns({"row": F.expr(f"at div {ROW}L"), "skip": skip, "size": F.col("end") - F.col("at")})
    place = F.struct(F.xxhash64("src", "slice").alias("of"), at.alias("at"), (at + F.col("size")).alias("end"), "skip")
    touched = F.sequence(F.expr(f"skip div {CHUNK}L"), F.expr(f"(skip + size + {window - 2}) div {CHUNK}L"))
    spans = spans.withColumn("place", place).withColumn("chunk", F.explode(touched)).withColumn("chunk", F.col("chunk").cast("int"))
    spans = table(spans.groupBy("doc", "row", "src", "slice", "chunk").agg(F.collect_list("place").alias("places")))
    slices = taken.filter("kind = 1").select(F.col("doc").alias("src"), "slice", "chunk", "words").groupBy("src", "slice", "chunk").agg(F.max_by("words", F.length("words")).alias("words"))
    slices = table(slices)
    discard(along, short, taken)
    return spans.join(slices, ["src", "slice", "chunk"]).groupBy("doc", "row").agg(F.collect_list(F.struct("chunk", "words", "places")).alias("spans"))


def _kept(own: list[bytes], spans: list[dict], window: int) -> np.ndarray:
    """Which words stay; a span goes if all its words are the source's."""
    same: dict[tuple, int] = {}
    for span in spans:
        source, start = span["words"].split(b" "), span["chunk"] * CHUNK
        for p in span["places"]:
            key, end = (p["of"], p["at"], p["end"], p["skip"]), p["skip"] + p["end"] - p["at"] + window - 1
            low, high = max(start, p["skip"]), min(start + CHUNK, end)
            if own[p["at"] + low - p["skip"] : p["at"] + high - p["skip"]] == source[low - start : high - start]:
                same[key] = same.get(key, 0) + high - low
    turn = np.zeros(len(own) + 1, np.int64)
    for (_, at, end, _), n in same.items():
        if n >= end - at + window - 1:
            turn[at] += 1
            turn[end + window - 1] -= 1
    return np.cumsum(turn[:-1]) == 0


def remove_repeats(df: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """df with each text cut down to its kept words, and n_words and n_removed.

    A kept word keeps the white space before it; a text that loses nothing stays as it is. With digest, kept_sha256 (of
    the kept words joined by one space) stands in for the text."""
    new = "n_words long, n_removed long" + ", kept_sha256 string" * digest
    keep, schema = adding(df.drop("text") if digest else df, new)
    doc, row, marks = fresh(df, "doc", "row", "spans")
    spans = repeated_spans(df, window).toDF(doc, row, marks)
    here = (F.col("doc_id").cast("long") == F.col(doc)) & (F.pmod(F.xxhash64("text"), F.lit(1 << 31)) == F.col(row))
    joined = df.join(spans, here, "left").select(*map(quoted, keep), *["text"] * digest, marks)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch, "text")
            null = batch.column("text").is_null().to_pylist()
            lists = batch.column(marks)
            total, gone, text = [], [], []
            for a, b in row_ranges(off):
                part = data[off[a] : off[b]]
                s, e, first, _ = words(part, off[a : b + 1] - off[a])
                raw = part.tobytes()
                for i in range(a, b):
                    ws, we = s[first[i - a] : first[i - a + 1]].tolist(), e[first[i - a] : first[i - a + 1]].tolist()
                    own = [raw[p:q] for p, q in zip(ws, we)]
                    total.append(len(own))
                    kept = None
                    if found := lists[i].as_py():
                        kept = _kept(own, found, window)
                    gone.append(len(own) - int(kept.sum()) if kept is not None else 0)
                    if digest:
                        text.append(hashlib.sha256(b" ".join([w for w, k in zip(own, kept.tolist()) if k] if gone[-1] else own)).hexdigest())
                    elif not gone[-1]:
                        text.append(None if null[i] else raw[off[i] - off[a] : off[i + 1] - off[a]].decode())
                    else:
                        before = [off[i] - off[a], *we[:-1]]
                        text.append(b"".join([raw[p:q] for p, q, k in zip(before, we, kept.tolist()) if k]).decode().lstrip())
            cols = {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            if digest:
                cols["kept_sha256"] = pa.array(text, pa.string())
                yield assemble(batch, keep, cols)
            else:
                held = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays([held if c == "text" else batch.column(c) for c in keep] + list(cols.values()), names=keep + list(cols))

    return mapped(joined, run, schema)
