"""Prefix trie of conversations by padded turn-id matrices over range shards.

A turn's id is 128 bits of SHA-256 of its role and text, so texts never leave the rows that hold them: a conversation is one row of ids
and text lengths. Rows are dealt by ranges of (id sequence, conv_id) to shards, so that every node's members stand together and a large
group of equal conversations splits by conv_id. In a shard numpy's lexsort orders padded matrices of turn ids, a block of columns at a
time (blocks double in width and hold only rows that reach them, so padding stays below the turns themselves). Column changes between
neighbours, OR-accumulated along the columns, mark where nodes start; reduceat over the rows that reach a depth aggregates its nodes.

Sorted shards are written, one row each. The lengths of the prefixes that neighbouring shards share tell which nodes begin before a shard
or go on after it, so every node starts and every leaf ends in exactly one shard and all aggregates add up: members, children, leaves, and
saved tokens as the text lengths of all members' later turns less those of started nodes. Nodes on a boundary are combined by their
prefix's digest with a grouping; what ends at them is hashed in order as a stream of pieces.

Turns are ordered by turn, null first, equal turns by id. Null role or text is empty. Rows without a conv_id are dropped. A conversation that
repeats rows holds those turns twice. An empty table has no node, not even a root. Extra columns are ignored. One conversation's ids (24
bytes a turn) have to fit one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, lean, table

ID, BLOCK, SHARD, MOST, LARGE = 16, 8, 1 << 14, 512, 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, part binary, parent_part binary, place long"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: an ordered array of structs with id (binary) and size (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), digest.alias("id"), F.length(text).alias("size"))
    own = conversations.filter("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct(t.id.alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """conv_id and turns of every conversation whose first `head` turns are replaced by as many of conversation `base`'s; both are expressions of conv_id."""
    own = turn_ids(conversations).withColumns({"base": base, "h": head})
    widest = own.agg(F.max("h")).first()[0] or 0
    first = own.filter(F.col("base") == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, widest).alias("front"))
    turns = F.concat(F.slice(F.coalesce("front", F.array().cast("array<struct<id: binary, size: int>>")), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(first, "base", "left").select("conv_id", turns.alias("turns"))


def _blocks(longest: int):
    a, width = 0, BLOCK
    while a < longest:
        yield a, a + width
        a, width = a + width, max(BLOCK, a + width)


def _padded(codes: np.ndarray, off: np.ndarray, size: np.ndarray, rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """Columns a to b - 1 of the turn codes of some rows, 0 where a row has ended."""
    col = np.arange(a, b)
    at = off[rows][:, None] + col
    return np.where(col < size[rows][:, None], codes[np.minimum(at, len(codes) - 1)], 0)


def order(codes: np.ndarray, off: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows in the order of their code sequences, shorter first, then of conv_id."""
    size = np.diff(off)
    rank = np.zeros(len(size), np.int64)
    for a, b in _blocks(int(size.max(initial=0))):
        rows = np.flatnonzero(size > a)
        m = _padded(codes, off, size, rows, a, b)
        o = np.lexsort((*m.T[::-1], rank[rows]))
        new = np.append(False, (m[o][1:] != m[o][:-1]).any(1) | (np.diff(rank[rows][o]) != 0))
        place = np.zeros(len(size), np.int64)  # rows that ended before stand first among those equal so far
        place[rows[o]] = np.cumsum(new) + 1
        rank = np.unique(rank * (len(rows) + 2) + place, return_inverse=True)[1]
    return np.lexsort((conv, rank))


def starts(codes: np.ndarray, off: np.ndarray, before: int) -> np.ndarray:
    """For each turn of sorted rows whether its node starts there: some column up to its own differs from the row above. The first row shares `before` turns with the row above it, in another shard."""
    size = np.diff(off)
    out, carry = np.zeros(len(codes), bool), np.zeros(len(size), bool)
    for a, b in _blocks(int(size.max(initial=0))):
        rows = np.flatnonzero(size > a)
        m = _padded(codes, off, size, rows, a, b)
        mask = np.ones(m.shape, bool)
        near = np.flatnonzero(np.diff(rows) == 1) + 1
        mask[near] = m[near] != m[near - 1]
        if rows[0] == 0:
            mask[0] = np.arange(a, b) >= before
        mask |= carry[rows][:, None]
        np.logical_or.accumulate(mask, axis=1, out=mask)
        carry[rows] = mask[:, -1]
        col = np.arange(a, b)
        inside = col < size[rows][:, None]
        out[(off[rows][:, None] + col)[inside]] = mask[inside]
    return out


def prefix_keys(ids: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1 ... depth ids."""
    h, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for d in range(depth):
        h.update(ids[d * ID : (d + 1) * ID])
        out.append(h.copy().digest())
    return out


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers from 1 upwards in the order of the ids (rows of two big-endian halves)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    o = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.append(True, (ids[o][1:] != ids[o][:-1]).any(1))
    out = np.empty(len(ids), np.int64)
    out[o] = np.cumsum(new)
    return out


def _halves(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _joined(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def nodes(raw: bytes, sizes: np.ndarray, off: np.ndarray, conv: np.ndarray, before: int, after: int, place: int):
    """Nodes of one sorted shard as tuples of NODE, the root first, a list for each depth. The first row shares `before` turns with the row above it, the last one `after` with the row below (-1: there is none)."""
    codes, size = _codes(_halves(raw)), np.diff(off)
    started = starts(codes, off, before)
    shared = np.add.reduceat(np.append(~started, False).astype(np.int64), np.minimum(off[:-1], len(started))) * (size > 0)  # turns shared with the row above
    leaf = np.append(shared[1:], after) < size
    later = np.where(started, 0, sizes)
    total = np.append(np.cumsum(later[::-1])[::-1], 0)
    later = total[: len(later)] - np.repeat(total[off[1:]], size)  # from this turn to the row's last one
    child = np.append(started[1:], False)
    child[off[1:][size > 0] - 1] = False
    front = prefix_keys(raw[: ID * size[0]], max(0, min(before, int(size[0]))))
    back = prefix_keys(raw[ID * off[-2] : ID * off[-1]], max(0, min(after, int(size[-1]))))
    rows = np.arange(len(size))
    parent, parent_part = np.zeros(len(size), np.int64), np.full(len(size), None, object)
    depth = 0
    while len(rows):
        pos = off[rows] + depth - 1
        edge = started[pos].copy() if depth else np.zeros(len(rows), bool)
        edge[0] = True
        at = np.flatnonzero(edge)
        count = np.diff(np.append(at, len(rows)))
        low = np.minimum.reduceat(conv[rows], at)
        ends = np.add.reduceat((size[rows] == depth).astype(np.int64), at)
        if depth:
            kids, saved = np.add.reduceat(child[pos].astype(np.int64), at), np.add.reduceat(later[pos], at)
        else:
            some = size > 0
            kids, saved = np.array([started[off[:-1][some]].sum()]), np.array([later[off[:-1][some]].sum()])
        leaves = np.add.reduceat(leaf[rows].astype(np.int64), at)
        part = np.full(len(at), None, object)
        if depth < len(front):
            part[0] = front[depth]
        if depth < len(back):
            part[-1] = back[depth]
        first = rows[at]
        told = [None] * len(at)
        for i in np.flatnonzero(ends).tolist():
            told[i] = _joined(conv[first[i] : first[i] + ends[i]])
        for i, key in enumerate(part):
            if key is None:
                told[i] = hashlib.sha256(told[i] or b"").digest()
        up = [None] * len(at) if not depth else [None if q is not None else p for p, q in zip(parent[first].tolist(), parent_part[first])]
        yield [low.tolist(), [depth] * len(at), up, count.tolist(), kids.tolist(), leaves.tolist(), saved.tolist(), told, part.tolist(), parent_part[first].tolist(), [place] * len(at)]
        parent[rows], parent_part[rows] = np.repeat(low, count), np.repeat(part, count)
        rows = rows[size[rows] > depth]
        depth += 1


def _shards(rows: DataFrame) -> DataFrame:
    """rows (conv_id, seq, sizes) by ranges, each range in order and one row: head (its first conv_id and sequence), tail (its last sequence), n and the columns' bytes."""
    turns = rows.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    n = max(1, min(MOST, turns // SHARD), turns // LARGE)
    schema = "head binary, head_conv long, tail binary, n long, conv binary, ends binary, ids binary, sizes binary"

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        del kept
        conv = t["conv_id"].to_numpy()
        size = pc.list_value_length(t["sizes"]).to_numpy().astype(np.int64)
        off = np.append(0, np.cumsum(size))
        ids = _halves(b"".join(x.as_py() for x in t["seq"]))
        sizes = t["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        del t
        o = order(_codes(ids), off, conv)
        end = np.cumsum(size[o])
        take = np.repeat(off[o] - np.append(0, end)[:-1], size[o]) + np.arange(len(ids))
        raw = ids[take].astype(">u8").tobytes()
        a, z = int(size[o[0]]), int(size[o[-1]])
        yield pa.RecordBatch.from_pylist([{"head": raw[: ID * a], "head_conv": int(conv[o[0]]), "tail": raw[len(raw) - ID * z :], "n": len(o), "conv": conv[o].tobytes(), "ends": end.tobytes(), "ids": raw, "sizes": sizes[take].tobytes()}],
            pa.schema([("head", pa.binary()), ("head_conv", pa.int64()), ("tail", pa.binary()), ("n", pa.int64()), ("conv", pa.binary()), ("ends", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())]))

    return lean(rows.repartitionByRange(n, "seq", "conv_id")).mapInArrow(run, schema)


def _borders(shards: DataFrame) -> DataFrame:
    """head, head_conv, place, and the turns shared with the shards before (0: none) and after (-1: none). One row a shard, so their number is bounded by _shards."""
    w = Window.orderBy("head", "head_conv")
    ends = shards.select("head", "head_conv", "tail").withColumns({"above": F.lag("tail").over(w), "below": F.lead("head").over(w), "place": F.row_number().over(w).cast("long")})

    def common(x: bytes | None, y: bytes | None, none: int) -> int:
        if x is None or y is None:
            return none
        k = min(len(x), len(y)) // ID
        a, b = (np.frombuffer(v[: k * ID], f"V{ID}") for v in (x, y))
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if len(differ) else k

    def run(batches):
        for batch in batches:
            r = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("head_conv"), batch.column("place"), pa.array([common(x["above"], x["head"], 0) for x in r], pa.int64()), pa.array([common(x["tail"], x["below"], -1) for x in r], pa.int64())],
                names=["head", "head_conv", "place", "before", "after"])

    return ends.mapInArrow(run, "head binary, head_conv long, place long, before long, after long")


def _expand(shards: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                off = np.append(0, np.frombuffer(r["ends"], np.int64))
                for level in nodes(r["ids"], np.frombuffer(r["sizes"], np.int64), off, np.frombuffer(r["conv"], np.int64), r["before"], r["after"], r["place"]):
                    for i in range(0, len(level[0]), 1 << 15):
                        types = [pa.int64()] * 7 + [pa.binary()] * 3 + [pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 15)], t) for c, t in zip(level, types)], names=[x.split()[0] for x in NODE.split(", ")])

    return lean(shards).mapInArrow(run, NODE)


def _streamed(pieces: DataFrame) -> DataFrame:
    """part -> SHA-256 of its pieces in the order of their places, joined by commas, as hex. A part's pieces stream through one task; only one batch is held."""

    def run(batches):
        key, h, some = None, None, False
        for batch in batches:
            out = []
            for p, text in zip(batch.column("part").to_pylist(), batch.column("ends").to_pylist()):
                if p != key:
                    if key is not None:
                        out.append((key, h.hexdigest()))
                    key, h, some = p, hashlib.sha256(), False
                h.update(b"," + text if some else text)
                some = True
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], pa.string())], names=["part", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["part", "ends_sha256"])

    return lean(pieces.repartition("part").sortWithinPartitions("part", "place")).mapInArrow(run, "part binary, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turns as from turn_ids or rebuilt, one row a conversation) -> a row for each distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    flat = table(rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.id)), "")).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    shards = table(_shards(flat))
    discard(flat)
    found = table(_expand(shards.join(F.broadcast(_borders(shards)), ["head", "head_conv"])))
    discard(shards)
    split = found.filter("part is not null")
    ends = _streamed(split.filter("ends is not null").select("part", "place", "ends"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = split.groupBy("part").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("parent_part").alias("parent_part"), F.max("parent_conv_id").alias("parent_conv_id"))
    merged = table(merged.join(ends, "part", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    every = found.filter("part is null").withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends", "place").unionByName(merged)
    up = merged.select(F.col("part").alias("parent_part"), F.col("conv_id").alias("_up"))
    out = every.join(up, "parent_part", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sql() -> str:
    """DuckDB SQL for op11. crc32 is worked out bit by bit: a number of 0 or more is mixed in, -1 shifts."""
    crc = "xor(list_reduce(flatten(list_transform(string_split(c::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, 4294967295::bigint), 4294967295)"
    return f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations where conv_id is not null),
own as (select c, list(struct_pack(r := role, t := txt) order by turn nulls first, sha256(length(role) || ':' || role || txt)) as ts from t group by c),
h as (select c, ts, c - c % 100 as base, {crc} % 6 as h from own),
re as (select a.c, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 :]) as ts from h a left join own b on b.c = a.base),
p as (select c, ts, d, ts[1 : d] as k, len(ts) = d as ends from (select c, ts, unnest(range(0, len(ts) + 1)) as d from re)),
n as (select d, k, min(c) as conv_id, count(*) as n_convs, bool_and(ends) as leaf, coalesce(string_agg(c, ',' order by c) filter (where ends), '') as e, case when d > 0 then (count(*) - 1) * length(k[d].t) else 0 end as own from p group by d, k),
m as (select p.c, p.d, n.conv_id, n.own, n.leaf, n.conv_id = p.c as mine from p join n on p.d = n.d and p.k = n.k),
below as (select v.conv_id, v.d, sum(w.own)::bigint as saved_tokens, count(*) filter (where w.leaf) as n_leaves, count(*) filter (where w.d = v.d + 1) as n_children from m v join m w on v.c = w.c and w.d >= v.d and w.mine group by all)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, b.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens, sha256(n.e) as ends_sha256
from n join below b on b.conv_id = n.conv_id and b.d = n.d left join m u on u.c = n.conv_id and u.d = n.d - 1"""
