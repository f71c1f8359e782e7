"""Packing of tokenised documents into sequences by length patterns.

A document's ids (the tokenizer's, without special tokens, then `end`) are cut into pieces of at most `size` tokens.
Pieces are dealt to shards of about SHARD pieces by a hash. In each shard a histogram of lengths, in bins of QUANTUM tokens, is fitted by
non-negative least squares with length patterns of up to PLACES documents. There are too many to list, so those that best match what the fit leaves
over are enumerated as it goes, by a bounded knapsack over the bins. Repeat counts never use more of a bin than there is, are rounded down, and HELD of
them are filled with pieces of the patterns' bins; the last places of a sequence choose pieces so that it gets full. What is left, pieces of every length,
goes best-fit, longest first, into the fullest sequence with room. Where that takes more sequences than the sum of lengths asks for, a shard also tries patterns of exact lengths (if there are few), and
the residual's rule alone, and keeps the best. Sequences that stay under FULL are taken apart and packed again together
with those of other shards. `placed_by` says how each piece came to its place.

Null texts are empty: they hold only `end`. Rows that repeat an id, or have none, are packed each. An empty table gives no
pieces. Extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import lean, table

SHARD, AGAIN, FULL, QUANTUM = 4096, 1024, 0.995, 64
PLACES, GROWTH, ROUNDS, HELD, TRIES, LOOSE = 10, 12, 4, 0.9, 12, 6
EXACT, SMALL = 128, 9
CACHE_WORDS = 400_000
ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without letters, digits and the apostrophe


class WordTokenizer:
    """Ids of texts, by the library, through a cache of white-space separated chunks, which its pieces never cross."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, chunks: list[bytes]) -> None:
        """Words of letters only are encoded many in one text and told apart by their last tokens; other chunks split into a word and a tail of punctuation first, or go through one by one."""
        known, ended, todo, other = self.known, [], set(), set()
        for c in chunks:
            core = c.rstrip(PUNCTUATION)
            if len(core) < len(c) and core:
                if core[-1] in ALNUM or (core[-1] > 127 and core.decode()[-1].isalnum()):  # else the tail would be cut off from punctuation before it
                    tail = c[len(core) :]
                    ended.append((c, core, tail))
                    other.add(tail)
                    todo.add(core)
                else:
                    other.add(c)
            else:
                todo.add(c)
        plain = []
        for x in todo:
            if x not in known:
                if (t := x.decode()).isalpha():
                    plain.append(t)
                else:
                    other.add(x)
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            raw = self.whole(" ".join(some))
            ends = 4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)
            if len(ends) == len(some):
                at = 0
                for x, e in zip(some, ends.tolist()):
                    known[x.encode()], at = raw[at:e], e
            else:
                other.update(x.encode() for x in some)
        rest = [x for x in other if x not in known]
        for x, e in zip(rest, self.library.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)):
            known[x] = np.array(e.ids, "<u4").tobytes()
        for c, core, tail in ended:
            known[c] = known[core] + known[tail]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids. Lower-casing first is the library's own step and is done here only where it commutes with its other normalisers."""
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[bytes]] = {}
        for i, t in enumerate(texts):
            low = t if t.isascii() else t.replace("Σ", "σ")
            low = low.lower()
            simple = t.isascii() or (unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low))
            if simple and not any(s in low for s in self.special):
                split[i] = low.encode().split()
            else:
                out[i] = self.whole(t)
        if len(self.known) > CACHE_WORDS:  # what was in use lately stays
            self.older, self.known = self.known, {}
        need = set().union(*split.values()).difference(self.known)
        kept = {c: ids for c in need if (ids := self.older.get(c)) is not None}
        self.known |= kept
        if len(kept) < len(need):
            self.learn([c for c in need if c not in kept])
        get = self.known.__getitem__
        for i, chunks in split.items():
            out[i] = b"".join(map(get, chunks))
        return out


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32), with the pieces' ids only as their CRC."""

    def run(batches):
        t = tokenizer(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, ids = [x or "" for x in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            for a in range(0, len(texts), 500):
                rows = []
                for doc, raw in zip(ids[a : a + 500], t.ids(texts[a : a + 500])):
                    raw += tail
                    for p, s in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[s : s + 4 * size]
                        rows.append((doc, p, s // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return lean(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(reward: np.ndarray, stock: np.ndarray, most: int, size: np.ndarray | None = None, full: int = 0, loose: int = LOOSE) -> list[np.ndarray]:
    """Patterns of 1 to `most` pieces that fill a sequence and whose bins' rewards sum up highest, the best one for each number of pieces.

    A piece counts with the middle of its bin, 2 b + 1 half quanta, or with its own `size` where bins are single lengths. A pattern holds no more of a bin than there is."""
    bins, tight = len(reward), 0
    if size is None:
        size, full, tight = 2 * np.arange(bins) + 1, 2 * bins, 1
    worth = np.where(stock > 0, reward, -np.inf)
    back = np.arange(full + 1)[:, None] - size  # what a pattern of a total held before its last piece of a bin
    best, picks, out = np.full(full + 1, -np.inf), [], []
    best[0] = 0
    for _ in range(most):
        value = np.where(back >= 0, best[np.maximum(back, 0)], -np.inf) + worth
        picks.append(value.argmax(1))
        best = value.max(1)
        at = full - int(best[full - tight :][::-1].argmax())
        if best[at] == -np.inf:  # no total is full: those down to LOOSE half quanta less
            at = full - int(best[full - loose :][::-1].argmax())
        if best[at] > 0:
            found = np.zeros(bins)
            for pick in picks[::-1]:
                found[pick[at]] += 1
                at -= size[pick[at]]
            if (found <= stock).all():
                out.append(found)
    return out


def least_squares(m: np.ndarray, h: np.ndarray, x: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative x that makes m x nearest to h: accelerated projected gradient from a first guess."""
    rate = 1 / np.linalg.norm(m.T @ m, 2)
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (m.T @ (m @ y - h)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / u * (new - x), u
    return x


def fit(h: np.ndarray, size: np.ndarray | None = None, full: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and whole repeat counts that use up a histogram of lengths, and never more of it than there is.

    Patterns are enumerated as they are needed: those that best match what the fit leaves over join it, until none would help. Counts
    shrink where a bin is overdrawn, are rounded down, and what is left is fitted again."""
    left, ms, counts = h.astype(float), [], []
    for _ in range(ROUNDS):
        m, x = np.zeros((len(h), 0)), np.zeros(0)
        for _ in range(GROWTH):
            rest = left - m @ x
            new = [p for p in price(rest, left, PLACES, size, full, full) if not (m.T == p).all(1).any()]
            if not new:
                break
            m, x = np.column_stack([m, *new]), np.append(x, np.zeros(len(new)))
            x = least_squares(m, left, x)
            m, x = m[:, x > 1e-3], x[x > 1e-3]
        if not len(x):
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            short = np.minimum(1, np.where(m @ x > 0, left / (m @ x), 1))
        x *= np.where(m > 0, short[:, None], 1).min(0)
        count = np.floor(x + 1e-6)
        if not count.any():  # the one with most repeats, if there is stock for one
            j = int(x.argmax())
            count[j] = float((m[:, j] <= left).all() and x[j] > 0.5)
        left = left - m @ count
        if not count.any():
            break
        ms.append(m[:, count > 0])
        counts.append(count[count > 0])
    return (np.column_stack(ms), np.concatenate(counts).astype(int)) if ms else (np.zeros((len(h), 0)), np.zeros(0, int))


PATTERN, FILLER, RESIDUAL = 0, 1, 2


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and by what it came there: a place of a pattern, room left in one, or the residual.

    Patterns of bins first. Where they leave more sequences than the lengths' sum needs, patterns of exact lengths follow if there are at most EXACT of them, then the residual's rule
    alone, which counts only if it saves more than one sequence in 200. At most SMALL pieces are also placed by trying. The way with fewest sequences counts, the earlier among equals."""
    least = -(-int(lengths.sum()) // size)
    best, n = None, 0
    for way, worth in ((pack_bins, 1.0), (pack_exact, 1.0), (pack_residual, 0.995), (pack_small, 1.0)):
        got = way(lengths, size)
        if got is not None and (best is None or got[0].max(initial=-1) + 1 < worth * n):
            best, n = got, int(got[0].max(initial=-1)) + 1
        if n <= least:
            break
    return best


def _fill(lengths: np.ndarray, size: int, order: np.ndarray, seq: np.ndarray, offset: np.ndarray, used: list[int]) -> None:
    """Pieces without a sequence, in order, each into the fullest one with room."""
    room = sorted((size - u, s) for s, u in enumerate(used) if u < size)
    for i in order[seq[order] < 0].tolist():
        n = int(lengths[i])
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, s = room.pop(k)
        else:
            left, s = size, len(used)
            used.append(0)
        seq[i], offset[i] = s, used[s]
        used[s] += n
        if left > n:
            insort(room, (left - n, s))


def pack_residual(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first."""
    seq, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
    _fill(lengths, size, np.argsort(-lengths, kind="stable"), seq, offset, [])
    return seq, offset, np.full(len(lengths), RESIDUAL)


def pack_exact(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Patterns over the histogram of the lengths themselves; None where there are too many."""
    value, h = np.unique(lengths, return_counts=True)
    if not 0 < len(value) <= EXACT:
        return None
    order = np.argsort(-lengths, kind="stable")
    pools = [np.flatnonzero(lengths == v).tolist() for v in value]
    seq, offset, by, used = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64), np.full(len(lengths), RESIDUAL), []
    m, count = fit(h.astype(float), value, size)
    for j in np.repeat(np.arange(len(count)), count).tolist():
        at = 0
        for b in np.repeat(np.arange(len(value)), m[:, j].astype(int))[::-1].tolist():
            i = pools[b].pop()
            seq[i], offset[i], by[i] = len(used), at, PATTERN
            at += int(value[b])
        used.append(at)
    _fill(lengths, size, order, seq, offset, used)
    return seq, offset, by


def pack_small(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The fewest sequences for at most SMALL pieces, by trying the places of each, longest first."""
    if not 0 < len(lengths) <= SMALL:
        return None
    order = np.argsort(-lengths, kind="stable").tolist()
    best: list[list[int]] = [[i] for i in order]

    def place(k: int, rooms: list[int], held: list[list[int]]) -> None:
        nonlocal best
        if len(held) >= len(best):
            return
        if k == len(order):
            best = [list(x) for x in held]
            return
        n = int(lengths[order[k]])
        for s, room in enumerate(rooms):
            if n <= room and room not in rooms[:s]:
                rooms[s] -= n
                held[s].append(order[k])
                place(k + 1, rooms, held)
                rooms[s] += n
                held[s].pop()
        place(k + 1, [*rooms, size - n], [*held, [order[k]]])

    place(0, [], [])
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for s, held in enumerate(best):
        at = 0
        for i in held:
            seq[i], offset[i] = s, at
            at += int(lengths[i])
    return seq, offset, np.full(len(lengths), RESIDUAL)


def pack_bins(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns over a histogram in bins of QUANTUM tokens, whose last places choose pieces so that sequences get full."""
    bins = -(-size // QUANTUM)
    order = np.argsort(-lengths, kind="stable")
    pools: list[list[tuple[int, int]]] = [[] for _ in range(bins)]
    seq, offset, by, used = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64), np.full(len(lengths), RESIDUAL), []
    for i in order[::-1].tolist():
        n = int(lengths[i])
        pools[max(0, n - 1) // QUANTUM].append((n, i))

    def place_of(space: int) -> tuple[int, int] | None:
        """Where the longest piece left that fits is."""
        b = min(bins, -(-space // QUANTUM)) - 1
        if b >= 0 and (k := bisect_left(pools[b], (space + 1, -1))):
            return b, k - 1
        for b in range(b - 1, -1, -1):
            if pools[b]:
                return b, len(pools[b]) - 1
        return None

    def largest(space: int) -> tuple[int, int] | None:
        """The longest piece left that fits, taken out."""
        at = place_of(space)
        return pools[at[0]].pop(at[1]) if at else None

    def fitting(pool: list[tuple[int, int]], space: int) -> tuple[int, int] | None:
        """A piece of a bin, taken out, after which the longest one that fits leaves least room."""
        least, found = size + 1, -1
        for k in sorted({i * (len(pool) - 1) // (TRIES - 1) for i in range(TRIES)}):
            if pool[k][0] > space:
                break
            next_to = place_of(space - pool[k][0])
            if next_to and pools[next_to[0]] is pool and next_to[1] >= k:
                next_to = (next_to[0], next_to[1] - 1) if next_to[1] else None  # the piece itself
            room = space - pool[k][0] - (pools[next_to[0]][next_to[1]][0] if next_to else 0)
            if 0 <= room < least:
                least, found = room, k
            if not room:
                break
        return pool.pop(found) if found >= 0 else None

    m, count = fit(np.array([len(p) for p in pools], float))
    # Repeats of all patterns take turns, so that pieces of every length stay for the residual, which fills up what the last ones leave open.
    turns = np.concatenate([np.arange(c) + 0.5 for c in count] or [np.zeros(0)]) / np.repeat(np.maximum(1, count), count)
    for j in np.repeat(np.arange(len(count)), count)[np.argsort(turns, kind="stable")][: int(HELD * count.sum())].tolist():
        need = np.repeat(np.arange(bins), m[:, j].astype(int))[::-1].tolist()
        if need:
            got, at = [], 0
            for place, b in enumerate(need):
                pool = pools[b]
                if place == len(need) - 1:  # the longest piece that fits, so that the lengths within bins don't add up to waste
                    one = largest(size - at)
                elif place == len(need) - 2 and pool:
                    one = fitting(pool, size - at) or largest(size - at)
                elif pool and pool[len(pool) // 2][0] <= size - at:  # the middle of the bin is what the pattern counts with
                    one = pool.pop(len(pool) // 2)
                else:
                    one = largest(min((b + 1) * QUANTUM, size - at))
                if not one:
                    break
                by[one[1]] = PATTERN if abs(max(0, one[0] - 1) // QUANTUM - b) <= 1 else FILLER
                got.append(one)
                at += one[0]
            while at < size and (one := largest(size - at)):
                by[one[1]] = FILLER
                got.append(one)
                at += one[0]
            if not got:
                continue
            at = 0
            for n, i in got:
                seq[i], offset[i] = len(used), at
                at += n
            used.append(at)
    _fill(lengths, size, order, seq, offset, used)
    return seq, offset, by


def _packer(size: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq, offset, by = pack(pdf["length"].to_numpy(), size)
        fill = np.bincount(seq, pdf["length"], minlength=seq.max() + 1 if len(seq) else 0)
        shard = int(pdf["shard"].iloc[0])
        return pdf.drop(columns="shard").assign(sequence_id=((2 * shard + level) << 24) + seq, offset=offset, placed_by=by.astype(np.int32), full=fill[seq] >= FULL * size)

    return run


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, placed_by (0 a pattern, 1 room left in one, 2 the residual)."""
    pieces = table(cut(docs, path, size, end))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, placed_by int, full boolean"

    def deal(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {n}L)"))

    shards = max(1, -(-pieces.count() // SHARD))
    packed = table(deal(pieces, shards).groupBy("shard").applyInPandas(_packer(size, 0), schema))
    rest = packed.filter("not full").drop("sequence_id", "offset", "placed_by", "full")
    again = deal(rest, max(1, -(-rest.count() // AGAIN))).groupBy("shard").applyInPandas(_packer(size, 1), schema)
    return packed.filter("full").unionByName(again).drop("full")
