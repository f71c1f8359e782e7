"""Byte-level BPE encoding and decoding with a public rank file.

`encode` keeps, for every text, its ids and the byte offset of every token; `decode` turns ids into bytes again.
Null texts count as empty: no ids. Ids outside the vocabulary raise KeyError. Extra columns stay as they are;
a column that already bears an output's name is replaced. Repeated rows are encoded each; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rxnframe.llm.common import adding, assemble, chunks, mapped
from rxnframe.llm.pretokenise import pieces

CACHE_PIECES = 600_000


class Vocabulary(dict):
    """Piece -> ids; a missing piece is merged pair by pair, lowest rank first, and kept while there is room."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.size = np.zeros(max(self.tokens, default=-1) + 1, np.int64)  # of each token, in bytes
        for i, t in self.tokens.items():
            self.size[i] = len(t)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.size))), np.uint8)

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self.merge(piece)
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        cut = list(range(len(piece) + 1))
        none = 1 << 60
        rank = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(piece[cut[i] : cut[i + 2]], none)
            if i:
                rank[i - 1] = ranks.get(piece[cut[i - 1] : cut[i + 1]], none)
        return tuple(ranks[piece[a:b]] for a, b in zip(cut, cut[1:]))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts, and the end."""
        return np.append(0, np.cumsum(self.size[ids]))

    def placed(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of tokens laid down at their offsets."""
        return self.bytes[np.arange(offsets[-1]) + np.repeat(self.begin[ids] - offsets[:-1], self.size[ids])].tobytes()

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for long pieces, with a heap over a linked list of cuts."""
        import heapq

        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * (n + 1))
        while heap:
            _, a, c = heapq.heappop(heap)
            if not alive[a] or (b := after[a]) >= n or after[b] != c:
                continue
            alive[b], after[a], before[c] = 0, c, a
            for left, right in ((before[a], c), (a, after[c] if c < n else n + 1)):
                if left >= 0 and right <= n and (r := ranks.get(piece[left:right])) is not None:
                    heapq.heappush(heap, (r, left, right))
        cuts, i = [0], 0
        while i < n:
            i = after[i]
            cuts.append(i)
        return tuple(ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:]))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary):
    """Yields the ids of each text."""
    for a, b in chunks(texts):
        data, at, first = pieces(texts[a:b])
        at = at.tolist()
        found = [data[s:e] for s, e in zip(at, at[1:])]
        get = vocab.__getitem__
        for i, j in zip(first.tolist(), first[1:].tolist()):
            yield list(chain.from_iterable(map(get, found[i:j])))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Adds ids array<int> and offsets array<int>: the byte at which each token starts."""

    keep, schema = adding(df, "ids array<int>, offsets array<int>")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            ids = list(encode_texts(_texts(batch, column), vocab))
            offsets = [np.cumsum([0, *(len(vocab.tokens[i]) for i in x)])[:-1].tolist() if x else [] for x in ids]
            yield assemble(batch, keep, {"ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array(offsets, pa.list_(pa.int32()))})

    return mapped(df, run, schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds decoded binary: the bytes of an array of ids; null ids give null."""

    keep, schema = adding(df, "decoded binary")

    def run(batches):
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            out = [None if ids is None else b"".join(map(token, ids)) for ids in batch.column(column).to_pylist()]
            yield assemble(batch, keep, {"decoded": pa.array(out, pa.binary())})

    return mapped(df, run, schema)


def round_trip(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Encode with offsets and decode by them in one pass; adds n_tokens, ids_sha256 and decoded_sha256 instead of the ids themselves, and n_bytes, the offset at which the last token ends."""

    keep, schema = adding(df, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")

    def run(batches):
        vocab = vocabulary(path)
        name, sha = vocab.names.__getitem__, hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha, ends = [], [], [], []
            for ids in encode_texts(_texts(batch, column), vocab):
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(name, ids)).encode()).hexdigest())
                at = np.array(ids, np.int64)
                offsets = vocab.offsets(at)
                text_sha.append(sha(vocab.placed(at, offsets)).hexdigest())
                ends.append(int(offsets[-1]))
            yield assemble(batch, keep, {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()), "n_bytes": pa.array(ends, pa.int64())})

    return mapped(df, run, schema)
