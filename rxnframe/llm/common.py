"""Helpers shared by the corpus operators: columns and batches, and vectorised word hashing. Work folder and tables are the session's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rxnframe.session import discard, shared_root, table, work_dir  # noqa: F401

BATCH_BYTES, BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df bears them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def adding(df: DataFrame, new: str) -> tuple[list[str], StructType]:
    """Columns of df that stay beside the new ones (named by a schema string, and replacing any of that name in any case), and the schema of all."""
    more = StructType.fromDDL(new)
    mine = {f.name.lower() for f in more}
    keep = [f for f in df.schema if f.name.lower() not in mine]
    return [f.name for f in keep], StructType([*keep, *more])


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def assemble(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch and the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(new.values()), names=keep + list(new))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a text column; sizes the number of shuffle groups."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def lean(df: DataFrame) -> DataFrame:
    """df, with the bytes of a batch handed to Python bounded and not only its rows; a bound that the session has set itself stays."""
    spark = df.sparkSession
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return df


def mapped(df: DataFrame, run, schema: StructType) -> DataFrame:
    """lean(df).mapInArrow(run, schema) for columns of any name: Spark's own names hold no dots or backticks meanwhile."""
    names, made = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(made)

    plain = StructType([StructField(n, f.dataType) for n, f in zip(made, schema)])
    return lean(df).toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*[f.name for f in schema])


def chunks(texts: list[str], limit: int = 1 << 20):
    """Ranges of texts of about `limit` characters together; a longer text stands alone, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; null is empty."""
    col = batch.column(column)
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    col = col.fill_null("")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_ranges(off: np.ndarray, limit: int = 1 << 20):
    """Consecutive row ranges of about `limit` bytes."""
    n, start = len(off) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_pow[0]) <= n:
        for k, base in enumerate((_BASE, _INV)):
            m = len(_pow[k])
            _pow[k] = np.concatenate([_pow[k], _pow[k] * np.uint64(pow(base, m, 1 << 64))])
    return _pow[0][: n + 1], _pow[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray, off: np.ndarray, lower: bool = False):
    """Words `[^\\x20\\x09-\\x0D]+` of rows laid end to end: byte starts and ends, first word of each row, 64-bit hashes."""
    space = _IS_SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = ~space[first]
    last = ~space
    last[:-1] &= space[1:]
    end = off[1:][off[:-1] < off[1:]] - 1
    last[end] = ~space[end]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    row_first = np.searchsorted(s, off)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] ^ ((e - s).astype(np.uint64) << np.uint64(56)))
    return s, e, row_first, h


def span_hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray, mult: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hashes of the values from s to e - 1, for many spans; they tell spans of one length apart."""
    if not len(h):
        return np.zeros(len(s), np.uint64)
    m = np.full(len(h) + 1, mult, np.uint64)
    m[0] = 1
    p = np.cumprod(m[:-1])
    m[1:] = pow(mult, -1, 1 << 64)
    q = np.cumprod(m)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p, out=total[1:])
    return mix((total[e] - total[s]) * q[s])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values (len(h) - k + 1 of them)."""
    at = np.arange(max(0, len(h) - k + 1))
    return span_hashes(h, at, at + k)


def local_rows(row_first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(row_first) - 1), np.diff(row_first))
