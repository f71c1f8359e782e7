"""Token counts through a digest cache.

Content (null: empty) and tokenizer version are keyed by SHA-256. Stored counts are joined, only distinct texts
without a stored count are encoded, and those are appended to the cache. The cache is a Parquet folder that driver and
executors share: `cache_path`, else the session's spark.rxnframe.token_cache, else the folder token_cache beside the
work tables in spark.checkpoint.dir, so that later calls find the counts of earlier ones. Each call appends a folder of
its own, so writers don't disturb each other; what two of them stored counts once. Empty texts count 0 tokens. Repeated
rows and equal texts share one encoding. Tokenizers are files of the libraries tokenizers (.json) and sentencepiece (.model). An empty table gives an empty result. Columns named n_bytes, n_tokens or
over_limit (in any case) are replaced, others stay whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxnframe.llm.common import chunks, discard, fresh, lean, quoted, shared_root, table
from rxnframe.llm.pretokenise import pieces

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"
CACHE_PIECES = 800_000


#: Part of a version: changes when texts are counted in another way.
WAY = b"pieces of the byte-level pattern, else whole texts"


def tokenizer_digest(path: str) -> str:
    """Changes with the tokenizer's file, with the library's version and with how it is called."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode() + WAY).hexdigest()


def byte_level(path: str) -> bool:
    """Whether a tokenizer splits texts by the byte-level pattern and changes nothing else before."""
    with open(path, "rb") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    return not told.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [x.content for x in t.get_added_tokens_decoder().values()], {}, byte_level(path)


@cache
def _sentences(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_texts(texts: list[str], path: str) -> list[int]:
    """Counts by the library. Where it splits by the byte-level pattern, texts are cut at piece boundaries, which it never merges across, so each distinct piece is encoded once; texts that hold a special string, and all texts of other tokenizers, go through whole."""
    if path.endswith(".model"):
        return [len(x) for x in _sentences(path).encode(texts, num_threads=1)] if texts else []
    t, special, known, cuts = _tokenizer(path)
    out: list[int] = []
    for a, b in chunks(texts):
        if not cuts:
            out += map(len, t.encode_batch_fast(texts[a:b], add_special_tokens=False))
            continue
        data, at, first = pieces(texts[a:b])
        at = at.tolist()
        found = [data[s:e] for s, e in zip(at, at[1:])]
        if len(known) > CACHE_PIECES:
            known.clear()
        if miss := list({*found}.difference(known)):
            for i in range(0, len(miss), 20_000):
                part = miss[i : i + 20_000]
                known.update(zip(part, map(len, t.encode_batch_fast([x.decode() for x in part], add_special_tokens=False))))
        get = known.__getitem__
        out += [sum(map(get, found[i:j])) for i, j in zip(first.tolist(), first[1:].tolist())]
        for i in range(a, b):
            if any(s in texts[i] for s in special):
                out[i] = len(t.encode(texts[i], add_special_tokens=False))
    return out


def default_cache(spark: SparkSession) -> str:
    return spark.conf.get("spark.rxnframe.token_cache", None) or f"{shared_root(spark)}/rxnframe/token_cache"


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, column: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = df.sparkSession
    cache_path = cache_path or default_cache(spark)
    version = tokenizer_digest(tokenizer_path)

    def append(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{cache_path}/run={uuid.uuid4().hex}")

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE).option("basePath", cache_path).parquet(cache_path)
        return rows.filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens").dropDuplicates(["content_digest"])

    append(spark.createDataFrame([], CACHE))  # a cache that is new can be read as well
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    (digest,) = fresh(df, "digest")
    text = F.coalesce(quoted(column), F.lit(""))
    keyed = df.withColumn(digest, F.sha2(text, 256))
    # Digests meet the cache first, so only texts without a stored count move.
    asked = df.select(F.sha2(text, 256).alias("content_digest"), text.alias("content"))
    unknown = table(asked.select("content_digest").distinct().join(stored(), "content_digest", "left_anti"))
    misses = asked.join(unknown, "content_digest", "left_semi").groupBy("content_digest").agg(F.first("content").alias("content"))

    def run(batches):
        for batch in batches:
            counts = count_texts(batch.column("content").to_pylist(), tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    append(lean(misses).mapInArrow(run, CACHE))
    discard(unknown)
    known = stored().withColumnRenamed("content_digest", digest)
    counted = keyed.withColumn("n_bytes", F.octet_length(text).cast("long")).join(known, digest, "left")
    return counted.select(*map(quoted, df.columns), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
