"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxnframe.llm import bpe, conversation_trie, language_id, line_dedup, near_dedup, packing, pii, quality, substring_dedup, token_counts, top_k, vector_dedup, whitening
from rxnframe.llm.common import read


def _bucket(n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids belong to no bucket."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=50, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(_bucket(4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    out = language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end=1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_bucket(5) == 0, F.lit(False))
    trusted = read(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~held_out)
    model = quality.fit(docs.filter(~held_out), trusted)
    out = quality.score(docs.withColumn("held_out", held_out), model, cutoff=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, k=5, percent=85)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), t=0.95)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(read(spark, sf_dir, "conversations"), c - c % 100, head))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_language_id, op4_line_dedup, op5_best_fit_packing, op6_quality,
        op7_byte_bpe, op8_minhash_near_dedup, op9_exact_top_k, op10_embedding_near_dedup,
        op11_conversation_trie, op12_pii, op13_embedding_whitening,
    )
}

WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = {
    "op1_substring_dedup": rf"""
with w as (select doc_id, coalesce(regexp_extract_all(text, {WORDS}), []) as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
least as (select h, min(doc_id) as first from win group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from (select win.doc_id, i from win join least using (h) where first < win.doc_id)),
pos as (select doc_id, unnest(range(1, len(ws) + 1)) as j, unnest(ws) as word from w),
kept as (select p.doc_id, string_agg(p.word, ' ' order by p.j) as text, count(*) as n from pos p anti join gone g on p.doc_id = g.doc_id and p.j = g.j group by p.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from w left join kept k on w.doc_id = k.doc_id""",
    "op4_line_dedup": line_dedup.sql(),
    "op8_minhash_near_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), {WORDS}) as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as component from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component, d.doc_id) as component_id, coalesce(c.component, d.doc_id) = d.doc_id as kept
from documents d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.node""",
    "op9_exact_top_k": top_k.sql(),
    "op10_embedding_near_dedup": vector_dedup.sql(),
    "op11_conversation_trie": conversation_trie.sql(),
}
