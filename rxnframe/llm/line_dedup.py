"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

HyperLogLog sketches of the sites (`source`) of each line hash merge by aggregation. A line whose estimate is clearly
under or over `sites` is decided; a line within `band` of it gets an exact distinct count. A line on `sites` sites or
more with at least `min_chars` characters is boilerplate: its first occurrence (smallest doc_id, then position) stays,
every other one goes.

Null texts have no lines and stay null. A null source counts as no site. Rows without an id neither keep a first
occurrence nor lose lines. Rows that repeat an id lose lines each by their own text; the places of a first occurrence are
those of the smallest id, so such rows keep the line at the same position. Empty and short lines always stay. An empty
table gives an empty result. Extra columns stay whatever their names; n_lines and n_removed are replaced. Lines are told
apart by 64-bit hashes, written once and read from there. A text is cut in time linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, fresh, quoted, table

SITES, BAND, LOG_K, MIN_CHARS = 8, 0.25, 11, 20


def site_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (a key of the text), site, hash and position of each line that is long enough."""
    parts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return parts.filter(F.length("line") >= min_chars).select("doc_id", "row", "site", "pos", F.xxhash64("line").alias("hash"))


def boilerplate(lines: DataFrame, sites: int = SITES, band: float = BAND) -> DataFrame:
    """lines (as from site_lines) -> hash, first_doc and first_pos of each boilerplate line."""
    seen = lines.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"))
    spread = table(seen.withColumn("estimate", F.hll_sketch_estimate("sketch")).filter(F.col("estimate") >= sites * (1 - band)).select("hash", "estimate", "first"))
    sure = spread.filter(F.col("estimate") > sites * (1 + band))
    near = spread.filter(F.col("estimate") <= sites * (1 + band))
    exact = lines.select("hash", "site").join(near.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    wide = table(sure.select("hash", "first").unionByName(near.join(exact.select("hash"), "hash").select("hash", "first")))
    discard(spread)
    return wide.select("hash", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def dedup_lines(docs: DataFrame, sites: int = SITES, band: float = BAND, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate cut out of text, and n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    lines = table(site_lines(docs, min_chars))
    hits = lines.select("doc_id", "row", "hash", "pos").join(boilerplate(lines, sites, band), "hash")
    gone = hits.filter((F.col("doc_id") != F.col("first_doc")) | (F.col("pos") != F.col("first_pos")))
    doc, row, cuts = fresh(docs, "doc", "row", "cuts")
    marks = table(gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))).toDF(doc, row, cuts)
    discard(lines)
    out = docs.join(marks, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")
    split = F.split("text", "\n")
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), cuts).alias("a"), F.concat(F.col(cuts), F.array(F.size(split))).alias("b"))
    kept = F.flatten(F.transform(ends, lambda x: F.slice(split, x.a + 2, x.b - x.a - 1)))  # the lines between two cuts
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines")
    n_removed = F.when(F.col(cuts).isNull(), 0).otherwise(F.size(cuts)).cast("long").alias("n_removed")
    return out.select(*[text if c.lower() == "text" else quoted(c) for c in docs.columns], n_lines, n_removed)


def sql(sites: int = SITES, min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for op4: exact distinct sites throughout."""
    return f"""
with parts as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
lines as (select doc_id, source, unnest(lines) as line, unnest(range(len(lines))) as pos from parts),
long as (select * from lines where length(line) >= {min_chars}),
wide as (select line, min(struct_pack(d := doc_id, p := pos)) as first from long group by line having count(distinct source) >= {sites}),
marked as (select l.doc_id, l.pos, l.line, w.line is not null and length(l.line) >= {min_chars} and (l.doc_id <> w.first.d or l.pos <> w.first.p) as gone
  from lines l left join wide w on l.line = w.line),
kept as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from marked group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(k.text) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id"""
