"""The pipeline's run, and its line stage against plain counting."""

import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F


def brute_lines(rows, sites=8, least=20):
    """doc_id -> text without boilerplate, from rows (doc_id, text, source)."""
    where, first = {}, {}
    for doc, text, source in sorted(rows):
        for pos, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                where.setdefault(line, set()).add(source)
                first.setdefault(line, (doc, pos))
    wide = {x for x, s in where.items() if len(s - {None}) >= sites}
    return {doc: "\n".join(x for pos, x in enumerate((text or "").split("\n")) if x not in wide or first[x] == (doc, pos)) for doc, text, _ in rows}


def test_line_stage(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, own = brute_lines(rows), {d: t for d, t, _ in rows}
    got = {r.doc_id: r for r in C.line_filter(spark, docs, sf).collect()}
    assert any(want[d] != (own[d] or "") for d in want)
    for d, text in want.items():
        if text.strip() or text == (own[d] or ""):
            assert (got[d].text or "") == text and (text == (own[d] or "") or got[d].n_chars == len(text))
        else:
            assert d not in got


def test_run_is_its_stages_in_order(spark, small):
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, p] = (s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))
    out = C.run(spark, small)
    rows = out.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for used in out.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("x")).collect():
        at = 0
        for x in used.x:
            assert x.offset == at
            at += x.length
        assert at <= 4096
