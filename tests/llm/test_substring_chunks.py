"""What a quoting document is sent stays bounded by its own length."""

import random

from pyspark.sql import functions as F

from rxnframe.llm import substring_dedup


def test_quotes_of_a_book(spark):
    rnd = random.Random(1)
    book = [f"w{rnd.randint(0, 10**6)}" for _ in range(6_000)]
    rows = [(0, " ".join(book)), (1, " ".join(book))]
    for d in range(2, 42):
        a, b = rnd.randrange(5_000), rnd.randrange(5_000)
        rows.append((d, " ".join([*book[a : a + 60], *[f"x{d}_{k}" for k in range(200)], *book[b : b + 60]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    sent = spans.select("doc", F.aggregate("spans", F.lit(0), lambda n, s: n + F.length(s.words)).alias("sent")).filter("doc > 1").collect()
    own = {d: len(t) for d, t in rows}
    assert len(sent) == 40 and all(r.sent <= 3 * own[r.doc] for r in sent)
    gone = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, digest=True).collect()}
    assert gone[0] == 0 and gone[1] == 6_000 and all(gone[d] in (120, 60 + 60, 119, 118) or gone[d] >= 60 for d in range(2, 42))
