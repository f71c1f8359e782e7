"""Personal-data spans against regular expressions of the library re, planted obfuscations, and edge cases."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rxnframe.llm import entry, pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    twice = lambda v: v * 2 - 9 if v > 4 else v * 2
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if good(kind, m.group()))
    return found, ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)


def check(rows, texts):
    for r, text in zip(rows, texts):
        found, written = base(text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in found) for i in range(4)], text
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), text
        spans = r.spans.split(",") if r.spans else []
        assert set(written.split(",") if written else []) <= set(spans)
        order = [(int(s.split(":")[1]), [p[0] for p in PATTERNS].index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def fuzz(n, seed):
    rnd = random.Random(seed)
    bits = ["a@b.c", "@", ".", "_%", "d@e-f.g.h", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111111111111111", "4111 1111-1111 1111", "411111111111111", " ", "-", "+", "+1 (643) 555-5742", "+(", "é🙂", "12", "\n", "x", "7"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_base_spans_match_the_patterns(spark):
    texts = [*fuzz(1500, 5), None, "", "a@b.c%d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "1" * 30_000, "a" * 200_000, "a" * 70_000 + "@b.c", "+1" + " " * 30_000 + "2", "1 " * 20_000, "a@b.c " * 3_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(sorted(pii.find(df).collect(), key=lambda r: r.doc_id), texts)


def test_op12(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = entry.op12_pii(spark, small).collect()
    assert len(out) == len(texts)
    check(out, [texts[r.doc_id] for r in out])


def corpus(n):
    """Texts with the base forms and with what looks alike: numbers that fail Luhn, dates, order numbers, hex strings."""
    rnd, rows = random.Random(9), []

    def card():
        d = [rnd.randint(0, 9) for _ in range(15)]
        return next(s for s in ("".join(map(str, [*d, c])) for c in range(10)) if luhn(s))

    for i in range(n):
        kind = i % 8
        number = "".join(str(rnd.randint(0, 9)) for _ in range(16))
        rows.append([
            f"write to joe.{i}@mail{i % 7}.example.com today", f"host {rnd.randint(1, 254)}.{i % 250}.{rnd.randint(0, 255)}.7 answered", f"paid with card {card()} yesterday",
            f"call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} now", f"order {number} was sent", f"on 20{rnd.randint(10, 24)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)} it rained",
            f'token = "{number}a{number}f"', f"version {rnd.randint(300, 999)}.{rnd.randint(256, 900)}.1.{i}",
        ][kind])
    return rows


HIDDEN = {
    "mail me: jane.doe (at) example (dot) org please": "email", "mail me: jane.doe[at]example.org please": "email", "mail jane.doe at example dot org please": "email",
    "paid with card 4111.1111.1111.1111 yesterday": "card", "host 10.20[.]30.7 answered": "ip",
}
CLEAN = ["They met at noon. The dot was red.", "chapter 3.2, page 17 of 2024", "order 1234567890123456 was sent", "on 2024-03-11 it rained", "9.81 m/s and 3.14159265358979"]


def test_method_adds_hidden_forms_and_leaves_clean_texts_alone(spark):
    texts = [*corpus(800), *HIDDEN, *CLEAN]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.text: r.spans for r in pii.find(df).collect()}
    check(pii.find(df).orderBy("doc_id").collect(), texts)
    for text, kind in HIDDEN.items():
        assert out[text].startswith(f"{kind}:"), (text, out[text])
    assert [out[t] for t in CLEAN] == [""] * len(CLEAN)
    added = [t for t in texts[:800] if out[t] != base(t)[1]]
    assert not added


def test_fit_reads_every_text(spark):
    """What is to be learned stands in a few of 25,000 texts only: copies of one whose hash is high, which samples of 20,000 texts left out, and their base forms."""
    texts = spark.createDataFrame([(f"order {i}234567890123456 was sent",) for i in range(1, 60) if not luhn(f"{i}234567890123456")], "text string")
    last = texts.orderBy(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)).desc()).first().text
    rows = [last] * 10 + ["paid with card 4111111111111111 yesterday"] * 10 + [f"nothing {i % 7}" for i in range(25_000)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = {r.label: r.n for r in pii.learnable(df).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert got[0] >= 10 and got[1] >= 10
    model = pii.fit(df)
    assert model is not None and model.trees


def test_weights_stand_for_equal_candidates(spark):
    df = spark.createDataFrame([(t,) for t in corpus(400) * 3], "text string")
    rows = pii.learnable(df).persist()
    each = rows.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    wanted = df.select(F.explode(pii.candidates(F.col("text"))).alias("c")).filter(pii.label(F.col("c")).isNotNull()).count()
    assert rows.count() < wanted == each.count()
    limits = pii._limits(rows)
    score = F.round(pii._train(rows, limits, 5, 3).score(F.struct(*pii.FEATURES)) - pii._train(each, limits, 5, 3).score(F.struct(*pii.FEATURES)), 9)
    assert [r[0] for r in rows.select(F.abs(score)).distinct().collect()] == [0.0]
    rows.unpersist()


def test_thresholds_count_every_fold(spark):
    """A constant score for each fold: 0.9 of fold 0 and 0.6 of fold 1, rows with weights."""
    at = lambda p: pii.Model([math.log(p / (1 - p)) / 2], [1.0])
    rows = [(f, y, *[pii.CARD, *[0] * (len(pii.FEATURES) - 1)], n) for f, y, n in [(0, 1, 99), (0, 0, 1), (1, 1, 60), (1, 0, 40)]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ("fold", "label", *pii.FEATURES)) + ", n long")
    for others, wanted in (((0.905, 0.605), 0.9), ((0.605, 0.905), 1.1)):
        model = at(0.5)
        pii._calibrate(model, df, [at(p) for p in others], 0.95)
        assert model.thresholds == {0: 0.5, 1: 0.5, 2: wanted, 3: 0.5}


def test_redact(spark):
    texts = [*corpus(200), "a@b.c 🙂 and +1 (643) 555-5742!", "nothing", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[200].text == "[email] 🙂 and [phone]!" and out[201].text == "nothing" and out[202].text == "" and out[203].text is None
    assert out[200].found == "x" and out[0].text == "write to [email] today"


def test_edges(spark):
    df = spark.createDataFrame([(None, "a@b.c", 1), (1, None, 2), (1, "a@b.c", 3)], "doc_id long, text string, spans int")
    rows = pii.find(df).collect()
    assert [(r.doc_id, r.spans) for r in rows] == [(None, "email:0:5"), (1, ""), (1, "email:0:5")]
    assert pii.find(df.limit(0)).count() == 0 and pii.fit(df) is None


@pytest.mark.parametrize("n", [0, 1, 2, 7, 16, 17, 1000])
def test_running_sums(spark, n):
    x = [(i * 7) % 11 for i in range(n)]
    row = spark.createDataFrame([(x,)], "x array<int>").select(pii.running(F.col("x")).alias("r")).first()
    assert row.r == [sum(x[: i + 1]) for i in range(n)]


def test_native_plan(spark, small):
    plan = entry.op12_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
