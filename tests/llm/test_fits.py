"""Counting with any tokenizer, and the fits of language and quality models against slow doubles."""

import random


import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rxnframe.llm import bpe, language_id, packing, quality, token_counts


def fuzz(n, seed):
    rnd = random.Random(seed)
    letters = "aZé1２ \n\t 　'!?srtmdlvé𝒳漢<|>"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["<|endoftext|>", "a<|endoftext|>b", "", "It's DON'T ..."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_every_json(name):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(P.path(name)), fuzz(3000, 5)
    assert token_counts.count_texts(texts, P.path(name)) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_counts_of_a_sentencepiece_model(spark, tmp_path):
    import sentencepiece

    path, texts = P.path("piece_bpe_32k.model"), fuzz(300, 6)
    t = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path, str(tmp_path / "c")).collect()}
    assert got == {i: len(t.encode(x or "")) for i, x in enumerate([*texts, None])}


def test_versions_differ_and_share_a_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "Don't STOP now"), (2, "Don't STOP now"), (3, None)], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            from tokenizers import Tokenizer

            n = len(Tokenizer.from_file(P.path(name)).encode("Don't STOP now", add_special_tokens=False))
            assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, P.path(name), cache).collect()} == {1: n, 2: n, 3: 0}
    assert spark.read.parquet(cache).count() == 4


def slow_language_model(rows):
    """Counts, weights and trust worked out one gram at a time; rows: (text, lang), all of which are training rows."""
    langs = sorted({lang for _, lang in rows})
    counts = np.full((len(langs), 2 * language_id.BUCKETS), 0.05)
    for text, lang in rows:
        for a, b in language_id.grams([text])[0].tolist():
            counts[langs.index(lang), a] += 1
            counts[langs.index(lang), b] += 1
    share = counts / counts.sum(1, keepdims=True)
    code = language_id.codewords(len(langs))
    weights = np.stack([np.log(share[c > 0].mean(0)) - np.log(share[c < 0].mean(0)) for c in code.T], 1)
    right = np.zeros(code.shape[1])
    for text, lang in rows:
        z = sum((weights[a] + weights[b] for a, b in language_id.grams([text])[0].tolist()), np.zeros(code.shape[1]))
        right += (z > 0) == (code[langs.index(lang)] > 0)
    return langs, weights, np.maximum(right / len(rows) - 0.5, 0.01)


def test_language_fit_against_a_slow_double(spark):
    rnd = random.Random(3)
    words = {"a": "the and of hello", "b": "le la et bonjour", "c": "der die und guten", "d": "el los y hola"}
    rows = sorted({(" ".join(rnd.choice(words[k].split()) for _ in range(rnd.randint(2, 9))), k) for k in words for _ in range(12)})
    df = spark.createDataFrame([(i % 7, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(df)
    langs, weights, trust = slow_language_model(rows)
    assert model.langs == langs and np.allclose(model.weights, weights, atol=1e-4) and np.allclose(model.trust, trust)


def test_null_and_equal_ids_train_without_one_hot_task(spark):
    """All ids null: rows are still spread over the hash, and the sample holds. Copies of one row count once."""
    df = spark.range(6_000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'x', 'y') as lang")
    df = df.unionByName(spark.range(3_000).selectExpr("1L as doc_id", "'the same' as text", "'x' as lang"))
    assert language_id.fit(df, sample=100).langs == ["x", "y"]
    at = df.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(language_id.TOP)).alias("at"))
    assert at.distinct().count() == 6_001


def slow_features(raw: bytes) -> np.ndarray:
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    return quality.features(data, off)[0]


def test_moments_cover_all_rows(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["good text", "BAD!! 99", "x", "Ünïcode", ""]) for _ in range(rnd.randint(0, 30))) for _ in range(400)] + [None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = quality.fit(docs, docs.filter("doc_id < 60").select("doc_id"), positives=20, unlabelled=30)
    x = np.stack([slow_features((t or "").encode()) for t in texts]).astype(float)
    assert np.allclose(model.centre, x.mean(0), atol=1e-5) and np.allclose(model.scale, x.std(0) + 0.02, atol=1e-4)


def test_prior_counts_all_held_out_rows():
    """The share above each cutoff by plain counting, and the estimate by a loop over cutoffs."""
    rng = np.random.default_rng(3)
    z, u = np.sort(rng.normal(2, 1, 300)), np.concatenate([rng.normal(2, 1, 700), rng.normal(-1, 1, 300)])
    above = np.array([(u >= c).sum() for c in z])
    assert (above == len(u) - np.searchsorted(np.sort(u), z, "left")).all()
    got, slack = quality.fold_prior(z, above, len(u))
    keep = z[:270]
    qp, qu = [np.mean(z >= c) for c in keep], [np.mean(u >= c) for c in keep]
    best = min(range(270), key=lambda i: (qu[i] + slack) / qp[i])
    alike = [b / a for a, b in zip(qp, qu) if a >= 0.2 and abs(b / a - qu[best] / qp[best]) <= slack]
    assert abs(got - np.quantile(alike, 0.25)) < 1e-3 and abs(got - 0.7) < 0.1  # a cutoff at the border of chance may fall on either side
    assert quality.estimate_prior([]) == 0.5 and quality.estimate_prior([(0.9, 0.1), (0.7, 0.1)]) == pytest.approx(0.7)


def test_quality_sample_does_not_depend_on_row_order(spark):
    docs = spark.range(900).selectExpr("id % 40 as doc_id", "concat('some text ', id % 300) as text")
    one, two = (sorted(r.text for r in quality._share(x, 50, 9).collect()) for x in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert one == two and 0 < len(one) <= 50 and len(set(one)) == len(one)


def test_offsets_place_every_token():
    v = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    for text, ids in zip(fuzz(300, 9), bpe.encode_texts(fuzz(300, 9), v)):
        at = np.array(ids, np.int64)
        offsets = v.offsets(at)
        raw = text.encode()
        assert v.placed(at, offsets) == raw and offsets[-1] == len(raw)
        assert [raw[a:b] for a, b in zip(offsets, offsets[1:])] == [v.tokens[i] for i in ids]


# Packing


def fewest(lengths, size):
    """The least number of sequences, by trying every place."""
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= lengths[k] and room[i] not in room[:i]:
                place(k + 1, [*room[:i], room[i] - lengths[k], *room[i + 1 :]])
        place(k + 1, [*room, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def sound(lengths, size):
    seq, offset, _ = packing.pack(np.array(lengths), size)
    used = {}
    for s, o, n in sorted(zip(seq.tolist(), offset.tolist(), lengths)):
        assert o == used.get(s, 0)
        used[s] = o + n
    assert max(used.values(), default=0) <= size
    return len(used)


def test_known_optima():
    assert sound([1365] * 2000 + [1366] * 1000, 4096) == 1000
    rnd = random.Random(1)
    half = [rnd.randint(1, 2047) for _ in range(1000)]
    assert sound(half + [4096 - x for x in half], 4096) == 1000
    assert sound([1024, 1024, 1024, 1024] * 500, 4096) == 500
    assert sound([2049] * 300, 4096) == 300


@pytest.mark.parametrize("seed", range(6))
def test_small_cases_reach_the_optimum(seed):
    rnd = random.Random(seed)
    off = 0
    for _ in range(12):
        lengths = [rnd.choice([rnd.randint(1, 4096), rnd.randint(600, 1700)]) for _ in range(rnd.randint(1, 9))]
        off += sound(lengths, 4096) - fewest(lengths, 4096)
    assert off == 0


