"""Corpus operators against SQL, the libraries, brute force or held-out accuracy, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rxnframe.llm import bpe, components, entry, language_id, line_dedup, near_dedup, packing, pretokenise, quality, substring_dedup, token_counts, top_k, vector_dedup
from tests.compare import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", None, None, 3), (4, "one", None, None, 3), (4, "two words", "fr", "b", 9),
    (None, "one", "en", "a", 3), (5, "long " * 30_000, "en", "b", 150_000), (6, "éàü 漢字 🙂 don't", "fr", "c", 15), (7, "a<|endoftext|>b", "en", "c", 15),
]


@pytest.fixture(scope="module")
def mid():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("ids", "digest", "family", "score", "spans", "hash", "content_digest", "group", "_key"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_matches_sql(spark, small, name):
    assert_same(entry.QUERIES[name](spark, small), connect(small), entry.SQL[name])


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Pieces and tokens


def reference():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=3):
    rnd = random.Random(seed)
    letters = "aZé1２ \n\t 　'!?srtmdlvé𝒳漢"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_pieces_match_the_pattern():
    import regex

    for t in fuzz(3000):
        data, at, first = pretokenise.pieces([t])
        assert [data[a:b].decode() for a, b in zip(at, at[1:])] == regex.findall(P.PATTERN, t)


def test_ids_match_the_library():
    e, v = reference(), bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    some = [*fuzz(2000, 4), "x" * 5000 + "ab" * 300, "", "<|endoftext|>"]
    assert list(bpe.encode_texts(some, v)) == [e.encode_ordinary(t) for t in some]


def test_op7(spark, small):
    e, t = reference(), texts(spark, small)
    for r in entry.op7_byte_bpe(spark, small).collect():
        ids = e.encode_ordinary(t[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t[r.doc_id].encode()).hexdigest()


def test_encode_decode_round_trip(odd, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(odd, path), path)
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.ids) == len(r.offsets)
        assert r.digest == "mine"
    assert bpe.decode(bpe.encode(none, path), path).count() == 0


def test_op2(spark, small):
    from tokenizers import Tokenizer

    k, t = Tokenizer.from_file(P.path("byte_bpe_50k.json")), texts(spark, small)
    for r in entry.op2_token_counts(spark, small).collect():
        n = len(k.encode(t[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t[r.doc_id].encode()), n, n > 512)


def test_token_count_cache(spark, odd, none, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = token_counts.token_counts(odd, path, cache).collect()
    kept = spark.read.parquet(cache)
    n = kept.count()
    assert n == kept.select("content_digest").distinct().count() == len({x[1] or "" for x in ODD})
    second = token_counts.token_counts(odd, path, cache).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and spark.read.parquet(cache).count() == n
    assert {r.text: r.n_tokens for r in first}[""] == 0 and len(first) == len(ODD)
    assert next(r.n_tokens for r in first if r.doc_id == 7) == 3
    spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), "another version", 99)], token_counts.CACHE).write.mode("append").parquet(cache)
    assert {r.n_tokens for r in token_counts.token_counts(odd.filter("text = 'one'"), path, cache).collect()} == {1}
    assert token_counts.token_counts(none, path, cache).count() == 0


# Packing


def test_op5(spark, small, slack=1.03):
    from tokenizers import Tokenizer

    k, t = Tokenizer.from_file(P.path("word_bpe_49k.json")), texts(spark, small)
    rows = entry.op5_best_fit_packing(spark, small).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(t)
    for d, got in by_doc.items():
        ids = np.array([*k.encode(t[d], add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got) == [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_seq) <= slack * -(-sum(r.length for r in rows) // 4096) + 1


def test_word_ids_match_the_library():
    t = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    some = [*fuzz(3000, 5), "Don't, stop. it's' «quoted», ΑΣ Σ. İstanbul é Å <|ENDOFTEXT|> <|endoftext|>x", "(a)b'll'. c',d ''e"]
    for s, ids in zip(some, t.ids(some)):
        assert np.frombuffer(ids, "<u4").tolist() == t.library.encode(s, add_special_tokens=False).ids, s


def test_packing_edges(odd, none):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert sum(1 for r in rows if r.doc_id == 4) == 3 and [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack_documents(none, path).count() == 0


def test_packing_is_tight():
    n = np.random.default_rng(1).integers(1, 3000, 3000)
    seq, offset, by = packing.pack(n, 4096)
    assert np.bincount(seq, n).max() <= 4096 and seq.max() + 1 <= 1.01 * n.sum() / 4096 + 1
    assert np.mean(by == packing.PATTERN) > 0.8


def test_counts_never_overdraw_a_bin():
    rng = np.random.default_rng(2)
    for h in (rng.integers(0, 60, 64), np.eye(64)[15] * 999, np.eye(64)[63] * 5, np.zeros(64), rng.poisson(0.4, 64), np.full(16, 3)):
        m, count = packing.fit(h.astype(float))
        assert (count > 0).all() and (m @ count <= h).all()
        assert (m.sum(0) <= packing.PLACES).all() and ((2 * np.arange(len(h)) + 1) @ m <= 2 * len(h)).all()


# Classifiers


def test_op3(spark, mid):
    rows = entry.op3_language_id(spark, mid).join(spark.read.parquet(f"{mid}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd, none):
    model = language_id.fit(odd)
    out = {r.text: r for r in language_id.predict(odd, model).collect()}
    assert out[None].lang_pred == out[""].lang_pred == out[" \n\t "].lang_pred == "und" and out[None].score == 0
    assert out["one"].lang_pred in ("en", "fr") and out["one"].digest == "mine"
    nothing = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    one = language_id.fit(odd.filter("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(odd, one).filter("text = 'one'").collect()} == {"en"}
    assert language_id.predict(none, model).count() == 0


def test_bands_follow_percent(spark):
    for percent in (50, 70, 80, 82, 85, 95, 100):
        rows, bands = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-4
    assert near_dedup.banding(85) == (6, 20)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(3, 63))))], "doc_id long, text string")
    links = [r.component_id for r in near_dedup.near_duplicates(docs, k=1, percent=80).orderBy("doc_id").collect()]
    assert links == [1, 1]


def test_pairs_at_threshold_share_a_band(spark):
    # 3000 pairs at similarity 80 / 100; six of them would meet in no band of the banding for 85
    both = F.expr("transform(sequence(1, 80), i -> concat(id, 'x', i))")
    own = F.expr("transform(sequence(1, 10), i -> concat(id, 'y', side, 'z', i))")
    docs = spark.range(3000).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("id") * 2 + F.col("side")).alias("doc_id"), F.array_join(F.concat(both, own), " ").alias("text"))
    out = near_dedup.near_duplicates(docs, k=1, percent=80)
    assert out.filter("kept").count() <= 3001


def test_rare_language_is_learned(spark):
    words = {"en": "the quick brown fox jumps over the lazy dog and then the other dog", "fr": "le renard brun saute par dessus le chien paresseux et puis un autre chien", "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"}
    lang = F.expr("case when id % 10000 = 77 then 'el' when id % 4 = 0 then 'fr' else 'en' end")
    text = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("lang")]
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), lang.alias("lang")).withColumn("text", F.concat(text, F.lit(" "), F.col("doc_id").cast("string")))
    void = spark.createDataFrame([(-1, "zz", " 12 "), (-2, "zz", "")], "doc_id long, lang string, text string")
    model = language_id.fit(docs.unionByName(void))
    assert model.langs == ["el", "en", "fr"]
    assert model.predict([words["el"], words["en"], words["fr"]], 0.2)[0] == ["el", "en", "fr"]


def test_language_quotas():
    assert language_id.quotas({"a": 10**9, "b": 3, "c": 10**6}, 3000) == {"b": 3, "c": 1498, "a": 1499}
    assert language_id.quotas({"a": 5, "b": 3}, 3000) == {"a": 5, "b": 3}
    assert set(language_id.quotas({str(i): 9 for i in range(50)}, 20).values()) == {1}
    assert language_id.quotas({}, 3000) == {}


def test_codewords():
    for n in range(2, 61):
        code = language_id.codewords(n)
        bits = code.shape[1]
        assert len({tuple(r) for r in code.tolist()}) == n and (np.abs(code.sum(0)) < n).all()
        columns = np.abs(code.T @ code) - n * np.eye(bits)
        assert columns.max() < n
        near = (bits - (code @ code.T - 2 * bits * np.eye(n)).max()) / 2
        assert near >= max(1, bits // 4)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 8, 13])
def test_decoding_matches_brute_force(n):
    rnd = random.Random(n)
    letters = [rnd.sample("abcdefghijklmnopqrstuvwxyzéäößñ", 9) for _ in range(n)]
    say = lambda i: " ".join("".join(rnd.choice(letters[i]) for _ in range(rnd.randint(2, 7))) for _ in range(25))
    langs = [f"l{i:02}" for i in range(n)]
    labels = [i % n for i in range(12 * n)]
    texts = [say(i) for i in labels]
    model = language_id.Model(langs, list(map(language_id.tally, texts)), [langs[i] for i in labels])
    assert np.isfinite(model.weights).all() and np.isfinite(model.trust).all()
    some = [say(i % n) for i in range(3 * n)] + ["x", "12", "é" * 50]
    got, scores, unsure = model.predict(some, 0.2)

    def counts(text):
        g = language_id.grams([text])[0]
        return g[:, 0].tolist() + g[:, 1].tolist()

    share = np.full((n, 2 * language_id.BUCKETS), 0.05)
    for i, t in zip(labels, texts):
        for b in counts(t):
            share[i, b] += 1
    share /= share.sum(1, keepdims=True)

    def margin(text, k):
        ones, zeros = ([i for i in range(n) if model.code[i, k] == s] for s in (1, -1))
        odds = sum(np.log(np.mean([share[i, b] for i in ones])) - np.log(np.mean([share[i, b] for i in zeros])) for b in counts(text))
        return odds / (1 + (len(text) + 1) / language_id.SATURATE)

    for text, lang, score, flag in zip(some, got, scores, unsure):
        if not any(c.isalpha() for c in text):
            assert (lang, score, flag) == ("und", 0, False)
            continue
        zs = [margin(text, k) for k in range(model.code.shape[1])]
        loss = [sum(w * np.log1p(np.exp(-z * c)) for w, z, c in zip(model.trust, zs, model.code[i])) for i in range(n)]
        p = np.exp(min(loss) - np.array(loss))
        p /= p.sum()
        assert lang == langs[int(p.argmax())] and abs(score - p.max()) < 1e-3 and 0 <= score <= 1
        two = sorted(p)[-2:] if n > 1 else [0, 1]
        assert abs((two[1] - two[0]) - 0.2) < 1e-3 or flag == (two[1] - two[0] < 0.2)


def test_long_text_in_slices(monkeypatch):
    model = language_id.Model(["a", "b", "c"], list(map(language_id.tally, ["hello world the", "bonjour le monde", "guten tag"])), ["a", "b", "c"])
    some = ["hello the bonjour 12 " * 400, "é ñ ü" * 100, "", "x" * 64, "tag " * 16]
    whole = model.margins(some)
    monkeypatch.setattr(language_id, "SLICE", 64)
    cut = model.margins(some)
    for t in some:
        places, letters, bucket, n = language_id.tally(t)
        g, _, (many,) = language_id.grams([t])
        assert (places, letters) == (len(t) + 1, many) and np.array_equal(np.bincount(g.ravel(), minlength=bucket.max() + 1)[bucket], n) and n.sum() == g.size
    assert np.allclose(whole[0], cut[0], atol=1e-4) and list(whole[1]) == list(cut[1])


def test_op6(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = entry.op6_quality(spark, large).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 1 for r in good) >= 0.97 * len(good)
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_quality_edges(odd, none):
    model = quality.fit(odd, odd.filter("doc_id = 6").select("doc_id"))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(odd, quality.fit(none, none)).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


# Duplicates


def test_line_dedup_edges(odd, none):
    rows = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(odd).collect()}
    assert rows == {(x[0], x[1]) for x in ODD}
    assert line_dedup.dedup_lines(none).count() == 0


def test_boilerplate_goes_but_its_first_occurrence_stays(spark):
    line = "all rights reserved by the owner of this site"
    rows = [(i, f"{line}\nbody number {i} of this page\n{line}", None, f"s{i % 9}", 0) for i in range(30)] + [(99, f"{line} ", None, "s1", 0)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].text == f"{line}\nbody number 0 of this page" and out[7].text == "body number 7 of this page" and out[99].n_removed == 0
    fewer = spark.createDataFrame([r[:3] + (f"s{r[0] % 7}", 0) for r in rows], DOCS)
    assert line_dedup.dedup_lines(fewer).agg(F.sum("n_removed")).first()[0] == 0


def brute_passages(rows, window):
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 5, 12])
def test_passages_match_brute_force(spark, window):
    rnd = random.Random(window)
    base = [" ".join(rnd.choice("abcd") for _ in range(60)) for _ in range(4)]
    rows = []
    for d in range(120):
        w = " ".join(rnd.choice(base)[a : a + rnd.randint(0, 80)] for a in [rnd.randint(0, 60) for _ in range(3)]).split()
        if rnd.random() < 0.5 and w:
            w[rnd.randrange(len(w))] = "z"
        rows.append((d * 3 % 121, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substring_dedup.remove_repeats(df, window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in out.collect()) == brute_passages(rows, window)


def test_passage_edges(odd, none):
    out = substring_dedup.remove_repeats(odd).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str((x[0], x[1])) for x in ODD)
    assert {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0} and {r._key for r in out} == {"mine"}
    assert substring_dedup.remove_repeats(none).count() == 0
    copies = odd.filter("doc_id = 5").unionByName(odd.filter("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long")))
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(copies).collect()} == {5: 0, 50: 30_000}


def brute_near(rows, k, percent):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return sorted((d, len(sets[d]), label[d], label[d] == d) for d in ids)


def near_copies(n, edits, seed, length=150):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [3, 6])
def test_near_duplicates_of_a_large_family(spark, edits):
    rows = list(enumerate(near_copies(330, edits, edits) + near_copies(20, 2, 9) + ["short text", "Short TEXT", "", "other"]))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, 5, 85).collect())) == brute_near(rows, 5, 85)


def test_near_duplicate_edges(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None} == {(1, None, True)}
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0} and {r.component_id for r in rows if r.doc_id == 4} == {4}
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rnd = random.Random(2)
    names = rnd.sample(range(10_000), 400)
    edges = {"path": list(zip(names, names[1:])), "star": [(9_999_999, x) for x in names], "random": [tuple(rnd.sample(names, 2)) for _ in range(300)], "empty": []}[shape]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    df = spark.createDataFrame([*edges, *edges[:3], (5, 5), (None, 5)], "a long, b long")
    assert {r.node: r.component for r in components.components(df).collect()} == label


# Vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_matches_brute_force():
    rng = np.random.default_rng(3)
    for n, d in ((5, 3), (400, 8), (900, 32)):
        x = np.floor(rng.normal(size=(n, d)) * rng.choice([3, 40])) + 0.0
        p = top_k.Postings(np.arange(n) * 7 % n, x)
        for own in range(0, n, 37):
            q = p.x[own]
            ids, scores = p.top(p.ids[own], q, 10)
            s = p.x @ q
            want = sorted((-s[i], p.ids[i]) for i in range(n) if i != own)[:10]
            assert list(zip(-scores, ids)) == want


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.0, 1.0], 2), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 0.0], 1), (6, [1.0, None], 1), (7, [], 1), (8, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [2.0, 0.1], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("vector", F.lit("mine")).withColumn("id", F.lit("mine"))
    out = vector_dedup.near_vectors(df).collect()
    assert len(out) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id in (0, 9, 2, 8, 3)) == [(0, 2, 0), (2, 0, 2), (3, 0, 3), (8, 0, 8), (9, 2, 0)]
    found = top_k.top_k(df, df.filter("vec_id % 100 = 0")).filter("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found][:2] == [(9, 2 * 1024 * 1024), (100, 1024 * 1024)] and {r.vec_id for r in found} == {9, 100, 2}
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0 and top_k.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("dims, n", [(64, 500), (40, 300), (1, 50), (5, 200)])
def test_near_vectors_match_brute_force(spark, dims, n):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.2, 0.35, 1.0], (n, 1))).astype(np.float32)
    x[: n // 10] = x[n // 2]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(1))
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, [float(y) for y in v], 0) for i, v in enumerate(x)], VECTORS)
    got = sorted(map(tuple, vector_dedup.near_vectors(df).collect()))
    assert got == [(i, int(link[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(n)]


# Pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    first = {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        rows = [(d, r.text or "") for d, r in before.items()]
        if name == "MinHash near-dedup":
            assert set(after) == {d for d, _, _, kept in brute_near(rows, 5, 80) if kept}
        if name == "substring dedup":
            want = {d: (text, gone) for d, _, gone, text in brute_passages(rows, 50)}
            assert {d: " ".join(r.text.split()) for d, r in after.items()} == {d: t for d, (t, gone) in want.items() if t or not gone}
            assert all(r.n_chars == len(r.text) for d, r in after.items() if want[d][1])
        if name == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 0").collect()}
            assert len(set(before) - set(after) - bad) <= 0.2 * len(before)
    assert sum(r.length for r in C.STAGES[-1][1](spark, docs, small).collect()) >= docs.count()
    assert first


def test_pipeline_on_odd_rows(spark, small, odd, none):
    import corpus_pipeline as C

    for _, stage in C.STAGES:
        assert stage(spark, none, small).count() == 0
    rows = odd.withColumns({c: F.lit(f"my {c}") for c in ("Score", "PREDICTED", "n_removed", "N_Lines", "n_words")})
    mine = {"Score", "PREDICTED", "n_removed", "N_Lines", "n_words"}
    before = sorted((x[0], x[1]) for x in ODD if x[0] and x[0] != 4 and x[1])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, rows, small)
        assert out.columns == rows.columns
        got = out.collect()
        assert all(r[c] == f"my {c}" for r in got for c in mine)
        if name != "quality classifier":  # nothing here repeats but rows of one id
            assert {(r.doc_id, r.text) for r in got} == {(x[0], x[1]) for x in ODD}
        else:
            assert {(r.doc_id, r.text) for r in got} <= {(x[0], x[1]) for x in ODD}
    pieces = C.STAGES[-1][1](spark, rows, small).collect()
    assert {r.doc_id for r in pieces} == {x[0] for x in ODD} and sum(r.doc_id == 4 for r in pieces) == 3 and before


def test_quality_stage_matches_brute_force(spark, small):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    trusted = spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1")
    model = quality.fit(docs, trusted)
    kept = {r.doc_id for r in C.quality_filter(spark, docs, small).collect()}
    for r in docs.collect():
        score = slow_score(model, (r.text or "").encode())
        assert (r.doc_id in kept) == (score >= quality.CUTOFF) or abs(score - quality.CUTOFF) < 1e-4


def slow_score(model, raw: bytes) -> float:
    """The linear model over features counted one by one."""

    def shape(c):
        plain = [i for i in range(33, 127) if not chr(i).isalnum()]
        if c in plain:
            return plain.index(c) + 8
        return 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 5 if c == 10 else 4 if c in (9, 11, 12, 13, 32) else 0 if c < 128 else 6 if c < 192 else 7

    n, x = len(raw), np.zeros(quality.WIDTH)
    kinds = [shape(c) for c in raw]
    for i, k in enumerate(kinds):
        x[k * quality.SHAPES + (kinds[i + 1] if i + 1 < n else 0)] += 1
    x[:-5] = np.sqrt(x[:-5] / max(1, n))
    w = [t for t in re.split(rb"[\x20\x09-\x0D]+", raw) if t]
    near = [[i >= k and w[i] == w[i - k] for k in (1, 2, 3)] for i in range(len(w))]
    x[-5:] = [sum(map(any, near)) / max(1, len(w)), sum(a[0] for a in near) / max(1, len(w)), np.log1p(n) / 10, np.log1p(kinds.count(4)) / 10, np.log1p(kinds.count(5)) / 10]
    return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))


@pytest.mark.parametrize("prior", [None, 0.3, 0.95])
def test_slope_is_that_of_the_non_negative_risk(prior):
    rng = np.random.default_rng(4)
    p, u, w = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), rng.normal(0, 1, 5)
    loss = lambda z: np.log1p(np.exp(-z))

    def risk(w):
        zp, zu = ([sum(a * b for a, b in zip(row, w[:-1])) + w[-1] for row in x] for x in (p, u))
        if prior is None:
            return sum(map(loss, zp)) / len(zp) + sum(loss(-z) for z in zu) / len(zu)
        negative = sum(loss(-z) for z in zu) / len(zu) - prior * sum(loss(-z) for z in zp) / len(zp)
        return prior * sum(map(loss, zp)) / len(zp) + negative if negative >= 0 else -negative

    branches = set()
    for sign, shift in ((1, 0), (1, 3), (1, -3), (-1, 0)):
        v = sign * w + np.array([0, 0, 0, 0, shift])
        g = quality.slope(p, u, v, prior)
        h = 1e-6
        want = [(risk(v + h * e) - risk(v - h * e)) / (2 * h) for e in np.eye(5)]
        assert np.allclose(g, want, atol=1e-5)
        zp, zu = (x @ v[:-1] + v[-1] for x in (p, u))
        branches.add(np.logaddexp(0, zu).mean() >= (prior or 0) * np.logaddexp(0, zp).mean())
    assert branches == ({True, False} if prior == 0.95 else {True})


# Paths that only large inputs take, forced by small constants


def test_top_k_in_several_shards_and_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(top_k, "VALUES", 64 * 30)
    monkeypatch.setattr(top_k, "SEEDS", 64 * 15)
    assert_same(entry.QUERIES["op9_exact_top_k"](spark, small), connect(small), entry.SQL["op9_exact_top_k"])
    monkeypatch.setattr(top_k, "VALUES", 64)
    v = spark.createDataFrame([(i % 7 * 100, [float(i % 5), float(i % 3), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    rows = [(i % 7 * 100, np.floor(1024 * np.array([i % 5, i % 3, 1.0]))) for i in range(60)]
    want = []
    for own, q in rows:  # rows that repeat an id are ranked each
        best = sorted(((-int(q @ x), i) for i, x in rows if i != own))[:10]
        want += [(own, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, top_k.top_k(v, v).collect())) == sorted(want)


def test_near_vectors_in_many_tiles(spark, small, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARE", 1000)
    monkeypatch.setattr(vector_dedup, "LEAST", 3)
    assert_same(entry.QUERIES["op10_embedding_near_dedup"](spark, small), connect(small), entry.SQL["op10_embedding_near_dedup"])
    test_near_vectors_match_brute_force(spark, 40, 120)


def test_invalid_row_beside_a_valid_one_of_its_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, None, 0), (2, [1.0, 0.01], 0), (1, [0.0, 0.0], 0)], VECTORS)
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect())
    assert rows == [(1, 0, 1), (1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_packing_in_many_shards(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    monkeypatch.setattr(packing, "AGAIN", 16)
    test_op5(spark, small, slack=1.1)


@pytest.mark.parametrize("edits", [4, 9])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, edits):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "TILE", 7)
    rows = list(enumerate(near_copies(90, edits, 5 + edits) + near_copies(60, edits, 6) + near_copies(20, 1, 9)))
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, 5, 85).collect())) == brute_near(rows, 5, 85)


def test_two_chained_clusters_of_near_copies(spark, monkeypatch):
    # two crowds whose members are alike among themselves, and linked to each other by few pairs or none
    monkeypatch.setattr(near_dedup, "TILE", 16)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for i in range(60):
        w = base[:]
        if i % 2:
            w[:4] = [f"v{j}" for j in range(4)]
        if i % 3 == 1:
            w[100 + i] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, 5, 95).collect())) == brute_near(rows, 5, 95)


@pytest.mark.parametrize("shared, own", [(852, 75), (900, 50)])
def test_recall_at_similarity(spark, shared, own):
    # 600 pairs of 85 and 90 %: all but a share of 1e-4 must be found
    both = F.expr(f"transform(sequence(1, {shared}), i -> concat(id, 'x', i))")
    mine = F.expr(f"transform(sequence(1, {own}), i -> concat(id, 'y', side, 'z', i))")
    docs = spark.range(600).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("id") * 2 + F.col("side")).alias("doc_id"), F.array_join(F.concat(both, mine), " ").alias("text"))
    assert near_dedup.near_duplicates(docs, k=1, percent=85).filter("kept").count() <= 601


def test_token_counts_with_two_writers(spark, odd, tmp_path):
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = token_counts.token_counts(odd, path, cache).collect()
    spark.read.parquet(cache).drop("run").write.parquet(f"{cache}/run=another")
    assert sorted(map(str, token_counts.token_counts(odd, path, cache).collect())) == sorted(map(str, first))


def test_token_counts_share_a_cache(spark, odd):
    path = P.path("byte_bpe_50k.json")
    token_counts.token_counts(odd, path).collect()
    n = spark.read.parquet(token_counts.default_cache(spark)).count()
    token_counts.token_counts(odd, path).collect()
    assert spark.read.parquet(token_counts.default_cache(spark)).count() == n > 0


CLASH = ["__digest", "__gone", "__spans", "__first", "N_TOKENS", "Score", "Lang_Pred", "n_Removed", "KEPT_SHA256", "ids", "doc", "row", "cuts", "digest", "a`b", "c.d", "c0", "spans", "content"]


def test_columns_of_any_name(spark, odd):
    df = odd.select("doc_id", "text", "lang", "source").withColumns({c: F.lit("mine") for c in CLASH})
    path = P.path("byte_bpe_multi_50k.tiktoken")
    made = {
        "ids": bpe.encode(df, path), "n_tokens": token_counts.token_counts(df, P.path("byte_bpe_50k.json")), "n_Tokens": bpe.round_trip(df, path), "lang_pred": language_id.predict(df, language_id.fit(df)),
        "score": quality.score(df, quality.fit(df, df.filter("doc_id = 6"))), "n_removed": line_dedup.dedup_lines(df), "n_words": substring_dedup.remove_repeats(df), "kept_sha256": substring_dedup.remove_repeats(df, digest=True),
    }
    for name, out in made.items():
        low = [c.lower() for c in out.columns]
        assert len(low) == len(set(low)) and name.lower() in low
        rows = out.collect()
        assert len(rows) == len(ODD)
        for c in CLASH:
            if c in out.columns and c not in ("ids", "N_TOKENS", "Score", "Lang_Pred", "n_Removed", "KEPT_SHA256"):
                assert {r[c] for r in rows} == {"mine"}, (name, c)
    assert set(CLASH) - {"n_Removed"} <= set(made["n_removed"].columns)
    assert set(CLASH) - {"N_TOKENS"} <= set(made["n_tokens"].columns)


def test_work_folder_must_be_shared():
    from rxnframe.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        common.work_dir(Session)


def test_passages_of_repeated_words(spark):
    # hot, periodic and shifted passages, whose windows meet on few edges
    rnd = random.Random(8)
    hot = [f"h{rnd.randrange(99)}" for _ in range(70)]
    rows = []
    for d in range(60):
        w = [f"u{d}_{i}" for i in range(rnd.randint(0, 30))] + hot[: rnd.randint(40, 70)] + [f"t{d}_{i}" for i in range(rnd.randint(0, 30))]
        if d % 3 == 0:
            w += ["la"] * rnd.randint(10, 120)
        if d % 4 == 0:
            w += ["do", "re", "mi"] * rnd.randint(10, 40)
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = substring_dedup.remove_repeats(df, 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in out.collect()) == brute_passages(rows, 50)


def test_passages_of_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " " + b), (2, b), (2, b), (3, "x " + a), (None, a)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out.collect()) == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 120, 120), (3, 61, 60)]
