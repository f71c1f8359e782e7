"""Language identification by error-correcting output codes.

Each language has a codeword. For every bit a binary classifier over hashed character bi- and trigrams (naive Bayes
log odds of the languages whose bit is 1 against the others) gives a margin; decoding takes the codeword with the
least logistic loss, each bit weighted by its accuracy on the training rows, and flags a text as ambiguous when the
runner-up is close.

Training takes at most `sample` labelled rows, whole texts: a documented bound, drawn for each language by a hash of the id. Rare
languages give all their rows and the others equal numbers, so every language with labelled letters is learned; were there
more languages than `sample`, each would give one row. Texts that are null or hold no letter get `und` with score 0. With no labelled row everything is `und`. Repeated rows are
predicted alike; an empty table gives an empty result; extra columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxnframe.llm.common import adding, assemble, chunks, discard, lean, mapped, table
from rxnframe.llm.pretokenise import LETTER, classes

SAMPLE, BUCKETS, SATURATE, TOP, SLICE = 3000, 1 << 15, 40, 1 << 40, 1 << 18
MAYBE_LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, a space for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    kind = classes()
    for i in np.flatnonzero(kind == LETTER).tolist():
        low = chr(i).lower()
        out[i] = ord(low) if len(low) == 1 else i
    return out


def _pairs(padded: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pairs (bigram, trigram) at every place of a string but its last two, and its lower-case letters."""
    low = _letters()[np.frombuffer(padded.encode("utf-32-le"), np.uint32)]
    a, b, c = low[:-2], low[1:-1], low[2:]
    two = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA77)
    three = (two ^ c) * np.uint32(0xC2B2AE3D)
    return np.stack([two >> np.uint32(17), (three >> np.uint32(17)) + np.uint32(BUCKETS)], 1), low


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket pairs at each place of texts, each between spaces of its own, text starts, and numbers of letters."""
    pairs, low = _pairs(" " + "  ".join(texts) + "   ")
    size = np.array(list(map(len, texts)), np.int64)
    last = np.cumsum(size + 2) - 1  # the place after a text's own
    own = np.ones(len(pairs), bool)
    own[last] = False
    letter = np.concatenate([[0], np.cumsum(low != 32)])
    return pairs[own], np.append(0, np.cumsum(size + 1)), letter[last] - letter[last - size]


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1. No column is constant, repeats another one or is its complement, so every bit splits the languages anew.

    Up to 7 languages take every such split. More take 8 splits into halves for each doubling, drawn from a fixed seed until
    any two codewords differ in a quarter of them."""
    if n <= 1:
        return np.zeros((n, 0), np.float32)
    if n <= 7:
        return np.array([c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c], np.float32).T
    bits, rng = 8 * int(np.ceil(np.log2(n))), np.random.default_rng(7)
    halves = np.where(np.arange(n) < n // 2, np.float32(1), np.float32(-1))
    while True:
        code = np.zeros((n, 0), np.float32)
        while code.shape[1] < bits:
            column = rng.permutation(halves)
            if (np.abs(column @ code) < n).all():
                code = np.hstack([code, column[:, None]])
        alike = code @ code.T - 2 * bits * np.eye(n, dtype=np.float32)
        if (bits - alike.max()) / 2 >= bits / 4:
            return code


def tally(text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Places and letters of a text, its buckets and how often each occurs; of a size that doesn't follow the text's length."""
    padded, total, letters = f" {text}  ", np.zeros(2 * BUCKETS, np.int64), 0
    for i in range(0, len(padded) - 2, SLICE):
        g, low = _pairs(padded[i : i + SLICE + 2])
        total += np.bincount(g.ravel(), minlength=2 * BUCKETS)
        letters += int((low[:-2] != 32).sum())
    found = np.flatnonzero(total)
    return len(padded) - 2, letters, found, total[found]


class Model:
    def __init__(self, langs: list[str], rows: list[tuple[int, int, np.ndarray, np.ndarray]], labels: list[str]):
        """rows: as from tally, with the language of each."""
        counts = np.zeros((len(langs), 2 * BUCKETS))
        row = np.array([langs.index(x) for x in labels], int)
        for i, (_, _, bucket, n) in zip(row, rows):
            counts[i, bucket] += n
        self.learn(langs, counts)
        self.weigh(sum((self.right(i, bucket, n) for i, (_, _, bucket, n) in zip(row, rows)), np.zeros(self.code.shape[1])), len(rows))

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> Model:
        """From the summed counts of each language's grams; bits are still to be weighed."""
        model = cls.__new__(cls)
        model.learn(langs, counts)
        model.weigh(np.zeros(model.code.shape[1]), 0)
        return model

    def learn(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        counts = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
        one = self.code > 0
        self.weights = np.stack([np.log(counts[o].mean(0)) - np.log(counts[~o].mean(0)) for o in one.T], 1).astype(np.float32) if self.code.size else np.zeros((2 * BUCKETS, 0), np.float32)

    def right(self, lang: int, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which bits come out right for a training row of a language."""
        return ((n @ self.weights[bucket] > 0) == (self.code[lang] > 0)).astype(float)

    def weigh(self, right: np.ndarray, rows: int) -> None:
        self.trust = np.maximum(right / max(1, rows) - 0.5, 0.01) if rows else np.ones(self.code.shape[1])

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        zs, ns = [], []
        for a, b in chunks(texts, SLICE):
            if len(texts[a]) > SLICE:  # alone in its range; summed slice by slice, so that memory doesn't follow its length
                padded, total, n = f" {texts[a]}  ", np.zeros((1, self.code.shape[1])), 0
                for i in range(0, len(padded) - 2, SLICE):
                    g, low = _pairs(padded[i : i + SLICE + 2])
                    total += (self.weights[g[:, 0]] + self.weights[g[:, 1]]).sum(0)
                    n += int((low[:-2] != 32).sum())
                zs.append(total / (1 + (len(padded) - 2) / SATURATE))
                ns.append([n])
                continue
            g, start, n = grams(texts[a:b])
            total = np.zeros((b - a, self.code.shape[1]))
            if self.code.size:
                w = self.weights[g[:, 0]] + self.weights[g[:, 1]]
                total = np.add.reduceat(w, start[:-1], 0)
            zs.append(total / (1 + np.diff(start)[:, None] / SATURATE))
            ns.append(n)
        return (np.concatenate(zs), np.concatenate(ns)) if zs else (np.zeros((0, self.code.shape[1])), np.zeros(0, int))

    def predict(self, texts: list[str], close: float):
        z, n = self.margins(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        loss = (np.logaddexp(0, -z[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        gap = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        lang = [self.langs[i] if k else "und" for i, k in zip(best.tolist(), n.tolist())]
        return lang, np.where(n > 0, top[:, -1], 0.0), (gap < close) & (n > 0)


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """Training rows of each language: all of the rare ones, equal numbers of the others, at least one each."""
    out, left = {}, sample
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(sizes) - i)))
        left -= out[lang]
    return out


def _summed(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """rows (key, n long, raw binary: equal arrays) added up for each key, one row a key; only one sum is held at a time."""
    schema = f"{key} {dict(rows.dtypes)[key]}, n long, raw binary"

    def run(batches):
        held, count, total, like = None, 0, None, None
        for batch in batches:
            out, like = [], batch.schema.field(key).type
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in (key, "n", "raw"))):
                x = np.frombuffer(zlib.decompress(raw), kind)
                if total is not None and k == held:
                    count, total = count + n, total + x
                    continue
                if total is not None:
                    out.append((held, count, zlib.compress(total.tobytes(), 1)))
                held, count, total = k, n, x
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (like, pa.int64(), pa.binary()))], names=[key, "n", "raw"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], like), pa.array([count], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=[key, "n", "raw"])

    return lean(rows.repartition(key).sortWithinPartitions(key)).mapInArrow(run, schema)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled (doc_id, text, lang); rows without letters in the text or without lang teach nothing.

    Rows are chosen by a hash of id and text, so null ids and ids that repeat are spread like others; rows alike in both count once. Counts of grams are added
    up in executors: what comes to the driver is one array a language, whatever the texts and the sample."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(MAYBE_LETTER)).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(TOP)).alias("at"))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()
    want = quotas({r.lang: r.n for r in seen}, sample)
    # A few rows more than wanted come under a language's bound, its least one in any case; the rank then takes the wanted number.
    bounds = [(r.lang, max(r.low, int(TOP * min(1.0, (want[r.lang] + 8 * want[r.lang] ** 0.5 + 8) / r.n))), want[r.lang]) for r in seen]
    near = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long, want long")), "lang").filter("at <= bound")
    near = near.groupBy("lang", "want", "at").agg(F.min("text").alias("text"))  # copies of one row meet before they are ranked
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    picked = table(near.withColumn("rank", rank).filter("rank <= want").select("text", "lang"))

    def count(batches):
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            many: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                _, letters, bucket, n = tally(text)
                if letters or lang in total:
                    total.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))[bucket] += n
                    many[lang] = many.get(lang, 0) + bool(letters)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(many.values()), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["lang", "n", "raw"])

    found = sorted(_summed(lean(picked).mapInArrow(count, "lang string, n long, raw binary"), "lang", "<i8").collect(), key=lambda r: r.lang)
    langs = [r.lang for r in found]
    model = Model.of(langs, np.stack([np.frombuffer(zlib.decompress(r.raw), "<i8") for r in found]).astype(float) if found else np.zeros((0, 2 * BUCKETS)))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def check(batches):
        for batch in batches:
            right, rows = np.zeros(shared.value.code.shape[1]), 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang in shared.value.langs:
                    _, _, bucket, n = tally(text)
                    right, rows = right + shared.value.right(shared.value.langs.index(lang), bucket, n), rows + 1
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows], pa.int64()), pa.array([zlib.compress(right.tobytes(), 1)], pa.binary())], names=["k", "n", "raw"])

    if model.code.size:
        for r in _summed(lean(picked).mapInArrow(check, "k int, n long, raw binary"), "k", "<f8").collect():
            model.weigh(np.frombuffer(zlib.decompress(r.raw), "<f8"), r.n)
    discard(picked)
    return model


def predict(df: DataFrame, model: Model, close: float = 0.2) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep, schema = adding(df, "lang_pred string, score double, ambiguous boolean")

    def run(batches):
        for batch in batches:
            lang, score, unsure = shared.value.predict([t or "" for t in batch.column("text").to_pylist()], close)
            yield assemble(batch, keep, {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure, pa.bool_())})

    return mapped(df, run, schema)
