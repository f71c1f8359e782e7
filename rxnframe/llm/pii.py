"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are regular expressions with checks of their own and always stay. High-recall generators propose further spans, which may overlap: addresses
with (at), [dot] and blanks, dotted quads written apart, IPv6, and groups of digits with any separators, which are proposed as card and as phone. Boosted trees score a
candidate by its format (digits, groups, their lengths, Luhn, octets, brackets) and context (words before it, letters that touch it). They learn from candidates
that rules decide: full base forms against those that fail their checks, look like dates or stick to letters; undecided ones are only scored. A kind's
threshold is the least score at which labelled candidates are right with the wanted `precision`; what scores as much and overlaps no base span is added.

Every labelled candidate of every text counts, in the trees, in their limits and in the thresholds: equal ones are one row with a weight, a split is sought among all values
that a feature takes, and a candidate's score for the thresholds is of trees that learned from the other texts (cross-fitting). Without candidates of both labels nothing is added.

All work on a text is one projection, without a shuffle. Patterns are written without backtracking over long runs, places come from two-level sums over the pieces
between matches, so long texts cost little more than their length. Places count code points. Null text is empty and stays null. Repeated rows give the same each; an empty table gives an empty
result; extra columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import discard, fresh, quoted, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
FOLDS, PRECISION, AROUND = 2, 0.95, 24
#: The contract's patterns. A run of characters is tried from its start or from the end of the match before only, and never given back: what matches is the same.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?)", r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
_NAME, _LABEL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+", r"[\p{L}\p{N}-]{1,63}+"
WIDE_EMAIL = rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}+|{_NAME}\x20(?:at|AT)\x20{_LABEL}(?:\x20(?:dot|DOT)\x20{_LABEL}){{1,8}}+"
WIDE_IP = r"(?<![\p{L}\p{N}.:])(?:[0-9]{1,3}+(?:\x20?(?:\.|[(\[]\x20?(?:\.|dot)\x20?[)\]])\x20?[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}+:){2,7}+(?::?[0-9A-Fa-f]{1,4}+){1,7}+)(?![\p{L}\p{N}:])"
WIDE_NUMBER = r"(?:\+|(?<![0-9]))[(]?[0-9]++[)]?(?:[\x20\x{a0}().\-/]{1,3}+[0-9]++){0,9}+"
_WORDS = {EMAIL: "mail|contact|write|reach", IP: r"\bip|host|server|addr|from", CARD: "card|visa|master|credit|debit|amex|pay", PHONE: "tel|phone|call|mobile|cell|fax|dial"}
FEATURES = ("kind", "digits", "groups", "longest", "first", "last", "length", "bracket", "touch_left", "touch_right", "word", "luhn", "octets", "date", "distinct")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(a: Column) -> Column:
    """Running sums of an array: sums of about sqrt(n) blocks first, so that n numbers cost about n * sqrt(n) additions and no list is copied as it grows."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda p, q: p + q)

    def blocked(w: Column) -> Column:
        count = F.ceil(F.size(a) / w).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(a, b * w + 1, w)))
        before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(before, lambda f: F.transform(a, lambda _, i: F.get(f, F.floor(i / w).cast("int")) + total(F.slice(a, F.floor(i / w).cast("int") * w + 1, i % w + 1))))

    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(a))).cast("int"), blocked))


def located(text: Column, pattern: str) -> Column:
    """Every match in order: start, end (exclusive), its text, and what stands before and after it, up to the next match."""

    def placed(m: Column, s: Column) -> Column:
        step = F.transform(m, lambda _, i: F.length(F.get(s, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        row = lambda at: F.transform(m, lambda x, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("txt"), F.substring(F.get(s, i), -AROUND, AROUND).alias("left"), F.substring(F.get(s, i + 1), 1, AROUND).alias("right")))
        return let(step, lambda a: let(running(a), row))

    none = F.array().cast("array<struct<start: int, end: int, txt: string, left: string, right: string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda s: placed(m, s))))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check; false for any other number of them."""

    def value(i: Column) -> Column:
        v = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.when(F.length(digits).between(12, 19), F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda p, q: p + q) % 10 == 0).otherwise(False)


_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def valid(kind: int, x: Column) -> Column:
    """The base check of a match."""
    if kind == IP:
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == CARD:
        return let(_only_digits(x), luhn)
    return F.length(_only_digits(x)).between(9, 15) if kind == PHONE else F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text: an array of (start, kind number, end), in order."""

    def of(k: int) -> Column:
        return F.transform(F.filter(located(text, BASE[k]), lambda c: valid(k, c.txt)), lambda c: F.struct(c.start.alias("start"), F.lit(k).alias("kind"), c.end.alias("end")))

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def features(kind: Column, c: Column) -> Column:
    """Format and context of a candidate."""

    def made(d: Column, g: Column) -> Column:
        n = F.transform(g, lambda x: F.length(x))
        flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
        word = F.lit(0)
        for k, words in _WORDS.items():
            word = F.when(kind == k, c.left.rlike(f"(?i){words}").cast("int")).otherwise(word)
        return F.struct(
            kind.alias("kind"), F.length(d).alias("digits"), F.size(g).alias("groups"), F.coalesce(F.array_max(n), F.lit(0)).alias("longest"), F.coalesce(F.get(n, F.lit(0)), F.lit(0)).alias("first"),
            F.coalesce(F.get(n, F.size(n) - 1), F.lit(0)).alias("last"), F.length(c.txt).alias("length"), flag(c.txt.contains("(")).alias("bracket"), flag(c.left.rlike(r"[\p{L}\p{N}_\"'=#]$")).alias("touch_left"),
            flag(c.right.rlike(r"^[\p{L}\p{N}_\"'@]")).alias("touch_right"), word.alias("word"), flag((kind == CARD) & luhn(d)).alias("luhn"), flag((kind == IP) & c.txt.rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$")).alias("octets"),
            flag(c.txt.rlike("^(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ][0-3]?[0-9]|^[0-3]?[0-9][-/.][0-3]?[0-9][-/.](?:19|20)?[0-9]{2}$")).alias("date"), F.size(F.array_distinct(F.split(d, ""))).alias("distinct"),
        )

    return let(_only_digits(c.txt), lambda d: let(F.regexp_extract_all(c.txt, F.lit("[0-9]+"), F.lit(0)), lambda g: made(d, g)))


def candidates(text: Column) -> Column:
    """What the generators propose: start, end, txt, f (features)."""
    told = lambda rows, k: F.transform(rows, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.txt.alias("txt"), features(F.lit(k), c).alias("f")))
    email = F.when(text.rlike(r"@|(?i:[(\[{]\x20?at\x20?[)\]}])|\x20(?:dot|DOT)\x20"), text)
    of = lambda rows, a, b: F.filter(rows, lambda c: F.length(_only_digits(c.txt)).between(a, b))
    number = let(located(text, WIDE_NUMBER), lambda rows: F.concat(told(of(rows, 12, 19), CARD), told(of(rows, 7, 15), PHONE)))
    return F.concat(told(located(F.coalesce(email, F.lit("")), WIDE_EMAIL), EMAIL), told(located(text, WIDE_IP), IP), number)


def label(c: Column) -> Column:
    """1 for a candidate of a full base form, 0 for one that a rule refuses, null for others."""
    f, x = c.f, c.txt
    stuck = (f.touch_left == 1) | (f.touch_right == 1) | (f.date == 1)
    right = {
        EMAIL: x.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$") & ~stuck, IP: x.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & (f.octets == 1) & ~stuck,
        CARD: x.rlike(r"^[0-9](?:[\x20-]?[0-9])+$") & (f.luhn == 1) & ~stuck, PHONE: x.startswith("+") & f.digits.between(9, 15) & ~stuck,
    }
    quad = x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    wrong = {EMAIL: F.lit(False), IP: (f.octets == 0) & ~x.contains(":"), CARD: (f.luhn == 0) | stuck | quad, PHONE: stuck | quad | (~x.startswith("+") & (f.groups == 1))}
    out = F.lit(None).cast("int")
    for k in right:
        out = F.when((f.kind == k) & right[k], 1).when((f.kind == k) & wrong[k], 0).otherwise(out)
    return out


class Model:
    """Trees (nested tuples: feature, threshold, left, right, or a number), their weights, and each kind's threshold."""

    def __init__(self, trees: list, weights: list[float]):
        self.trees, self.weights = trees, weights
        self.thresholds = dict.fromkeys(range(len(KINDS)), 0.5)

    def score(self, f: Column) -> Column:
        """Chance that a candidate of these features is personal data."""

        def grown(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            name, limit, low, high = t
            return F.when(f[name] <= F.lit(limit), grown(low)).otherwise(grown(high))

        return 1 / (1 + F.exp(-2 * sum((w * grown(t) for t, w in zip(self.trees, self.weights)), F.lit(0.0))))


def _tree(node, limits: list):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    s = node.split()
    sides = [_tree(n, limits) for n in (node.leftChild(), node.rightChild())]
    return (*limits[s.featureIndex()], *(sides if 0.0 in list(s.leftCategories()) else reversed(sides)))


def learnable(docs: DataFrame) -> DataFrame:
    """All labelled candidates of all texts: features, label, and n, how many are equal in both. Copies of a text have one fold."""
    rows = docs.filter("text is not null").select(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold"), F.explode(candidates(F.col("text"))).alias("c"))
    return rows.select("fold", label(F.col("c")).alias("label"), "c.f.*").filter("label is not null").groupBy("fold", "label", *FEATURES).agg(F.count("*").alias("n"))


def _limits(rows: DataFrame) -> list[tuple[str, float]]:
    """Feature and number, for each middle between two values next to each other that a feature takes in any row. The generators' patterns bound how many there are."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(name).alias("v")) for i, name in enumerate(FEATURES)]))
    values = sorted((r.i, r.v) for r in rows.select(pairs.alias("p")).select("p.*").distinct().collect())
    return [(FEATURES[i], (v + w) / 2) for (i, v), (j, w) in zip(values, values[1:]) if i == j]


def _train(rows: DataFrame, limits: list[tuple[str, float]], rounds: int, depth: int) -> Model | None:
    """Boosted trees of weighted rows; None without both labels. Whether a limit is passed is a feature of two categories each: for numbers Spark would draw a sample of rows to place its splits."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    got = rows.agg(F.sum("n").alias("n"), F.countDistinct("label").alias("labels")).first()
    if got["labels"] < 2 or not limits:
        return None
    passed = lambda name: F.transform(F.array(*[F.lit(v) for k, v in limits if k == name]), lambda v: (F.col(name) > v).cast("double"))
    attrs = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": f"{name} {v}"} for i, (name, v) in enumerate(limits)]}, "num_attrs": len(limits)}}
    vector = array_to_vector(F.flatten(F.array(*map(passed, dict(limits))))).alias("features", metadata=attrs)
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, weightCol="n", minWeightFractionPerNode=min(0.49, 3 / got["n"]))
    made = gbt.fit(rows.select(vector, F.col("label").cast("double"), F.col("n").cast("double")))
    return Model([_tree((t._java_obj if hasattr(t, "_java_obj") else t).rootNode(), limits) for t in made.trees], list(made.treeWeights))


def fit(docs: DataFrame, precision: float = PRECISION, rounds: int = 20, depth: int = 3) -> Model | None:
    """Boosted trees and thresholds from all labelled candidates of all texts; None without candidates of both labels."""
    rows = table(learnable(docs.select("text")))
    limits = _limits(rows)
    model = _train(rows, limits, rounds, depth)
    if model is not None:
        _calibrate(model, rows, [_train(rows.filter(F.col("fold") != i), limits, rounds, depth) or model for i in range(FOLDS)], precision)
    discard(rows)
    return model


def _calibrate(model: Model, rows: DataFrame, others: list[Model], precision: float) -> None:
    """Sets thresholds: from the top score down, as long as the share of right ones stays. A fold is scored by the trees without it (fit: by all, if those had nothing to learn from). At most 100 rows a kind come to the driver."""
    score = F.lit(None).cast("double")
    for i, other in enumerate(others):
        score = F.when(F.col("fold") == i, other.score(F.struct(*FEATURES))).otherwise(score)
    cell = F.floor(F.least(score * 100, F.lit(99.0))).cast("int")
    got = rows.withColumn("cell", cell).groupBy("kind", "cell").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    for k in model.thresholds:
        right = n = 0
        best = None
        for r in sorted((r for r in got if r["kind"] == k), key=lambda r: -r["cell"]):
            right, n = right + r["right"], n + r["n"]
            if right >= precision * n:
                best = r["cell"] / 100
        if n and right < n:  # a kind of which nothing was wrong tells nothing about its threshold
            model.thresholds[k] = 1.1 if best is None else max(best, 0.5)


def spans(docs: DataFrame, model: Model | None, name: str = "found") -> DataFrame:
    """docs with an array of (start, kind, end, base): all base spans and what the model adds, by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def joined(base: Column) -> Column:
        sure = F.transform(base, lambda b: F.struct(b.start.alias("start"), b.kind.alias("kind"), b.end.alias("end"), F.lit(True).alias("base")))
        if model is None:
            return sure
        limit = F.lit(None).cast("double")
        enough = lambda c: F.coalesce(*[F.when(c.f.kind == k, model.score(c.f) >= t) for k, t in model.thresholds.items()], limit.isNotNull())
        likely = F.transform(F.filter(candidates(text), enough), lambda c: F.struct(c.start.alias("start"), c.f.kind.alias("kind"), c.end.alias("end")))
        new = F.filter(F.array_except(likely, base), lambda c: ~F.exists(base, lambda b: (b.start < c.end) & (c.start < b.end)))
        return F.array_sort(F.concat(sure, F.transform(new, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"), F.lit(False).alias("base")))))

    return docs.withColumn(name, let(base_spans(text), joined))


def written(found: Column, base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    rows = F.filter(found, lambda s: s.base) if base_only else found
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all spans, written out)."""
    made = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in made])
    (found,) = fresh(docs, "found")
    out = spans(docs, fit(docs, **options), found)
    count = lambda k: F.size(F.filter(F.col(found), lambda s: s.base & (s.kind == k))).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(*[quoted(c) for c in docs.columns], *map(count, range(len(KINDS))), F.sha2(written(F.col(found), True), 256).alias("base_sha256"), written(F.col(found)).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; of spans that overlap the first one names the place and all are hidden."""
    (found,) = fresh(docs, "found")
    out = spans(docs, fit(docs, **options), found)
    names, start = F.array(*map(F.lit, KINDS)), F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc.text, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit("["), F.get(names, s.kind), F.lit("]"))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, kept).otherwise(acc.text).alias("text"))

    done = F.aggregate(F.col(found), start, step, lambda acc: F.concat(acc.text, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    text = F.when(F.size(found) == 0, F.col("text")).otherwise(done).alias("text")
    return out.select(*[text if c.lower() == "text" else quoted(c) for c in docs.columns])
