"""Row selection, keys, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxnframe.functions.columns import hash_bucket
from rxnframe.operators.tolerance import dedupe_greedy

SPLITS = {
    "train": ("train",), "val": ("val",), "test": ("test",), "trainval": ("train", "val"),
    "traintest": ("train", "test"), "valtest": ("val", "test"), "all": ("train", "val", "test"),
}
TOP = 1 << 32


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "graph_id") -> DataFrame:
    """Rows whose id isn't listed."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def filter_class(df: DataFrame, column: str, choice) -> DataFrame:
    """A list keeps its members, a string is a regular expression."""
    return df.filter(F.col(column).rlike(choice) if isinstance(choice, str) else F.col(column).isin(list(choice)))


def select_split(df: DataFrame, name: str, column: str = "split", fold: int | None = None) -> DataFrame:
    """Rows of a named union of splits, of one fold if given."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name}")
    out = df.filter(F.col(column).isin(*SPLITS[name]))
    return out if fold is None else out.filter(F.col("fold") == fold)


def filter_score(df: DataFrame, column: str = "score", limit: float = 5.0) -> DataFrame:
    """Rows whose structure score doesn't exceed the limit."""
    return df.filter(F.col(column) <= limit)


def filter_converged(df: DataFrame) -> DataFrame:
    """Finished rows with a single imaginary mode."""
    return df.filter(F.col("finished") & F.col("single_mode"))


def filter_barrier(df: DataFrame, threshold: float, slack: float = 5.0, column: str = "barrier") -> DataFrame:
    """Rows whose barrier is at most threshold + slack; unknown barriers stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) <= threshold + slack))


def filter_confidence(df: DataFrame, threshold: float = 0.10, column: str = "confidence") -> DataFrame:
    """Rows mapped with enough confidence."""
    return df.filter(F.col(column) >= threshold)


def dummy_encode(df: DataFrame, column: str, values=None, most: int = 1000) -> DataFrame:
    """is_<value> columns of 0 and 1; nulls of other numeric columns become 0. Without values, one pass finds them; more than `most` distinct ones raise, as each becomes a column."""
    if values is None:
        values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} distinct values")
        values.sort()
    return df.withColumns({f"is_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values}).fillna(0)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def keep_lowest(df: DataFrame, key: str, target: str, order: str) -> DataFrame:
    """The row with the lowest target of each key, ties to the lowest `order`, null and NaN targets excluded; sorted by `order`."""
    good = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    return first_per_key(good, [key], [target, order]).orderBy(order)


def distinct_arrays(df: DataFrame, keys: list[str], array: str, index: str) -> DataFrame:
    """Distinct arrays of each key with the index of their first row."""
    return df.groupBy(*keys, array).agg(F.min(index).alias("first_index"))


def dedupe_within(df: DataFrame, key: str, value: str, order: str, eps: float = 1e-5, mode: str = "greedy") -> DataFrame:
    """Rows of a key whose value is farther than eps from each one kept before.

    greedy follows `order`, whatever the size of a key (see tolerance.dedupe_greedy); gap sorts by value and keeps a row more than eps above the one below, kept or not."""
    if mode == "greedy":
        return dedupe_greedy(df, key, value, order, eps)
    before = F.lag(value).over(Window.partitionBy(key).orderBy(value, order))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(value) - F.col("_before") > eps)).drop("_before")


def build_registry(df: DataFrame, eps: float = 5 / 627.5) -> DataFrame:
    """Df (reaction_index, rtype, source, energy, arrival) -> one record per reaction: type (intended wins) and its transition states, numbered from 0 by arrival, whose energies are farther than eps from those of all earlier ones."""
    kept = dedupe_greedy(df, "reaction_index", "energy", "arrival", eps)
    states = F.array_sort(F.collect_list(F.struct("arrival", "source", "energy")))
    out = kept.groupBy("reaction_index").agg(F.bool_or(F.col("rtype") == "intended").alias("_in"), states.alias("_ts"))
    numbered = F.transform("_ts", lambda x, i: F.struct(i.alias("ts_ind"), x.source.alias("source"), x.energy.alias("energy")))
    return out.select("reaction_index", F.when(F.col("_in"), "intended").otherwise("unintended").alias("rtype"), numbered.alias("states"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A seeded shuffle's first n rows, in no order. Rows whose hash lies below a bound are taken where they are; only those in the bound's own range of the hash, one of 4096, are ranked."""
    part = F.shiftright(F.col("_b"), 20)
    x = df.withColumn("_b", hash_bucket(key, seed))
    sizes = sorted((r[0] if r[0] is not None else -1, r[1]) for r in x.groupBy(part.alias("_part")).agg(F.count("*")).collect())  # 4097 rows at most
    taken, last = 0, None
    for p, size in sizes:
        if taken + size > n:
            last = p
            break
        taken += size
    if last is None:
        return df
    place = F.coalesce(part, F.lit(-1))
    rank = F.row_number().over(Window.orderBy("_b", key))
    rest = x.filter(place == last).withColumn("_r", rank).filter(F.col("_r") <= n - taken).drop("_r")
    return x.filter(place < last).unionByName(rest).drop("_b")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def merge_datasets(first: DataFrame, *others: DataFrame, key: str | None = None, target: str | None = None, order: str | None = None) -> DataFrame:
    """H1: bag union by column name; with a key, the lowest target of each key stays."""
    for other in others:
        first = first.unionByName(other)
    return first if key is None else keep_lowest(first, key, target, order)


def union_ids(key: str, *frames: DataFrame) -> DataFrame:
    """H2: the distinct ids of several id sets; null is no id. Partial distincts combine before the shuffle."""
    out = frames[0].select(key)
    for other in frames[1:]:
        out = out.unionByName(other.select(key))
    return out.filter(F.col(key).isNotNull()).distinct()


def _three(bucket: Column, holdout: float) -> Column:
    """train below 1 - holdout of the bucket range, then val and test in equal halves."""
    a, b = int(TOP * (1 - holdout)), int(TOP * (1 - holdout / 2))
    return F.when(bucket < a, "train").when(bucket < b, "val").otherwise("test")


def random_split3(df: DataFrame, key: str, holdout: float = 0.2, seed: int = 0, exact: bool = False) -> DataFrame:
    """Key and split. Thresholds on a hash of the key are exact in expectation and need no shuffle; exact counts number the keys within a two-pass rank of the hash."""
    ids = df.select(key).distinct()
    bucket = hash_bucket(key, seed)
    if not exact:
        return ids.withColumn("split", _three(bucket, holdout))
    ids = ids.withColumn("_b", bucket).withColumn("_part", F.shiftright("_b", 20))
    sizes = ids.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows at most
    total = sizes.agg(F.sum("_n").alias("_total"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_b", key)) + F.col("_before")
    ranked = ids.join(F.broadcast(before.select("_part", "_before").crossJoin(total)), "_part").withColumn("_at", place)
    keep = F.floor(F.col("_total") * (1 - holdout))
    half = keep + F.floor((F.col("_total") - keep) / 2)
    return ranked.select(key, F.when(F.col("_at") <= keep, "train").when(F.col("_at") <= half, "val").otherwise("test").alias("split"))


def kfold_split(df: DataFrame, key: str, k: int, seed: int = 0, test: float = 0.1) -> DataFrame:
    """Key, fold (1 to k) and split; a fixed test part, and one fold of the rest for validation each time."""
    bucket = hash_bucket(key, seed)
    ids = df.select(key).distinct().withColumn("_test", bucket >= int(TOP * (1 - test))).withColumn("_own", F.pmod(bucket, F.lit(k)) + 1)
    folds = ids.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return folds.select(key, "fold", F.when(F.col("_test"), "test").when(F.col("_own") == F.col("fold"), "val").otherwise("train").alias("split"))


def preset_split(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Key, fold and split from columns Split or fold{i}Split; other values are left out."""
    named = df.select(key, *columns).unpivot([key], columns, "_column", "split").filter(F.col("split").isin(*SPLITS["all"]))
    fold = F.coalesce(F.expr("try_cast(regexp_extract(_column, '^fold([0-9]+)Split$', 1) as int)"), F.lit(0))
    return named.select(key, fold.alias("fold"), "split")


def group_split(df: DataFrame, key: str, group: str, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """I4: the split of a row is its group's, so no group straddles splits."""
    return df.select(key, group).withColumn("split", _three(hash_bucket(group, seed), holdout))


def cluster_split(df: DataFrame, key: str, vector: str, k: int, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """I4: group_split over k-means clusters of an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x)
    return group_split(model.transform(x).select(key, "cluster"), key, "cluster", holdout, seed)


def repeated_split(df: DataFrame, key: str, n: int, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """N independent splits, told apart by fold (1 to n)."""
    ids = df.select(key).distinct().withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    text = F.concat((F.col("fold") + seed).cast("string"), F.lit(":"), F.col(key).cast("string"))
    return ids.withColumn("split", _three(hash_bucket(text), holdout))


def attach_split(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Records with their split labels, null if unlisted."""
    return df.join(splits, key, "left")
