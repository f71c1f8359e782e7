"""Column builders shared by the operators; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(column: str | Column, seed: int = 0, prefix: str = "") -> Column:
    """A stable number from 0 to 2**32 - 1 for an id: the first 8 hex digits of md5(id, or seed:id)."""
    col = F.col(column) if isinstance(column, str) else column
    text = col.cast("string") if seed == 0 and not prefix else F.concat(F.lit(f"{prefix}{seed}:"), col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def one_hot(column: str | Column, vocabulary: Iterable, default: list[int] | None = None) -> Column:
    """array<int> with a 1 at the value's place in the vocabulary; default (all 0) for other values and null."""
    col = F.col(column) if isinstance(column, str) else column
    vocabulary = list(vocabulary)
    hot = F.array(*[F.coalesce((col == F.lit(v)).cast("int"), F.lit(0)) for v in vocabulary])
    if default is None:
        return hot
    return F.when(col.isin(vocabulary), hot).otherwise(F.array(*map(F.lit, default)))


def lookup(column: str | Column, values: Mapping, default=None) -> Column:
    """Dictionary lookup by a literal map."""
    col = F.col(column) if isinstance(column, str) else column
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, col), F.lit(default)) if default is not None else F.element_at(table, col)


def split_reaction(column: str) -> tuple[Column, Column]:
    """The two sides of `R>>P`; a missing side is null."""
    parts = F.split(F.col(column), ">>")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def fragments(side: Column) -> Column:
    """Fragments of a side; none for null or an empty string."""
    return F.filter(F.split(F.coalesce(side, F.lit("")), r"\."), lambda x: x != "")


def molecularity_class(reactant: Column, product: Column | None = None) -> Column:
    """R{n}P{m}, or R{n} for one side only."""
    left = F.concat(F.lit("R"), F.size(fragments(reactant)).cast("string"))
    return left if product is None else F.concat(left, F.lit("P"), F.size(fragments(product)).cast("string"))


def side_key(side: Column, missing: str = "InChI_NA") -> Column:
    """Canonical key of a side: its fragments sorted; `missing` for none."""
    parts = fragments(side)
    return F.when(F.size(parts) > 0, F.array_join(F.array_sort(parts), ".")).otherwise(F.lit(missing))


def entity_key(reactant: Column, product: Column, normaliser=side_key) -> Column:
    return F.concat(normaliser(reactant), F.lit(">>"), normaliser(product))


def skeleton_key(side: Column, width: int = 14) -> Column:
    """Sorted prefixes of the fragments, joined by '-'."""
    return F.array_join(F.array_sort(F.transform(fragments(side), lambda x: F.substring(x, 1, width))), "-")


def reaction_index(reactant: Column, product: Column, changed: Column | None = None) -> Column:
    """Direction-independent index: fragments on both sides go unless listed in `changed`, the rest is sorted, then the sides are."""
    left, right = fragments(reactant), fragments(product)

    def active(own: Column, other: Column) -> Column:
        keep = lambda x: ~F.array_contains(other, x) if changed is None else ~F.array_contains(other, x) | F.array_contains(changed, x)
        return F.array_join(F.array_sort(F.filter(own, keep)), ".")

    a, b = active(left, right), active(right, left)
    return F.concat(F.least(a, b), F.lit(">>"), F.greatest(a, b))


def is_zwitterion(text: Column) -> Column:
    """Some fragment holds both signs."""
    return F.exists(fragments(text), lambda x: x.contains("+") & x.contains("-"))


def path_id(path: str | Column) -> Column:
    """Last path segment without its extension."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def radial_basis(distance: Column, n: int, cutoff: float, exponent: int = 5) -> Column:
    """array<double> of n values env(d / c) sin(k pi d / c), all 0 at or beyond the cutoff and for d <= 0."""
    p = exponent + 1
    a, b, c = -(p + 1) * (p + 2) / 2, p * (p + 2), -p * (p + 1) / 2
    d = distance.cast("double") / cutoff
    env = 1 / d + a * F.pow(d, F.lit(p - 1)) + b * F.pow(d, F.lit(p)) + c * F.pow(d, F.lit(p + 1))
    inside = (d > 0) & (d < 1)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(inside, env * F.sin(k * F.pi() * d)).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix_vector(rows: list[list[float]], vector: Column) -> Column:
    """array<double>: a fixed matrix times an array column."""
    return F.array(*[dot(F.array(*[F.lit(float(w)) for w in row]), vector) for row in rows])
