"""Arrays of scores, samples and features; shape mismatches raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cut(a: Column, start: Column, end: Column) -> Column:
    """Elements [start, end) with both clamped to the array."""
    low = F.greatest(F.lit(0), F.least(start, F.size(a))).cast("int")
    high = F.greatest(low, F.least(end, F.size(a)).cast("int"))
    return F.slice(a, low + 1, high - low)


def greedy_argmax(a: Column) -> Column:
    """Index of the largest value, the first on ties; null for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def argmin_first(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)) - 1)


def top_k(a: Column, k: int) -> Column:
    """Indices of the k largest values, descending, ties by index."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def slice_axis1(a: Column, start: Column, end: Column) -> Column:
    """Rows of an array of time steps."""
    return cut(a, start, end)


def concat_axis1(a: Column, b: Column) -> Column:
    """Time steps of ``a``, then of ``b``; steps of both must be equally wide."""
    wide = lambda x: F.when(F.size(x) > 0, F.size(x[0]))
    fits = F.coalesce(wide(a) == wide(b), F.lit(True))
    return F.when(fits, F.concat(a, b)).otherwise(F.raise_error(F.lit("time steps differ in width")))


def add(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y)).otherwise(F.raise_error(F.lit("shapes differ")))


def repeat_axis1(a: Column, times: int) -> Column:
    """The one time step of ``a`` ``times`` times."""
    return F.when(F.size(a) == 1, F.flatten(F.array_repeat(a, times))).otherwise(F.raise_error(F.lit("one time step is needed")))


def trim_features(features: Column, mask: Column) -> Column:
    """The first sum(mask) time steps."""
    return F.slice(features, 1, F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int")))


def apply_cmvn(x: Column, shift: Column, scale: Column) -> Column:
    """(x + shift) * scale, element by element."""
    moved = F.zip_with(F.zip_with(x, shift, lambda a, b: a + b), scale, lambda a, b: a * b)
    return F.when((F.size(x) == F.size(shift)) & (F.size(x) == F.size(scale)), moved).otherwise(F.raise_error(F.lit("vector and CMVN differ in width")))
