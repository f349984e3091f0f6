"""Comparing two outputs of one computation, element by element and by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.arrays import greedy_argmax, top_k


def align_outputs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full join of rows (on..., values) as a_values, b_values, with same_shape (false where one side is absent)."""
    both = a.select(*on, F.col("values").alias("a_values")).join(b.select(*on, F.col("values").alias("b_values")), on, "full_outer")
    return both.withColumn("same_shape", F.coalesce(F.size("a_values") == F.size("b_values"), F.lit(False)))


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def compare_outputs(aligned: DataFrame, rtol: float = 5e-3, atol: float = 5e-3, by: str | None = None) -> DataFrame:
    """Max and mean absolute difference, all finite, all close, and the worst row; one row for each ``by``, or one.

    Arrays of equal shape are compared in place; a row whose shapes differ is neither finite nor close.
    """
    diff = F.zip_with("a_values", "b_values", lambda x, y: F.abs(x.cast("double") - y))
    close = F.zip_with("a_values", "b_values", lambda x, y: F.abs(x.cast("double") - y) <= F.abs(y.cast("double")) * rtol + atol)
    rows = aligned.withColumn("diff", F.when(F.col("same_shape"), diff))
    each = rows.select(
        *([by] if by else []),
        "name",
        F.array_max("diff").alias("worst"),
        F.aggregate("diff", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.when(F.col("same_shape"), F.size("diff")).otherwise(0).alias("n"),
        (F.col("same_shape") & F.coalesce(F.forall("a_values", _finite) & F.forall("b_values", _finite), F.lit(False))).alias("finite"),
        (F.col("same_shape") & F.coalesce(F.forall(close, lambda x: x), F.lit(False))).alias("close"),
    )
    return each.groupBy(*([by] if by else [])).agg(
        F.max("worst").alias("max_abs_diff"), (F.sum("total") / F.sum("n")).alias("mean_abs_diff"), F.bool_and("finite").alias("all_finite"), F.bool_and("close").alias("all_close"), F.max_by("name", F.struct("worst", -F.xxhash64("name"))).alias("worst_name"), F.count("*").alias("n_rows")
    )


def compare_rankings(aligned: DataFrame, k: int = 10, least: int = 8) -> DataFrame:
    """Adds same_top, shared (common members of both top k), and agrees."""
    rows = aligned.where("same_shape").withColumn("same_top", greedy_argmax(F.col("a_values")) == greedy_argmax(F.col("b_values")))
    rows = rows.withColumn("shared", F.size(F.array_intersect(top_k(F.col("a_values"), k), top_k(F.col("b_values"), k))))
    return rows.withColumn("agrees", F.col("same_top") & (F.col("shared") >= F.least(F.lit(least), F.size("a_values"))))


def contract_diff(required: Column, present: Column) -> Column:
    """struct(missing, extra): sorted names of one side only."""
    return F.struct(F.array_sort(F.array_except(required, present)).alias("missing"), F.array_sort(F.array_except(present, required)).alias("extra"))


def feature_stats(df: DataFrame, key: str, feature: str, order: str) -> DataFrame:
    """(key, n_rows, width, mean, head): shape, mean, and the first 10 values of the first row."""
    total = F.aggregate(F.col(feature), F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = df.select(key, order, F.size(feature).alias("width"), total.alias("total"), F.slice(feature, 1, 10).alias("head"))
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.max("width").alias("width"), (F.sum("total") / F.sum("width")).alias("mean"), F.min_by("head", order).alias("head"))


def logmel_normalized(df: DataFrame, key: str, feature: str) -> DataFrame:
    """Floors log-mel values at the recording's maximum - 8, then (x + 4) / 4."""
    top = df.groupBy(key).agg(F.max(F.array_max(feature)).alias("top"))
    return df.join(top, key).withColumn(feature, F.transform(feature, lambda x: (F.greatest(x.cast("double"), F.col("top").cast("double") - 8.0) + 4.0) / 4.0)).drop("top")
