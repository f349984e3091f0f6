"""Merging audio features into token embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_audio_features(tokens: DataFrame, features: DataFrame, placeholder: Column, key: str = "item_id") -> DataFrame:
    """The k-th placeholder of an item takes the k-th feature row; other positions keep their embedding.

    ``tokens``: key, pos, embed; ``features``: key, k (0..), feat.  Adds fits: whether the item's counts agree.
    """
    marked = tokens.withColumn("is_audio", placeholder)
    w = Window.partitionBy(key, "is_audio").orderBy("pos")
    marked = marked.withColumn("k", F.when(F.col("is_audio"), F.row_number().over(w) - 1))
    places = marked.groupBy(key).agg(F.count(F.when(F.col("is_audio"), 1)).alias("n_places"))
    given = features.groupBy(key).agg(F.count("*").alias("n_features"))
    counts = places.join(given, key, "left").select(key, (F.col("n_places") == F.coalesce("n_features", F.lit(0))).alias("fits"))
    out = marked.join(features.select(key, "k", "feat"), [key, "k"], "left").withColumn("embed", F.when(F.col("is_audio"), F.col("feat")).otherwise(F.col("embed")))
    return out.drop("feat", "k").join(counts, key)


def mismatched_items(merged: DataFrame, key: str = "item_id") -> DataFrame:
    return merged.where("not fits").select(key).distinct()
