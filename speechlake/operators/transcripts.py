"""From recognised pieces to one text, language and summary per recording.

Ordered aggregates carry their index inside the collected structs and sort it afterwards; only small values are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.options import SegmentOptions


def ordered(value: Column, order: str) -> Column:
    """Aggregate: values in order of ``order``, nulls skipped."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def merge_texts(df: DataFrame, key: str = "audio_id", order: str = "seq", text: str = "text") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(ordered(F.col(text), order), "").alias("text"))


def without_repeats(df: DataFrame, key: str = "audio_id", order: str = "seq", language: str = "language") -> DataFrame:
    """Rows whose trimmed language isn't blank and differs from that of the non-blank row before."""
    w = Window.partitionBy(key).orderBy(order)
    named = df.withColumn(language, F.trim(F.col(language))).where(F.col(language) != "")
    return named.withColumn("was", F.lag(language).over(w)).where("was is null or was <> " + language).drop("was")


def merge_languages(df: DataFrame, key: str = "audio_id", order: str = "seq", language: str = "language") -> DataFrame:
    """(key, language): the languages in order, comma-joined, without consecutive repeats; "" where none is named."""
    found = without_repeats(df, key, order, language).groupBy(key).agg(F.array_join(ordered(F.col(language), order), ",").alias("language"))
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce("language", F.lit("")).alias("language"))


def file_summary(segments: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, n_segments, speech_ms, first_ms, last_ms)."""
    return segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def file_facts(files: DataFrame, segments: DataFrame, detected: DataFrame, options: SegmentOptions = SegmentOptions(), key: str = "audio_id") -> DataFrame:
    """One row for each of ``files`` (key, duration_ms), those without speech included.

    duration_ms; n_detected: segments that the detector gave; n_segments, speech_ms, first_ms, last_ms: those that were kept (null
    times where there are none); and the options that they were made with.  All three tables are grouped by one key.
    """
    found = detected.groupBy(key).agg(F.count("*").alias("n_detected"))
    rows = files.select(key, "duration_ms").join(found, key, "left").join(file_summary(segments, key), key, "left")
    return rows.na.fill(0, ["n_detected", "n_segments", "speech_ms"]).withColumns({k: F.lit(v) for k, v in vars(options).items()})


def in_input_order(results: DataFrame, inputs: DataFrame, key: str = "audio_id", position: str = "position", order: str = "seq") -> DataFrame:
    """``results`` (key, order, ...) with the position of their input (key, position), sorted by it and then by ``order``.

    A range partitioning and a sort within each range: files that are written from it follow one another in order.
    """
    return results.join(inputs.select(key, position), key).orderBy(position, order)


def elapsed_totals(df: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, vad_ms, asr_ms, total_ms) from rows of (key, vad_elapsed_ms, asr_elapsed_ms); nulls count as 0."""
    return df.groupBy(key).agg(F.sum(F.coalesce("vad_elapsed_ms", F.lit(0.0))).alias("vad_ms"), F.sum(F.coalesce("asr_elapsed_ms", F.lit(0.0))).alias("asr_ms")).withColumn("total_ms", F.col("vad_ms") + F.col("asr_ms"))


def running_elapsed(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds <value>_total: the running sum in order."""
    return df.withColumn(f"{value}_total", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def chunk_totals(df: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, mel_frames, audio_tokens, n_chunks) summed over the chunks of a recording."""
    return df.groupBy(key).agg(F.sum("mel_frames").alias("mel_frames"), F.sum("audio_tokens").alias("audio_tokens"), F.count("*").alias("n_chunks"))


def normalize_language(df: DataFrame, allowed: DataFrame, language: str = "language") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): blank becomes null, other names get a capital first letter and must be in ``allowed`` (language)."""
    named = df.withColumn(language, F.when(F.trim(F.col(language)) != "", F.initcap(F.trim(F.col(language)))))
    allowed = allowed.select(F.col("language").alias(language)).distinct()
    known = named.join(allowed, language, "left_semi")
    rejected = named.where(F.col(language).isNotNull()).join(allowed, language, "left_anti")
    return known.unionByName(named.where(F.col(language).isNull())), rejected


def with_params(items: DataFrame, params: DataFrame, key: str = "audio_id") -> DataFrame:
    """Attaches parameters: one row spreads over all items, otherwise there must be one row for each item (else it raises)."""
    n = params.limit(2).count()
    if n == 1:
        return items.crossJoin(F.broadcast(params.drop(key)))
    if params.count() != items.count() or items.join(params, key, "left_anti").limit(1).count():
        raise ValueError("parameters must be one row, or one for each item")
    return items.join(params, key)


def missing_inputs(required: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return required.join(present, key, "left_anti")
