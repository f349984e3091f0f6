"""Cutting audio: fixed chunks, clips of segments, and which chunks belong to which segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.arrays import cut
from speechlake.functions.audio import clip
from speechlake.functions.timebase import samples_to_ms


def chunk_audio(audio: DataFrame, chunk_ms: int, key: str = "audio_id") -> DataFrame:
    """(key, chunk_id, start_ms, end_ms, samples): chunks of ``chunk_ms``, the last one short.  ``audio``: key, sample_rate, samples."""
    step = F.greatest(F.lit(1), F.bround(F.lit(float(chunk_ms)) * F.col("sample_rate") / 1000, 0)).cast("int")
    rows = audio.where(F.size("samples") > 0).withColumn("step", step)
    rows = rows.select(key, "sample_rate", "samples", "step", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / F.col("step")).cast("int"))).alias("chunk_id"))
    start, end = F.col("chunk_id") * F.col("step"), F.least((F.col("chunk_id") + 1) * F.col("step"), F.size("samples"))
    ms = lambda n: F.bround(n * F.lit(1000.0) / F.col("sample_rate"), 0).cast("long")
    return rows.select(key, F.col("chunk_id").cast("long").alias("chunk_id"), ms(start).alias("start_ms"), ms(end).alias("end_ms"), cut(F.col("samples"), start, end).alias("samples"))


def slice_segments(audio: DataFrame, segments: DataFrame, rate: int, key: str = "audio_id") -> DataFrame:
    """The clip of each segment; empty clips are dropped.  For recordings that are one row each."""
    joined = segments.join(audio.select(key, "samples"), key)
    return joined.withColumn("clip", clip(F.col("samples"), F.col("start_ms"), F.col("end_ms"), rate)).drop("samples").where(F.size("clip") > 0)


def chunks_in_segments(chunks: DataFrame, segments: DataFrame, bucket_ms: int, key: str = "audio_id") -> DataFrame:
    """Each (segment, chunk) whose times overlap, once: chunks (key, chunk_id, start_ms, end_ms, ...), segments (key, seq, start_ms, end_ms).

    Both sides are listed under each time bucket that they touch, so it is an equi-join on (key, bucket) that a long recording
    doesn't make one task; a pair is kept only in the bucket where the overlap begins.  Chunk times come as chunk_start_ms, chunk_end_ms.
    """
    bucket = lambda c: F.floor(c / bucket_ms)
    spread = lambda df: df.where("end_ms > start_ms").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_ms")), bucket(F.col("end_ms") - 1))))
    left = spread(segments.select(key, "seq", "start_ms", "end_ms"))
    right = spread(chunks).withColumnsRenamed({"start_ms": "chunk_start_ms", "end_ms": "chunk_end_ms"})
    overlap = (F.col("chunk_start_ms") < F.col("end_ms")) & (F.col("start_ms") < F.col("chunk_end_ms"))
    first = bucket(F.greatest("start_ms", "chunk_start_ms")) == F.col("bucket")
    return left.join(right, [key, "bucket"]).where(overlap & first).drop("bucket")


def trim_to_vad_end(utterances: DataFrame, ends: DataFrame, rate: int, key: str = "utterance_id") -> DataFrame:
    """Cuts utterances (key, start_ms, window_samples, total_samples, buffer_samples) to the ends (key, end_ms) the detector gave.

    target = the samples from start to end.  Beyond the target the window loses its tail and the buffer is emptied; else the
    buffer is cut to what is missing.  An end before the start changes nothing.
    """
    target = F.bround((F.col("end_ms") - F.col("start_ms")) * F.lit(float(rate)) / 1000, 0).cast("long")
    rows = utterances.join(ends, key, "left").withColumn("target", F.when(F.col("end_ms") >= F.col("start_ms"), target))
    over = F.greatest(F.lit(0), F.col("total_samples") - F.col("target"))
    keeps = F.col("target").isNull()
    cols = {
        "window_samples": F.when(keeps, F.col("window_samples")).otherwise(F.greatest(F.lit(0), F.col("window_samples") - over)),
        "buffer_samples": F.when(keeps, F.col("buffer_samples")).when(over > 0, 0).otherwise(F.least("buffer_samples", F.col("target") - F.col("total_samples"))),
        "total_samples": F.when(keeps, F.col("total_samples")).otherwise(F.least("total_samples", "target")),
    }
    return rows.withColumns({k: v.cast("long") for k, v in cols.items()}).drop("target")


def stacked_ms(chunks: DataFrame, rate: int, key: str = "stream_id") -> DataFrame:
    """Duration of each key in ms from its chunks' sample counts (n_samples)."""
    return chunks.groupBy(key).agg(F.sum("n_samples").alias("n_samples")).withColumn("duration_ms", samples_to_ms(F.col("n_samples"), rate))
