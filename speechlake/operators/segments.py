"""Speech segments and detector events.

Segments are rows (key, seq, start_ms, end_ms, ...); a window over the key is as large as one recording's segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.options import SegmentOptions


def explode_segments(df: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, seq, start_ms, end_ms) from ``segments`` (array of arrays); entries shorter than two are dropped."""
    rows = df.select(key, F.posexplode("segments").alias("seq", "s")).where(F.size("s") >= 2)
    return rows.select(key, "seq", F.col("s")[0].cast("long").alias("start_ms"), F.col("s")[1].cast("long").alias("end_ms"))


def pad_segments(df: DataFrame, opts: SegmentOptions = SegmentOptions()) -> DataFrame:
    """Clamps to [0, duration_ms], drops what is shorter than the least length, and pads inside the recording."""
    vad_start, vad_end = F.greatest(F.lit(0), F.col("start_ms")), F.least(F.col("duration_ms"), F.col("end_ms"))
    df = df.withColumns({"vad_start_ms": vad_start.cast("long"), "vad_end_ms": vad_end.cast("long")}).where(F.col("vad_end_ms") - F.col("vad_start_ms") >= opts.min_segment_ms)
    padded = {"start_ms": F.greatest(F.lit(0), F.col("vad_start_ms") - opts.pad_start_ms).cast("long"), "end_ms": F.least(F.col("duration_ms"), F.col("vad_end_ms") + opts.pad_end_ms).cast("long")}
    return df.withColumns(padded).where("end_ms > start_ms")


def merge_segments(df: DataFrame, gap_ms: int, key: str = "audio_id", order: str = "seq") -> DataFrame:
    """Fuses segments whose gap to the largest end so far is ``gap_ms`` at most, in list order."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # a segment that starts a new island begins beyond the end of all before it, so the running end is the island's
    opens = F.when(F.col("start_ms") - F.max("end_ms").over(before) <= gap_ms, 0).otherwise(1)
    islands = df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(upto))
    first = lambda c: F.min_by(c, order).alias(c)
    return islands.groupBy(key, "island").agg(first("start_ms"), F.max("end_ms").alias("end_ms"), first("vad_start_ms"), F.max("vad_end_ms").alias("vad_end_ms")).select(key, (F.col("island") - 1).alias("seq"), "start_ms", "end_ms", "vad_start_ms", "vad_end_ms")


def classify_vad_events(df: DataFrame) -> DataFrame:
    """Adds kind: start [b, -1], end [-1, e], complete [b, e], other."""
    start, end = F.col("start_ms"), F.col("end_ms")
    return df.withColumn("kind", F.when((start >= 0) & (end == -1), "start").when((start == -1) & (end >= 0), "end").when((start >= 0) & (end >= 0), "complete").otherwise("other"))


def complete_segments(df: DataFrame) -> DataFrame:
    return df.where("start_ms >= 0 and end_ms >= start_ms")


def repair_end(df: DataFrame, fallback: str = "chunk_end_ms") -> DataFrame:
    """An end before its start, or absent, becomes the later of the start and the chunk's (or the stream's) end."""
    broken = F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms"))
    return df.withColumn("end_ms", F.when(broken, F.greatest("start_ms", fallback)).otherwise(F.col("end_ms")))


def pair_vad_events(df: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """(key, seq, start_ms, end_ms): an end takes the last start since the previous close, 0 if there is none; complete events stay."""
    df = classify_vad_events(df)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("kind").isin("end", "complete").cast("int")
    df = df.withColumn("group", F.coalesce(F.sum(closes).over(before), F.lit(0)))
    within = Window.partitionBy(key, "group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == "start", F.col("start_ms")), ignorenulls=True).over(within)
    df = df.withColumn("opened", opened).where(F.col("kind").isin("end", "complete"))
    start = F.when(F.col("kind") == "complete", F.col("start_ms")).otherwise(F.coalesce("opened", F.lit(0)))
    return df.select(key, order, start.cast("long").alias("start_ms"), "end_ms")
