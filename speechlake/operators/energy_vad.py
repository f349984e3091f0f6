"""Energy-based speech detection over frames, by run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions.audio import frame_db_mean, frame_db_sum
from speechlake.options import EnergyVadOptions


def frame_levels(audio: DataFrame, form: str = "mean", frame: int | None = None, hop: int = 160, key: str = "audio_id") -> DataFrame:
    """(key, frame_idx, db) of each recording's samples; ``form``: mean (short last frames) or sum (full frames)."""
    levels = frame_db_mean(F.col("samples"), frame or 320, hop) if form == "mean" else frame_db_sum(F.col("samples"), frame or 400, hop)
    return audio.select(key, F.posexplode(levels).alias("frame_idx", "db"))


def runs(df: DataFrame, state: Column, key: str, order: str) -> DataFrame:
    """(key, run, state, first, n): maximal runs of equal states; ``first`` is the order value of the run's first row."""
    w = Window.partitionBy(key).orderBy(order)
    df = df.select(key, order, state.alias("state"))
    turned = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    df = df.withColumn("turned", turned).withColumn("run", F.sum("turned").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, "run", "state").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.max(order).alias("last"))


def energy_vad(frames: DataFrame, speech: Column, speech_frames: int, silence_frames: int, key: str = "audio_id", order: str = "frame_idx") -> DataFrame:
    """(key, seq, first, stop) from one row per frame.

    Speech starts at a run of ``speech_frames`` speech frames or more, and stops at the next run of ``silence_frames``
    silent frames or more, ``first`` and ``stop`` being the order values of those runs' first frames; ``stop`` is null where
    speech is still open at the end.  The frames collapse to runs first, so the second window is over runs only.
    """
    kept = runs(frames, speech, key, order).where(F.when(F.col("state"), F.col("n") >= speech_frames).otherwise(F.col("n") >= silence_frames))
    w = Window.partitionBy(key).orderBy("run")
    turns = kept.withColumn("was", F.lag("state").over(w)).where((F.col("state") & ~F.coalesce("was", F.lit(False))) | (~F.col("state") & F.coalesce("was", F.lit(False))))
    turns = turns.withColumn("stop", F.lead("first").over(w)).where("state")
    return turns.select(key, (F.row_number().over(w) - 1).alias("seq"), "first", "stop")


def energy_segments(frames: DataFrame, opts: EnergyVadOptions = EnergyVadOptions(), key: str = "audio_id") -> DataFrame:
    """(key, seq, start_ms, end_ms) from (key, frame_idx, db, duration_ms); open speech ends with the recording."""
    found = energy_vad(frames, F.col("db") >= opts.threshold_db, opts.speech_frames, opts.silence_frames, key)
    ends = frames.groupBy(key).agg(F.max("duration_ms").alias("duration_ms"))
    return found.join(ends, key).select(key, "seq", (F.col("first") * opts.hop_ms).cast("long").alias("start_ms"), F.coalesce(F.col("stop") * opts.hop_ms, "duration_ms").cast("long").alias("end_ms"), "duration_ms")


def vote_window(frames: DataFrame, state: Column, size: int = 20, key: str = "audio_id", order: str = "frame_idx") -> DataFrame:
    """Adds votes: speech frames among the last ``size``; frames before the first count as silence."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)
    return frames.withColumn("votes", F.sum(state.cast("long")).over(w))
