"""Recordings to segments, texts and summaries; detectors and recognisers are given by the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.text import parse_asr_output
from speechlake.functions.timebase import samples_to_ms
from speechlake.operators.clips import slice_segments
from speechlake.operators.energy_vad import energy_segments, frame_levels
from speechlake.operators.features import features
from speechlake.operators.inference import balanced, split_long_audio, transcribe_segments
from speechlake.operators.segments import merge_segments, pad_segments
from speechlake.operators.transcripts import file_facts, merge_languages, merge_texts
from speechlake.operators.vad_machine import frame_state, score_frames, vad_segments
from speechlake.options import SAMPLE_RATE, EnergyVadOptions, SegmentOptions

Model = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def speech_regions(frames: DataFrame, vad: EnergyVadOptions, seg: SegmentOptions, key: str = "audio_id") -> DataFrame:
    """Where speech is: (key, seq, start_ms, end_ms, vad_start_ms, vad_end_ms) from (key, frame_idx, db, duration_ms), one key throughout."""
    return merge_segments(pad_segments(energy_segments(frames, vad, key), seg), seg.merge_gap_ms, key)


def with_duration(audio: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    return audio.withColumn("duration_ms", samples_to_ms(F.size("samples"), rate))


def energy_regions(audio: DataFrame, vad: EnergyVadOptions = EnergyVadOptions(), seg: SegmentOptions = SegmentOptions(), key: str = "audio_id") -> DataFrame:
    """The same from samples."""
    frames = frame_levels(audio, "mean", vad.frame_ms * SAMPLE_RATE // 1000, vad.hop_ms * SAMPLE_RATE // 1000, key)
    return speech_regions(frames.join(with_duration(audio).select(key, "duration_ms"), key), vad, seg, key)


def machine_regions(audio: DataFrame, make_scorer, seg: SegmentOptions = SegmentOptions(), key: str = "audio_id") -> DataFrame:
    """Regions by features, a scorer, and the frame machine.  Frames are scored where they were made, before any shuffle."""
    return merge_segments(pad_segments(machine_segments(audio, make_scorer, key), seg), seg.merge_gap_ms, key)


def machine_segments(audio: DataFrame, make_scorer, key: str = "audio_id") -> DataFrame:
    """(key, seq, start_ms, end_ms, duration_ms): the detector's segments, before they are padded and merged."""
    scored = score_frames(features(audio, "stacked_fbank", key), make_scorer, key, sort=False)
    found = vad_segments(scored.withColumn("db", F.lit(0.0)), frame_state(F.col("silence"), F.col("db")), key=key)
    return found.join(with_duration(audio).select(key, "duration_ms"), key)


def transcribe(audio: DataFrame, regions: DataFrame, make_model: Model, parts: int, on_error: str = "row", key: str = "audio_id", detected: DataFrame | None = None, options: SegmentOptions = SegmentOptions()) -> tuple[DataFrame, DataFrame]:
    """(segments, files): each region's text and language, and for each recording what ``file_facts`` tells, its text and languages.

    Recordings without speech are in ``files`` too.  ``detected`` (key, ...): the detector's segments, to be counted; else the regions are.
    """
    clips = balanced(slice_segments(audio, regions, SAMPLE_RATE, key).withColumnRenamed("clip", "samples"), parts)
    done = transcribe_segments(clips, make_model, on_error).withColumn("p", parse_asr_output(F.col("raw_text")))
    segments = done.drop("samples").withColumns({"language": F.col("p.language"), "text": F.col("p.text")}).drop("p")
    facts = file_facts(with_duration(audio).select(key, "duration_ms"), segments, regions if detected is None else detected, options, key)
    texts = merge_texts(segments, key).join(merge_languages(segments, key), key)
    return segments, facts.join(texts, key, "left").na.fill("", ["text", "language"])


def transcribe_long(audio: DataFrame, make_model: Model, parts: int, longest_s: float = 1200.0, key: str = "audio_id") -> DataFrame:
    """(key, text, language, n_pieces) of recordings that are cut at quiet places first.  Rows: key, sample_rate, samples."""
    pieces = balanced(split_long_audio(audio, longest_s, key=key), parts)
    done = transcribe_segments(pieces, make_model).withColumn("p", parse_asr_output(F.col("raw_text")))
    rows = done.select(key, F.col("piece").alias("seq"), F.col("p.language").alias("language"), F.col("p.text").alias("text"))
    return rows.groupBy(key).agg(F.count("*").alias("n_pieces")).join(merge_texts(rows, key), key).join(merge_languages(rows, key), key)
