"""PCM samples, frame energies, mel scales and token counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechlake.functions.arrays import bound, cut
from speechlake.functions.timebase import ms_to_samples

HOP = 160


def normalize_pcm(samples: Column, int16: bool = False) -> Column:
    """Samples in [-1, 1]; ``int16`` divides by 32768 first."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") / (32768.0 if int16 else 1.0))).cast("float"))


def downmix(samples: Column, channels: Column, kind: str = "float") -> Column:
    """Plain mean over the channels of interleaved samples, as floats; ``kind`` ``double`` keeps the digits of doubles."""
    frames = F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)
    mean = lambda i: (F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels).cast(kind)
    return F.when(channels == 1, samples).when(F.size(samples) < channels, F.array().cast(f"array<{kind}>")).otherwise(F.transform(frames, mean))


def limit_seconds(samples: Column, rate: Column, seconds: float) -> Column:
    """The first ``seconds``, at the native rate; all for 0 or less."""
    if seconds <= 0:
        return samples
    return F.slice(samples, 1, F.bround(rate * F.lit(float(seconds)), 0).cast("int"))


def _decibel(x: Column) -> Column:
    return F.log10(x) * 10


def frame_db_mean(samples: Column, frame: int = 320, hop: int = HOP) -> Column:
    """10 log10 of each frame's mean square, at least 1e-12; a frame starts at every hop, the last ones are short."""
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.size(samples) - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    level = lambda f: _decibel(F.greatest(F.aggregate(f, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(f), F.lit(1e-12)))
    return F.transform(starts, lambda i: bound(F.slice(samples, i + 1, frame), level))


def frame_db_sum(samples: Column, frame: int = 400, hop: int = HOP) -> Column:
    """10 log10 of (each full frame's sum of squares + 1e-6)."""
    starts = F.when(F.size(samples) >= frame, F.sequence(F.lit(0), F.size(samples) - frame, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _decibel(F.aggregate(F.slice(samples, i + 1, frame), F.lit(0.0), lambda a, x: a + x.cast("double") * x) + 1e-6))


def clip(samples: Column, start_ms: Column, end_ms: Column, rate: int) -> Column:
    """Samples of [start_ms, end_ms), clamped."""
    return cut(samples, ms_to_samples(start_ms, rate), ms_to_samples(end_ms, rate))


def hz_to_mel(hz: Column) -> Column:
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    return F.when(hz < 1000.0, hz * 3.0 / 200.0).otherwise(15.0 + F.log(F.greatest(hz, F.lit(1.0)) / 1000.0) * (27.0 / math.log(6.4)))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15.0, mel * 200.0 / 3.0).otherwise(F.exp((mel - 15.0) * (math.log(6.4) / 27.0)) * 1000.0)


def kaldi_mel(hz: Column) -> Column:
    return F.log(hz / 700.0 + 1.0) * 1127.0


def kaldi_mel_inv(mel: Column) -> Column:
    return (F.exp(mel / 1127.0) - 1.0) * 700.0


def mel_frames(samples: Column) -> Column:
    return F.floor(samples / F.lit(HOP)).cast("long")


def audio_tokens(frames: Column) -> Column:
    """Tokens of so many mel frames: 13 for each full hundred, one for each 8 or part of 8 beyond."""
    return (F.floor(frames / 100) * 13 + F.ceil((frames % 100) / 8)).cast("long")
