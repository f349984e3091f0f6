"""Milliseconds and samples.

``mode`` is how a fraction is rounded: ``even`` (half to even), ``away`` (half away from zero), or ``truncate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("even", "away", "truncate")


def rounded(value: Column, mode: str = "even") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "truncate":
        return value.cast("long")
    return (F.bround(value, 0) if mode == "even" else F.round(value, 0)).cast("long")


def ms_to_samples(ms: Column, rate: int, mode: str = "even") -> Column:
    return rounded(ms * F.lit(float(rate)) / F.lit(1000.0), mode)


def samples_to_ms(samples: Column, rate: int, mode: str = "even") -> Column:
    return rounded(samples * F.lit(1000.0) / F.lit(float(rate)), mode)


def chunk_end_ms(start_ms: Column, samples: Column, rate: int) -> Column:
    return start_ms + samples_to_ms(samples, rate)
