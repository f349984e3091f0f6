"""Options of the jobs.  Times are in milliseconds, levels in dB."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLE_RATE = 16_000


@dataclass(frozen=True)
class SegmentOptions:
    min_segment_ms: int = 200
    pad_start_ms: int = 200
    pad_end_ms: int = 200
    merge_gap_ms: int = 200


@dataclass(frozen=True)
class EnergyVadOptions:
    """Frames and the two run lengths of the energy detector."""

    frame_ms: int = 20
    hop_ms: int = 10
    threshold_db: float = -45.0
    min_speech_ms: int = 200
    min_silence_ms: int = 500

    @property
    def speech_frames(self) -> int:
        return max(1, self.min_speech_ms // self.hop_ms)

    @property
    def silence_frames(self) -> int:
        return max(1, self.min_silence_ms // self.hop_ms)


@dataclass(frozen=True)
class MachineOptions:
    """The frame state machine: 10 ms frames; lengths in frames."""

    frame_ms: int = 10
    vote_frames: int = 20
    to_speech: int = 15
    to_silence: int = 15
    look_back: int = 20
    end_silence: int = 100
    longest: int = 6000
    tail_frames: int = 10
    end_back: int = 89


@dataclass(frozen=True)
class StreamOptions:
    """Pre-roll, recompute window, decode step, and how partial texts become stable."""

    sample_rate: int = SAMPLE_RATE
    pre_roll_ms: int = 300
    window_seconds: float = 10.0
    step_seconds: float = 0.5
    unfixed_chunks: int = 2
    unfixed_tokens: int = 5
    revision: str = "clear"  # or keep_stable
    emit: str = "changed"  # or pending
    restart: str = "ignore"  # or close_and_reopen
    source_rate: int | None = None  # of the chunks, where it isn't sample_rate
