"""The frame state machine of the detector: votes over a window, look-back at starts, silence limit at ends.

``Machine`` holds what the next frame needs and nothing else, as plain numbers, so a streaming operator can keep it as state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StringType, StructField, StructType

from speechlake.operators.workers import once
from speechlake.options import MachineOptions

WAITING, SPEAKING = 0, 1


def frame_state(silence: Column, db: Column, margin: float = 0.6, least_db: float = -100.0) -> Column:
    """Whether a frame is speech: the clamped silence score leaves speech ahead by ``margin``, and the level holds."""
    s = F.greatest(F.lit(1e-7), F.least(F.lit(1.0 - 1e-7), silence.cast("double")))
    return F.coalesce((1.0 - s >= s + margin) & (db >= least_db), F.lit(False))


@dataclass
class Machine:
    """Feeds frames one by one; segments come out as [start_ms, end_ms, closed]."""

    frame: int = 0
    votes: list[int] = field(default_factory=list)
    voted_speech: bool = False
    phase: int = WAITING
    floor: int = 0
    silent: int = 0
    start: int = -1
    ends: int = 0
    segments: list[list] = field(default_factory=list)
    told_start: bool = False

    def feed(self, speech: bool, last: bool, o: MachineOptions) -> None:
        f = self.frame
        self.frame += 1
        was = self.voted_speech
        self.votes = [*self.votes[-(o.vote_frames - 1) :], int(speech)]
        total = sum(self.votes)
        if not was and total >= o.to_speech:
            self.voted_speech = True
        elif was and total <= o.to_silence:
            self.voted_speech = False
        if was or self.voted_speech:
            self.silent = 0
        else:
            self.silent += 1
        delay = o.vote_frames + o.look_back
        if self.phase == WAITING:
            if not was and self.voted_speech:
                self.start = max(self.floor, f - delay)
                self.segments.append([self.start * o.frame_ms, self.start * o.frame_ms, False])
                self.phase = SPEAKING
                self._reach(f, o)
            elif not was and last and not self.ends:
                self.ends += 1
                self._rest(o)
            elif not was and f >= delay:
                self.floor = max(self.floor, f - delay)
            return
        too_long = f - self.start + 1 > o.longest
        if not was and not self.voted_speech:
            if self.silent >= o.end_silence:
                self._close(f - o.end_back, o)
            elif too_long or last and self.silent > 0:
                self._close(f, o)
            elif self.silent <= o.tail_frames:
                self._reach(f, o)
        elif too_long or last:
            self._close(f, o)
        else:
            self._reach(f, o)

    def _reach(self, f: int, o: MachineOptions) -> None:
        self.segments[-1][1] = (f + 1) * o.frame_ms

    def _close(self, f: int, o: MachineOptions) -> None:
        self.segments[-1][1:] = [(f + 1) * o.frame_ms, True]
        self.ends += 1
        self._rest(o)

    def _rest(self, o: MachineOptions) -> None:
        if self.segments:
            self.floor = max(self.floor, self.segments[-1][1] // o.frame_ms)
        self.votes, self.voted_speech, self.phase, self.silent, self.start = [], False, WAITING, 0, -1

    def take_events(self) -> list[tuple[int, int]]:
        """New events: [start, -1] once a segment opens, [-1, end] when it closes, [start, end] for both at once."""
        out, rest = [], []
        for segment in self.segments:
            start, end, closed = segment
            if closed:
                out.append((-1 if self.told_start else start, end))
                self.told_start = False
            else:
                if not self.told_start:
                    out.append((start, -1))
                    self.told_start = True
                rest.append(segment)
        # a closed segment's end still bounds the next start through ``floor``
        self.segments = rest
        return out

    def saved(self) -> dict:
        return asdict(self)


def segments_of(speech: np.ndarray, o: MachineOptions = MachineOptions()) -> list[tuple[int, int]]:
    """Closed segments of a whole recording's frame states."""
    m = Machine()
    n = len(speech)
    for i, s in enumerate(speech.tolist()):
        m.feed(s, i == n - 1, o)
    return [(a, b) for a, b, closed in m.segments if closed and b >= a]


def _key_turns(keys: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows with one key; a null key is a key."""
    values = keys.to_pylist()
    cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return list(zip(cuts, cuts[1:], strict=False)) if values else []


def vad_segments(frames: DataFrame, speech: Column, o: MachineOptions = MachineOptions(), key: str = "audio_id", order: str = "frame_idx") -> DataFrame:
    """(key, seq, start_ms, end_ms) from one row per frame.

    The rule is sequential, so a recording's frames pass by in order in one task; it holds the machine and one batch.
    """
    kind = frames.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, seq, waiting = None, None, 0, None

        def told(kept: list) -> list:
            """Closed segments that can't change any more, as rows."""
            nonlocal seq
            out = []
            for a, b, closed in kept:
                if closed and b >= a:
                    out.append((now, seq, a, b))
                    seq += 1
            return out

        def ended() -> list:
            machine.feed(waiting, True, o)
            return told(machine.segments)

        def batch_of(out: list, like: pa.DataType) -> pa.RecordBatch:
            types = (like, pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [key, "seq", "start_ms", "end_ms"])

        like = None
        for batch in batches:
            like, out, states = batch.schema.field(0).type, [], batch.column(1).to_pylist()
            for a, b in _key_turns(batch.column(0)):
                own = batch.column(0)[a].as_py()
                if machine is None or own != now:
                    if machine is not None:
                        out += ended()
                    machine, now, seq, waiting = Machine(), own, 0, None
                for s in states[a:b]:
                    if waiting is not None:
                        machine.feed(waiting, False, o)
                    waiting = s
                done = machine.segments[:-1]  # the last one stays, as its end bounds the next start
                machine.segments = machine.segments[-1:]
                out += told(done)
            yield batch_of(out, like)
        if machine is not None:
            yield batch_of(ended(), like)

    rows_in = frames.select(key, F.coalesce(speech, F.lit(False)).alias("s"), F.col(order).alias("o")).repartition(key).sortWithinPartitions(key, "o")
    return rows_in.select(key, "s").mapInArrow(rows, f"{key} {kind}, seq long, start_ms long, end_ms long")


def score_frames(feats: DataFrame, make_scorer: Callable[[], Callable], key: str = "audio_id", order: str = "frame_idx", sort: bool = True, on_error: str = "raise") -> DataFrame:
    """Adds silence (float) to rows with ``feat``, recording by recording and in order; with ``on_error="row"`` error (string) too.

    The scorer, made once in a worker, gets (rows, width), the rows' ``db`` (zeros where there is no such column) and its state, which
    is None at a recording's first frame, and returns as many scores and its new state.  A recording may come in several parts.
    ``sort=False``: each recording's rows already stand together and in order, as ``features`` gives them, so nothing is shuffled.
    With ``row`` a recording whose scoring fails has no scores from there on, and ``vad: message`` in error.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error must be raise or row")
    make_scorer, with_error = once(make_scorer), on_error == "row"
    out = StructType([*feats.schema.fields, StructField("silence", FloatType()), *([StructField("error", StringType())] if with_error else [])])
    names, has_db = [f.name for f in out.fields], "db" in feats.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, now, state, failed, started = make_scorer(), None, None, None, False
        for batch in batches:
            keys, feat = (batch.column(batch.schema.get_field_index(c)) for c in (key, "feat"))
            db = batch.column(batch.schema.get_field_index("db")).to_numpy(zero_copy_only=False).astype(np.float64) if has_db else np.zeros(batch.num_rows)
            scores, errors = np.full(batch.num_rows, np.nan, np.float32), [None] * batch.num_rows
            for a, b in _key_turns(keys):
                own = keys[a].as_py()
                if not started or own != now:
                    now, state, failed, started = own, None, None, True
                if failed is None:
                    try:
                        x = feat.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                        scores[a:b], state = score(x, db[a:b], state)
                    except Exception as e:
                        if not with_error:
                            raise
                        failed = f"vad: {e!r}"
                if failed is not None:
                    scores[a:b], errors[a:b] = np.nan, [failed] * (b - a)
            more = [pa.array(scores, from_pandas=True), *([pa.array(errors, pa.string())] if with_error else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    ordered = feats.repartition(key).sortWithinPartitions(key, order) if sort else feats
    return ordered.mapInArrow(rows, out)
