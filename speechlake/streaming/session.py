"""One stream's state: features carried over chunk borders, the frame machine, utterances, and partial texts.

``Session`` takes chunks in order and returns event rows.  Its state is what the next chunk needs - no history of frames or
scores - and can be saved in a few columns, so a streaming query and a replay of stored chunks run the same code.

Scorers and models may have a memory.  They are functions of their inputs and a state of any type that can be pickled, and
return the new state beside their result; the session keeps it, so one scorer and one model serve all streams.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Generator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np

from speechlake.operators.features import fbank, frame_signal
from speechlake.operators.tokens import Tokenizer
from speechlake.operators.vad_machine import Machine
from speechlake.options import MachineOptions, StreamOptions
from speechlake.sources.audio_files import Resampler

FRAME, HOP = 400, 160
#: Gets (frames, 400) stacked features, their levels in dB and its state (None at the start of a stream), and returns silence scores and its new state.
Scorer = Callable[[np.ndarray, np.ndarray, Any], tuple[np.ndarray, Any]]
#: Gets the window's samples, the text prefix and its state (None at the start of an utterance), and returns the text that follows and its new state.
Model = Callable[[np.ndarray, str, Any], tuple[str, Any]]
#: Steps of a session: calls of the model are yielded, their results sent, events returned.
Calls = Generator[tuple[np.ndarray, str, Any], tuple[str, Any], Any]
#: The columns of a saved session; an ended one has only the first.
SAVED = "session string, samples binary, frames binary, levels binary, pre_roll binary, buffer binary, window binary, scorer binary, model binary"


def _none() -> np.ndarray:
    return np.zeros(0, np.float32)


@dataclass
class Carry:
    """Samples and frames that later chunks still need; frames come out once their right neighbours are there."""

    samples: np.ndarray = field(default_factory=_none)
    frames: np.ndarray = field(default_factory=lambda: np.zeros((0, 80), np.float32))
    levels: np.ndarray = field(default_factory=_none)
    started: bool = False

    def feed(self, pcm: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        """(stacked features, dB) of the frames that are complete now."""
        x = np.concatenate((self.samples, pcm.astype(np.float32)))
        n = 1 + (len(x) - FRAME) // HOP if len(x) >= FRAME else 0
        if n:
            own = x[: (n - 1) * HOP + FRAME]
            db = 10 * np.log10((frame_signal(own, FRAME, HOP).astype(np.float64) ** 2).sum(1) + 1e-6)
            feats = fbank(own)
            if not self.started:  # the first frame stands in for the two before it
                self.frames, self.started = np.repeat(feats[:1], 2, 0), True
            self.frames, self.levels = np.concatenate((self.frames, feats)), np.concatenate((self.levels, db.astype(np.float32)))
            x = x[n * HOP :]
        self.samples = x
        frames = np.concatenate((self.frames, np.repeat(self.frames[-1:], 2, 0))) if final and len(self.frames) else self.frames
        k = max(0, len(frames) - 4)
        out = np.stack([frames[i : i + k] for i in range(5)], 1).reshape(k, 400) if k else np.zeros((0, 400), np.float32)
        levels, self.levels = self.levels[:k], self.levels[k:]
        self.frames = self.frames[k:]
        return out, levels


@dataclass
class Utterance:
    """Recognition of the open utterance: buffer, window, last raw text, and what of it was told."""

    start_ms: int = 0
    chunk: int = 0
    buffer: np.ndarray = field(default_factory=_none)
    window: np.ndarray = field(default_factory=_none)
    total: int = 0
    trimmed: int = 0
    raw: str = ""
    confirmed: str = ""
    pending: str = ""
    told: str = ""
    memory: Any = None


@dataclass
class Session:
    """Feed chunks with ``push``; give it scorer, model and tokenizer again after ``load``."""

    options: StreamOptions = field(default_factory=StreamOptions)
    machine_options: MachineOptions = field(default_factory=MachineOptions)
    carry: Carry = field(default_factory=Carry)
    machine: Machine = field(default_factory=Machine)
    utterance: Utterance | None = None
    resampler: Resampler | None = None
    pre_roll: np.ndarray = field(default_factory=_none)
    speaking: bool = False
    utterances: int = 0
    results: int = 0
    finished: bool = False
    failed: bool = False
    end_ms: int = 0
    memory: Any = None
    scorer: Scorer | None = None
    model: Model | None = None
    tokenizer: Tokenizer | None = None
    _rows: list[dict] = field(default_factory=list)
    _worker: str = "session"

    def __post_init__(self):
        o = self.options
        if self.resampler is None and o.source_rate not in (None, o.sample_rate):
            self.resampler = Resampler(o.source_rate, o.sample_rate)

    # state in columns

    @property
    def step(self) -> int:
        """Samples that are decoded at once."""
        return round(self.options.step_seconds * self.options.sample_rate)

    @property
    def longest(self) -> int:
        """Samples of the recognition window at most."""
        return round(self.options.window_seconds * self.options.sample_rate)

    def save(self, with_window: bool = True) -> tuple:
        """The values of SAVED; without the window for a caller that keeps its steps apart."""
        marks = {k: getattr(self, k) for k in ("speaking", "utterances", "results", "finished", "failed", "end_ms")}
        if self.finished:
            return (json.dumps(marks), *[None] * 8)
        u, c, r = self.utterance, self.carry, self.resampler
        own = u and {k: v for k, v in vars(u).items() if k not in ("buffer", "window", "memory")}
        raw = lambda x: x.astype("<f4").tobytes()
        arrays = [raw(x) for x in (c.samples, c.frames, c.levels, self.pre_roll, *((u.buffer, u.window if with_window else _none()) if u else (_none(), _none())))]
        kept = [None if x is None else pickle.dumps(x, 5) for x in (self.memory, u.memory if u else None)]
        return (json.dumps(marks | {"started": c.started, "machine": asdict(self.machine), "utterance": own, "resampler": r and [r.seen, r.made, r.tail.tolist()]}), *arrays, *kept)

    @classmethod
    def load(cls, saved: tuple, **given) -> Session:
        x, arrays = json.loads(saved[0]), [np.frombuffer(b, "<f4").copy() if b is not None else _none() for b in saved[1:7]]
        samples, frames, levels, pre_roll, buffer, window = arrays
        memory, own_memory = (None if b is None else pickle.loads(bytes(b)) for b in saved[7:])
        started, machine, own, rates = x.pop("started", False), x.pop("machine", {}), x.pop("utterance", None), x.pop("resampler", None)
        if rates:
            o = given["options"]
            given["resampler"] = Resampler(o.source_rate, o.sample_rate, *rates[:2], np.array(rates[2], np.float64))
        utterance = own and Utterance(**own, buffer=buffer, window=window, memory=own_memory)
        return cls(**given, **x, carry=Carry(samples, frames.reshape(-1, 80), levels, started), machine=Machine(**machine), utterance=utterance, pre_roll=pre_roll, memory=memory)

    # events

    def _event(self, kind: str, chunk_id: int, utterance: int | None = None, **values) -> dict:
        row = {"result_id": self.results, "event_type": kind, "utterance_id": (self.utterances - 1 if self.utterance else -1) if utterance is None else utterance, "trigger_chunk_id": chunk_id, "start_ms": None, "end_ms": None, "text": "", "confirmed_delta": "", "confirmed_text": "", "pending_text": "", "error": None}
        self.results += 1
        self._rows.append(row | values)
        return self._rows[-1]

    def _guarded(self, chunk_id: int, work: Calls) -> Calls:
        """The events told during ``work``; if it fails, one error row ends them and the stream."""
        self._rows, self._worker = [], "session"
        try:
            yield from work
        except Exception as e:
            self._event("error", chunk_id, error=f"{self._worker}: {e!r}")
            self.finished = self.failed = True
        return self._rows

    def advance(self, chunk_id: int, start_ms: int, pcm: np.ndarray, is_final: bool = False) -> Calls:
        """``push`` in steps: yields each call of the model as (window, prefix, state), is sent its result, and returns the events."""
        if self.failed:
            return []
        if self.finished:
            self._rows = []
            return [self._event("error", chunk_id, error="vad: audio after the end of the stream")]

        def work() -> Calls:
            yield from self._chunk(chunk_id, start_ms, np.clip(np.asarray(pcm, np.float32), -1, 1), False)
            if is_final:
                yield from self._finish(chunk_id)

        return (yield from self._guarded(chunk_id, work()))

    def _driven(self, steps: Calls) -> list[dict]:
        """Runs steps with the session's own model."""
        result = None
        while True:
            try:
                call = next(steps) if result is None else steps.send(result)
            except StopIteration as end:
                return end.value
            while True:
                try:
                    result = self.model(*call)
                    break
                except Exception as e:
                    try:
                        call = steps.throw(e)
                    except StopIteration as end:
                        return end.value

    def push(self, chunk_id: int, start_ms: int, pcm: np.ndarray, is_final: bool = False) -> list[dict]:
        """Events of one chunk.  The final chunk closes everything; a chunk after it is an error row.

        A scorer or model that raises gives one error row, named vad or asr, and ends the stream: later chunks give nothing.
        """
        return self._driven(self.advance(chunk_id, start_ms, pcm, is_final))

    def _detected(self, pcm: np.ndarray, final: bool) -> list[tuple[int, int]]:
        feats, levels = self.carry.feed(pcm, final)
        if len(feats):
            self._worker = "vad"
            scores, self.memory = self.scorer(feats, levels, self.memory)
            self._worker = "session"
            s = np.clip(np.asarray(scores, np.float64), 1e-7, 1 - 1e-7)
            speech = (1 - s >= s + 0.6).tolist()
            for i, x in enumerate(speech):
                self.machine.feed(x, final and i == len(speech) - 1, self.machine_options)
        return self.machine.take_events()

    def _chunk(self, chunk_id: int, start_ms: int, pcm: np.ndarray, final: bool) -> Calls:
        o, fed, was = self.options, False, self.speaking
        chunk_end = start_ms + round(len(pcm) * 1000 / (o.source_rate or o.sample_rate))
        if self.resampler is not None:
            pcm = self.resampler.feed(pcm, final)
        self.end_ms = max(self.end_ms, chunk_end)
        begin = lambda at: self._open(at, np.concatenate((self.pre_roll, pcm)), chunk_id)
        for start, end in self._detected(pcm, final):
            if end == -1:
                if self.speaking and o.restart == "ignore":
                    continue
                if self.speaking:
                    yield from self._close(start, chunk_id)
                yield from begin(start)
                fed = self.speaking = True
                continue
            end = end if end >= max(start, 0) else max(start, chunk_end)
            if self.speaking or was:
                if not fed:
                    yield from self._hear(pcm, chunk_id, start_ms)
            elif start >= 0:
                yield from begin(start)
            else:
                continue
            fed, self.speaking, was = True, False, False
            yield from self._close(end, chunk_id)
        if self.speaking and not fed:
            yield from self._hear(pcm, chunk_id, start_ms)
        keep = round(o.pre_roll_ms * o.sample_rate / 1000)
        self.pre_roll = _none() if self.speaking else np.concatenate((self.pre_roll, pcm))[-keep:] if keep else _none()

    def _finish(self, chunk_id: int) -> Calls:
        o = self.options
        yield from self._chunk(chunk_id, self.end_ms, np.zeros(HOP * (o.source_rate or o.sample_rate) // o.sample_rate, np.float32), True)
        if self.speaking:
            yield from self._close(self.end_ms, chunk_id)
            self.speaking = False
        self.finished = True
        self._event("pipeline_done", chunk_id, end_ms=self.end_ms)

    def timed_out(self) -> list[dict]:
        """Closes a stream that no longer sends anything."""
        return [] if self.finished else self._driven(self._guarded(-1, self._finish(-1)))

    # utterances

    def _open(self, start: int, pcm: np.ndarray, chunk_id: int) -> Calls:
        self.utterance = Utterance(start_ms=start)
        self.utterances += 1
        self._event("speech_start", chunk_id, start_ms=start)
        yield from self._hear(pcm, chunk_id, start)

    def _hear(self, pcm: np.ndarray, chunk_id: int, start_ms: int) -> Calls:
        if self.utterance is None:  # audio without a start opens an utterance at the chunk
            self.utterance = Utterance(start_ms=start_ms)
            self.utterances += 1
        u = self.utterance
        u.buffer = np.concatenate((u.buffer, pcm))
        while len(u.buffer) >= self.step:
            part, u.buffer = u.buffer[: self.step], u.buffer[self.step :]
            yield from self._decode(part, chunk_id)

    def _cut_back(self, raw: str, back: int) -> str:
        if self.tokenizer is not None:
            return self.tokenizer.rollback(self.tokenizer.encode(raw), back)
        return raw[: len(raw) - back] if back < len(raw) else ""

    def _decode(self, part: np.ndarray, chunk_id: int) -> Calls:
        u, o = self.utterance, self.options
        u.total += len(part)
        u.window = np.concatenate((u.window, part))
        u.trimmed += max(0, len(u.window) - self.longest)
        u.window = u.window[-self.longest :]
        prefix = "" if u.chunk < o.unfixed_chunks else self._cut_back(u.raw, o.unfixed_tokens)
        self._worker = "asr"
        text, u.memory = yield u.window, prefix, u.memory
        self._worker = "session"
        u.raw = prefix + text
        u.chunk += 1
        self._tell(self._cut_back(u.raw, 0), False, chunk_id)

    def _tell(self, text: str, final: bool, chunk_id: int) -> None:
        u, o = self.utterance, self.options
        revised, delta = False, ""
        if not text:
            u.pending = ""
        elif text.startswith(u.confirmed):
            rest = text[len(u.confirmed) :]
            n = len(rest)
            if not final:
                n = next((i for i, (a, b) in enumerate(zip(u.pending, rest, strict=False)) if a != b), min(len(u.pending), len(rest)))
            delta, u.pending = rest[:n], rest[n:]
            u.confirmed += delta
        elif final:
            revised = bool(u.confirmed or u.pending)
            u.confirmed, u.pending = text, ""
        else:
            revised, u.pending = True, text
            u.confirmed = "" if o.revision == "clear" else u.confirmed
        now = u.confirmed + u.pending
        worth = delta or revised or now != u.told if o.emit == "changed" else bool(u.pending)
        u.told = now
        if not final and worth:
            end = u.start_ms + round(u.total * 1000 / o.sample_rate)
            self._event("partial", chunk_id, start_ms=u.start_ms, end_ms=end, text=now, confirmed_delta=delta, confirmed_text=u.confirmed, pending_text=u.pending)

    def _close(self, end: int, chunk_id: int) -> Calls:
        u, o = self.utterance, self.options
        if u is None:
            return
        if end >= u.start_ms:
            target = round((end - u.start_ms) * o.sample_rate / 1000)
            if target < u.total:
                u.window, u.buffer, u.total = u.window[: max(0, len(u.window) - (u.total - target))], _none(), target
            else:
                u.buffer = u.buffer[: target - u.total]
        if len(u.buffer):
            part, u.buffer = u.buffer, _none()
            yield from self._decode(part, chunk_id)
        before = u.confirmed
        self._tell(u.raw, True, chunk_id)
        delta = u.confirmed[len(before) :] if u.confirmed.startswith(before) else ""
        self._event("final", chunk_id, start_ms=u.start_ms, end_ms=end, text=u.confirmed, confirmed_delta=delta, confirmed_text=u.confirmed)
        self._event("speech_end", chunk_id, start_ms=u.start_ms, end_ms=end)
        self.utterance = None
