"""Sessions over streams whose chunks come out of order, with state that grows by what is new.

``ordered_events`` keeps chunks in a reorder buffer until the watermark has passed their time - or, where chunks are numbered
without gaps, until all before them are there - and then feeds them to the stream's session in order.  A chunk behind the watermark is
told as a row of its own and changes nothing else.

A stream's state is a few kinds: a value with counters, carried frames and the open half step; a map with one entry per decoded
step of the recognition window, so a batch writes the new steps and drops the old ones, not the window; a map of waiting chunks.
Event-time timers release chunks, close silent streams and drop the marks of ended ones, so a query over what is there ends by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from speechlake.operators.workers import once
from speechlake.options import StreamOptions
from speechlake.streaming.jobs import EVENTS, Loader, event_frame, with_event_time
from speechlake.streaming.session import SAVED, Session

#: The state store that maps and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKS = "newest bigint, following bigint, closes bigint, wakes bigint"


class OrderedSessions(StatefulProcessor):
    """One session per stream behind a reorder buffer.  Rows: stream_id, chunk_id, start_ms, event_ms, pcm, is_final."""

    def __init__(self, load: Loader, options: StreamOptions, numbered: bool, timeout_ms: int, ended_ms: int):
        self.make, self.options, self.numbered, self.timeout_ms, self.ended_ms = load, options, numbered, timeout_ms, ended_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session_state = handle.getValueState("session", SAVED)
        self.marks_state = handle.getValueState("marks", MARKS)
        self.steps = handle.getMapState("steps", "step bigint", "samples binary")
        self.waiting = handle.getMapState("waiting", "event_ms bigint, start_ms bigint, chunk_id bigint, copy bigint", "pcm binary, is_final boolean")

    # state

    def _load(self) -> tuple[Session, dict, int]:
        """The session, the marks, and how many steps of its window are stored."""
        names = [c.split()[0] for c in MARKS.split(", ")]
        marks = dict(zip(names, self.marks_state.get(), strict=True)) if self.marks_state.exists() else {"newest": None, "following": 0, "closes": None, "wakes": None}
        given = {"options": self.options, **self.make()}
        if not self.session_state.exists():
            return Session(**given), marks, 0
        session = Session.load(tuple(self.session_state.get()), **given)
        u, stored = session.utterance, 0
        if u is not None and u.chunk:
            parts = sorted((int(k[0]), np.frombuffer(bytes(v[0]), "<f4")) for k, v in self.steps.iterator())
            u.window, stored = np.concatenate([x for _, x in parts])[-session.longest :], u.chunk
        return session, marks, stored

    def _save(self, session: Session, marks: dict, before: int | None, stored: int) -> None:
        """Writes what is small, the steps since ``stored`` if utterance ``before`` is still open, and drops steps no longer in the window."""
        u = session.utterance
        if u is None or u.chunk == 0 or session.utterances != before or stored == 0:
            if self.steps.exists():
                self.steps.clear()
            stored = 0
        if u is not None:
            first = u.total - len(u.window)  # of the window, in samples of the utterance
            for k in range(max(stored, first // session.step), u.chunk):
                self.steps.updateValue((k,), (u.window[max(0, k * session.step - first) : (k + 1) * session.step - first].astype("<f4").tobytes(),))
            for k in range(max(0, (stored * session.step - session.longest) // session.step), first // session.step):
                if self.steps.containsKey((k,)):
                    self.steps.removeKey((k,))
        self.session_state.update(session.save(with_window=False))
        self.marks_state.update(tuple(marks.values()))

    def _forget(self) -> None:
        for state in (self.session_state, self.marks_state, self.steps, self.waiting):
            if state.exists():
                state.clear()

    def _wake(self, marks: dict, at: int) -> None:
        """Makes sure that a timer fires at ``at``, in ms, or before."""
        if marks["wakes"] is None or marks["wakes"] > at:
            if marks["wakes"] is not None:
                self.handle.deleteTimer(marks["wakes"])
            self.handle.registerTimer(at)
            marks["wakes"] = at

    # work

    def _released(self, session: Session, marks: dict, watermark: int) -> tuple[Session, list[dict]]:
        """Feeds what the watermark, or the count of chunks, lets go; sets the timer for what stays.

        A chunk that is ``ended_ms`` past the end of its stream is the first of a new one.
        """
        rows: list[dict] = []
        keys = sorted(tuple(map(int, k)) for k in self.waiting.keys()) if self.waiting.exists() else []
        while keys and (keys[0][0] < watermark or self.numbered and keys[0][2] <= marks["following"]):
            event_ms, start_ms, chunk_id, _ = key = keys.pop(0)
            pcm, is_final = self.waiting.getValue(key)
            self.waiting.removeKey(key)
            if marks["closes"] is not None and self.ended_ms and event_ms >= marks["closes"]:
                session, marks["closes"], marks["following"] = Session(options=self.options, **self.make()), None, 0
            rows += session.push(chunk_id, start_ms, np.frombuffer(bytes(pcm), "<f4"), bool(is_final))
            marks["following"] = max(marks["following"], chunk_id + 1)
            if session.finished and marks["closes"] is None:
                marks["closes"] = event_ms + self.ended_ms
        if keys:
            self._wake(marks, keys[0][0] + 1)
        elif session.finished and self.ended_ms:
            self._wake(marks, marks["closes"])
        elif self.timeout_ms and not session.finished:
            self._wake(marks, marks["newest"] + self.timeout_ms)
        return session, rows

    def _frame(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        return event_frame([x | {"stream_id": key[0]} for x in rows])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, marks, stored = self._load()
        before, watermark, late = session.utterances, int(timerValues.getCurrentWatermarkInMs()), []
        for pdf in rows:
            for c in pdf.itertuples():
                event_ms, start_ms, chunk_id = int(c.event_ms), int(c.start_ms), int(c.chunk_id)
                if event_ms < watermark:
                    late.append({"event_type": "late", "trigger_chunk_id": chunk_id, "start_ms": start_ms, "error": "behind the watermark"})
                    continue
                pcm = np.zeros(0, "<f4") if c.pcm is None else np.asarray(c.pcm, "<f4")
                at = (event_ms, start_ms, chunk_id, 0)
                while self.waiting.containsKey(at):
                    at = (*at[:3], at[3] + 1)
                self.waiting.updateValue(at, (pcm.tobytes(), bool(c.is_final) if pd.notna(c.is_final) else False))
                marks["newest"] = event_ms if marks["newest"] is None else max(marks["newest"], event_ms)
        out: list[dict] = []
        if marks["newest"] is not None:
            session, out = self._released(session, marks, watermark)
            self._save(session, marks, before, stored)
        yield self._frame(key, [*late, *out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.marks_state.exists():
            return
        session, marks, stored = self._load()
        before, watermark = session.utterances, int(timerValues.getCurrentWatermarkInMs())
        if marks["wakes"] is not None and int(expiredTimerInfo.getExpiryTimeInMs()) >= marks["wakes"]:
            marks["wakes"] = None
        session, out = self._released(session, marks, watermark)
        empty = not self.waiting.exists()
        if empty and session.finished and self.ended_ms and watermark >= marks["closes"]:
            self._drop_timer(marks)
            self._forget()
        elif empty and not session.finished and self.timeout_ms and watermark >= marks["newest"] + self.timeout_ms:
            out += session.timed_out()
            self._drop_timer(marks)
            self._forget()
        else:
            self._save(session, marks, before, stored)
        yield self._frame(key, out)

    def _drop_timer(self, marks: dict) -> None:
        if marks["wakes"] is not None:
            self.handle.deleteTimer(marks["wakes"])

    def close(self) -> None:
        pass


def ordered_events(
    chunks: DataFrame, load: Callable[[], dict], options: StreamOptions = StreamOptions(), delay: str = "10 seconds", numbered: bool = False, timeout_ms: int = 0, ended_ms: int = 3_600_000, epoch: str = "1970-01-01"
) -> DataFrame:
    """Event rows of a stream of chunks that may come up to ``delay`` out of order; the rows of ``replay`` over the same chunks.

    A chunk's time is its start after ``epoch``, and the watermark that of the newest chunk of all streams less ``delay``.  A chunk
    waits until the watermark has passed it; with ``numbered``, where ids count up from 0 in each stream, only while one before it is missing.
    What comes behind the watermark is a row of the type ``late``, without a result_id: the reject output.

    A stream that sends nothing until the watermark is ``timeout_ms`` past its newest chunk is closed (0: never).  Of an ended
    one a mark stays for ``ended_ms`` after its last chunk (0: for ever): what it still sends till then is an error row, later a new stream.  Needs
    ``spark.sql.streaming.stateStore.providerClass`` to be ``STORE``.
    """
    timed = with_event_time(chunks, epoch).withWatermark("event_time", delay)
    # the time goes on as a number: rows behind the watermark must reach the processor, which tells them
    rows = timed.select("stream_id", "chunk_id", "start_ms", F.unix_millis("event_time").alias("event_ms"), "pcm", "is_final")
    processor = OrderedSessions(once(load), options, numbered, timeout_ms, ended_ms)
    return rows.groupBy("stream_id").transformWithStateInPandas(processor, EVENTS, "Append", "EventTime")


def stored_arrivals(chunks: DataFrame, delay_ms: int, batch: str = "batch", time: str = "start_ms") -> DataFrame:
    """Adds late and place to stored chunks (stream_id, chunk_id, start_ms, ``batch``): what ``ordered_events`` makes of these batches.

    The watermark of a batch is the newest time in all batches before it, of all streams, less ``delay_ms``.  ``late``: the chunk is
    behind it.  ``place``: the chunk's place, from 0, in the order in which its stream's session gets those that aren't late.
    """
    newest = chunks.groupBy(batch).agg(F.max(time).alias("newest"))  # a row per batch
    before = F.max("newest").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    watermarks = newest.select(batch, (F.coalesce(before - delay_ms, F.lit(0)).alias("watermark")))
    late = F.coalesce(F.col(time) < F.greatest("watermark", F.lit(0)), F.lit(False))
    rows = chunks.join(watermarks, batch).withColumn("late", late).drop("watermark")
    order = Window.partitionBy("stream_id", "late").orderBy(time, "chunk_id")
    return rows.withColumn("place", F.when(~F.col("late"), F.row_number().over(order) - 1).cast("long"))
