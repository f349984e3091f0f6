"""Replay of many streams side by side, so that a model gets the windows of many of them in one call.

Streams are dealt to cohorts, and a cohort's chunks pass by in the order of their times.  In a round each stream of the cohort
takes one chunk and runs until it needs the model; the windows that are due are put together by length, and each such batch is one
call.  A task holds the sessions of one cohort.  Rows are those of ``replay``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.operators.workers import once
from speechlake.options import StreamOptions
from speechlake.streaming.jobs import EVENTS, event_frame
from speechlake.streaming.session import Calls, Session

#: Streams in a cohort, about, and windows in a call at most.
COHORT, CALL = 64, 32
#: Gets windows of about one length, their prefixes and states, and returns a (text, state) for each.
BatchModel = Callable[[list[np.ndarray], list[str], list[Any]], list[tuple[str, Any]]]


def by_length(windows: list[np.ndarray], most: int = CALL, spread: float = 1.25) -> list[list[int]]:
    """Indexes in groups of ``most`` at most, in each of which no window is more than ``spread`` times as long as another."""
    out: list[list[int]] = []
    for i in sorted(range(len(windows)), key=lambda i: len(windows[i])):
        if out and len(out[-1]) < most and len(windows[i]) <= spread * len(windows[out[-1][0]]):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def called(model: BatchModel, calls: list[tuple], most: int) -> list[tuple[str, Any] | Exception]:
    """The result of each call, or why it failed; windows of a batch that fails are tried one by one."""
    results: list[Any] = [None] * len(calls)
    for group in by_length([c[0] for c in calls], most):
        try:
            got = model(*(list(x) for x in zip(*(calls[i] for i in group), strict=True)))
            if len(got) != len(group):
                raise ValueError(f"{len(got)} results for {len(group)} windows")
            for i, r in zip(group, got, strict=True):
                results[i] = r
        except Exception as whole:
            for i in group:
                try:
                    results[i] = whole if len(group) == 1 else model(*([x] for x in calls[i]))[0]
                except Exception as e:
                    results[i] = e
    return results


def finished(model: BatchModel, steps: list[Calls], most: int = CALL) -> list[list[dict]]:
    """Runs the steps of several sessions to their ends, together; the events of each."""
    events: list[Any] = [None] * len(steps)
    waiting: list[tuple[int, tuple]] = []

    def on(i: int, go: Callable[[], tuple]) -> None:
        try:
            waiting.append((i, go()))
        except StopIteration as end:
            events[i] = end.value

    for i, s in enumerate(steps):
        on(i, lambda s=s: next(s))
    while waiting:
        now, waiting[:] = list(waiting), []
        for (i, _), r in zip(now, called(model, [c for _, c in now], most), strict=True):
            on(i, lambda s=steps[i], r=r: s.throw(r) if isinstance(r, Exception) else s.send(r))
    return events


def replay_together(chunks: DataFrame, load: Callable[[], dict], options: StreamOptions = StreamOptions(), cohort: int = COHORT, call: int = CALL) -> DataFrame:
    """The rows of ``replay``; ``load`` makes scorer, batch_model (a BatchModel) and tokenizer.

    A model that fails on a batch is called for its windows one by one; a stream whose own window fails has one error row.
    """
    load = once(load)
    cohorts = -(-chunks.select("stream_id").distinct().count() // cohort) or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = dict(load())
        model = given.pop("batch_model")
        sessions: dict[str | None, Session] = {}
        now, due = None, {}

        def told() -> list[dict]:
            steps = [sessions[k].advance(int(c.chunk_id), int(c.start_ms), np.zeros(0, np.float32) if c.pcm is None else np.asarray(c.pcm, np.float32), bool(c.is_final)) for k, c in due.items()]
            keys = list(due)
            due.clear()
            return [e | {"stream_id": k} for k, own in zip(keys, finished(model, steps, call), strict=True) for e in own]

        for pdf in batches:
            out: list[dict] = []
            for c in pdf.itertuples():
                key = c.stream_id if isinstance(c.stream_id, str) else None
                if c.cohort != now:
                    out += told()
                    sessions.clear()
                    now = c.cohort
                if key in due:  # a round has one chunk of a stream
                    out += told()
                if key not in sessions:
                    sessions[key] = Session(options=options, **given)
                due[key] = c
            yield event_frame(out)
        yield event_frame(told())

    rows = chunks.select("stream_id", "chunk_id", "start_ms", "pcm", "is_final", F.pmod(F.xxhash64("stream_id"), F.lit(cohorts)).alias("cohort"))
    return rows.repartition("cohort").sortWithinPartitions("cohort", "start_ms", "stream_id", "chunk_id").mapInPandas(run, EVENTS)
