"""The frame machine over recordings in slices, so that one very long recording is the work of many tasks.

The machine is sequential, but it forgets: once it has waited for as long as it votes and looks back, its state follows from the last
frames alone.  So every slice is first run as if the machine came to it waiting, on a task of its own.  Then each slice's entry is
compared with the exit of the one before; slices that were run from another state are run again from the true one, until none is.
Only the exits are looked at together, one short row per slice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.operators.kept import kept
from speechlake.operators.vad_machine import SPEAKING, Machine, vad_segments
from speechlake.options import MachineOptions

#: Frames of a slice: about eleven minutes of audio, and 8 KB as bits.
SLICE_FRAMES = 1 << 16
#: Rounds after which a recording whose slices still change goes the sequential way.
ROUNDS = 8

RUN = "id string, slice long, entry string, exit string, starts array<long>, ends array<long>"


def saved(m: Machine, o: MachineOptions) -> str:
    """What of a machine's state later frames can depend on; equal texts go on equally."""
    waiting = m.phase != SPEAKING
    state = asdict(m) | {"votes": m.votes[-(o.vote_frames - 1) :] if o.vote_frames > 1 else [], "ends": 0, "told_start": False}
    state |= {"silent": 0, "start": -1, "segments": []} if waiting else {"segments": [[m.start * o.frame_ms, m.start * o.frame_ms, False]]}
    return json.dumps(state, sort_keys=True)


def waiting_at(frame: int, before: np.ndarray, o: MachineOptions) -> str:
    """The state before ``frame`` of a machine that has waited for long; ``before``: the last frames' states."""
    votes = [int(x) for x in before[len(before) - (o.vote_frames - 1) :]] if o.vote_frames > 1 else []
    return saved(Machine(frame=frame, votes=votes, floor=max(0, frame - 1 - o.vote_frames - o.look_back)), o)


def run_slice(entry: str, speech: np.ndarray, last: bool, o: MachineOptions) -> tuple[str, list[int], list[int]]:
    """(exit, starts, ends) of the segments that close in a slice."""
    m, n = Machine(**json.loads(entry)), len(speech)
    for i, s in enumerate(speech.tolist()):
        m.feed(s, last and i == n - 1, o)
    closed = [(a, b) for a, b, c in m.segments if c and b >= a]
    return saved(m, o), [a for a, _ in closed], [b for _, b in closed]


SLICES = "id string, slice long, n long, bits binary, before binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lambda x: x.values.to_numpy(zero_copy_only=False).astype(np.uint8) if len(x) else np.zeros(0, np.uint8)
    for batch in batches:
        states, before = ([of(x) for x in batch.column(c)] for c in ("states", "before"))
        values = [batch.column("id"), batch.column("slice"), pa.array([len(x) for x in states], pa.int64()), pa.array([np.packbits(x).tobytes() for x in states], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in SLICES.split(", ")])


def frame_slices(frames: DataFrame, speech: Column, key: str, order: str, size: int, halo: int) -> DataFrame:
    """(id, slice, n, bits, before): the states of ``size`` frames as bits, and the ``halo`` states before them as bytes."""
    rows = frames.select(F.to_json(F.struct(F.col(key).alias("k"))).alias("id"), F.floor(F.col(order) / size).alias("slice"), F.col(order).alias("o"), F.coalesce(speech, F.lit(False)).alias("s"))
    own = rows.select("id", "slice", F.struct("o", "s").alias("x"), F.lit(True).alias("own"))
    beside = rows.where(F.pmod("o", F.lit(size)) >= size - halo).select("id", F.col("slice") + 1, F.struct("o", "s"), F.lit(False))
    states = lambda mine: F.transform(F.array_sort(F.collect_list(F.when(F.col("own") == mine, F.col("x")))), lambda x: x["s"])
    grouped = own.union(beside).groupBy("id", "slice").agg(states(True).alias("states"), states(False).alias("before"))
    return grouped.where(F.size("states") > 0).mapInArrow(_packed, SLICES)


def _run(o: MachineOptions, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                speech = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"])
                entry = r["entry"]
                if entry is None:
                    entry = waiting_at(r["slice"] * size, np.frombuffer(r["before"], np.uint8), o) if r["slice"] else saved(Machine(), o)
                out.append((r["id"], r["slice"], entry, *run_slice(entry, speech, r["slice"] == r["last"], o)))
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [c.split()[0] for c in RUN.split(", ")])

    return rows


def sliced_segments(
    frames: DataFrame, speech: Column, o: MachineOptions = MachineOptions(), key: str = "audio_id", order: str = "frame_idx", slice_frames: int = SLICE_FRAMES, rounds: int = ROUNDS
) -> DataFrame:
    """The rows of ``vad_segments``, with ``slice_frames`` frames a task; ``order`` numbers a recording's frames from 0 without gaps.

    A slice is run again only where the machine doesn't come to it waiting, as in the middle of speech.  A recording that still
    changes after ``rounds``, such as hours of speech without a pause, goes through ``vad_segments``.
    """
    halo = max(o.vote_frames - 1, 1)
    if slice_frames <= o.vote_frames + o.look_back:
        raise ValueError("a slice must be longer than the machine votes and looks back")
    slices = kept(frame_slices(frames, speech, key, order, slice_frames, halo).repartition("id", "slice"))
    last = slices.groupBy("id").agg(F.max("slice").alias("last"))
    slices = slices.join(last, "id")
    now = kept(slices.withColumn("entry", F.lit(None).cast("string")).mapInArrow(_run(o, slice_frames), RUN))
    stale = None
    for n in range(rounds + 1):
        came = F.lag("exit").over(Window.partitionBy("id").orderBy("slice"))
        stale = kept(now.select("id", "slice", "entry", came.alias("came")).where("came is not null and came <> entry").select("id", "slice", F.col("came").alias("entry")))
        if stale.isEmpty() or n == rounds:
            break
        again = slices.join(stale, ["id", "slice"]).mapInArrow(_run(o, slice_frames), RUN)
        now = kept(now.join(stale.select("id", "slice"), ["id", "slice"], "left_anti").union(again))
    slow = stale.select("id").distinct()
    found = now.join(slow, "id", "left_anti").select("id", "slice", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "x"))
    found = found.select("id", "x.starts", "x.ends", (F.row_number().over(Window.partitionBy("id").orderBy("slice", "i")) - 1).cast("long").alias("seq"))
    value = F.from_json("id", f"struct<k:{frames.schema[key].dataType.simpleString()}>")["k"].alias(key)
    out = found.select(value, "seq", F.col("starts").alias("start_ms"), F.col("ends").alias("end_ms"))
    if stale.isEmpty():
        return out
    rest = frames.withColumn("id", F.to_json(F.struct(F.col(key).alias("k")))).join(slow, "id", "left_semi").drop("id")
    return out.unionByName(vad_segments(rest, speech, o, key, order))
