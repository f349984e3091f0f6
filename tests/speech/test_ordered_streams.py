import datetime
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechlake.options import StreamOptions
from speechlake.streaming.jobs import CHUNKS, read_chunk_stream, replay
from speechlake.streaming.ordered import STORE, OrderedSessions, ordered_events, stored_arrivals
from speechlake.streaming.session import Session
from tests.speech.test_streaming import RATE, chunks_of, load, recording

SHORT = StreamOptions(window_seconds=1.3)


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, batches, folder, name, **options):
    """The rows of ``ordered_events`` over these batches, one after the other."""
    for b in batches:
        spark.createDataFrame(b, CHUNKS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        time.sleep(1.05)  # files are taken in order of their times
    q = ordered_events(read_chunk_stream(spark, f"{folder}/{name}", 1), load, **options).writeStream.format("memory").queryName(name)
    q = q.option("checkpointLocation", f"{folder}/c{name}").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(300)
    return spark.table(name).collect()


def arrivals(delay_ms, batch=12):
    data = [c for k in range(3) for c in chunks_of(f"s{k}", recording(k)[k * 3000 :], 4000)]
    r = random.Random(1)
    data.sort(key=lambda c: c[2] + r.random() * delay_ms)
    return [data[i : i + batch] for i in range(0, len(data), batch)]


#: A chunk of another stream, far ahead, so that the watermark passes all others.
AHEAD = [("zz", 0, 10**6, 10**6, [0.0], True, datetime.datetime(2024, 1, 1))]


def test_shuffled_arrival_gives_the_ordered_rows(spark, tmp_path, store):
    batches = arrivals(900)
    whole = spark.createDataFrame([c for b in batches for c in b], CHUNKS)
    for name, numbered, options in (("waits", False, SHORT), ("numbered", True, StreamOptions())):
        got = streamed(spark, batches if numbered else [*batches, AHEAD], str(tmp_path), name, delay="1 second", numbered=numbered, options=options)
        assert sorted(str(x) for x in got if x.stream_id != "zz") == sorted(map(str, replay(whole, load, options).collect()))


def test_late_chunks_are_rejected_as_in_stored_batches(spark, tmp_path, store):
    batches = [*arrivals(2500), AHEAD]
    got = streamed(spark, batches, str(tmp_path), "rejects", delay="1 second")
    rows = spark.createDataFrame([(*c, i) for i, b in enumerate(batches) for c in b], CHUNKS + ", batch int")
    told = stored_arrivals(rows, 1000)
    late = {(x.stream_id, x.chunk_id) for x in told.where("late").collect()}
    assert late and {(x.stream_id, x.trigger_chunk_id) for x in got if x.event_type == "late"} == late
    want = replay(told.where("not late"), load).collect()
    assert sorted(str(x) for x in got if x.event_type != "late" and x.stream_id != "zz") == sorted(str(x) for x in want if x.stream_id != "zz")
    places = told.where("place is not null").groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("place", "start_ms"))).alias("p")).collect()
    assert all([y.place for y in x.p] == list(range(len(x.p))) and [y.start_ms for y in x.p] == sorted(y.start_ms for y in x.p) for x in places)


def test_silent_streams_close_and_ended_ones_are_forgotten(spark, tmp_path, store):
    data = chunks_of("s", recording()[: RATE * 2], 4000, False)
    ended = chunks_of("e", recording()[: RATE * 2], 4000)
    after = [("e", 100, 5_000, 5_000, [0.0], False, datetime.datetime(2024, 1, 1))]
    again = [("e", 0, 90_000, 90_000, [0.0] * 100, True, datetime.datetime(2024, 1, 1))]
    far = lambda ms: [("zz", ms, ms, ms, [0.0], False, datetime.datetime(2024, 1, 1))]
    got = streamed(spark, [[*data, *ended], after, far(9_000), far(80_000), again, far(200_000)], str(tmp_path), "silent", delay="1 second", timeout_ms=20_000, ended_ms=30_000)
    kinds = {k: [x.event_type for x in sorted((x for x in got if x.stream_id == k), key=lambda x: (x.result_id, x.trigger_chunk_id))] for k in "se"}
    assert kinds["s"].count("pipeline_done") == 1 and kinds["s"].count("final") == 1
    assert kinds["e"].count("pipeline_done") == 2 and kinds["e"].count("error") == 1  # the second is a new stream of that name


class Kept:
    """A state of one kind in memory, which counts the bytes that are written to it."""

    def __init__(self):
        self.rows, self.written = {}, 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.updateValue((), value)

    def updateValue(self, key, value):
        self.rows[tuple(key)] = value
        self.written += sum(len(x) for x in value if isinstance(x, (bytes, str)))

    def getValue(self, key):
        return self.rows[tuple(key)]

    def containsKey(self, key):
        return tuple(key) in self.rows

    def removeKey(self, key):
        del self.rows[tuple(key)]

    def keys(self):
        return list(self.rows)

    def iterator(self):
        return list(self.rows.items())

    def clear(self):
        self.rows.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


def test_what_is_written_follows_the_new_audio():
    """In a long utterance a batch writes its own samples and a constant, not the window; the events stay the same."""
    x = recording(5, ((0.5, 0), (20.0, 1), (1.5, 0)))
    handle, processor = Handle(), OrderedSessions(load, StreamOptions(), True, 0, 0)
    processor.init(handle)
    out, written, before = [], [], 0
    chunks = chunks_of("s", x, 4000)
    for _, i, a, _, pcm, final, _ in chunks:
        pdf = pd.DataFrame({"event_ms": [a], "start_ms": [a], "chunk_id": [i], "pcm": [np.array(pcm, np.float32)], "is_final": [final]})
        out += [f for f in processor.handleInputRows(("s",), iter([pdf]), Times())]
        now = sum(k.written for n, k in handle.states.items() if n != "waiting")
        written.append(now - before)
        before = now
    whole, want = Session(**load()), []
    for _, i, a, _, pcm, final, _ in chunks:
        want += whole.push(i, a, pcm, final)
    got = pd.concat(out)
    assert got["event_type"].tolist() == [e["event_type"] for e in want] and got["text"].tolist() == [e["text"] for e in want]
    assert max(written) < 3 * 32_000 + 20_000 and len(handle.states["waiting"].rows) == 0  # the window alone has 640,000 bytes


def test_empty_arrivals(spark):
    assert stored_arrivals(spark.createDataFrame([], "stream_id string, chunk_id long, start_ms long, batch int"), 5).collect() == []
    rows = spark.createDataFrame([(None, 0, 0, 0, 1), (None, 1, None, 1, 1), ("a", 2, 9000, 0, 1), ("a", 3, 10, 1, 1)], "stream_id string, chunk_id long, start_ms long, batch int, newest int")
    assert {x.chunk_id: (x.late, x.place) for x in stored_arrivals(rows, 5).collect()}[3] == (True, None)
