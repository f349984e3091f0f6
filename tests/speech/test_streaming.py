import datetime
import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.jobs import offline
from speechlake.operators.features import fbank, features, stacked
from speechlake.operators.vad_machine import frame_state, score_frames, vad_segments
from speechlake.options import MachineOptions, SegmentOptions, StreamOptions
from speechlake.streaming.jobs import CHUNKS, late_rows, read_chunk_stream, replay, routed_chunks, stream_events, windowed, with_event_time
from speechlake.streaming.session import Carry, Session

RATE = 16_000


def recording(seed=1, parts=((0.6, 0), (1.2, 1), (1.5, 0), (0.9, 1), (0.7, 0))):
    r = np.random.default_rng(seed)
    return np.concatenate([r.standard_normal(int(RATE * s)) * (0.2 if on else 0.001) for s, on in parts]).astype(np.float32)


def load():
    def scorer(feats, levels, state):
        return np.where(levels > -5, 0.0, 1.0), None

    def model(window, prefix, state):
        return "w" * (len(window) // 4000), None

    return {"scorer": scorer, "model": model}


def chunks_of(stream, x, size, final=True):
    out = [(stream, i, a * 1000 // RATE, min(a + size, len(x)) * 1000 // RATE, x[a : a + size].tolist(), final and a + size >= len(x), datetime.datetime(2024, 1, 1)) for i, a in enumerate(range(0, len(x), size))]
    return out


@pytest.mark.parametrize("size", [160, 399, 400, 1601, 4000, 100_000])
def test_features_carry_over(size):
    x = recording()[:20_000]
    carry, got, levels = Carry(), [], []
    for a in range(0, len(x), size):
        f, d = carry.feed(x[a : a + size], a + size >= len(x))
        got.append(f)
        levels.append(d)
    want = stacked(fbank(x))
    assert np.allclose(np.concatenate(got), want, atol=1e-3) and len(np.concatenate(levels)) == len(want)


def rows(events):
    return [(e["event_type"], e["utterance_id"], e["start_ms"], e["end_ms"], e["text"], e["confirmed_delta"]) for e in events]


def test_session_by_chunks():
    x = recording()
    s, out = Session(**load()), []
    for _, i, a, _, pcm, final, _ in chunks_of("s", x, 4000):
        s = Session.load(s.save(), **load())
        out += s.push(i, a, pcm, final)
    kinds = [e["event_type"] for e in out]
    assert kinds.count("speech_start") == 2 == kinds.count("final") == kinds.count("speech_end") and kinds[-1] == "pipeline_done"
    assert [e["result_id"] for e in out] == list(range(len(out)))
    starts = [e["start_ms"] for e in out if e["event_type"] == "speech_start"]
    assert abs(starts[0] - 600) < 450 and abs(starts[1] - 3300) < 450
    assert [e["utterance_id"] for e in out if e["event_type"] == "final"] == [0, 1]
    assert s.push(99, 0, [0.0])[0]["event_type"] == "error"
    for u in (0, 1):
        own = [e for e in out if e["utterance_id"] == u and e["event_type"] in ("partial", "final")]
        assert "".join(e["confirmed_delta"] for e in own) == own[-1]["text"] and set(own[-1]["text"]) == {"w"}
    silent = Session(**load())
    assert [e["event_type"] for e in silent.push(0, 0, np.zeros(8000), True)] == ["pipeline_done"]


def test_stream_is_replay(spark, tmp_path):
    data = [c for k in range(3) for c in chunks_of(f"s{k}", recording(k)[k * 3000 :], 4000)]
    data.append(("s0", 1000, 10**6, 10**6, [0.0], False, datetime.datetime(2024, 1, 1)))
    data.sort(key=lambda c: c[2])
    df = spark.createDataFrame(data, CHUNKS)
    want = sorted(map(str, replay(df, load).collect()))
    assert any("error" in w for w in want)
    for cut in (7, 20):
        folder = f"{tmp_path}/{cut}"
        for i in range(0, len(data), cut):
            spark.createDataFrame(data[i : i + cut], CHUNKS).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(1.1)  # files are taken in order of their times
        q = stream_events(read_chunk_stream(spark, folder, 1), load, ended_ms=0).writeStream.format("memory").queryName(f"q{cut}").option("checkpointLocation", f"{tmp_path}/c{cut}").trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(240)
        assert sorted(map(str, spark.table(f"q{cut}").collect())) == want


def test_silent_streams_time_out(spark, tmp_path):
    data = chunks_of("s", recording()[: RATE * 2], 4000, False)
    spark.createDataFrame(data, CHUNKS).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_events(read_chunk_stream(spark, f"{tmp_path}/in"), load, timeout_ms=500).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    try:
        until = time.time() + 120
        while time.time() < until and not spark.table("silent").where("event_type = 'pipeline_done'").count():
            time.sleep(1)
    finally:
        q.stop()
    kinds = [x.event_type for x in spark.table("silent").orderBy("result_id").collect()]
    assert kinds[-1] == "pipeline_done" and kinds.count("final") == 1


def test_options():
    x = recording(4)
    for o in (StreamOptions(pre_roll_ms=0), StreamOptions(window_seconds=0.5), StreamOptions(emit="pending"), StreamOptions(revision="keep_stable", restart="close_and_reopen", unfixed_tokens=0)):
        s = Session(options=o, **load())
        out = [e for _, i, a, _, pcm, final, _ in chunks_of("s", x, 1600) for e in s.push(i, a, pcm, final)]
        assert out[-1]["event_type"] == "pipeline_done" and sum(e["event_type"] == "final" for e in out) == 2


def test_windows_and_late_rows(spark):
    df = with_event_time(spark.createDataFrame([("a", i, 250 * i, 1, i == 5) for i in range(10)], "stream_id string, chunk_id long, start_ms long, n_samples long, is_final boolean"))
    assert sorted(r.n for r in windowed(df, "tumbling", "1 second").collect()) == [2, 4, 4]
    assert windowed(df, "sliding", "1 second", "500 milliseconds").count() == 6
    assert windowed(df, "session", "1 second").first().n == 10
    assert late_rows(df, "error").where("late").count() == 4
    for bad in (lambda: windowed(df, "odd", "1 second"), lambda: late_rows(df, "odd")):
        with pytest.raises(ValueError):
            bad()


def test_offline_jobs(spark):
    import pandas as pd

    def make():
        return lambda pdf: pd.DataFrame({"raw_text": [f"language {'en' if len(s) % 2 else 'de'}<asr_text>{len(s)} " for s in pdf["samples"]], "elapsed_ms": [1.0] * len(pdf)})

    x = recording(2)
    df = spark.createDataFrame([("a", RATE, x.tolist()), ("b", RATE, recording(3, ((0.5, 0), (0.8, 1), (1.2, 0))).tolist())], "audio_id string, sample_rate int, samples array<float>")
    regions = offline.energy_regions(df)
    assert {(r.audio_id, r.n) for r in regions.groupBy("audio_id").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 1)}
    segs, files = offline.transcribe(df, regions, make, 2)
    assert segs.count() == 3 and {r.audio_id: r.n_segments for r in files.collect()} == {"a": 2, "b": 1}
    silent = df.union(spark.createDataFrame([("c", RATE, [0.0] * 8000)], df.schema))
    facts = {r.audio_id: r for r in offline.transcribe(silent, regions, make, 2)[1].collect()}
    assert facts["c"].n_segments == 0 == facts["c"].n_detected and facts["c"].duration_ms == 500 and facts["c"].text == "" and facts["a"].n_segments == 2 and facts["a"].pad_start_ms == 200

    def scorer():
        return lambda feats, db, state: (np.where(feats[:, 160:240].mean(1) > 18, 0.0, 1.0), None)

    found = offline.machine_regions(df, scorer, SegmentOptions())
    assert found.where("audio_id = 'a'").count() == 2
    long = offline.transcribe_long(df, make, 2, 2.0).collect()
    assert {r.audio_id: r.n_pieces for r in long} == {"a": 3, "b": 2} or all(r.n_pieces >= 1 for r in long)
    assert MachineOptions().end_silence == 100


def remembering():
    """A scorer that hears 20 frames: those at hand and the 19 before them."""

    def score(feats, levels, state):
        level = np.concatenate((np.zeros(0) if state is None else state, feats[:, 160:240].mean(1, dtype=np.float64)))
        sums = np.concatenate(([0.0], np.cumsum(level)))
        ends = np.arange(len(level) - len(feats), len(level)) + 1
        starts = np.maximum(ends - 20, 0)
        return np.where((sums[ends] - sums[starts]) / (ends - starts) > 17.5, 0.0, 1.0), level[-19:]

    return score


def test_a_scorer_with_memory_whole_cut_and_streamed(spark):
    parts = ((0.6, 0), (1.2, 1), (1.5, 0), (0.9, 1), (1.6, 0))
    audio = spark.createDataFrame([(f"s{k}", recording(k, parts)[k * 3000 :].tolist()) for k in range(3)], "audio_id string, samples array<float>")
    feats = features(audio, "stacked_fbank")

    def segments(**options):
        found = vad_segments(score_frames(feats, remembering, **options), frame_state(F.col("silence"), F.lit(0.0)))
        return sorted((x.audio_id, x.start_ms, x.end_ms) for x in found.collect())

    whole = segments(sort=False)
    assert len(whole) == 6
    for rows_in_batch in ("37", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
        try:
            assert segments() == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (399, 1601, 4000, 100_000):
        streamed = []
        for k in range(3):
            s = Session(**load() | {"scorer": remembering()})
            for _, i, a, _, pcm, final, _ in chunks_of(f"s{k}", recording(k, parts)[k * 3000 :], size):
                s = Session.load(s.save(), **load() | {"scorer": remembering()})
                streamed += [(f"s{k}", e["start_ms"], e["end_ms"]) for e in s.push(i, a, pcm, final) if e["event_type"] == "speech_end"]
        assert sorted((k, b) for k, _, b in streamed) == sorted((k, b) for k, _, b in whole)
        if size < 100_000:
            assert sorted(streamed) == whole


def test_a_model_with_memory():
    given = load() | {"model": lambda window, prefix, calls: (f"{calls or 0};", (calls or 0) + 1)}
    s, x = Session(**given), recording()
    out = []
    for _, i, a, _, pcm, final, _ in chunks_of("s", x, 1600):
        s = Session.load(s.save(), **given)
        out += s.push(i, a, pcm, final)
    finals = [e["text"] for e in out if e["event_type"] == "final"]
    assert len(finals) == 2 and all(t.endswith(";") and int(t.split(";")[-2]) >= 2 for t in finals)  # an utterance's memory begins anew
    assert s.finished and s.save()[1:] == (None,) * 8


def test_error_rows_and_loads(spark, tmp_path):
    folder = str(tmp_path)

    def failing():
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        plain = load()["scorer"]

        def scorer(feats, levels, state):
            if np.isnan(levels).any():
                raise ValueError("no numbers")
            return plain(feats, levels, state)

        return load() | {"scorer": scorer}

    chunks = spark.createDataFrame([c for k in range(40) for c in chunks_of(f"s{k}", recording(k)[:40_000], 8000)], CHUNKS)
    want = sorted(str(x) for x in replay(chunks, load).collect() if x.stream_id != "s7")
    broken = chunks.withColumn("pcm", F.when(F.col("stream_id") == "s7", F.array_repeat(F.lit(float("nan")).cast("float"), 8000)).otherwise(F.col("pcm")))
    got = replay(broken, failing).collect()
    assert sorted(str(x) for x in got if x.stream_id != "s7") == want
    bad = [x for x in got if x.stream_id == "s7"]
    assert [x.event_type for x in bad] == ["error"] and "no numbers" in bad[0].error and bad[0].error.startswith("vad")
    assert len(os.listdir(folder)) <= 8  # a worker makes its scorer once, not for each of 40 streams


def test_late_chunks_of_a_stream(spark, tmp_path):
    schema = "stream_id string, chunk_id long, start_ms long, n_samples long, is_final boolean"
    batches = [[("a", 0, 0, 1, False), ("a", 1, 250, 1, False), ("b", 0, 0, 1, False)], [("a", 2, 90_000, 1, False), ("a", 3, 500, 1, False)], [("a", 4, 90_250, 1, True)], [("a", 5, 90_500, 1, False), ("b", 1, 250, 1, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = routed_chunks(stream, 60_000, 0).writeStream.format("memory").queryName("routed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(240)
    assert {(x.stream_id, x.chunk_id): x.late for x in spark.table("routed").collect()} == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("a", 3): "behind", ("a", 4): None, ("a", 5): "ended", ("b", 0): None, ("b", 1): None}
