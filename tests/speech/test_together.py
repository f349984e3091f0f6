import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from speechlake.streaming.jobs import CHUNKS, replay
from speechlake.streaming.together import by_length, called, replay_together
from tests.speech.test_streaming import chunks_of, load, recording


def counting(folder):
    """The batch model of ``load``; each call leaves a file with the number of its windows."""

    def made():
        one = load()

        def batch_model(windows, prefixes, states):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(len(windows)))
            if any(np.isnan(w).any() for w in windows):
                raise ValueError("cannot hear")
            return [one["model"](*x) for x in zip(windows, prefixes, states, strict=True)]

        return {"scorer": one["scorer"], "batch_model": batch_model}

    return made


def test_rows_unchanged_and_calls_fall(spark, tmp_path):
    data = [c for k in range(12) for c in chunks_of(f"s{k}", recording(k)[k * 1000 :], 4000)] + [(None, *c[1:]) for c in chunks_of("", recording(50), 4000)]
    df = spark.createDataFrame(data, CHUNKS)
    want = sorted(map(str, replay(df, load).collect()))
    counts = {}
    for cohort in (1, 4, 64):
        folder = tmp_path / str(cohort)
        folder.mkdir()
        assert sorted(map(str, replay_together(df, counting(str(folder)), cohort=cohort).collect())) == want
        counts[cohort] = [int(f.read_text()) for f in folder.iterdir()]
    assert sum(counts[1]) == sum(counts[4]) == sum(counts[64])  # windows
    assert len(counts[64]) < len(counts[4]) < len(counts[1]) and len(counts[64]) < sum(counts[64]) / 4


def test_a_window_that_fails_ends_its_own_stream_only(spark, tmp_path):
    data = [c for k in range(5) for c in chunks_of(f"s{k}", recording(k), 4000)]
    df = spark.createDataFrame(data, CHUNKS)
    bad = df.withColumn("pcm", F.when((F.col("stream_id") == "s3") & (F.col("chunk_id") == 5), F.transform("pcm", lambda x, i: F.when(i == 7, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("pcm")))
    want = sorted(str(x) for x in replay(df, load).collect() if x.stream_id != "s3")

    def scored():
        one = counting(str(tmp_path))()
        scorer = one["scorer"]
        return one | {"scorer": lambda feats, levels, state: scorer(feats, np.where(np.isnan(levels), 0.0, levels), state)}

    got = replay_together(bad, scored).collect()
    assert sorted(str(x) for x in got if x.stream_id != "s3") == want
    own = sorted((x for x in got if x.stream_id == "s3"), key=lambda x: x.result_id)
    assert own[-1].event_type == "error" and own[-1].error.startswith("asr") and "cannot hear" in own[-1].error


def test_groups_by_length():
    windows = [np.zeros(n) for n in (100, 5, 90, 101, 6, 300, 110, 7)]
    groups = by_length(windows, 3)
    assert sorted(i for g in groups for i in g) == list(range(8)) and max(map(len, groups)) <= 3
    assert all(max(len(windows[i]) for i in g) <= 1.25 * min(len(windows[i]) for i in g) for g in groups)
    assert by_length([]) == [] and called(lambda *x: [], [], 3) == []
    got = called(lambda w, p, s: [("t", None)], [(np.zeros(5), "", None), (np.zeros(5), "", None)], 3)
    assert got == [("t", None), ("t", None)]  # a batch with too few results is called one by one


def test_no_streams(spark):
    assert replay_together(spark.createDataFrame([], CHUNKS), counting("/nowhere")).collect() == []
