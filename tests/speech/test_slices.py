import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.model_queries import SMALL
from speechlake.operators import vad_slices
from speechlake.operators.feature_slices import FRONT_ENDS, audio_slices, sliced_features
from speechlake.operators.features import features
from speechlake.operators.vad_machine import segments_of, vad_segments
from speechlake.operators.vad_slices import frame_slices, sliced_segments
from speechlake.operators.inference import split_long_audio, split_long_pieces
from speechlake.options import MachineOptions


def states(seed, n, kind):
    """Frame states in runs: pauses of all lengths, hours of speech, or noise."""
    r = np.random.default_rng(seed)
    if kind == "speech":
        return np.ones(n, bool)
    if kind == "noise":
        return r.random(n) < 0.7
    runs = r.integers(1, 60 if kind == "short" else 400, n)
    return np.repeat(np.arange(n) % 2 == 0, runs)[:n]


def frames_of(spark, recordings):
    rows = [(k, i, bool(s)) for k, x in recordings.items() for i, s in enumerate(x)]
    return spark.createDataFrame(rows, "audio_id string, frame_idx long, s boolean")


@pytest.mark.parametrize(("o", "size", "rounds"), [(SMALL, 7, 8), (SMALL, 64, 8), (MachineOptions(), 50, 30), (MachineOptions(), 700, 2)])
def test_slices_give_the_sequential_segments(spark, o, size, rounds):
    recordings = {f"{kind}{k}": states(k, 1500 + 37 * k, kind) for k in range(3) for kind in ("short", "long", "noise")} | {"speech": states(0, 1400, "speech"), None: states(9, 900, "short"), "one": np.ones(1, bool)}
    frames = frames_of(spark, recordings)
    got = sliced_segments(frames, F.col("s"), o, slice_frames=size, rounds=rounds)
    want = vad_segments(frames, F.col("s"), o)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got) == rows(want) and len(rows(want)) > 5


def test_a_long_recording_in_many_tasks(spark):
    """Slices of a recording of 400,000 frames stand on separate tasks and are rerun only beside speech."""
    n, size = 400_000, 6_250
    frames = spark.range(0, n, 1, 8).select(F.lit("a").alias("audio_id"), F.col("id").alias("frame_idx"), (F.pmod(F.floor(F.col("id") / 97) * 31 + 7, F.lit(11)) < 4).alias("s"))
    x = (np.arange(n) // 97 * 31 + 7) % 11 < 4
    got = sliced_segments(frames, F.col("s"), slice_frames=size).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == segments_of(x) and [r.seq for r in got] == list(range(len(got)))
    slices = frame_slices(frames, F.col("s"), "audio_id", "frame_idx", size, 19).repartition(16, "id", "slice")
    parts = slices.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.length("bits")).alias("bytes")).collect()
    assert sum(r.n for r in parts) == 64 and len(parts) > 8 and max(r.bytes for r in parts) <= size // 8 + 1


def test_edges(spark):
    none = spark.createDataFrame([], "audio_id string, frame_idx long, s boolean")
    assert sliced_segments(none, F.col("s")).collect() == []
    with pytest.raises(ValueError):
        sliced_segments(none, F.col("s"), slice_frames=40)
    nulls = spark.createDataFrame([(1, i, None if i % 3 else True, 5) for i in range(200)], "audio_id long, frame_idx long, s boolean, slice long")
    assert sliced_segments(nulls, F.col("s"), SMALL, slice_frames=20).collect() == vad_segments(nulls, F.col("s"), SMALL).collect()
    assert vad_slices.SLICE_FRAMES > 40


@pytest.mark.parametrize("size", [4096, 1101])
@pytest.mark.parametrize("front_end", list(FRONT_ENDS))
def test_features_of_cut_and_whole_recordings(spark, front_end, size):
    r = np.random.default_rng(3)
    lengths = [0, 1, 100, 399, 400, 401, 4096, 4097, 8192 + 39, 8192 + 161, 3 * 4096 + 300, 20_000, 5 * 4096]
    whole = {k: (r.standard_normal(n) * np.linspace(0.01, 0.5, n)).astype(np.float32) for k, n in enumerate(lengths)} | {None: r.standard_normal(9000).astype(np.float32)}
    pieces, slice_samples = [], size
    for k, x in whole.items():
        cuts = sorted({0, len(x), *r.integers(0, len(x) + 1, 6).tolist()})
        pieces += [(k, a, x[a:b].tolist(), 1) for a, b in zip(cuts, cuts[1:], strict=False)] or [(k, 0, None, 1)]
    r.shuffle(pieces)
    df = spark.createDataFrame(pieces, "audio_id long, offset long, samples array<float>, slice int")
    got = {(x.audio_id, x.frame_idx): x.feat for x in sliced_features(df, front_end, slice_samples=slice_samples).collect()}
    audio = spark.createDataFrame([(k, x.tolist()) for k, x in whole.items()], "audio_id long, samples array<float>")
    want = {(x.audio_id, x.frame_idx): x.feat for x in features(audio, front_end).collect()}
    assert got.keys() == want.keys() and len(want) > 300
    assert max(np.abs(np.array(got[k]) - np.array(want[k])).max() for k in want) < 1e-4
    end = FRONT_ENDS[front_end]
    rows = audio_slices(df, end.left, end.right, slice_samples).select(F.max(F.size("samples")).alias("n"), F.count("*").alias("rows")).first()
    assert rows.n <= slice_samples + end.left + end.right and rows.rows == sum(-(-n // slice_samples) for n in [*lengths, 9000])


def test_pieces_that_do_not_follow(spark):
    df = spark.createDataFrame([(1, 0, [0.0] * 3000), (1, 3500, [0.0] * 3000)], "audio_id long, offset long, samples array<float>")
    with pytest.raises(Exception, match="follow"):
        sliced_features(df, "fbank", slice_samples=2000).collect()
    assert sliced_features(df.where("audio_id = 2"), "log_mel", slice_samples=2000).collect() == []
    with pytest.raises(ValueError):
        sliced_features(df, "log_mel", slice_samples=400)


@pytest.mark.parametrize("longest", [1.0, 0.35])
def test_cuts_of_cut_and_whole_recordings(spark, longest):
    r = np.random.default_rng(7)
    whole = {k: (r.standard_normal(n) * np.abs(np.sin(np.arange(n) / 300))).astype(np.float32) for k, n in enumerate([0, 1, 300, 999, 1000, 1001, 1200, 5000, 20_000])}
    whole[9] = np.zeros(7000, np.float32)
    pieces = []
    for k, x in whole.items():
        cuts = sorted({0, len(x), *r.integers(0, len(x) + 1, 9).tolist()})
        pieces += [(k, 1000, a, x[a:b].tolist(), 1) for a, b in zip(cuts, cuts[1:], strict=False)] or [(k, 1000, 0, None, 1)]
    r.shuffle(pieces)
    df = spark.createDataFrame([(int(a), int(b), int(c), d, int(e)) for a, b, c, d, e in pieces], "audio_id long, sample_rate int, offset long, samples array<float>, piece int")
    audio = spark.createDataFrame([(k, 1000, x.tolist()) for k, x in whole.items()], "audio_id long, sample_rate int, samples array<float>")
    rows = lambda df: sorted((x.audio_id, x.piece, x.offset, x.samples) for x in df.collect())
    want = rows(split_long_audio(audio, longest, 0.5, 0.2))
    assert rows(split_long_pieces(df, longest, 0.5, 0.2)) == want and len(want) > 30
    with pytest.raises(Exception, match="follow"):
        split_long_pieces(df.where("offset > 0 and audio_id = 8"), longest).collect()
    assert split_long_pieces(df.limit(0)).collect() == []
