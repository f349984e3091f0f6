import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.functions import arrays, audio, timebase
from speechlake.operators.clips import chunk_audio, chunks_in_segments
from speechlake.operators.features import fbank, features, log_mel, mel_filters, mel_spectrogram, reflect, stack_frames, stacked
from speechlake.operators.inference import quiet_cuts, split_long_audio, transcribe_segments
from speechlake.sources.audio_files import UnsupportedAudio, decode_wav, encode_wav, read_wav, resample, resampled
from speechlake.sources.tables import read_cmvn, write_segments


def tone(hz, rate, seconds, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def test_wav_forms(tmp_path, spark):
    x = tone(440, 8000, 0.1)
    two = np.stack((x, -x), 1).reshape(-1)
    for bits, channels, samples in ((16, 1, x), (32, 1, x), (16, 2, two), (32, 2, two)):
        data = encode_wav(samples, 8000, channels, bits)
        odd = data[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + data[12:]
        for d in (data, odd):
            rate, n, b, got = decode_wav(d)
            assert (rate, n, b) == (8000, channels, bits) and np.abs(got - samples).max() < 2e-5
    for bad in (b"", b"RIFF1234WAVX", data[:20], encode_wav(x, 8000)[:34] + struct.pack("<H", 24) + encode_wav(x, 8000)[36:]):
        with pytest.raises((UnsupportedAudio, struct.error)):
            decode_wav(bad)
    (tmp_path / "a.wav").write_bytes(encode_wav(two, 8000, 2))
    (tmp_path / "b.wav").write_bytes(b"broken")
    rows = {r.path[-5:]: r for r in read_wav(spark, str(tmp_path), "row").collect()}
    assert len(rows["a.wav"].samples) == 1600 and rows["b.wav"].samples is None and "RIFF" in rows["b.wav"].error
    mono = read_wav(spark, str(tmp_path), "row").where("error is null").select(audio.downmix(F.col("samples"), F.col("channels")).alias("m")).first()
    assert len(mono.m) == 800 and max(map(abs, mono.m)) < 1e-4


def test_resampling_keeps_tones(spark):
    for rate in (8000, 44_100, 22_050, 48_000):
        x = tone(1000, rate, 1.0)
        y = resampled(x, rate, 16_000)
        assert len(y) == 16_000 and np.argmax(np.abs(np.fft.rfft(y))) == 1000
        assert np.abs(y[2000:-2000] - tone(1000, 16_000, 1.0)[2000:-2000]).max() < 0.02
    high = resampled(tone(10_000, 44_100, 1.0), 44_100, 16_000)
    assert np.abs(high[500:-500]).max() < 0.02
    df = spark.createDataFrame([(1, 8000, tone(100, 8000, 0.1).tolist()), (2, 16_000, [0.5]), (3, None, None)], "id int, sample_rate int, samples array<float>")
    assert {r.id: r.samples and len(r.samples) for r in resample(df).collect()} == {1: 1600, 2: 1, 3: None}


def test_rounding_modes(spark):
    df = spark.createDataFrame([(8,), (24,), (40,), (0,), (15,)], "n long")
    got = df.select(*[timebase.samples_to_ms(F.col("n"), 16_000, m) for m in timebase.MODES]).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (2, 2, 1), (2, 3, 2), (0, 0, 0), (1, 1, 0)]
    with pytest.raises(ValueError):
        timebase.rounded(F.col("n"), "up")


def test_token_counts(spark):
    got = spark.range(0, 3000).select("id", audio.audio_tokens(F.col("id")).alias("t")).collect()

    def steps(m):
        leave = m % 100
        a = (leave - 1) // 2 + 1
        return ((a - 1) // 2 + 1 - 1) // 2 + 1 + m // 100 * 13

    assert all(r.t == steps(r.id) for r in got)


def test_shape_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="shapes differ"):
        df.select(arrays.add(F.col("a"), F.col("b"))).collect()
    assert df.select(arrays.cut(F.col("a"), F.lit(-3), F.lit(9))).first()[0] == [1.0, 2.0]


def test_filters_and_log_mel():
    bank = mel_filters("slaney")
    assert bank.shape == (128, 201) and bank.min() >= 0 and abs(bank[60].sum() * 40 - 1) < 0.1
    assert mel_filters("kaldi", n_fft=512, n_mels=80, low=20.0).shape == (80, 256)
    assert reflect(np.array([1.0, 2, 3]), 2).tolist() == [3, 2, 1, 2, 3, 2, 1] and reflect(np.array([5.0]), 2).tolist() == [5] * 5
    x = tone(1000, 16_000, 0.5)
    m = log_mel(x)
    assert m.shape == (50, 128) and m.max() - m.min() <= 2.0 + 1e-6
    peak = int(np.argmax(m[20]))
    assert abs(peak - int(np.argmax(bank[:, 25]))) <= 1
    assert mel_spectrogram(tone(1000, 24_000, 0.5)).shape == (12_000 // 256, 128) or mel_spectrogram(tone(1000, 24_000, 0.5)).shape[1] == 128


def test_fbank_by_loop():
    x = (np.random.default_rng(1).standard_normal(16_00) * 0.1).astype(np.float32)
    bank, got = mel_filters("kaldi", n_fft=512, n_mels=80, low=20.0), fbank(x)
    assert got.shape == (1 + (1600 - 400) // 160, 80)
    for t in (0, 3):
        f = x[t * 160 : t * 160 + 400].astype(np.float64) * 32768
        f = f - f.mean()
        g = np.array([f[i] - 0.97 * f[max(0, i - 1)] for i in range(400)]) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(400) / 399))
        power = np.abs(np.fft.fft(np.concatenate((g, np.zeros(112)))))[:256] ** 2
        assert np.allclose(got[t], np.log(np.maximum(bank @ power, np.finfo(np.float32).eps)), atol=1e-3)
    assert len(fbank(x[:399])) == 0 and len(fbank(x[:400])) == 1


def test_feature_rows_and_stacking(spark):
    x = tone(300, 16_000, 0.2)
    df = spark.createDataFrame([("a", x.tolist()), ("b", []), ("c", None), ("d", x[:100].tolist())], "audio_id string, samples array<float>")
    rows = features(df, "fbank")
    stacked_rows = {r.frame_idx: r.stacked for r in stack_frames(rows).collect()}
    want = stacked(fbank(x))
    assert len(stacked_rows) == len(want) and all(np.allclose(stacked_rows[i], want[i], atol=1e-5) for i in stacked_rows)
    assert features(df, "log_mel").groupBy("audio_id").count().collect()[0]["count"] >= 1


def test_quiet_cuts(spark):
    r = np.random.default_rng(2)
    x = (r.standard_normal(5000) * 0.5).astype(np.float32)
    x[1950:1990] = 0.001
    x[1960] = 0.0
    cuts = quiet_cuts(x, 100, longest_s=20, around_s=5, quiet_s=0.2)
    assert cuts[0] == 0 and cuts[1] == 1960 and cuts[-1] == 5000 and max(np.diff(cuts)) <= 2500
    df = spark.createDataFrame([("a", 100, x.tolist()), ("s", 100, [0.5] * 7), ("e", 100, []), ("n", 100, None)], "audio_id string, sample_rate int, samples array<float>")
    rows = split_long_audio(df, 20, 0.5).collect()
    assert np.allclose(np.concatenate([x_.samples for x_ in sorted((q for q in rows if q.audio_id == "a"), key=lambda q: q.piece)])[:5000], x)
    assert {(q.audio_id, len(q.samples)) for q in rows if q.audio_id != "a"} == {("s", 50), ("e", 50), ("n", 50)}


def test_chunks(spark):
    df = spark.createDataFrame([("a", 16_000, [0.1] * 8500), ("b", 16_000, [0.1]), ("e", 16_000, [])], "audio_id string, sample_rate int, samples array<float>")
    got = sorted((r.audio_id, r.chunk_id, r.start_ms, r.end_ms, len(r.samples)) for r in chunk_audio(df, 250).collect())
    assert got == [("a", 0, 0, 250, 4000), ("a", 1, 250, 500, 4000), ("a", 2, 500, 531, 500), ("b", 0, 0, 0, 1)]


def test_interval_join_is_the_plain_one(spark):
    r = random.Random(4)
    chunks = [(r.choice("ab"), i, s := r.randint(0, 3000), s + r.randint(0, 300)) for i in range(80)]
    segs = [(r.choice("ab"), i, s := r.randint(0, 3000), s + r.randint(0, 900)) for i in range(30)]
    got = chunks_in_segments(spark.createDataFrame(chunks, "audio_id string, chunk_id long, start_ms long, end_ms long"), spark.createDataFrame(segs, "audio_id string, seq long, start_ms long, end_ms long"), 250).select("audio_id", "seq", "chunk_id").collect()
    want = sorted((k, i, j) for k, i, s, e in segs for c, j, a, b in chunks if k == c and e > s and b > a and a < e and s < b)
    assert sorted(map(tuple, got)) == want


def test_cmvn_and_segments_files(spark, tmp_path):
    (tmp_path / "am.mvn").write_text("<Nnet>\n<Splice> 3 3\n[ 0 ]\n<AddShift> 3 3\n<LearnRateCoef> 0 [ -1.5 2 3e-1 ]\n<Rescale> 3 3\n<LearnRateCoef> 0 [ 0.5 1 2 ]\n</Nnet>\n")
    row = read_cmvn(spark, str(tmp_path / "am.mvn")).first()
    assert row["shift"] == [-1.5, 2.0, 0.3] and row["scale"] == [0.5, 1.0, 2.0]
    write_segments(spark.createDataFrame([("x", 1), ("y", 2)], "day string, n int"), f"{tmp_path}/out", ["day"])
    assert spark.read.parquet(f"{tmp_path}/out").where("day = 'y'").count() == 1


def test_models_and_error_rows(spark):
    import pandas as pd

    def make():
        def run(pdf):
            if (pdf["n"] == 3).any():
                raise RuntimeError("bad clip")
            return pd.DataFrame({"raw_text": [f"t{n}" for n in pdf["n"]], "elapsed_ms": [1.5] * len(pdf)})

        return run

    df = spark.createDataFrame([(1,), (3,), (4,)], "n int")
    got = {r.n: (r.raw_text, r.elapsed_ms, r.error) for r in transcribe_segments(df, make, "row").collect()}
    assert got == {1: ("t1", 1.5, None), 3: (None, None, "asr: bad clip"), 4: ("t4", 1.5, None)}
    with pytest.raises(Exception, match="bad clip"):
        transcribe_segments(df, make).collect()
    audio = spark.createDataFrame([(1, 8000, [0.5] * 900), (2, 0, [0.5] * 900), (3, -5, [float("nan")] * 900), (4, 16_000, [0.5] * 900)], "audio_id int, sample_rate int, samples array<float>")
    rates = {r.audio_id: (r.samples and len(r.samples), r.error) for r in resample(audio, on_error="row").collect()}
    assert rates == {1: (1800, None), 2: (None, "resample: sample rate 0"), 3: (None, "resample: sample rate -5"), 4: (900, None)}
    pieces = {(r.audio_id, r.piece): r.error for r in split_long_audio(audio, 0.1, 0.01, 0.01, on_error="row").collect()}
    assert pieces[2, None] == "split: sample rate 0" and pieces[1, 1] is None and pieces[4, 0] is None
    feats = features(audio, "fbank", on_error="row").where("error is not null").collect()
    assert [(r.audio_id, r.frame_idx) for r in feats] == [(3, None)] and feats[0].error.startswith("features: ")
    for bad in (lambda: resample(audio), lambda: split_long_audio(audio)):
        with pytest.raises(Exception, match="sample rate"):
            bad().collect()
    assert math.isclose(transcribe_segments(df.where("n <> 3"), make).agg(F.sum("elapsed_ms")).first()[0], 3.0)
