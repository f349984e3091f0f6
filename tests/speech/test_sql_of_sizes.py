"""Queries against their SQL on tables whose sizes or values the driver's smallest tables don't have."""

import duckdb
import numpy as np
import pandas as pd

from speechlake.model_queries import ORACLE_SQL, QUERIES
from speechlake.operators.feature_slices import sliced_features
from speechlake.operators.features import fbank, fbank_short, features
from tests.speech.test_queries import rows


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = rows(QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(ORACLE_SQL[name]).df())
    assert want[1] and [list(map(str, r)) for r in got[1]] == [list(map(str, r)) for r in want[1]] and got[0] == want[0]


def vectors(n, seed=1):
    x = (np.random.default_rng(seed).standard_normal((n, 64)) * 0.125).astype(np.float32)
    return pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": np.zeros(n, np.int32)})


def test_a_last_recording_shorter_than_a_frame(spark, tmp_path):
    """256 samples lack less than a hop of one frame, 192 more."""
    same_as_sql(spark, tmp_path, "detector_features", embeddings=vectors(36))
    same_as_sql(spark, tmp_path, "detector_features", embeddings=vectors(35))
    x = vectors(5).embedding.explode().to_numpy(np.float32)
    assert len(fbank_short(x)) == len(fbank_short(x[:241])) == 1 and len(fbank_short(x[:240])) == len(fbank(x)) == 0


def test_features_in_doubles(spark):
    x = vectors(16).embedding.explode().to_numpy(np.float64)
    df = spark.createDataFrame([("a", x.tolist())], "audio_id string, samples array<double>")
    for kind, near in (("double", 1e-12), ("float", 1e-5)):
        rows = features(df, "fbank", kind=kind).orderBy("frame_idx")
        assert rows.schema["feat"].dataType.simpleString() == f"array<{kind}>"
        assert np.abs(np.array([r.feat for r in rows.collect()]) - fbank(x, np.float64)).max() < near


def test_slices_of_a_last_recording_shorter_than_a_frame(spark, tmp_path):
    same_as_sql(spark, tmp_path, "detector_features_by_slices", embeddings=vectors(36))
    x = vectors(64).embedding.explode().to_numpy(np.float64)
    for front_end in ("log_mel", "mel_spectrogram", "stacked_fbank"):
        of = lambda rows: np.array([r.feat for r in rows.orderBy("frame_idx").collect()])
        cut = spark.createDataFrame([("a", i, x[i : i + 700].tolist()) for i in range(0, len(x), 700)], "audio_id string, offset long, samples array<double>")
        whole = spark.createDataFrame([("a", x.tolist())], "audio_id string, samples array<double>")
        got, want = (of(f) for f in (sliced_features(cut, front_end, slice_samples=2200, kind="double"), features(whole, front_end, kind="double")))
        assert got.shape == want.shape and np.abs(got - want).max() < 1e-10


def test_a_mean_that_floats_round_to_another_digit(spark, tmp_path):
    df = vectors(1)
    x = np.zeros(64, np.float32)
    x[:2] = 1.0014, 0.0001  # the mean as a double is under 0.50075, its nearest float over it
    df.embedding = [x]
    same_as_sql(spark, tmp_path, "downmixed", embeddings=df)
    same_as_sql(spark, tmp_path, "downmixed", embeddings=vectors(2000))


def test_order_where_partitions_are_put_together_anew(spark, tmp_path):
    """Rows with all columns and rows with their places only are of other sizes, so adaptive execution cuts them elsewhere."""
    r = np.random.default_rng(4)
    n = 20_000
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(r.integers(0, 30 * 86_400_000, n)), "ms")
    kinds = r.choice(["click", "view", "error", "signup", "purchase"], n)
    events = pd.DataFrame({"event_id": np.arange(n), "ts": at.astype("datetime64[us]"), "user_id": r.integers(0, 300, n), "event_type": kinds, "value": r.random(n) * 500, "props": "{}"})
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        same_as_sql(spark, tmp_path, "ordered_output", events=events)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
