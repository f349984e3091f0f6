"""Registered queries whose operators run Python in tasks: files, spectra, the frame machine, tokens, models and sessions.

As in ``queries``, the driver's tables stand in for audio.  Scorers and models are stand-ins whose results SQL can tell.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.functions import arrays
from speechlake.operators import partials, transcripts
from speechlake.operators.feature_slices import sliced_features
from speechlake.operators.features import features
from speechlake.operators.inference import split_long_audio, split_long_pieces, transcribe_segments
from speechlake.operators.kept import kept, shared_folder
from speechlake.operators.tokens import byte_characters, collected, decode, encode, order_special_tokens, piece_counts
from speechlake.operators.vad_machine import frame_state, score_frames, vad_segments
from speechlake.operators.vad_slices import sliced_segments
from speechlake.options import MachineOptions, StreamOptions
from speechlake.queries import EV, HOURS, ORACLE_SQL, PADDED, QUERIES, embeddings, event_rows, fixed, fixed_sql, frame_rows, merged_rows, query, segment_rows, table
from speechlake.sources.audio_files import resample, resample_pieces
from speechlake.sources.event_sink import read_events, write_batch
from speechlake.sources.tables import parse_cmvn, parse_merges, read_tokenizer_file, write_segments
from speechlake.sources.wav_ranges import read_wav_ranges, write_wav
from speechlake.streaming.jobs import late_rows, replay
from speechlake.streaming.together import replay_together

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT 'v' || vec_id AS path, 16000 AS sample_rate, 16 AS bits, 64 AS n, CAST(list_sum([CAST(round_even(CAST(x AS DOUBLE) * 32768, 0) AS BIGINT) for x in embedding]) AS BIGINT) AS total FROM embeddings")
def wav_files(spark, sf_dir):
    """Embeddings written as WAV files and read back."""
    from speechlake.sources.audio_files import decode_files, encode_wav

    content = F.udf(lambda x: encode_wav(np.asarray(x, np.float64), 16_000), "binary", useArrow=True)
    files = embeddings(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), content("samples").alias("content"))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 32768, 0).cast("long"))
    return decode_files(files).select("path", "sample_rate", "bits", F.size("samples").alias("n"), total.alias("total"))


def recordings(spark: SparkSession, sf_dir: str, vectors: int) -> DataFrame:
    """Recordings of ``vectors`` consecutive embeddings each: (audio_id, samples)."""
    rows = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / vectors).alias("audio_id"), "vec_id", "samples")
    parts = F.array_sort(F.collect_list(F.struct("vec_id", "samples")))
    return rows.groupBy("audio_id").agg(F.flatten(F.transform(parts, lambda x: x["samples"])).alias("samples"))


@query("""SELECT vec_id // 32 AS audio_id, 16000 AS sample_rate, 16 AS bits, sum(len(embedding)) AS n, CAST(sum(list_sum([CAST(round_even(CAST(x AS DOUBLE) * 32768, 0) AS BIGINT) for x in embedding])) AS BIGINT) AS total,
CAST(ceil(sum(len(embedding)) / 300.0) AS BIGINT) AS pieces FROM embeddings GROUP BY 1""")
def wav_files_by_ranges(spark, sf_dir):
    """Recordings written as WAV files to the shared folder and read back by ranges of bytes, in pieces of 300 samples."""
    folder = f"{shared_folder(spark)}/wav-{uuid.uuid4().hex}"
    write_wav(recordings(spark, sf_dir, 32).withColumn("sample_rate", F.lit(16_000)), folder)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 32768, 0).cast("long"))
    rows = read_wav_ranges(spark, folder, range_bytes=44 + 2400, piece_bytes=600)
    rows = rows.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("audio_id"), "sample_rate", "bits", F.size("samples").alias("n"), total.alias("total"), (F.col("offset") % 300 == 0).alias("whole"))
    return rows.groupBy("audio_id", "sample_rate", "bits").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count_if("whole").alias("pieces"))


def _feature_rows(spark, sf_dir, front_end):
    rows = features(recordings(spark, sf_dir, 32), front_end, kind="double")
    return rows.select("audio_id", "frame_idx", F.size("feat").alias("width"), fixed(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 1).alias("total"))


RECORDINGS_SQL = "rec AS (SELECT vec_id // 32 AS audio_id, flatten(list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id)) AS x, CAST(count(*) * 64 AS BIGINT) AS n FROM embeddings GROUP BY 1)"


def spectrum_sql(frames: str, sample: str, window: str, size: int, n_fft: int, bins: int, hop: int) -> str:
    """Up to ``pw``: (audio_id, f, k, p), the power of each bin of each frame, by the plain sum over a frame's samples."""
    return f"""{RECORDINGS_SQL},
fr AS (SELECT audio_id, x, n, unnest(range(0, {frames})) AS f FROM rec),
smp AS (SELECT audio_id, x, n, f, unnest(range(0, {size})) AS t, f * {hop} AS start FROM fr),
raw AS (SELECT audio_id, f, t, {sample} AS v FROM smp),
win AS (SELECT audio_id, f, t, ({window}) AS v FROM raw),
ks AS (SELECT unnest(range(0, {bins})) AS k),
tw AS (SELECT j, cos(2 * pi() * j / {n_fft}) AS c, sin(2 * pi() * j / {n_fft}) AS s FROM (SELECT unnest(range(0, {n_fft})) AS j)),
pw AS (SELECT audio_id, f, k, pow(sum(v * c), 2) + pow(sum(v * s), 2) AS p FROM win, ks JOIN tw ON j = k * t % {n_fft} GROUP BY ALL)"""


def reflected_sql(pad: int) -> str:
    i = f"(start + t - {pad})"
    return f"x[1 + CASE WHEN {i} < 0 THEN least(-{i}, n - 1) WHEN {i} >= n THEN greatest(2 * n - 2 - {i}, 0) ELSE {i} END]"


def slaney_sql(rate: int, n_fft: int) -> str:
    return f"""pt0 AS (SELECT j, j * (15 + ln({rate / 2 / 1000}) * 27 / ln(6.4)) / 129 AS z FROM (SELECT unnest(range(0, 130)) AS j)),
pt1 AS (SELECT j, CASE WHEN z < 15 THEN z * 200 / 3 ELSE 1000 * exp((z - 15) * ln(6.4) / 27) END AS f FROM pt0),
pt AS (SELECT j, f AS a, lead(f) OVER (ORDER BY j) AS b, lead(f, 2) OVER (ORDER BY j) AS c FROM pt1),
fl AS (SELECT j, k, greatest(0, least((k * {rate / n_fft} - a) / (b - a), (c - k * {rate / n_fft}) / (c - b))) * 2 / (c - a) AS w FROM pt, ks WHERE c IS NOT NULL)"""


HANN = "v * (0.5 - 0.5 * cos(2 * pi() * t / {}))".format
PRE = "(v - mean) - 0.97 * (coalesce(lag(v) OVER (PARTITION BY audio_id, f ORDER BY t), v) - mean)"
KALDI = "1127 * ln(1 + {} / 700.0)".format


@query(f"""WITH {spectrum_sql("1 + (n - 400) // 160", "x[1 + start + t] * 32768", f"({PRE}) * (0.54 - 0.46 * cos(2 * pi() * t / 399))", 400, 512, 256, 160).replace("AS v FROM raw)", "AS v FROM (SELECT *, avg(v) OVER (PARTITION BY audio_id, f) AS mean FROM raw))")},
pt AS (SELECT unnest(range(0, 80)) AS j, {KALDI(20)} AS low, ({KALDI(8000)} - {KALDI(20)}) / 81 AS wide),
fl AS (SELECT j, k, greatest(0, least(({KALDI("(k * 31.25)")} - low) / wide - j, j + 2 - ({KALDI("(k * 31.25)")} - low) / wide)) AS w FROM pt, ks),
e AS (SELECT audio_id, f, j, ln(greatest(sum(p * w), 1.1920928955078125e-07)) AS e FROM pw JOIN fl USING (k) GROUP BY 1, 2, 3),
fs AS (SELECT audio_id, f, sum(e) AS total FROM e GROUP BY 1, 2), fm AS (SELECT *, max(f) OVER (PARTITION BY audio_id) AS last FROM fs)
SELECT a.audio_id, a.f AS frame_idx, 400 AS width, {fixed_sql("sum(b.total)", 1)} AS total FROM fm a, (SELECT unnest(range(-2, 3)) AS d) JOIN fm b ON b.audio_id = a.audio_id AND b.f = greatest(0, least(a.last, a.f + d)) GROUP BY 1, 2""")
def detector_features(spark, sf_dir):
    """The detector's features; the SQL counts a frame where a recording lacks less than a hop of one."""
    return _feature_rows(spark, sf_dir, "stacked_fbank_short")


@query(f"""WITH {spectrum_sql("n // 160", reflected_sql(200), HANN(400), 400, 400, 201, 160)}, {slaney_sql(16_000, 400)},
e AS (SELECT audio_id, f, j, log10(greatest(sum(p * w), 1e-10)) AS e FROM pw JOIN fl USING (k) GROUP BY 1, 2, 3),
m AS (SELECT *, max(e) OVER (PARTITION BY audio_id) AS top FROM e)
SELECT audio_id, f AS frame_idx, 128 AS width, {fixed_sql("sum((greatest(e, top - 8) + 4) / 4)", 1)} AS total FROM m GROUP BY 1, 2""")
def log_mel_features(spark, sf_dir):
    return _feature_rows(spark, sf_dir, "log_mel")


@query(f"""WITH {spectrum_sql("n // 256", reflected_sql(384), HANN(1024), 1024, 1024, 513, 256)}, {slaney_sql(24_000, 1024)},
e AS (SELECT audio_id, f, j, ln(greatest(sum(sqrt(p + 1e-9) * w), 1e-5)) AS e FROM pw JOIN fl USING (k) GROUP BY 1, 2, 3)
SELECT audio_id, f AS frame_idx, 128 AS width, {fixed_sql("sum(e)", 1)} AS total FROM e GROUP BY 1, 2""")
def mel_spectrograms(spark, sf_dir):
    return _feature_rows(spark, sf_dir, "mel_spectrogram")


def _sliced_feature_rows(spark, sf_dir, front_end):
    """Features of the same recordings, which come in pieces of about 700 samples and are dealt to slices of 1,100."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 700)))
    rows = recordings(spark, sf_dir, 32).select("audio_id", "samples", pieces.alias("piece"))
    rows = rows.select("audio_id", (F.col("piece") * 700).alias("offset"), F.slice("samples", (F.col("piece") * 700 + 1).cast("int"), F.lit(700)).alias("samples"))
    rows = sliced_features(rows, front_end, slice_samples=1100, kind="double")
    return rows.select("audio_id", "frame_idx", F.size("feat").alias("width"), fixed(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 1).alias("total"))


@query(ORACLE_SQL["log_mel_features"])
def log_mel_features_by_slices(spark, sf_dir):
    return _sliced_feature_rows(spark, sf_dir, "log_mel")


@query(ORACLE_SQL["detector_features"])
def detector_features_by_slices(spark, sf_dir):
    return _sliced_feature_rows(spark, sf_dir, "stacked_fbank_short")


# --- the frame machine and scorers --------------------------------------------------------------------------------------

SMALL = MachineOptions(vote_frames=4, to_speech=3, to_silence=2, look_back=2, end_silence=6, longest=40, tail_frames=2, end_back=4)


def machine_sql(speech: str, o: MachineOptions, frames: str = EV) -> str:
    """The frame machine as a recursive query over ``ev`` (user_id, i, ...): all users advance by one frame in each step."""
    delay = o.vote_frames + o.look_back
    return f"""RECURSIVE {frames},
fr AS (SELECT user_id, i, {speech} AS sp, i = max(i) OVER (PARTITION BY user_id) AS last FROM ev),
m AS (SELECT user_id, -1::BIGINT AS i, []::INT[] AS votes, false AS voted, false AS speaking, 0::BIGINT AS floor, 0::BIGINT AS silent, -1::BIGINT AS start, NULL::BIGINT AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL
SELECT user_id, i, CASE WHEN rests THEN [] ELSE votes END, CASE WHEN rests THEN false ELSE voted END, opens OR (speaking AND NOT rests),
  CASE WHEN closes IS NOT NULL THEN greatest(floor, closes + 1) WHEN NOT speaking AND NOT opens AND i >= {delay} THEN greatest(floor, i - {delay}) ELSE floor END,
  CASE WHEN rests THEN 0 ELSE silent END, CASE WHEN rests THEN -1 WHEN opens THEN opened ELSE start END, CASE WHEN closes IS NOT NULL THEN start * {o.frame_ms} END, (closes + 1) * {o.frame_ms}
FROM (SELECT *, NOT speaking AND voted AS opens, greatest(floor, i - {delay}) AS opened, closes IS NOT NULL AS rests
  FROM (SELECT *, CASE WHEN NOT speaking THEN NULL WHEN NOT was AND NOT voted THEN CASE WHEN silent >= {o.end_silence} THEN i - {o.end_back} WHEN i - start + 1 > {o.longest} OR (last AND silent > 0) THEN i END
      WHEN i - start + 1 > {o.longest} OR last THEN i END AS closes
    FROM (SELECT *, CASE WHEN was OR voted THEN 0 ELSE silent0 + 1 END AS silent
      FROM (SELECT *, CASE WHEN NOT was AND list_sum(votes) >= {o.to_speech} THEN true WHEN was AND list_sum(votes) <= {o.to_silence} THEN false ELSE was END AS voted
        FROM (SELECT fr.user_id, fr.i, fr.last, m.voted AS was, m.speaking, m.floor, m.silent AS silent0, m.start, list_append(m.votes, fr.sp::INT)[-{o.vote_frames}:] AS votes FROM m JOIN fr ON fr.user_id = m.user_id AND fr.i = m.i + 1))))))
SELECT user_id AS audio_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS seq, a AS start_ms, b AS end_ms FROM m WHERE b >= a"""


@query("WITH " + machine_sql("value < 100", SMALL))
def machine_segments(spark, sf_dir):
    """The frame machine over users' events: value under 100 is speech."""
    return vad_segments(frame_rows(spark, sf_dir), F.col("db") < 100, SMALL)


@query("WITH " + machine_sql("value < 100", SMALL))
def machine_segments_by_slices(spark, sf_dir):
    """The same with slices of 30 frames, each on its own."""
    return sliced_segments(frame_rows(spark, sf_dir), F.col("db") < 100, SMALL, slice_frames=30)


def running_mean():
    """A scorer with a memory: the mean of all that it has seen of a recording."""

    def score(feats, levels, state):
        n, total = state or (0, 0.0)
        sums = total + np.cumsum(feats[:, 0].astype(np.float64))
        return sums / (n + 1 + np.arange(len(feats))) / 500, (n + len(feats), float(sums[-1]))

    return score


def mean_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("audio_id"), F.col("i").alias("frame_idx"), F.array(F.floor("value").cast("float")).alias("feat"))
    return score_frames(rows, running_mean)


@query(f"WITH {EV} SELECT user_id AS audio_id, i AS frame_idx, avg(floor(value)) OVER (PARTITION BY user_id ORDER BY i) / 500 < 0.15012347 AS low FROM ev")
def mean_scored_frames(spark, sf_dir):
    return mean_scored(spark, sf_dir).select("audio_id", "frame_idx", (F.col("silence") < 0.15012347).alias("low"))


@query("WITH " + machine_sql("coalesce(1 - mean >= mean + 0.60012347, false)", SMALL).replace(f"{EV},", f"{EV}, mean AS (SELECT *, greatest(1e-7, least(1 - 1e-7, avg(floor(value)) OVER (PARTITION BY user_id ORDER BY i) / 500)) AS mean FROM ev),").replace("sp, i = max(i) OVER (PARTITION BY user_id) AS last FROM ev)", "sp, i = max(i) OVER (PARTITION BY user_id) AS last FROM mean)"))
def mean_scored_segments(spark, sf_dir):
    """Scores with a memory, then frame states, then the frame machine."""
    return vad_segments(mean_scored(spark, sf_dir), frame_state(F.col("silence"), F.lit(0.0), 0.60012347), SMALL)


# --- models, recordings and files ---------------------------------------------------------------------------------------


def loudest():
    """A stand-in for a model: tells where a clip is loudest; it can't hear every seventh."""

    def run(pdf):
        if (pdf["vec_id"] % 7 == 0).any():
            raise ValueError("cannot hear")
        return pd.DataFrame({"raw_text": [f"language x<asr_text>{int(np.argmax(s))}" for s in pdf["samples"]], "elapsed_ms": [1.0] * len(pdf)})

    return run


@query("""SELECT vec_id, label, CASE WHEN vec_id % 7 <> 0 THEN 'language x<asr_text>' || (list_position(embedding, list_max(embedding)) - 1) END AS raw_text,
CASE WHEN vec_id % 7 <> 0 THEN 1 END AS elapsed_ms, CASE WHEN vec_id % 7 = 0 THEN 'asr: cannot hear' END AS error FROM embeddings""")
def scored_segments(spark, sf_dir):
    """Clips through a model that is made once in a worker; a clip that it can't hear is an error row, its batch goes on."""
    return transcribe_segments(embeddings(spark, sf_dir), loudest, "row").drop("samples").withColumn("elapsed_ms", F.col("elapsed_ms").cast("int"))


@query("""WITH RECURSIVE r AS (SELECT vec_id // 64 AS audio_id, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1),
a AS (SELECT audio_id, [abs(CAST(v AS DOUBLE)) for v in x] AS v, len(x) AS n FROM r),
c AS (SELECT audio_id, 0::BIGINT AS piece, 0::BIGINT AS cut FROM a
UNION ALL SELECT audio_id, piece + 1, CASE WHEN n - cut <= 1000 THEN n ELSE greatest(cut + 1, quiet + list_position(v[quiet + 1 : quiet + 100], list_min(v[quiet + 1 : quiet + 100])) - 1) END
FROM (SELECT *, CASE WHEN n - cut > 1000 THEN cut + 800 + list_position(sums, list_min(sums)) - 1 END AS quiet
  FROM (SELECT c.audio_id, c.piece, c.cut, a.n, a.v, [list_sum(a.v[c.cut + 800 + k + 1 : c.cut + 800 + k + 100]) for k in range(0, least(a.n - c.cut - 800, 400) - 99)] AS sums FROM c JOIN a USING (audio_id) WHERE c.cut < a.n)))
SELECT audio_id, piece, cut AS "offset", CAST(greatest(500, following - cut) AS INT) AS n FROM (SELECT *, lead(cut) OVER (PARTITION BY audio_id ORDER BY piece) AS following FROM c) WHERE following IS NOT NULL""")
def long_audio_pieces(spark, sf_dir):
    rows = recordings(spark, sf_dir, 64).withColumn("sample_rate", F.lit(1000))
    return split_long_audio(rows, 1.0, 0.5, 0.2).select("audio_id", "piece", "offset", F.size("samples").alias("n"))


@query(ORACLE_SQL["long_audio_pieces"])
def long_audio_pieces_from_pieces(spark, sf_dir):
    """The same cuts of recordings that come in pieces of 333 samples."""
    rows = recordings(spark, sf_dir, 64).select("audio_id", "samples", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 333))).alias("k"))
    rows = rows.select("audio_id", F.lit(1000).alias("sample_rate"), (F.col("k") * 333).alias("offset"), F.slice("samples", (F.col("k") * 333 + 1).cast("int"), F.lit(333)).alias("samples"))
    return split_long_pieces(rows, 1.0, 0.5, 0.2).select("audio_id", "piece", "offset", F.size("samples").alias("n"))


@query("WITH r AS (SELECT vec_id // 32 AS audio_id, count(*) * 64 AS n FROM embeddings GROUP BY 1) SELECT audio_id, CAST(round_even(n * 16000.0 / 22050.0, 0) AS INT) AS n FROM r")
def resampled_lengths(spark, sf_dir):
    return resample(recordings(spark, sf_dir, 32).withColumn("sample_rate", F.lit(22_050))).select("audio_id", F.size("samples").alias("n"))


@query("WITH r AS (SELECT vec_id // 32 AS audio_id, count(*) * 64 AS n FROM embeddings GROUP BY 1) SELECT audio_id, CAST(round_even(n * 16000.0 / 22050.0, 0) AS BIGINT) AS n, true AS same FROM r")
def resampled_pieces(spark, sf_dir):
    """Recordings in pieces of 300 samples through a filter that keeps its tail; ``same``: what comes out is what the whole gives."""
    rows = recordings(spark, sf_dir, 32).withColumn("sample_rate", F.lit(22_050))
    cut = rows.select("audio_id", "sample_rate", "samples", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 300))).alias("k"))
    cut = cut.select("audio_id", "sample_rate", (F.col("k") * 300).alias("offset"), F.slice("samples", (F.col("k") * 300 + 1).cast("int"), F.lit(300)).alias("samples"))
    parts = F.array_sort(F.collect_list(F.struct("offset", "samples")))
    got = resample_pieces(cut, key="audio_id").groupBy("audio_id").agg(F.flatten(F.transform(parts, lambda x: x["samples"])).alias("got"))
    both = got.join(resample(rows).select("audio_id", "samples"), "audio_id")
    far = F.array_max(F.zip_with("got", "samples", lambda a, b: F.abs(F.coalesce(a - b, F.lit(9.0)))))
    return both.select("audio_id", F.size("got").cast("long").alias("n"), (far < 1e-6).alias("same"))


def tone(hz, rate, n):
    """Samples of a sine of amplitude 0.5."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.sin(i * hz * (2 * np.pi) / rate) * 0.5).cast("float"))


@query("""WITH r AS (SELECT vec_id, unnest([8000, 22050, 44100, 48000]) AS rate FROM embeddings)
SELECT vec_id, rate, CAST(round_even(rate // 10 * 16000.0 / rate, 0) AS INT) AS n, true AS near FROM r""")
def resampled_tones(spark, sf_dir):
    """A tone of each embedding's own pitch from four rates to 16 kHz, against the tone at 16 kHz, but for the filter's ends."""
    hz = 100 + F.col("vec_id") % 2900
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, (8_000, 22_050, 44_100, 48_000)))).alias("rate"))
    rows = rows.select("vec_id", "rate", F.col("rate").alias("sample_rate"), tone(hz, F.col("rate"), F.floor(F.col("rate") / 10).cast("int")).alias("samples"))
    off = F.transform("samples", lambda x, j: F.abs(x - F.sin(j * (100 + F.col("vec_id") % 2900) * (2 * np.pi) / 16_000) * 0.5))
    inner = F.slice(off, 65, F.size(off) - 128)
    return resample(rows).select("vec_id", "rate", F.size("samples").alias("n"), (F.array_max(inner) < 0.005).alias("near"))


def tone_sql(rate: int, n_fft: int, low: int, bins: int, power: int, made: str) -> str:
    """Peak and level of a windowed tone on one bin of the spectrum: a half of the amplitude there, a quarter on either side."""
    hz = rate / n_fft
    return f"""mel AS (SELECT unnest(range(0, 130)) AS j), pt0 AS (SELECT j, j * (15 + ln({rate / 2 / 1000}) * 27 / ln(6.4)) / 129 AS z FROM mel),
pt1 AS (SELECT j, CASE WHEN z < 15 THEN z * 200 / 3 ELSE 1000 * exp((z - 15) * ln(6.4) / 27) END AS f FROM pt0),
tri AS (SELECT j, f AS a, lead(f) OVER (ORDER BY j) AS b, lead(f, 2) OVER (ORDER BY j) AS c FROM pt1),
t AS (SELECT vec_id, {low} + vec_id % {bins} AS k FROM embeddings),
s AS (SELECT vec_id, (k + d) * {hz} AS f, pow(0.5 * {n_fft} / 4 / CASE WHEN d = 0 THEN 1 ELSE 2 END, {power}) AS p FROM t, (SELECT unnest([-1, 0, 1]) AS d)),
e AS (SELECT vec_id, j, sum(p * greatest(0, least((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a)) AS e FROM s, tri WHERE c IS NOT NULL GROUP BY 1, 2),
g AS (SELECT vec_id, arg_max(j, e) AS peak, max(e) AS e FROM e GROUP BY 1)
SELECT vec_id, peak, {fixed_sql(made, 1)} AS level FROM g"""


def tone_features(spark, sf_dir, rate, n_fft, low, bins, front_end, frame):
    """The middle frame's loudest mel band and its level, for a tone of each embedding's own bin."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tone((low + F.col("vec_id") % bins) * (rate / n_fft), F.lit(float(rate)), F.lit(4096)).alias("samples"))
    top = F.array_max("feat")
    return features(rows, front_end, "vec_id").where(F.col("frame_idx") == frame).select("vec_id", (F.array_position("feat", top) - 1).alias("peak"), fixed(top, 1).alias("level"))


@query("WITH " + tone_sql(16_000, 400, 40, 140, 2, "(log10(e) + 4) / 4"))
def log_mel_of_tones(spark, sf_dir):
    return tone_features(spark, sf_dir, 16_000, 400, 40, 140, "log_mel", 12)


@query("WITH " + tone_sql(24_000, 1024, 60, 400, 1, "ln(e)"))
def mel_spectrograms_of_tones(spark, sf_dir):
    return tone_features(spark, sf_dir, 24_000, 1024, 60, 400, "mel_spectrogram", 8)


@query(f"""WITH {PADDED}, f AS (SELECT DISTINCT user_id AS audio_id, max(start_ms) OVER (PARTITION BY user_id) + 43200000 AS duration_ms FROM ev UNION ALL SELECT -1 - user_id, 5 FROM (SELECT DISTINCT user_id FROM ev))
SELECT f.audio_id, duration_ms, coalesce(d.n, 0) AS n_detected, count(m.seq) AS n_segments, CAST(coalesce(sum(end_ms - start_ms), 0) AS BIGINT) AS speech_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms,
{HOURS.min_segment_ms} AS min_segment_ms, {HOURS.pad_start_ms} AS pad_start_ms, {HOURS.pad_end_ms} AS pad_end_ms, {HOURS.merge_gap_ms} AS merge_gap_ms
FROM f LEFT JOIN (SELECT audio_id, count(*) AS n FROM seg GROUP BY 1) d ON d.audio_id = f.audio_id LEFT JOIN merged m ON m.audio_id = f.audio_id GROUP BY 1, 2, 3""")
def file_facts(spark, sf_dir):
    """Facts of each user's recording, and of as many silent ones."""
    found = segment_rows(spark, sf_dir)
    files = found.groupBy("audio_id").agg(F.max("duration_ms").alias("duration_ms"))
    silent = files.select((-1 - F.col("audio_id")).alias("audio_id"), F.lit(5).cast("bigint").alias("duration_ms"))
    return transcripts.file_facts(files.union(silent), merged_rows(spark, sf_dir), found, HOURS)


@query(f"WITH {PADDED} SELECT -audio_id AS position, audio_id, seq, start_ms, row_number() OVER (ORDER BY -audio_id, seq) AS place FROM merged")
def ordered_output(spark, sf_dir):
    """Segments in the order of their inputs; ``place`` is told by where the rows came out: their partition, and their place in it."""
    inputs = event_rows(spark, sf_dir).select(F.col("user_id").alias("audio_id"), (-F.col("user_id")).alias("position")).distinct()
    out = transcripts.in_input_order(merged_rows(spark, sf_dir), inputs).select("position", "audio_id", "seq", "start_ms", F.monotonically_increasing_id().alias("at"))
    out = kept(out.withColumn("part", F.shiftright("at", 33)))  # sorted once: another sort may cut its partitions elsewhere
    sizes = out.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) + F.col("before")
    return out.join(before, "part").select("position", "audio_id", "seq", "start_ms", place.alias("place"))


@query(f"""WITH {EV} SELECT user_id AS stream_id, i AS chunk_id, CASE WHEN i % 7 = 3 THEN start_ms - 90000000 ELSE start_ms END
  < max(CASE WHEN i % 7 = 3 THEN start_ms - 90000000 ELSE start_ms END) OVER (PARTITION BY user_id ORDER BY i) - 86400000 AS late FROM ev""")
def chunks_behind(spark, sf_dir):
    """Every seventh chunk starts 25 hours early; those more than a day behind the newest so far are late."""
    at = F.when(F.col("i") % 7 == 3, F.col("start_ms") - 90_000_000).otherwise(F.col("start_ms"))
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("stream_id"), F.col("i").alias("chunk_id"), at.alias("start_ms"))
    return late_rows(rows, "behind", delay_ms=86_400_000).select("stream_id", "chunk_id", "late")


# --- tokens and tables --------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT vec_id // 8 AS item_id, vec_id % 8 AS step, list_position(embedding, list_max(embedding)) - 1 AS id FROM embeddings),
e AS (SELECT item_id, step, id, row_number() OVER (PARTITION BY item_id ORDER BY step) AS n, count(CASE WHEN id < 12 THEN 1 END) OVER (PARTITION BY item_id ORDER BY step) AS ended FROM s)
SELECT item_id, coalesce(string_agg(id, ',' ORDER BY step) FILTER (ended = 0 AND n <= 6), '') AS ids FROM e GROUP BY 1""")
def greedy_sequences(spark, sf_dir):
    """Each step's best token up to an end token (any under 12), six at most."""
    rows = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("item_id"), (F.col("vec_id") % 8).alias("step"), F.col("samples").alias("logits"))
    return partials.greedy_sequence(rows, list(range(12)), 6).select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"SELECT vec_id, {fixed_sql('list_sum([2 * CAST(x AS DOUBLE) * i for x, i in embedding])', 4)} AS total FROM embeddings")
def normalised_by_files(spark, sf_dir):
    """CMVN text made of each embedding, read back and applied to it: shifted by itself, scaled by places."""
    listed = lambda a: F.concat(F.lit(" [ "), F.array_join(F.transform(a, lambda x: x.cast("string")), " "), F.lit(" ]\n"))
    places = F.transform("samples", lambda _, i: i + 1)
    said = F.concat(F.lit("<Nnet>\n<AddShift> 64 64\n<LearnRateCoef> 0"), listed("samples"), F.lit("<Rescale> 64 64\n<LearnRateCoef> 0"), listed(places), F.lit("</Nnet>\n"))
    rows = embeddings(spark, sf_dir).select("vec_id", "samples", parse_cmvn(said).alias("c"))
    scaled = arrays.apply_cmvn(F.col("samples"), F.col("c.shift"), F.col("c.scale"))
    return rows.select("vec_id", fixed(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([^ \n]+) ([^ \n]+) ', '\1 \2' || chr(10), 'g'), chr(10)) AS lines FROM conversations),
p AS (SELECT conv_id, turn, [trim(x) for x in lines if len(string_split(trim(x), ' ')) = 2] AS pairs FROM l),
u AS (SELECT conv_id, turn, unnest(pairs) AS pair, unnest(range(0, len(pairs))) AS rank FROM p)
SELECT conv_id, turn, string_split(pair, ' ')[1] AS "left", string_split(pair, ' ')[2] AS "right", CAST(rank AS INT) AS rank FROM u""")
def merge_tables(spark, sf_dir):
    """Merge lists made of each turn's words, two a line; a line of another number of words is none."""
    said = F.regexp_replace("text", r"([^ \n]+) ([^ \n]+) ", "$1 $2\n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parse_merges(said)).alias("rank", "p"))
    return rows.select("conv_id", "turn", "p.left", "p.right", "rank")


MARKS_SQL = "，。、；：？！（）《》“”‘’—…"
LETTERS_SQL, SIGNS_SQL = rf"(?:[A-Za-z]|[^\x00-\x7f{MARKS_SQL}])", rf"[\x00\x03-\x08\x0b\x0c\x0e-\x1f!-/:-@\[-`{{-\x7f{MARKS_SQL}]"


def pieces_sql(source: str) -> str:
    """The pieces of each row of (doc_id, text) in order, as rows of (doc_id, part, place, piece)."""
    return rf"""c AS (SELECT doc_id, string_split(regexp_replace(text, '(''(?:s|t|re|ve|m|ll|d|S|T|RE|VE|M|LL|D))', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS parts FROM {source} WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS words, unnest(range(0, len(parts))) AS part FROM c),
l AS (SELECT doc_id, part, CASE WHEN part % 2 = 1 THEN [words] ELSE regexp_extract_all(regexp_replace(words, '( +)( [^ \n\r\t])', '\1' || chr(1) || '\2', 'g'), ' +\x01| ?{LETTERS_SQL}+| ?{SIGNS_SQL}+[\n\r]*|[0-9]| +|[\n\r\t][ \n\r\t]*') END AS found FROM p),
pc AS (SELECT doc_id, part, place, replace(piece, chr(1), '') AS piece FROM (SELECT doc_id, part, unnest(found) AS piece, unnest(range(0, len(found))) AS place FROM l))"""


@query(f"WITH {pieces_sql('documents')} SELECT piece, count(*) AS n FROM pc GROUP BY 1")
def text_pieces(spark, sf_dir):
    return piece_counts(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The byte-level vocabulary among the installed public tokenizers."""
    try:
        import public_tokenizers
    except ImportError:
        return "byte_bpe_50k.json"
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(spark: SparkSession):
    return collected(*read_tokenizer_file(spark, f"file://{tokenizer_path()}"))


@query("SELECT doc_id, length(text) AS n_chars, true AS same FROM documents")
def token_round_trips(spark, sf_dir):
    t = tokenizer(spark)
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), t), t, keep_special=True)
    return rows.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.col("text")).alias("same"))


#: A word that stands for a special token, and a longer one that begins with it.
SPECIAL = ("<|s|>", "<|s|> of")


@query(f"""WITH t AS (SELECT doc_id, replace(text, ' the ', ' {SPECIAL[0]} ') AS t FROM documents),
n AS (SELECT doc_id, (length(t) - length(replace(t, '{SPECIAL[1]}', ''))) // {len(SPECIAL[1])} AS longer, (length(t) - length(replace(t, '{SPECIAL[0]}', ''))) // {len(SPECIAL[0])} AS n FROM t)
SELECT doc_id, coalesce(longer, 0) AS longer, coalesce(n - longer, 0) AS shorter FROM n""")
def special_tokens_matched(spark, sf_dir):
    """Special tokens in texts: where one begins another, the longest that fits is taken."""
    vocab, merges, added = read_tokenizer_file(spark, f"file://{tokenizer_path()}")
    added = added.unionByName(spark.createDataFrame([(SPECIAL[0], 100_001), (SPECIAL[1], 100_002)], "token string, id long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit(f" {SPECIAL[0]} ")).alias("text"))
    ids = encode(rows, collected(vocab, merges, order_special_tokens(added)))
    count = lambda i: F.size(F.filter("ids", lambda x: x == i)).cast("long")
    return ids.select("doc_id", count(100_002).alias("longer"), count(100_001).alias("shorter"))


@query(f"WITH {PADDED} SELECT audio_id, seq, start_ms, end_ms, CAST(audio_id % 4 AS INT) AS part FROM merged")
def segments_written(spark, sf_dir):
    """Merged segments written to directories by a value and read back."""
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    rows = merged_rows(spark, sf_dir).select("audio_id", "seq", "start_ms", "end_ms", (F.col("audio_id") % 4).cast("int").alias("part"))
    write_segments(rows, folder, ["part"])
    return spark.read.schema(rows.schema).parquet(folder)


def tokens_sql(source: str) -> str:
    """A recursive query up to ``toks``: (doc_id, part, place, k, token, id), with every piece merged by rank."""
    alphabet = ", ".join("'" + c.replace("'", "''") + "'" for c in byte_characters())
    return f"""RECURSIVE {pieces_sql(source)},
f AS (SELECT content::JSON AS j FROM read_text('{tokenizer_path()}')),
vocab AS (SELECT e.key AS token, e.value AS id FROM (SELECT unnest(map_entries((j->'$.model.vocab')::MAP(VARCHAR, BIGINT))) AS e FROM f)),
listed AS (SELECT (j->'$.model.merges')::VARCHAR[][] AS m FROM f),
merges AS (SELECT pair[1] AS l, pair[2] AS r, rank FROM (SELECT unnest(m) AS pair, unnest(range(0, len(m))) AS rank FROM listed)),
alphabet AS (SELECT [{alphabet}] AS a),
t AS (SELECT piece, [a[('0x' || h)::INT + 1] for h in regexp_extract_all(hex(encode(piece)), '..')] AS tokens, 0 AS step FROM (SELECT DISTINCT piece FROM pc), alphabet
UNION ALL SELECT piece, tokens[:i - 1] || [tokens[i] || tokens[i + 1]] || tokens[i + 2:], step + 1
FROM (SELECT piece, any_value(tokens) AS tokens, any_value(step) AS step, arg_min(i, rank * 100000 + i) AS i FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM t) JOIN merges ON l = tokens[i] AND r = tokens[i + 1] GROUP BY piece)),
done AS (SELECT piece, arg_max(tokens, step) AS tokens FROM t GROUP BY 1),
ids AS (SELECT piece, token, k, id FROM (SELECT piece, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS k FROM done) JOIN vocab USING (token)),
toks AS (SELECT doc_id, part, place, k, token, id FROM pc JOIN ids USING (piece))"""


@query(f"""WITH {tokens_sql('documents')}
SELECT d.doc_id, count(id) AS n_tokens, md5(coalesce(string_agg(id, ',' ORDER BY part, place, k), '')) AS ids FROM documents d LEFT JOIN toks ON d.doc_id = toks.doc_id GROUP BY 1""")
def token_ids(spark, sf_dir):
    """The ids of each document, against merging by rank in SQL."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(spark))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids"))


@query(f"""WITH {tokens_sql("(SELECT conv_id * 100 + turn AS doc_id, text FROM conversations)")},
e AS (SELECT doc_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS whole, sum(length(token)) OVER w AS bytes FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY part, place, k)),
u AS (SELECT conv_id * 100 + turn AS doc_id, turn, text, hex(encode(text)) AS h FROM conversations),
b AS (SELECT u.doc_id, max(bytes) AS bytes FROM u JOIN e ON e.doc_id = u.doc_id WHERE n <= whole - 5 AND substring(h, 2 * CAST(bytes AS INT) + 1, 1) NOT IN ('8', '9', 'A', 'B') GROUP BY 1)
SELECT u.doc_id AS utterance_id, md5(CASE WHEN turn % 4 = 3 THEN text WHEN turn < 2 THEN '' ELSE decode(unhex(substring(h, 1, 2 * CAST(coalesce(bytes, 0) AS INT)))) END) AS stable FROM u LEFT JOIN b ON b.doc_id = u.doc_id""")
def stable_prefixes(spark, sf_dir):
    """What of each turn's text is stable: nothing in the first two, all of every fourth, else all but its last five tokens."""
    t = tokenizer(spark)
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("utterance_id"), F.col("turn").alias("chunk_id"), F.col("text").alias("raw_text"), (F.col("turn") % 4 == 3).alias("is_final"))
    return partials.stable_prefix(encode(rows, t, "raw_text"), t).select("utterance_id", F.md5("stable").alias("stable"))


#: Levels of the frames of each stream, the ten milliseconds of silence at its end included; a frame is five blocks of 80 samples.
STREAM_FRAMES = """vs AS (SELECT CAST(vec_id // 64 AS VARCHAR) AS user_id, vec_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS place, [pow(greatest(-1, least(1, x * CASE WHEN vec_id % 37 < 15 THEN 0.05 ELSE 1 END)), 2) for x in embedding] AS sq FROM embeddings),
bl AS (SELECT user_id, place * 20 + b AS b, list_sum([sq[1 + (b * 80 + t) % 64] for t in range(0, 80)]) AS e FROM (SELECT *, unnest(range(0, 20)) AS b FROM vs)),
nb AS (SELECT user_id, count(*) + 2 AS n FROM bl GROUP BY 1),
fs AS (SELECT user_id, unnest(range(0, 1 + (n - 5) // 2)) AS i FROM nb),
ev AS (SELECT fs.user_id, i, 10 * log10(coalesce(sum(e), 0) + 1e-6) AS level FROM fs LEFT JOIN bl ON bl.user_id = fs.user_id AND b BETWEEN 2 * i AND 2 * i + 4 GROUP BY 1, 2)"""


#: All events of the streams by the rules of sessions, in lengths, as the model only writes w: chunks are of 1,600 samples, the one that
#: ends a stream of 160; frames come out two frames late; a decode takes 8,000 samples, a window holds 32,000.
STREAM_EVENTS = f"""{machine_sql("level > 0", MachineOptions(), STREAM_FRAMES).rpartition(chr(10) + "SELECT user_id AS audio_id")[0]},
ch AS (SELECT CAST(vec_id // 64 AS VARCHAR) AS user_id, count(*) AS chunks, max(vec_id) AS last_id, min(vec_id) AS first_id FROM embeddings GROUP BY 1),
op AS (SELECT user_id, i AS f, start * 10 AS a, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS u FROM (SELECT *, lag(speaking) OVER (PARTITION BY user_id ORDER BY i) AS before FROM m) WHERE speaking AND NOT before),
cl AS (SELECT user_id, i AS f, b, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS u FROM m WHERE b IS NOT NULL),
ut0 AS (SELECT op.user_id, op.u, a, coalesce(b, chunks * 100 + 10) AS b, chunks, first_id, last_id, least((op.f + 4) // 10 + 1, chunks + 1) AS co, least(coalesce((cl.f + 4) // 10 + 1, chunks + 1), chunks + 1) AS cc
  FROM op JOIN ch ON ch.user_id = op.user_id LEFT JOIN cl ON cl.user_id = op.user_id AND cl.u = op.u),
ut AS (SELECT *, least(3, co - coalesce(lag(cc) OVER (PARTITION BY user_id ORDER BY u), 1)) AS pre FROM ut0),
heard AS (SELECT *, unnest(range(co, cc + 1)) AS c FROM ut),
fed AS (SELECT *, 1600 * (pre + least(c, chunks) - co + 1) + CASE WHEN c > chunks THEN 160 ELSE 0 END AS n FROM heard),
st0 AS (SELECT user_id, u, unnest(range(coalesce(lag(n // 8000) OVER (PARTITION BY user_id, u ORDER BY c), 0), n // 8000)) AS k, c, NULL AS part FROM fed),
ends AS (SELECT user_id, u, cc AS c, n // 8000 AS k, least(n % 8000, (b - a) * 16 - n // 8000 * 8000) AS part FROM fed WHERE c = cc),
st AS (SELECT user_id, u, k, c, (k + 1) * 8000 AS total FROM st0 UNION ALL SELECT user_id, u, k, c, k * 8000 + part FROM ends WHERE part > 0),
tx AS (SELECT user_id, u, -1::BIGINT AS k, 0::BIGINT AS c, 0::BIGINT AS total, 0::BIGINT AS n, 0::BIGINT AS conf, 0::BIGINT AS pend, 0::BIGINT AS delta, false AS worth FROM ut
UNION ALL
SELECT user_id, u, k, c, total, t, CASE WHEN t < conf THEN 0 ELSE conf + least(pend, t - conf) END, CASE WHEN t = 0 THEN 0 WHEN t < conf THEN t ELSE t - conf - least(pend, t - conf) END,
  CASE WHEN t < conf THEN 0 ELSE least(pend, t - conf) END, t < conf OR least(pend, t - conf) > 0 OR t <> conf + pend
FROM (SELECT tx.user_id, tx.u, st.k, st.c, st.total, tx.conf, tx.pend, CASE WHEN st.k < 2 THEN 0 ELSE greatest(tx.n - 5, 0) END + least(st.total, 32000) // 800 + st.k AS t FROM tx JOIN st ON st.user_id = tx.user_id AND st.u = tx.u AND st.k = tx.k + 1)),
fin AS (SELECT user_id, u, arg_max(n, k) AS n, arg_max(conf, k) AS conf FROM tx GROUP BY 1, 2),
ev2 AS (SELECT user_id, u, 0 AS place, 0 AS k, 'speech_start' AS event_type, co AS c, a AS start_ms, NULL AS end_ms, 0 AS t, 0 AS d, 0 AS conf, 0 AS pend FROM ut
UNION ALL SELECT tx.user_id, tx.u, 1, k, 'partial', c, a, a + total // 16, tx.conf + pend, delta, tx.conf, pend FROM tx JOIN ut ON ut.user_id = tx.user_id AND ut.u = tx.u WHERE k >= 0 AND worth
UNION ALL SELECT ut.user_id, ut.u, 2, 0, 'final', cc, a, b, n, greatest(n - conf, 0), n, 0 FROM ut JOIN fin ON fin.user_id = ut.user_id AND fin.u = ut.u
UNION ALL SELECT user_id, u, 3, 0, 'speech_end', cc, a, b, 0, 0, 0, 0 FROM ut
UNION ALL SELECT user_id, -1, 4, 0, 'pipeline_done', chunks, NULL, chunks * 100 + 10, 0, 0, 0, 0 FROM ch)
SELECT ev2.user_id AS stream_id, row_number() OVER (PARTITION BY ev2.user_id ORDER BY place = 4, u, place, k) - 1 AS result_id, event_type, u AS utterance_id, least(first_id + c - 1, last_id) AS trigger_chunk_id, start_ms, end_ms,
  repeat('w', t) AS text, repeat('w', d) AS confirmed_delta, repeat('w', conf) AS confirmed_text, repeat('w', pend) AS pending_text FROM ev2 JOIN ch ON ch.user_id = ev2.user_id"""


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk streams, 64 embeddings each of 100 ms; of every 37 embeddings 15 are quiet."""
    pcm = F.flatten(F.array_repeat(F.transform("samples", lambda x: x * F.when(F.col("vec_id") % 37 < 15, 0.05).otherwise(1.0)), 25)).cast("array<float>")
    place = F.col("vec_id") % 64
    rows = embeddings(spark, sf_dir).withColumn("last", F.max("vec_id").over(Window.partitionBy(F.floor(F.col("vec_id") / 64))))
    return rows.select(F.floor(F.col("vec_id") / 64).cast("string").alias("stream_id"), F.col("vec_id").alias("chunk_id"), (place * 100).alias("start_ms"), pcm.alias("pcm"), (F.col("vec_id") == F.col("last")).alias("is_final"))


def stream_models():
    """Stand-ins: frames over 0 dB are speech; a text has a letter per 50 ms of the window, and one more at each call."""
    return {"scorer": lambda feats, levels, state: (np.where(levels > 0, 0.0, 1.0), None), "model": lambda window, prefix, calls: ("w" * (len(window) // 800 + (calls or 0)), (calls or 0) + 1)}


@query("WITH " + STREAM_EVENTS)
def streamed_texts(spark, sf_dir):
    """Every event of chunk streams: starts, partial and final texts with what is confirmed and pending, ends."""
    return replay(stream_chunks(spark, sf_dir), stream_models, StreamOptions(window_seconds=2.0)).drop("error")


@query("WITH " + STREAM_EVENTS)
def streams_together(spark, sf_dir):
    """The same events with the windows of many streams in each call of the model."""

    def load():
        one = stream_models()
        return {"scorer": one["scorer"], "batch_model": lambda windows, prefixes, states: [one["model"](*x) for x in zip(windows, prefixes, states, strict=True)]}

    return replay_together(stream_chunks(spark, sf_dir), load, StreamOptions(window_seconds=2.0), cohort=4).drop("error")


@query("WITH " + machine_sql("level > 0", MachineOptions(), STREAM_FRAMES).replace("user_id AS audio_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS seq", "user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS utterance_id"))
def replayed_streams(spark, sf_dir):
    """Utterances of chunk streams through detection and recognition with stand-ins for the models."""
    return replay(stream_chunks(spark, sf_dir), stream_models).where("event_type = 'speech_end'").select("stream_id", "utterance_id", "start_ms", "end_ms")


@query(f"WITH {EV} SELECT user_id AS stream_id, i AS result_id, event_type, CASE WHEN i % 10 < 6 THEN i % 10 // 3 WHEN i % 10 = 9 THEN 3 END AS batch_id FROM ev WHERE i % 10 < 6 OR i % 10 = 9")
def events_written_again(spark, sf_dir):
    """Events through the sink: two batches written twice, one that was never committed, and one by another run that repeats rows."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("stream_id"), F.col("i").alias("result_id"), "event_type", (F.col("i") % 10).alias("d"))
    for batch in (0, 1, 0):
        write_batch(rows.where(F.floor(F.col("d") / 3) == batch).drop("d"), batch, folder)
    rows.where("d > 5 and d < 9").drop("d").write.parquet(f"{folder}/rows/batch_id=2")  # it stopped before its commit
    write_batch(rows.where("d = 9 or d < 2").drop("d"), 3, folder)
    return read_events(spark, folder, "stream_id bigint, result_id bigint, event_type string")
