"""Registered queries: the operators applied to the driver's tables, and DuckDB SQL for the rows they return.

The tables hold no audio, so they stand in for it: a user's events in time are a recording's frames, chunks or segments, an
embedding is 64 samples or a score vector, a conversation is a recording with one piece per turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechlake.functions import arrays, audio, text, timebase
from speechlake.jobs.offline import speech_regions
from speechlake.operators import asr_windows, clips, compare, energy_vad, events, partials, segments, transcripts
from speechlake.operators.embedding_merge import merge_audio_features
from speechlake.operators.features import stack_frames
from speechlake.operators.vad_machine import frame_state
from speechlake.options import EnergyVadOptions, SegmentOptions
from speechlake.streaming.jobs import late_rows, windowed
from speechlake.streaming.ordered import stored_arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(x: Column, digits: int = 6) -> Column:
    """A float as a whole number of 10 ** -digits, so that sums in another order hash the same."""
    return F.round(x.cast("double") * float(10**digits), 0).cast("long")


def fixed_sql(x: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({x} AS DOUBLE) * {float(10**digits)}, 0) AS BIGINT)"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, value, i, start_ms): each user's events numbered in time, in ms from the first."""
    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("i"), F.floor((us - F.min(us).over(w)) / 1000).cast("long").alias("start_ms")
    )


EV = """ev AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000) AS BIGINT) AS start_ms FROM events)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


# --- frames, votes and segments ---------------------------------------------------------------------------------------

VAD = EnergyVadOptions(threshold_db=60.0, min_speech_ms=20, min_silence_ms=30)
SEG = SegmentOptions(min_segment_ms=20, pad_start_ms=10, pad_end_ms=20, merge_gap_ms=30)
HOURS = SegmentOptions(min_segment_ms=600_000, pad_start_ms=1_800_000, pad_end_ms=3_600_000, merge_gap_ms=7_200_000)


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return rows.select(F.col("user_id").alias("audio_id"), F.col("i").alias("frame_idx"), F.col("value").alias("db"), (F.count("*").over(Window.partitionBy("user_id")) * VAD.hop_ms).alias("duration_ms"))


ENERGY = f"""{EV},
runs0 AS (SELECT user_id, i, value >= {VAD.threshold_db} AS speech FROM ev),
runs1 AS (SELECT *, CASE WHEN lag(speech) OVER (PARTITION BY user_id ORDER BY i) = speech THEN 0 ELSE 1 END AS turned FROM runs0),
runs2 AS (SELECT *, sum(turned) OVER (PARTITION BY user_id ORDER BY i) AS run FROM runs1),
runs3 AS (SELECT user_id, run, speech, min(i) AS first, count(*) AS n FROM runs2 GROUP BY ALL),
kept AS (SELECT * FROM runs3 WHERE CASE WHEN speech THEN n >= {VAD.speech_frames} ELSE n >= {VAD.silence_frames} END),
turns AS (SELECT *, lag(speech) OVER (PARTITION BY user_id ORDER BY run) AS was FROM kept),
turns2 AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY run) AS stop FROM turns WHERE speech <> coalesce(was, false)),
found AS (SELECT user_id AS audio_id, row_number() OVER (PARTITION BY user_id ORDER BY run) - 1 AS seq, first, stop FROM turns2 WHERE speech)"""


@query(f"WITH {ENERGY} SELECT audio_id, seq, first, stop FROM found")
def energy_vad_runs(spark, sf_dir):
    return energy_vad.energy_vad(frame_rows(spark, sf_dir), F.col("db") >= VAD.threshold_db, VAD.speech_frames, VAD.silence_frames)


REGIONS = f"""{ENERGY},
d AS (SELECT user_id AS audio_id, count(*) * {VAD.hop_ms} AS duration_ms FROM ev GROUP BY 1),
s0 AS (SELECT f.audio_id, seq, greatest(0, first * {VAD.hop_ms}) AS vs, least(duration_ms, coalesce(stop * {VAD.hop_ms}, duration_ms)) AS ve, duration_ms FROM found f JOIN d USING (audio_id)),
s1 AS (SELECT audio_id, seq, vs, ve, greatest(0, vs - {SEG.pad_start_ms}) AS s, least(duration_ms, ve + {SEG.pad_end_ms}) AS e FROM s0 WHERE ve - vs >= {SEG.min_segment_ms}),
s2 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY audio_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {SEG.merge_gap_ms} THEN 0 ELSE 1 END AS opens FROM s1 WHERE e > s),
s3 AS (SELECT *, sum(opens) OVER (PARTITION BY audio_id ORDER BY seq) AS island FROM s2)"""


@query(f"""WITH {REGIONS} SELECT audio_id, CAST(island - 1 AS BIGINT) AS seq, arg_min(s, seq) AS start_ms, max(e) AS end_ms, arg_min(vs, seq) AS vad_start_ms, max(ve) AS vad_end_ms
FROM s3 GROUP BY audio_id, island""")
def speech_regions_of_users(spark, sf_dir):
    return speech_regions(frame_rows(spark, sf_dir), VAD, SEG)


@query(f"WITH {EV} SELECT user_id AS audio_id, i AS frame_idx, CAST(sum(CAST(value >= 60 AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS votes FROM ev")
def vote_window(spark, sf_dir):
    return energy_vad.vote_window(frame_rows(spark, sf_dir), F.col("db") >= 60).select("audio_id", "frame_idx", "votes")


@query("SELECT event_id, coalesce(1 - greatest(1e-7, least(1 - 1e-7, value / 500)) >= greatest(1e-7, least(1 - 1e-7, value / 500)) + 0.6 AND value >= 5, false) AS speech FROM events")
def frame_states(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", frame_state(F.col("value") / 500, F.col("value"), least_db=5.0).alias("speech"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as segments of value minutes; the recording ends 12 hours after the last one starts."""
    rows = event_rows(spark, sf_dir)
    end = F.col("start_ms") + F.floor(F.col("value") * 60_000).cast("long")
    return rows.select(F.col("user_id").alias("audio_id"), F.col("i").alias("seq"), "start_ms", end.alias("end_ms"), (F.max("start_ms").over(Window.partitionBy("user_id")) + 43_200_000).alias("duration_ms"), "event_type", "value")


PADDED = f"""{EV},
seg AS (SELECT user_id AS audio_id, i AS seq, start_ms, start_ms + CAST(floor(value * 60000) AS BIGINT) AS end_ms, max(start_ms) OVER (PARTITION BY user_id) + 43200000 AS duration_ms FROM ev),
cl AS (SELECT audio_id, seq, greatest(0, start_ms) AS vs, least(duration_ms, end_ms) AS ve, duration_ms FROM seg),
padded AS (SELECT audio_id, seq, greatest(0, vs - {HOURS.pad_start_ms}) AS start_ms, least(duration_ms, ve + {HOURS.pad_end_ms}) AS end_ms, vs AS vad_start_ms, ve AS vad_end_ms FROM cl WHERE ve - vs >= {HOURS.min_segment_ms}),
isl AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY audio_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOURS.merge_gap_ms} THEN 0 ELSE 1 END AS opens FROM padded WHERE end_ms > start_ms),
isl2 AS (SELECT *, sum(opens) OVER (PARTITION BY audio_id ORDER BY seq) AS island FROM isl),
merged AS (SELECT audio_id, CAST(island - 1 AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, max(end_ms) AS end_ms, arg_min(vad_start_ms, seq) AS vad_start_ms, max(vad_end_ms) AS vad_end_ms FROM isl2 GROUP BY audio_id, island)"""


@query(f"WITH {PADDED} SELECT * FROM padded WHERE end_ms > start_ms")
def padded_segments(spark, sf_dir):
    return segments.pad_segments(segment_rows(spark, sf_dir), HOURS).select("audio_id", "seq", "start_ms", "end_ms", "vad_start_ms", "vad_end_ms")


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.merge_segments(segments.pad_segments(segment_rows(spark, sf_dir), HOURS), HOURS.merge_gap_ms)


@query(f"WITH {PADDED} SELECT * FROM merged")
def merged_segments(spark, sf_dir):
    return merged_rows(spark, sf_dir)


@query(f"WITH {PADDED} SELECT audio_id, count(*) AS n_segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM merged GROUP BY 1")
def file_summaries(spark, sf_dir):
    return transcripts.file_summary(merged_rows(spark, sf_dir))


def vad_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector events: clicks open, views close, purchases are complete, others are neither."""
    rows = segment_rows(spark, sf_dir)
    kind = F.col("event_type")
    return rows.select(F.col("audio_id").alias("stream_id"), "seq", F.when(kind.isin("click", "purchase"), F.col("start_ms")).otherwise(-1).alias("start_ms"), F.when(kind.isin("view", "purchase"), F.col("end_ms")).otherwise(-1).alias("end_ms"))


VADEV = f"""{EV},
ve AS (SELECT user_id AS stream_id, i AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN start_ms ELSE -1 END AS start_ms, CASE WHEN event_type IN ('view', 'purchase') THEN start_ms + CAST(floor(value * 60000) AS BIGINT) ELSE -1 END AS end_ms FROM ev),
vk AS (SELECT *, CASE WHEN start_ms >= 0 AND end_ms = -1 THEN 'start' WHEN start_ms = -1 AND end_ms >= 0 THEN 'end' WHEN start_ms >= 0 AND end_ms >= 0 THEN 'complete' ELSE 'other' END AS kind FROM ve)"""


@query(f"WITH {VADEV} SELECT stream_id, kind, count(*) AS n FROM vk GROUP BY 1, 2")
def classified_events(spark, sf_dir):
    return segments.classify_vad_events(vad_event_rows(spark, sf_dir)).groupBy("stream_id", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {VADEV},
g AS (SELECT *, coalesce(sum(CAST(kind IN ('end', 'complete') AS INT)) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM vk),
o AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN start_ms END IGNORE NULLS) OVER (PARTITION BY stream_id, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM g)
SELECT stream_id, seq, CASE WHEN kind = 'complete' THEN start_ms ELSE coalesce(opened, 0) END AS start_ms, end_ms FROM o WHERE kind IN ('end', 'complete')""")
def paired_events(spark, sf_dir):
    return segments.pair_vad_events(vad_event_rows(spark, sf_dir))


@query(f"WITH {EV}, r AS (SELECT event_id, start_ms, CASE WHEN i % 3 = 0 THEN NULL ELSE start_ms + CAST(floor(value * 1000) AS BIGINT) - 20000 END AS e, start_ms + 250 AS c FROM ev) SELECT event_id, CASE WHEN e IS NULL OR e < start_ms THEN greatest(start_ms, c) ELSE e END AS end_ms FROM r")
def repaired_ends(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumns({"end_ms": F.when(F.col("i") % 3 == 0, F.lit(None)).otherwise(F.col("start_ms") + F.floor(F.col("value") * 1000) - 20_000).cast("long"), "chunk_end_ms": F.col("start_ms") + 250})
    return segments.repair_end(rows).select("event_id", "end_ms")


@query(f"WITH {VADEV} SELECT stream_id, seq, end_ms - start_ms AS length_ms FROM ve WHERE start_ms >= 0 AND end_ms >= start_ms")
def complete_segments(spark, sf_dir):
    return segments.complete_segments(vad_event_rows(spark, sf_dir)).select("stream_id", "seq", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"))


@query(f"WITH {EV}, p AS (SELECT user_id AS audio_id, unnest([[start_ms, start_ms + 5], [start_ms], [start_ms + 9, start_ms + 12]]) AS s, unnest([0, 1, 2]) AS seq, event_id FROM ev) SELECT audio_id, seq, s[1] AS start_ms, s[2] AS end_ms FROM p WHERE len(s) >= 2")
def exploded_segments(spark, sf_dir):
    at = F.col("start_ms")
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("audio_id"), F.array(F.array(at, at + 5), F.array(at), F.array(at + 9, at + 12)).alias("segments"))
    return segments.explode_segments(rows)


# --- samples ----------------------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT vec_id, unnest(range(0, 64, 10)) AS s, embedding AS e FROM embeddings),
x AS (SELECT vec_id, s, unnest(e[s + 1 : s + 20]) AS v FROM f)
SELECT vec_id, CAST(s // 10 AS INT) AS frame_idx, {fixed_sql('10 * log10(greatest(avg(CAST(v AS DOUBLE) * v), 1e-12))', 5)} AS db FROM x GROUP BY 1, 2""")
def frame_levels_mean(spark, sf_dir):
    return energy_vad.frame_levels(embeddings(spark, sf_dir), "mean", 20, 10, "vec_id").withColumn("db", fixed(F.col("db"), 5))


@query(f"""WITH f AS (SELECT vec_id, unnest(range(0, 49, 8)) AS s, embedding AS e FROM embeddings),
x AS (SELECT vec_id, s, unnest(e[s + 1 : s + 16]) AS v FROM f)
SELECT vec_id, CAST(s // 8 AS INT) AS frame_idx, {fixed_sql('10 * log10(sum(CAST(v AS DOUBLE) * v) + 1e-6)', 5)} AS db FROM x GROUP BY 1, 2""")
def frame_levels_sum(spark, sf_dir):
    return energy_vad.frame_levels(embeddings(spark, sf_dir), "sum", 16, 8, "vec_id").withColumn("db", fixed(F.col("db"), 5))


@query(f"SELECT vec_id, {fixed_sql('list_sum([greatest(-1.0, least(1.0, CAST(x AS DOUBLE) * 5)) for x in embedding])')} AS total FROM embeddings")
def normalized_pcm(spark, sf_dir):
    loud = F.transform("samples", lambda x: x * 5)
    kept = F.transform(audio.normalize_pcm(loud), lambda x: x.cast("double"))
    # float samples: their sum is told to six digits only after going back to the clipped doubles
    clipped = F.transform(loud, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    near = F.forall(F.zip_with(kept, clipped, lambda a, b: F.abs(a - b)), lambda d: d < 1e-7)
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return embeddings(spark, sf_dir).select("vec_id", F.when(near, fixed(total)).alias("total"))


@query(f"SELECT vec_id, 32 AS n, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in embedding]) / 2', 4)} AS total FROM embeddings")
def downmixed(spark, sf_dir):
    mono = audio.downmix(F.col("samples"), F.lit(2), "double")
    return embeddings(spark, sf_dir).select("vec_id", F.size(mono).alias("n"), fixed(F.aggregate(mono, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT vec_id, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in embedding[1:48]])')} AS total FROM embeddings")
def limited_seconds(spark, sf_dir):
    kept = audio.limit_seconds(F.col("samples"), F.lit(16_000), 0.003)
    return embeddings(spark, sf_dir).select("vec_id", fixed(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(l_partkey * 1000.0 / 16000.0, 0) AS BIGINT) AS even_ms, CAST(round(l_partkey * 1000.0 / 16000.0, 0) AS BIGINT) AS away_ms,
CAST(trunc(l_partkey * 1000.0 / 16000.0) AS BIGINT) AS cut_ms, l_partkey * 16 AS samples, l_suppkey + CAST(round_even(l_partkey * 1000.0 / 16000.0, 0) AS BIGINT) AS end_ms FROM lineitem""")
def time_bases(spark, sf_dir):
    n = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", timebase.samples_to_ms(n, 16_000).alias("even_ms"), timebase.samples_to_ms(n, 16_000, "away").alias("away_ms"), timebase.samples_to_ms(n, 16_000, "truncate").alias("cut_ms"), timebase.ms_to_samples(n, 16_000).alias("samples"), timebase.chunk_end_ms(F.col("l_suppkey"), n, 16_000).alias("end_ms")
    )


@query(f"""WITH c AS (SELECT vec_id, unnest(range(0, 4)) AS chunk_id, embedding AS e FROM embeddings)
SELECT vec_id, chunk_id, chunk_id AS start_ms, chunk_id + 1 AS end_ms, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in e[chunk_id * 16 + 1 : chunk_id * 16 + 16]])')} AS total FROM c""")
def audio_chunks(spark, sf_dir):
    rows = clips.chunk_audio(embeddings(spark, sf_dir).withColumn("sample_rate", F.lit(16_000)), 1, "vec_id")
    return rows.select("vec_id", "chunk_id", "start_ms", "end_ms", fixed(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""WITH s AS (SELECT vec_id, vec_id % 5 AS a, vec_id % 5 + vec_id % 3 AS b, embedding AS e FROM embeddings)
SELECT vec_id, least(64, b * 16) - a * 16 AS n, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in e[a * 16 + 1 : b * 16]])')} AS total FROM s WHERE least(64, b * 16) > a * 16""")
def segment_clips(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    segs = rows.select("vec_id", (F.col("vec_id") % 5).alias("start_ms"), (F.col("vec_id") % 5 + F.col("vec_id") % 3).alias("end_ms"))
    out = clips.slice_segments(rows, segs, 16_000, "vec_id")
    return out.select("vec_id", F.size("clip").cast("long").alias("n"), fixed(F.aggregate("clip", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 50 AS hz, CAST(o_custkey AS BIGINT) AS m FROM orders)
SELECT o_orderkey, {fixed_sql('CASE WHEN hz < 1000 THEN hz * 3 / 200 ELSE 15 + ln(hz / 1000) * 27 / ln(6.4) END', 4)} AS mel, {fixed_sql('1127 * ln(1 + hz / 700)', 4)} AS kaldi, {fixed_sql('hz', 4)} AS back, {fixed_sql('hz', 4)} AS kaldi_back,
CAST(floor(m / 160) AS BIGINT) AS frames, CAST(13 * floor(m / 100) + ceil((m % 100) / 8) AS BIGINT) AS tokens FROM t""")
def mel_scales(spark, sf_dir):
    hz, m = F.col("o_totalprice").cast("double") / 50, F.col("o_custkey").cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fixed(audio.hz_to_mel(hz), 4).alias("mel"), fixed(audio.kaldi_mel(hz), 4).alias("kaldi"), fixed(audio.mel_to_hz(audio.hz_to_mel(hz)), 4).alias("back"), fixed(audio.kaldi_mel_inv(audio.kaldi_mel(hz)), 4).alias("kaldi_back"), audio.mel_frames(m).alias("frames"), audio.audio_tokens(m).alias("tokens")
    )


# --- arrays and comparisons ------------------------------------------------------------------------------------------


@query("""SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, list_position(embedding, list_min(embedding)) - 1 AS least,
(SELECT string_agg(i - 1, ',' ORDER BY v DESC, i) FROM (SELECT unnest(embedding) AS v, unnest(range(1, 65)) AS i ORDER BY v DESC, i LIMIT 10)) AS top FROM embeddings""")
def score_ranks(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", arrays.greedy_argmax(F.col("samples")).cast("long").alias("best"), arrays.argmin_first(F.col("samples")).cast("long").alias("least"), F.array_join(F.transform(arrays.top_k(F.col("samples"), 10), lambda i: i.cast("string")), ",").alias("top"))


@query(f"""SELECT vec_id, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in embedding[9:24]]) + 2 * list_sum([CAST(x AS DOUBLE) for x in embedding[1:8]])', 5)} AS joined, {fixed_sql('2 * list_sum([CAST(x AS DOUBLE) for x in embedding])', 5)} AS doubled, 24 AS repeated FROM embeddings""")
def array_work(spark, sf_dir):
    x = F.col("samples")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, 8))
    total = lambda a: F.aggregate(F.flatten(a), F.lit(0.0), lambda s, v: s + v)
    head = arrays.slice_axis1(steps, F.lit(0), F.lit(1))
    joined = arrays.concat_axis1(arrays.concat_axis1(arrays.slice_axis1(steps, F.lit(1), F.lit(3)), head), head)
    return embeddings(spark, sf_dir).select("vec_id", fixed(total(joined), 5).alias("joined"), fixed(F.aggregate(arrays.add(x, x), F.lit(0.0), lambda s, v: s + v), 5).alias("doubled"), F.size(F.flatten(arrays.repeat_axis1(head, 3))).alias("repeated"))


@query(f"SELECT vec_id, {fixed_sql('list_sum([CAST(x AS DOUBLE) for x in embedding[1 : 8 * (1 + vec_id % 8)]])', 5)} AS total, {fixed_sql('list_sum([(CAST(x AS DOUBLE) + 0.5) * 2 for x in embedding])', 5)} AS scaled FROM embeddings")
def trimmed_features(spark, sf_dir):
    x = F.col("samples")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    kept = F.aggregate(F.flatten(arrays.trim_features(steps, mask)), F.lit(0.0), lambda s, v: s + v)
    scaled = arrays.apply_cmvn(x, F.array_repeat(F.lit(0.5), 64), F.array_repeat(F.lit(2.0), 64))
    return embeddings(spark, sf_dir).select("vec_id", fixed(kept, 5).alias("total"), fixed(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v), 5).alias("scaled"))


@query(f"""WITH f AS (SELECT label, vec_id, embedding AS e FROM embeddings),
l AS (SELECT *, {', '.join(f"coalesce({fn}(e, {n}) OVER w, {edge}(e) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {name}" for fn, n, edge, name in (("lag", 2, "first", "a"), ("lag", 1, "first", "b"), ("lead", 1, "last", "d"), ("lead", 2, "last", "g")))} FROM f WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, len(a) + len(b) + len(e) + len(d) + len(g) AS width, {fixed_sql('CAST(a[1] AS DOUBLE) + 2 * CAST(b[2] AS DOUBLE) + 4 * CAST(e[3] AS DOUBLE) + 8 * CAST(d[4] AS DOUBLE) + 16 * CAST(g[5] AS DOUBLE)', 5)} AS probe FROM l""")
def stacked_frames(spark, sf_dir):
    rows = stack_frames(embeddings(spark, sf_dir).withColumnRenamed("samples", "feat"), 5, "label", "vec_id")
    s = F.col("stacked")
    return rows.select("vec_id", F.size(s).cast("long").alias("width"), fixed(s[0] + 2 * s[65] + 4 * s[130] + 8 * s[195] + 16 * s[260], 5).alias("probe"))


@query(f"""WITH t AS (SELECT label, max(list_max(embedding)) AS top FROM embeddings GROUP BY 1)
SELECT vec_id, {fixed_sql('list_sum([(greatest(CAST(x AS DOUBLE) * 20, CAST(top AS DOUBLE) * 20 - 8) + 4) / 4 for x in embedding])', 4)} AS total FROM embeddings JOIN t USING (label)""")
def normalized_logmel(spark, sf_dir):
    rows = embeddings(spark, sf_dir).withColumn("feat", F.transform("samples", lambda x: x * 20))
    return compare.logmel_normalized(rows, "label", "feat").select("vec_id", fixed(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT label, count(*) AS n_rows, 64 AS width, {fixed_sql('avg(list_sum([CAST(x AS DOUBLE) for x in embedding]) / 64)', 5)} AS mean, {fixed_sql('CAST(arg_min(embedding, vec_id)[3] AS DOUBLE)', 5)} AS third FROM embeddings GROUP BY 1")
def feature_statistics(spark, sf_dir):
    rows = compare.feature_stats(embeddings(spark, sf_dir), "label", "samples", "vec_id")
    return rows.select("label", "n_rows", "width", fixed(F.col("mean"), 5).alias("mean"), fixed(F.col("head")[2], 5).alias("third"))


def two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings against themselves to two digits; every tenth lacks its partner, every seventh has a shorter one."""
    a = embeddings(spark, sf_dir).select("label", F.col("vec_id").alias("name"), F.col("samples").alias("values"))
    short = F.when(F.col("name") % 7 == 0, F.slice("values", 1, 60)).otherwise(F.col("values"))
    b = a.where("name % 10 <> 3").withColumn("values", F.transform(short, lambda x: F.round(x, 2)))
    return compare.align_outputs(a, b, ["label", "name"])


TWO = """a AS (SELECT label, vec_id AS name, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
b AS (SELECT label, name, [round(x, 2) for x in CASE WHEN name % 7 = 0 THEN v[1:60] ELSE v END] AS w FROM a WHERE name % 10 <> 3),
ab AS (SELECT label, name, v, w, coalesce(len(v) = len(w), false) AS same_shape FROM a LEFT JOIN b USING (label, name))"""


@query(f"""WITH {TWO}, e AS (SELECT label, name, same_shape, unnest(v) AS x, unnest(w) AS y FROM ab WHERE same_shape),
p AS (SELECT label, name, max(abs(x - y)) AS worst, sum(abs(x - y)) AS total, count(*) AS n, bool_and(abs(x - y) <= abs(y) * 0.005 + 0.005) AS close FROM e GROUP BY 1, 2)
SELECT ab.label, {fixed_sql('max(worst)')} AS max_abs_diff, {fixed_sql('sum(total) / sum(n)')} AS mean_abs_diff, bool_and(same_shape) AS all_finite, bool_and(same_shape AND coalesce(close, false)) AS all_close, count(*) AS n_rows
FROM ab LEFT JOIN p ON ab.label = p.label AND ab.name = p.name GROUP BY 1""")
def compared_outputs(spark, sf_dir):
    rows = compare.compare_outputs(two_outputs(spark, sf_dir), by="label")
    return rows.select("label", fixed(F.col("max_abs_diff")).alias("max_abs_diff"), fixed(F.col("mean_abs_diff")).alias("mean_abs_diff"), "all_finite", "all_close", "n_rows")


@query(f"""WITH {TWO}, i AS (SELECT label, name, v, w, unnest(v) AS x, unnest(w) AS y, unnest(range(0, 64)) AS k FROM ab WHERE same_shape),
r AS (SELECT label, name, k, row_number() OVER (PARTITION BY name ORDER BY x DESC, k) AS ra, row_number() OVER (PARTITION BY name ORDER BY y DESC, k) AS rb FROM i),
s AS (SELECT name, CAST(count(*) FILTER (ra <= 10 AND rb <= 10) AS INT) AS shared, count(*) FILTER (ra = 1 AND rb = 1) = 1 AS same_top FROM r GROUP BY 1)
SELECT name, shared, same_top, same_top AND shared >= 8 AS agrees FROM s""")
def compared_rankings(spark, sf_dir):
    return compare.compare_rankings(two_outputs(spark, sf_dir)).select("name", "shared", "same_top", "agrees")


@query("""WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 100))) AS hi, list_sort(list_distinct(list(event_type) FILTER (value <= 20))) AS lo FROM events GROUP BY 1)
SELECT user_id, list_aggregate([x for x in coalesce(hi, []) if NOT list_contains(coalesce(lo, []), x)], 'string_agg', ',') AS missing, list_aggregate([x for x in coalesce(lo, []) if NOT list_contains(coalesce(hi, []), x)], 'string_agg', ',') AS extra FROM t""")
def contract_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("hi"), F.collect_set(F.when(F.col("value") <= 20, F.col("event_type"))).alias("lo"))
    named = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    return rows.withColumn("d", compare.contract_diff(F.col("hi"), F.col("lo"))).select("user_id", named(F.col("d.missing")).alias("missing"), named(F.col("d.extra")).alias("extra"))


# --- transcripts ------------------------------------------------------------------------------------------------------

CONV = "c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text, CASE WHEN turn % 5 = 4 THEN ' ' ELSE role END AS role FROM conversations)"


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"), F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(F.col("role")).alias("role"))


@query(f"WITH {CONV} SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS text FROM c GROUP BY 1")
def merged_texts(spark, sf_dir):
    return transcripts.merge_texts(conversation_rows(spark, sf_dir), "conv_id", "turn")


@query(f"""WITH {CONV}, n AS (SELECT conv_id, turn, trim(role) AS l, lag(trim(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM c WHERE trim(role) <> ''),
m AS (SELECT conv_id, string_agg(l, ',' ORDER BY turn) AS language FROM n WHERE was IS NULL OR was <> l GROUP BY 1)
SELECT conv_id, coalesce(language, '') AS language FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN m USING (conv_id)""")
def merged_languages(spark, sf_dir):
    return transcripts.merge_languages(conversation_rows(spark, sf_dir), "conv_id", "turn", "role")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN role ELSE 'Forced' END AS language, CASE WHEN turn % 3 = 2 THEN text || '<asr_text>x' ELSE text END AS text FROM conversations""")
def parsed_outputs(spark, sf_dir):
    kind = F.col("turn") % 3
    raw = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("language  "), "role", F.lit(" <asr_text>"), "text")).otherwise(F.concat(F.lit("language de<asr_text>"), "text", F.lit("<asr_text>x")))
    parsed = text.parse_asr_output(raw, F.when(kind == 2, F.lit("Forced")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parsed["language"].alias("language"), parsed["text"].alias("text"))


@query("""WITH m AS (SELECT conv_id, CAST(floor(length(text) * 10 / 160) AS BIGINT) AS m FROM conversations)
SELECT conv_id, CAST(sum(m) AS BIGINT) AS mel_frames, CAST(sum(CAST(13 * floor(m / 100) + ceil((m % 100) / 8) AS BIGINT)) AS BIGINT) AS audio_tokens, count(*) AS n_chunks FROM m GROUP BY 1""")
def chunk_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("mel_frames", audio.mel_frames(F.length("text") * 10))
    return transcripts.chunk_totals(rows.withColumn("audio_tokens", audio.audio_tokens(F.col("mel_frames"))), "conv_id")


@query(f"""SELECT user_id AS audio_id, {fixed_sql("sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END)", 2)} AS vad_ms, {fixed_sql("sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END)", 2)} AS asr_ms, {fixed_sql('sum(value)', 2)} AS total_ms FROM events GROUP BY 1""")
def elapsed_totals(spark, sf_dir):
    view = F.col("event_type") == "view"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("audio_id"), F.when(view, F.col("value")).alias("vad_elapsed_ms"), F.when(~view, F.col("value")).alias("asr_elapsed_ms"))
    out = transcripts.elapsed_totals(rows)
    return out.select("audio_id", *[fixed(F.col(c), 2).alias(c) for c in ("vad_ms", "asr_ms", "total_ms")])


@query(f"WITH {EV} SELECT event_id, {fixed_sql('sum(value) OVER (PARTITION BY user_id ORDER BY i)', 2)} AS value_total FROM ev")
def running_elapsed(spark, sf_dir):
    return transcripts.running_elapsed(event_rows(spark, sf_dir), "user_id", "i", "value").select("event_id", fixed(F.col("value_total"), 2).alias("value_total"))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE upper(lang[1]) || lower(lang[2:]) END AS language FROM documents)
SELECT doc_id, language, coalesce(language IN ('En', 'De'), true) AS kept FROM n""")
def normalized_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit("  ")).when(F.col("doc_id") % 6 == 1, F.upper("lang")).otherwise(F.concat(F.lit(" "), "lang")).alias("language"))
    kept, rejected = transcripts.normalize_language(rows, spark.createDataFrame([("En",), ("De",)], "language string"))
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False))).select("doc_id", "language", "kept")


@query("SELECT d.doc_id, l.quality, b.context FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (SELECT max(item_id) AS context FROM benchmark) b")
def items_with_params(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    items = table(spark, sf_dir, "documents").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    one = table(spark, sf_dir, "benchmark").agg(F.max("item_id").alias("context"))
    return transcripts.with_params(transcripts.with_params(items, labels, "doc_id"), one, "none")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def missing_inputs(spark, sf_dir):
    return transcripts.missing_inputs(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- prompts and texts -----------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT conv_id, turn, text, [trim(x) for x in string_split(replace(text, '，', ','), ',') if trim(x) <> ''] AS words FROM (SELECT conv_id, turn, trim(replace(replace(text, chr(10), ' '), '.', ',')) AS text FROM conversations)),
h AS (SELECT *, CASE WHEN len(words) = 0 THEN 'ctx' ELSE 'ctx' || chr(10) || 'Hot words: ' || array_to_string(words, '、') END AS ctx FROM w)
SELECT conv_id, turn, len(words) AS n_words, md5('<|im_start|>system' || chr(10) || ctx || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<|audio_start|>' || repeat('<|audio_pad|>', turn) || '<|audio_end|><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
|| CASE WHEN turn % 2 = 0 THEN '' ELSE 'language French<asr_text>' END) AS prompt FROM h""")
def prompts(spark, sf_dir):
    said = F.trim(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("."), F.lit(",")))
    rows = table(spark, sf_dir, "conversations").withColumn("words", text.normalize_hotwords(said))
    prompt = text.build_prompt(text.context_with_hotwords(F.lit("ctx"), F.col("words")), F.col("turn"), F.when(F.col("turn") % 2 == 1, F.lit("French")))
    return rows.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.md5(prompt).alias("prompt"))


def hypothesis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six growing prefixes of each conversation turn, the third with a changed head, the others with a changed tail."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("utterance_id"), "text", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("chunk_id"))
    part = F.substring("text", F.lit(1), F.floor(F.length("text") * F.col("chunk_id") / 6).cast("int"))
    changed = F.when(F.col("chunk_id") == 6, part).when((F.col("chunk_id") == 3) & (F.col("utterance_id") % 3 == 0), F.concat(F.lit("#"), part)).otherwise(F.concat(part, F.lit("~"), F.col("chunk_id").cast("string")))
    return rows.select("utterance_id", "chunk_id", changed.alias("text"), (F.col("chunk_id") == 6).alias("is_final"))


HYP = """h0 AS (SELECT conv_id * 100 + turn AS utterance_id, text, unnest(range(1, 7)) AS chunk_id FROM conversations),
h AS (SELECT utterance_id, chunk_id, CASE WHEN chunk_id = 6 THEN p WHEN chunk_id = 3 AND utterance_id % 3 = 0 THEN '#' || p ELSE p || '~' || chunk_id END AS text, chunk_id = 6 AS is_final
      FROM (SELECT utterance_id, chunk_id, substring(text, 1, CAST(floor(length(text) * chunk_id / 6) AS INT)) AS p FROM h0))"""


@query(f"""WITH {HYP}, l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY utterance_id ORDER BY chunk_id), '') AS was FROM h)
SELECT utterance_id, chunk_id, CASE WHEN text <> '' AND starts_with(text, was) THEN substring(text, length(was) + 1) ELSE '' END AS delta, text <> '' AND NOT starts_with(text, was) AS revised FROM l""")
def stream_deltas(spark, sf_dir):
    rows = hypothesis_rows(spark, sf_dir).withColumn("was", F.lag("text").over(Window.partitionBy("utterance_id").orderBy("chunk_id")))
    d = text.stream_delta(F.col("text"), F.col("was"))
    return rows.select("utterance_id", "chunk_id", d["delta"].alias("delta"), d["revised"].alias("revised"))


@query(f"""WITH RECURSIVE {HYP},
f AS (SELECT utterance_id, 0::BIGINT AS chunk_id, '' AS delta, '' AS confirmed, '' AS pending, false AS revised FROM h WHERE chunk_id = 1
UNION ALL
SELECT s.utterance_id, s.chunk_id, d, CASE WHEN r AND is_final THEN text WHEN r THEN '' ELSE confirmed || d END, CASE WHEN r AND is_final THEN '' WHEN r THEN text WHEN text = '' OR is_final THEN '' ELSE substring(rest, n + 1) END, r
FROM (SELECT *, CASE WHEN text = '' OR r THEN '' WHEN is_final THEN rest ELSE substring(rest, 1, n) END AS d
  FROM (SELECT *, coalesce(list_position([substring(pending, k, 1) = substring(rest, k, 1) AND k <= length(pending) AND k <= length(rest) for k in range(1, 1 + greatest(length(pending), length(rest)))], false) - 1, length(pending)) AS n
    FROM (SELECT h.utterance_id, h.chunk_id, h.text, h.is_final, f.confirmed, f.pending, substring(h.text, length(f.confirmed) + 1) AS rest,
      h.text <> '' AND NOT starts_with(h.text, f.confirmed) AND (NOT h.is_final OR f.confirmed <> '' OR f.pending <> '') AS r FROM f JOIN h ON h.utterance_id = f.utterance_id AND h.chunk_id = f.chunk_id + 1))) s)
SELECT utterance_id, chunk_id, delta AS confirmed_delta, md5(confirmed) AS confirmed, md5(pending) AS pending, revised FROM f WHERE chunk_id > 0""")
def tracked_partials(spark, sf_dir):
    rows = partials.track_partials(hypothesis_rows(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("long")))
    return rows.select("utterance_id", "chunk_id", "confirmed_delta", F.md5("confirmed_text").alias("confirmed"), F.md5("pending_text").alias("pending"), "revised")


@query(f"""WITH {HYP}, l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY utterance_id ORDER BY chunk_id), '') AS was FROM h)
SELECT utterance_id, count(*) AS n FROM l WHERE text <> was OR chunk_id = 5 GROUP BY 1""")
def emitted_changes(spark, sf_dir):
    rows = hypothesis_rows(spark, sf_dir).withColumns({"confirmed_delta": F.lit(""), "revised": F.col("chunk_id") == 5})
    return events.emit_changes(rows, order="chunk_id").groupBy("utterance_id").agg(F.count("*").alias("n"))


# --- streams of chunks -----------------------------------------------------------------------------------------------


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks of floor(value) + 1 samples."""
    return event_rows(spark, sf_dir).select(F.col("user_id").alias("stream_id"), F.col("i").alias("chunk_id"), "start_ms", (F.floor("value") + 1).cast("long").alias("n_samples"), "event_id", "event_type", "value")


CHUNK = f"{EV}, ch AS (SELECT user_id AS stream_id, i AS chunk_id, start_ms, CAST(floor(value) + 1 AS BIGINT) AS n_samples, event_id, event_type, value FROM ev)"


@query(f"""WITH {CHUNK}, t AS (SELECT *, sum(n_samples) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS total FROM ch)
SELECT stream_id, chunk_id, CAST(least(total, 1000) AS BIGINT) AS kept, CAST(greatest(0, total - 1000) AS BIGINT) AS trimmed, CAST(sum(CAST(total > 1000 AS INT)) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS BIGINT) AS trim_events FROM t""")
def recompute_windows(spark, sf_dir):
    return asr_windows.asr_windows(chunk_rows(spark, sf_dir), 1000).select("stream_id", "chunk_id", "kept", "trimmed", "trim_events")


@query(f"""WITH {CHUNK}, t AS (SELECT *, sum(n_samples) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS total FROM ch)
SELECT stream_id, CAST(sum(CAST(total > 1000 AS INT)) AS BIGINT) AS trim_events, CAST(arg_max(greatest(0, least(total - 1000, n_samples)), chunk_id) AS BIGINT) AS last_trimmed, CAST(max(greatest(0, total - 1000)) AS BIGINT) AS total_trimmed FROM t GROUP BY 1""")
def trim_totals(spark, sf_dir):
    return asr_windows.trim_counters(chunk_rows(spark, sf_dir), 1000)


@query(f"""WITH {CHUNK}, t AS (SELECT *, sum(n_samples) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS total FROM ch)
SELECT stream_id, chunk_id, CAST(floor(total / 160) - floor((total - n_samples) / 160) AS BIGINT) AS triggered, CAST(total % 160 AS BIGINT) AS buffered FROM t""")
def decode_triggers(spark, sf_dir):
    return asr_windows.decode_triggers(chunk_rows(spark, sf_dir), 160).select("stream_id", "chunk_id", "triggered", "buffered")


@query(f"""WITH {CHUNK}, m AS (SELECT stream_id, start_ms // 86400000 AS minute, chunk_id, start_ms FROM ch WHERE start_ms >= 86400000)
SELECT stream_id, minute, arg_min(chunk_id, start_ms) AS chunk_id, min(start_ms) AS start_ms FROM m GROUP BY 1, 2""")
def progress_marks(spark, sf_dir):
    return events.progress_marks(chunk_rows(spark, sf_dir), 86_400)


@query(f"""WITH {CHUNK}, s AS (SELECT *, sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS begun,
  last_value(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now,
  last_value(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ch)
SELECT stream_id, chunk_id AS result_id, CAST(CASE WHEN now = 1 OR (event_type = 'view' AND was = 1) THEN begun - 1 ELSE -1 END AS BIGINT) AS utterance_id FROM s""")
def numbered_events(spark, sf_dir):
    rows = events.number_events(chunk_rows(spark, sf_dir), order="chunk_id", starts=F.col("event_type") == "click", ends=F.col("event_type") == "view")
    return rows.select("stream_id", F.col("result_id").cast("long").alias("result_id"), "utterance_id")


@query(f"""WITH {PADDED}, c AS (SELECT user_id AS audio_id, i AS chunk_id, start_ms, start_ms + 900000 AS end_ms FROM ev)
SELECT m.audio_id, m.seq, count(*) AS n, CAST(sum(c.chunk_id) AS BIGINT) AS ids FROM merged m JOIN c ON m.audio_id = c.audio_id AND c.start_ms < m.end_ms AND m.start_ms < c.end_ms GROUP BY 1, 2""")
def chunks_in_segments(spark, sf_dir):
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("audio_id"), F.col("i").alias("chunk_id"), "start_ms", (F.col("start_ms") + 900_000).alias("end_ms"))
    met = clips.chunks_in_segments(rows, merged_rows(spark, sf_dir), 3_600_000)
    return met.groupBy("audio_id", "seq").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


@query(f"WITH {CHUNK} SELECT a.stream_id, a.chunk_id AS result_id, coalesce(a.start_ms - b.start_ms, 0) AS latency_ms FROM ch a LEFT JOIN ch b ON a.stream_id = b.stream_id AND b.chunk_id = a.chunk_id - a.chunk_id % 4 AND b.event_type <> 'error'")
def emit_latencies(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    at = F.timestamp_millis("start_ms")
    emitted = rows.select("stream_id", F.col("chunk_id").alias("result_id"), (F.col("chunk_id") - F.col("chunk_id") % 4).alias("trigger_chunk_id"), at.alias("emitted_at"))
    pushed = rows.where("event_type <> 'error'").select("stream_id", "chunk_id", at.alias("pushed_at"))
    return events.emit_latency(emitted, pushed).select("stream_id", "result_id", F.round("emit_latency_ms", 0).cast("long").alias("latency_ms"))


@query(f"""WITH u AS (SELECT event_id AS utterance_id, event_id * 10 AS start_ms, CAST(floor(value * 3) AS BIGINT) AS w, CAST(floor(value * 5) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS b, user_id FROM events),
e AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN start_ms - 1 ELSE start_ms + user_id % 50 END AS end_ms FROM u),
g AS (SELECT *, CASE WHEN end_ms >= start_ms THEN (end_ms - start_ms) * 16 END AS target FROM e)
SELECT utterance_id, CASE WHEN target IS NULL THEN w ELSE greatest(0, w - greatest(0, t - target)) END AS window_samples, CASE WHEN target IS NULL THEN t ELSE least(t, target) END AS total_samples,
CASE WHEN target IS NULL THEN b WHEN t > target THEN 0 ELSE least(b, target - t) END AS buffer_samples FROM g""")
def trimmed_utterances(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("utterance_id"), (F.col("event_id") * 10).alias("start_ms"), F.floor(v * 3).alias("window_samples"), F.floor(v * 5).alias("total_samples"), F.floor(v).alias("buffer_samples"), u)
    ends = rows.where(u % 4 != 0).select("utterance_id", F.when(u % 4 == 1, F.col("start_ms") - 1).otherwise(F.col("start_ms") + u % 50).alias("end_ms"))
    return clips.trim_to_vad_end(rows.drop("user_id"), ends, 16_000).select("utterance_id", "window_samples", "total_samples", "buffer_samples")


@query(f"""WITH {CHUNK}, q AS (SELECT *, event_type = 'click' AS sp FROM ch), r AS (SELECT *, CASE WHEN lag(sp) OVER (PARTITION BY stream_id ORDER BY chunk_id) = sp THEN 0 ELSE 1 END AS turned FROM q),
r2 AS (SELECT *, sum(turned) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS run FROM r),
k AS (SELECT stream_id, run + 1 AS run, sum(n_samples) AS n, sum(n_samples * value) AS z FROM r2 WHERE NOT sp GROUP BY 1, 2)
SELECT r2.stream_id, r2.chunk_id, CAST(least(300, coalesce(k.n, 0)) AS INT) AS n FROM r2 LEFT JOIN k USING (stream_id, run) WHERE sp AND turned = 1""")
def pre_rolls(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).withColumns({"pcm": F.array_repeat(F.lit(0.5).cast("float"), F.col("n_samples").cast("int")), "in_speech": F.col("event_type") == "click"})
    return asr_windows.with_preroll(rows, 300).where("pre_roll is not null").select("stream_id", "chunk_id", F.size("pre_roll").alias("n"))


@query(f"""WITH t AS (SELECT vec_id // 8 AS item_id, vec_id % 8 AS pos, embedding AS e FROM embeddings),
p AS (SELECT *, pos % 3 = 1 AS is_audio, CASE WHEN pos % 3 = 1 THEN row_number() OVER (PARTITION BY item_id, pos % 3 = 1 ORDER BY pos) - 1 END AS k FROM t),
f AS (SELECT item_id, pos AS k, e FROM t WHERE pos < 2 + item_id % 2),
n AS (SELECT p.item_id, count(*) FILTER (is_audio) = (SELECT count(*) FROM f WHERE f.item_id = p.item_id) AS fits FROM p GROUP BY 1)
SELECT p.item_id, p.pos, n.fits, {fixed_sql('CAST((CASE WHEN is_audio THEN f.e ELSE p.e END)[1] AS DOUBLE)', 5)} AS first FROM p LEFT JOIN f ON p.item_id = f.item_id AND p.k = f.k JOIN n ON n.item_id = p.item_id""")
def merged_audio_features(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("item_id"), (F.col("vec_id") % 8).alias("pos"), F.col("samples").alias("embed"))
    feats = rows.where(F.col("pos") < 2 + F.col("item_id") % 2).select("item_id", F.col("pos").cast("int").alias("k"), F.col("embed").alias("feat"))
    out = merge_audio_features(rows, feats, F.col("pos") % 3 == 1)
    return out.select("item_id", "pos", "fits", fixed(F.col("embed")[0], 5).alias("first"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "tumbling", "1 day", None)


@query("""WITH e AS (SELECT user_id, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * unnest(range(0, 4))) AS window_start FROM events)
SELECT user_id, window_start, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM e GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "sliding", "24 hours", "6 hours")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS window_start, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "session", "12 hours", None)


def _windows(spark, sf_dir, kind, length, hop):
    rows = table(spark, sf_dir, "events").withColumn("n_samples", F.floor("value"))
    return windowed(rows, kind, length, hop, "user_id", "ts").select("user_id", "window_start", "n", "total")


@query(f"""WITH {CHUNK}, f AS (SELECT *, chunk_id % 40 = 39 AS is_final FROM ch), l AS (SELECT stream_id, min(chunk_id) FILTER (is_final) AS last FROM f GROUP BY 1)
SELECT stream_id, count(*) FILTER (chunk_id > last) AS late, count(*) AS n FROM f JOIN l USING (stream_id) GROUP BY 1""")
def late_chunks(spark, sf_dir):
    rows = late_rows(chunk_rows(spark, sf_dir).withColumn("is_final", F.col("chunk_id") % 40 == 39), "error")
    return rows.groupBy("stream_id").agg(F.count(F.when(F.col("late"), 1)).alias("late"), F.count("*").alias("n"))


# --- event rows and logs ---------------------------------------------------------------------------------------------


def result_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all kinds from the chunk stream, as one table with metadata."""
    rows = chunk_rows(spark, sf_dir)
    meta = F.create_map(F.lit("samples"), F.col("n_samples").cast("string"), F.lit("flag"), (F.col("chunk_id") % 2 == 0).cast("string"))
    more = F.create_map(F.lit("flag"), F.lit("false"), F.lit("kind"), F.col("event_type"))
    base = rows.select("stream_id", F.col("chunk_id").alias("result_id"), "start_ms", text.merge_metadata(meta, F.when(F.col("chunk_id") % 5 == 0, more).otherwise(F.create_map().cast("map<string,string>"))).alias("metadata"), "event_type")
    starts = base.where("event_type = 'click'").withColumn("event_type", F.lit("speech_start"))
    ends = base.where("event_type = 'view'").withColumns({"event_type": F.lit("speech_end"), "end_ms": F.col("start_ms") + 5})
    rest = base.where("event_type not in ('click', 'view')").withColumns({"text": F.col("event_type"), "event_type": F.lit("partial")})
    return events.union_events(starts, ends, rest).withColumn("utterance_id", F.lit(0))


@query(f"""WITH {CHUNK} SELECT '[' || CASE event_type WHEN 'click' THEN 'speech_start' WHEN 'view' THEN 'speech_end' ELSE 'partial' END || '] utt=0 rid=' || chunk_id || ' start=' || start_ms || 'ms' || CASE WHEN event_type = 'view' THEN ' end=' || (start_ms + 5) || 'ms' ELSE '' END
|| ' flag=' || CASE WHEN chunk_id % 5 = 0 THEN 0 ELSE CAST(chunk_id % 2 = 0 AS INT) END || ' samples=' || n_samples || CASE WHEN event_type IN ('click', 'view') THEN '' ELSE ' text="' || event_type || '"' END AS line FROM ch""")
def event_log_lines(spark, sf_dir):
    return events.render_event_log(result_events(spark, sf_dir), ["flag", "absent", "samples"])


@query(f"""WITH {PADDED}, f AS (SELECT user_id AS audio_id, (SELECT count(*) FROM merged m WHERE m.audio_id = user_id) AS n FROM (SELECT DISTINCT user_id FROM ev)),
s AS (SELECT m.audio_id, m.seq, f.n FROM merged m JOIN f USING (audio_id))
SELECT audio_id, 'run_start' AS step, CAST(NULL AS BIGINT) AS seq, 0 AS n, n AS n_total FROM f UNION ALL SELECT audio_id, 'vad_done', NULL, n, n FROM f UNION ALL SELECT audio_id, 'run_done', NULL, n, n FROM f
UNION ALL SELECT audio_id, 'segment_start', seq, seq + 1, n FROM s UNION ALL SELECT audio_id, 'segment_done', seq, seq + 1, n FROM s""")
def progress_events(spark, sf_dir):
    files = event_rows(spark, sf_dir).select(F.col("user_id").alias("audio_id")).distinct()
    return events.progress_events(files, merged_rows(spark, sf_dir))


@query("SELECT conv_id, turn, length(text) AS full_text_chars, length(role) AS pending_text_chars, CAST(round_even(turn * 24 * 1000.0 / 16000.0, 0) AS BIGINT) AS pre_roll_ms FROM conversations")
def event_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("full_text"), F.col("role").alias("pending_text"), (F.col("turn") * 24).alias("pre_roll_samples"))
    return events.event_counters(rows, 16_000).select("conv_id", "turn", "full_text_chars", "pending_text_chars", "pre_roll_ms")


@query("""WITH v AS (SELECT p_partkey AS id, p_name AS token FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT l_orderkey, l_linenumber, p_name AS token FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey * 10 + l_linenumber AS item_id, count(m.id) > 0 AS known FROM w LEFT JOIN (SELECT token, min(id) AS id FROM v GROUP BY 1) m ON w.token = m.token GROUP BY 1""")
def token_lookups(spark, sf_dir):
    from speechlake.operators.tokens import tokens_to_ids

    parts = table(spark, sf_dir, "part")
    vocab = parts.where("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("token")).agg(F.min("p_partkey").alias("id"))
    items = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.array("p_name").alias("tokens"))
    known, unknown = tokens_to_ids(items, vocab)
    return known.select("item_id", F.lit(True).alias("known")).union(unknown.select("item_id", F.lit(False))).groupBy("item_id").agg(F.max("known").alias("known"))


@query("""SELECT o_orderkey AS item_id, count(p_name) AS n, md5(coalesce(string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey), '')) AS tokens FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 GROUP BY 1""")
def tokens_of_ids(spark, sf_dir):
    """Each order's parts as ids, looked up again: every third is unknown and skipped, every seventh special and left out."""
    from speechlake.operators.tokens import ids_to_tokens

    parts, lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("token")), table(spark, sf_dir, "lineitem")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    ids = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.transform(ordered, lambda x: x["l_partkey"]).alias("ids"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")).join(ids, "item_id", "left")
    rows = ids_to_tokens(items, parts.where("id % 3 <> 0"), parts.where("id % 7 = 0"))
    return rows.select("item_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", "|")).alias("tokens"))


@query(f"""WITH {EV}, a AS (SELECT user_id AS stream_id, i AS chunk_id, start_ms, (start_ms + (i * 7919 + user_id * 104729) % 172800000) // 43200000 AS batch FROM ev),
n AS (SELECT batch, max(max(start_ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS watermark FROM a GROUP BY batch),
l AS (SELECT a.*, start_ms < greatest(0, coalesce(watermark, 0)) AS late FROM a JOIN n USING (batch))
SELECT stream_id, chunk_id, batch, late, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY stream_id, late ORDER BY start_ms, chunk_id) - 1 END AS place FROM l""")
def reordered_chunks(spark, sf_dir):
    """Each event as a chunk that arrives up to two days late, in batches of twelve hours, behind a reorder buffer of a day."""
    rows = event_rows(spark, sf_dir).select(F.col("user_id").alias("stream_id"), F.col("i").alias("chunk_id"), "start_ms")
    arrival = F.col("start_ms") + (F.col("chunk_id") * 7919 + F.col("stream_id") * 104_729) % 172_800_000
    return stored_arrivals(rows.withColumn("batch", F.floor(arrival / 43_200_000)), 86_400_000).drop("start_ms")
