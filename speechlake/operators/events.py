"""Result events: numbering, counters, latency, union, and log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.functions.text import project_metadata
from speechlake.functions.timebase import samples_to_ms


def number_events(df: DataFrame, key: str = "stream_id", order: str = "seq", starts: Column | None = None, ends: Column | None = None) -> DataFrame:
    """Adds result_id (0.. in emit order) and utterance_id (0.. per speech start; -1 outside speech, the end row still inside)."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("event_type") == "speech_start" if starts is None else starts
    ends = F.col("event_type") == "speech_end" if ends is None else ends
    begun = F.sum(starts.cast("long")).over(upto)
    last = F.last(F.when(starts, F.lit(1)).when(ends, F.lit(0)), ignorenulls=True)
    inside = (F.coalesce(last.over(upto), F.lit(0)) == 1) | (ends & (F.coalesce(last.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1))
    return df.withColumns({"result_id": F.row_number().over(w) - 1, "utterance_id": F.when(inside, begun - 1).otherwise(F.lit(-1))})


def emit_changes(df: DataFrame, mode: str = "changed", key: str = "utterance_id", order: str = "seq") -> DataFrame:
    """Partials worth emitting: new confirmed text, a text that differs from the one before, or a revision; or (``pending``) pending text."""
    if mode == "pending":
        return df.where("pending_text <> ''")
    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("before", F.coalesce(before, F.lit(""))).where("confirmed_delta <> '' or text <> before or revised").drop("before")


def event_counters(df: DataFrame, rate: int) -> DataFrame:
    """Adds text lengths in code points and ms equivalents of sample counts."""
    chars = {f"{c}_chars": F.char_length(F.coalesce(c, F.lit(""))) for c in ("full_text", "confirmed_delta", "confirmed_text", "pending_text") if c in df.columns}
    times = {c.replace("_samples", "_ms"): samples_to_ms(F.col(c), rate) for c in df.columns if c.endswith("_samples")}
    return df.withColumns(chars | times)


def union_events(*dfs: DataFrame) -> DataFrame:
    """One event table; columns that a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def emit_latency(events: DataFrame, chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """Adds emit_latency_ms: from the push of the chunk that caused the event (trigger_chunk_id) to its emission; 0 without a chunk."""
    pushed = chunks.select(key, F.col("chunk_id").alias("trigger_chunk_id"), "pushed_at")
    ms = (F.col("emitted_at").cast("double") - F.col("pushed_at").cast("double")) * 1000
    return events.join(pushed, [key, "trigger_chunk_id"], "left").withColumn("emit_latency_ms", F.coalesce(ms, F.lit(0.0)))


def progress_marks(chunks: DataFrame, every_s: int = 60, key: str = "stream_id") -> DataFrame:
    """(key, minute, chunk_id, start_ms): the first chunk that starts in each bucket, from the first full one on."""
    rows = chunks.withColumn("minute", F.floor(F.col("start_ms") / (every_s * 1000))).where("minute >= 1")
    first = F.min(F.struct("start_ms", "chunk_id"))
    return rows.groupBy(key, "minute").agg(first.alias("m")).select(key, "minute", F.col("m.chunk_id"), F.col("m.start_ms"))


def progress_events(files: DataFrame, segments: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, step, seq, n, n_total): run start, detection done, each segment's start and end, and run done."""
    counted = segments.groupBy(key).agg(F.count("*").alias("n_total"))
    base = files.select(key).join(counted, key, "left").withColumn("n_total", F.coalesce("n_total", F.lit(0)))
    rows = lambda df, step, seq, n: df.select(key, F.lit(step).alias("step"), seq.cast("long").alias("seq"), n.cast("long").alias("n"), F.col("n_total").cast("long").alias("n_total"))
    each = segments.select(key, "seq").join(counted, key)
    none = F.lit(None)
    return union_events(rows(base, "run_start", none, F.lit(0)), rows(base, "vad_done", none, F.col("n_total")), rows(each, "segment_start", F.col("seq"), F.col("seq") + 1), rows(each, "segment_done", F.col("seq"), F.col("seq") + 1), rows(base, "run_done", none, F.col("n_total")))


def render_event_log(events: DataFrame, keys: list[str]) -> DataFrame:
    """(line): [type] utt=.. rid=.. start=..ms end=..ms, then the listed metadata keys that exist, then the quoted text if any."""
    part = lambda name, c, unit="": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string"), F.lit(unit)))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit('text="'), F.col("text"), F.lit('"')))
    more = F.array_join(project_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")), keys), " ")
    return events.select(F.concat_ws(" ", F.concat(F.lit("["), "event_type", F.lit("]")), part("utt", "utterance_id"), part("rid", "result_id"), part("start", "start_ms", "ms"), part("end", "end_ms", "ms"), F.when(more != "", more), text).alias("line"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, errors): rows with an ``error`` go to (key columns kept) error events."""
    return df.where("error is null").drop("error"), df.where("error is not null")
