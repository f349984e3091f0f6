"""Bounds of the audio that streaming recognition sees; audio itself is never copied here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _upto(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def asr_windows(chunks: DataFrame, longest: int, key: str = "stream_id", order: str = "chunk_id", n: str = "n_samples") -> DataFrame:
    """Adds total, kept, trimmed, window_start and trim_events after each append: the window is the last ``longest`` samples."""
    w = _upto(key, order)
    df = chunks.withColumn("total", F.sum(n).over(w))
    df = df.withColumns({"kept": F.least("total", F.lit(longest)), "trimmed": F.greatest(F.lit(0), F.col("total") - longest), "window_start": F.greatest(F.lit(0), F.col("total") - longest)})
    return df.withColumn("trim_events", F.sum(((F.col("total") > longest) & (F.col(n) > 0)).cast("long")).over(w))


def trim_counters(chunks: DataFrame, longest: int, key: str = "stream_id", order: str = "chunk_id", n: str = "n_samples") -> DataFrame:
    """(key, trim_events, last_trimmed, total_trimmed) at the end of each stream: in closed form from running totals."""
    df = asr_windows(chunks, longest, key, order, n)
    own = F.greatest(F.lit(0), F.least(F.col("total") - longest, F.col(n)))
    return df.withColumn("own", own).groupBy(key).agg(F.max("trim_events").alias("trim_events"), F.max_by("own", order).alias("last_trimmed"), F.max("trimmed").alias("total_trimmed"))


def decode_triggers(feeds: DataFrame, step: int, key: str = "stream_id", order: str = "chunk_id", n: str = "n_samples") -> DataFrame:
    """Adds fed, triggered (decodes that this feed sets off) and buffered (samples left) for a decode every ``step`` samples."""
    fed = F.sum(n).over(_upto(key, order))
    df = feeds.withColumn("fed", fed)
    return df.withColumns({"triggered": F.floor(F.col("fed") / step) - F.floor((F.col("fed") - F.col(n)) / step), "buffered": F.col("fed") % step})


def with_preroll(chunks: DataFrame, pre_roll: int, key: str = "stream_id", order: str = "chunk_id") -> DataFrame:
    """Adds pre_roll (samples) to the chunks where speech starts: the last ``pre_roll`` samples before, since the speech before ended.

    ``chunks``: key, order, pcm, in_speech.  A chunk in speech empties the store; each run of silent chunks fills it anew.
    """
    w = Window.partitionBy(key).orderBy(order)
    turned = F.when(F.lag("in_speech").over(w) == F.col("in_speech"), 0).otherwise(1)
    df = chunks.withColumn("turned", turned)
    df = df.withColumn("run", F.sum("turned").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # only the chunks at the end of a silent run that the pre-roll reaches into are collected
    back = Window.partitionBy(key, "run").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    quiet = df.where(~F.col("in_speech")).withColumn("after", F.coalesce(F.sum(F.size("pcm")).over(back), F.lit(0))).where(F.col("after") < pre_roll)
    kept = quiet.groupBy(key, (F.col("run") + 1).alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "pcm"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda x: x["pcm"]))
    kept = kept.select(key, "run", whole.alias("whole")).select(key, "run", F.slice("whole", F.greatest(F.lit(1), F.size("whole") - pre_roll + 1), F.lit(pre_roll)).alias("kept"))
    df = df.join(kept, [key, "run"], "left")
    starts = F.col("in_speech") & (F.col("turned") == 1)
    return df.withColumn("pre_roll", F.when(starts, F.coalesce("kept", F.array().cast("array<float>")))).drop("kept", "run", "turned")
