"""Streaming queries over chunks, their replay over stored chunks, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechlake.operators.workers import once
from speechlake.options import StreamOptions
from speechlake.streaming.session import SAVED, Session

CHUNKS = "stream_id string, chunk_id bigint, start_ms bigint, end_ms bigint, pcm array<float>, is_final boolean, pushed_at timestamp"
EVENTS = "stream_id string, result_id bigint, event_type string, utterance_id bigint, trigger_chunk_id bigint, start_ms bigint, end_ms bigint, text string, confirmed_delta string, confirmed_text string, pending_text string, error string"
#: Makes a scorer, model and tokenizer (None: roll back by code points).  It runs once in a Python worker, for all streams there.
Loader = Callable[[], dict]


def read_chunk_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _columns() -> list[str]:
    return [c.split()[0] for c in EVENTS.split(", ")]


def _push(session: Session, stream_id: str | None, c) -> list[dict]:
    pcm = np.zeros(0, np.float32) if c.pcm is None else np.asarray(c.pcm, np.float32)
    return [x | {"stream_id": stream_id} for x in session.push(int(c.chunk_id), int(c.start_ms), pcm, bool(c.is_final))]


def event_frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=_columns())
    return df.astype({c: "Int64" for c in ("result_id", "utterance_id", "trigger_chunk_id", "start_ms", "end_ms")})


def replay(chunks: DataFrame, load: Loader, options: StreamOptions = StreamOptions()) -> DataFrame:
    """Event rows of stored chunks: each stream from its first chunk to its last, in order.

    Streams are sorted within partitions and pass by chunk by chunk; a task holds one session and one batch, however long a
    stream is.  A scorer or model that fails gives its stream one error row; other streams go on.
    """
    load = once(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, now = None, None
        for pdf in batches:
            out: list[dict] = []
            for c in pdf.itertuples():
                stream_id = c.stream_id if isinstance(c.stream_id, str) else None
                if session is None or stream_id != now:
                    session, now = Session(options=options, **load()), stream_id
                out += _push(session, stream_id, c)
            yield event_frame(out)

    rows = chunks.select("stream_id", "chunk_id", "start_ms", "pcm", "is_final")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "start_ms", "chunk_id").mapInPandas(run, EVENTS)


def _limits(*ms: int) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if any(ms) else GroupStateTimeout.NoTimeout


def stream_events(chunks: DataFrame, load: Loader, options: StreamOptions = StreamOptions(), timeout_ms: int = 0, ended_ms: int = 0) -> DataFrame:
    """The same rows from a stream of chunks, with a session's state kept per stream.

    Chunks of one stream must arrive in order of start_ms from batch to batch (else see ``ordered_events``); within a batch they are sorted.  The end marker
    closes a stream; with ``timeout_ms`` one that sends nothing for so long is closed too, and its state dropped.  Of a closed
    stream only a mark stays, with ``ended_ms`` for so long after its last chunk, else with the checkpoint: till then what it still sends is
    an error row, later a new stream.

    While a time limit runs Spark always plans another batch, so a query with one doesn't end by itself; a run over what is there
    (``availableNow``) ends only without.
    """
    load = once(load)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = {"options": options, **load()}
        session = Session.load(state.get, **given) if state.exists else Session(**given)
        if state.hasTimedOut:
            state.remove()
            yield event_frame([x | {"stream_id": key[0]} for x in session.timed_out()])
            return
        pdf = pd.concat(frames).sort_values(["start_ms", "chunk_id"], kind="stable")
        yield event_frame([x for c in pdf.itertuples() for x in _push(session, key[0], c)])
        state.update(session.save())
        wait = ended_ms if session.finished else timeout_ms
        if wait:
            state.setTimeoutDuration(wait)

    return chunks.groupBy("stream_id").applyInPandasWithState(run, EVENTS, SAVED, "append", _limits(timeout_ms, ended_ms))


ROUTED = "stream_id string, chunk_id bigint, start_ms bigint, n_samples bigint, late string"


def routed_chunks(chunks: DataFrame, delay_ms: int | None = None, ended_ms: int = 0) -> DataFrame:
    """(stream_id, chunk_id, start_ms, n_samples, late) of a stream of chunks (stream_id, chunk_id, start_ms, n_samples, is_final).

    ``late`` is null for a chunk in time, ``ended`` for one that starts after its stream's end marker, and ``behind`` for one that
    starts more than ``delay_ms`` before the newest of the batches so far, its own included; nothing is dropped, so ``where("late is not null")`` is the
    reject output.  State is two numbers per stream, dropped ``ended_ms`` after the last chunk of an ended one (0: never).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, end = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(frames)
        ends = pdf.loc[pdf["is_final"].fillna(False).astype(bool), "start_ms"]
        end = min([x for x in (end, *ends.tolist()) if x is not None], default=None)
        newest = max(x for x in (newest, int(pdf["start_ms"].max())) if x is not None)
        late = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
        if delay_ms is not None:
            late[pdf["start_ms"] < newest - delay_ms] = "behind"
        if end is not None:
            late[pdf["start_ms"] > end] = "ended"
        state.update((newest, None if end is None else int(end)))
        if end is not None and ended_ms:
            state.setTimeoutDuration(ended_ms)
        yield pdf[["chunk_id", "start_ms", "n_samples"]].assign(stream_id=key[0], late=late)[[c.split()[0] for c in ROUTED.split(", ")]]

    return chunks.groupBy("stream_id").applyInPandasWithState(run, ROUTED, "newest bigint, ended bigint", "append", _limits(ended_ms))


def with_event_time(chunks: DataFrame, epoch: str = "1970-01-01") -> DataFrame:
    """Adds event_time: the chunk's start after ``epoch``."""
    return chunks.withColumn("event_time", F.timestamp_millis(F.unix_millis(F.lit(epoch).cast("timestamp")) + F.col("start_ms")))


def late_rows(chunks: DataFrame, policy: str = "drop", delay: str = "10 seconds", delay_ms: int = 10_000) -> DataFrame:
    """What to do with chunks that come too late.

    ``drop``: rows later than the watermark are left to the windows to drop.  ``error``: rows that start after a stream's end
    marker are flagged.  ``behind``: rows that start more than ``delay_ms`` before the newest one with a chunk_id up to theirs are.
    The last two work on stored chunks; for a stream see ``routed_chunks``.
    """
    if policy == "drop":
        return chunks.withWatermark("event_time", delay)
    if policy == "error":
        ends = chunks.where("is_final").groupBy("stream_id").agg(F.min(F.struct("start_ms", "chunk_id")).alias("last"))
        late = F.coalesce(F.struct("start_ms", "chunk_id") > F.col("last"), F.lit(False))
        return chunks.join(ends, "stream_id", "left").withColumn("late", late).drop("last")
    if policy != "behind":
        raise ValueError("policy must be drop, error or behind")
    newest = F.max("start_ms").over(Window.partitionBy("stream_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("late", F.col("start_ms") < newest - delay_ms)


def windowed(df: DataFrame, kind: str, length: str, hop: str | None = None, key: str = "stream_id", time: str = "event_time", value: str = "n_samples") -> DataFrame:
    """(key, window_start, window_end, n, total) over tumbling, sliding or session windows; works on streams with a watermark."""
    if kind not in ("tumbling", "sliding", "session"):
        raise ValueError("kind must be tumbling, sliding or session")
    w = F.session_window(time, length) if kind == "session" else F.window(time, length, hop if kind == "sliding" else length)
    out = df.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")
