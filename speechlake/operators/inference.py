"""Calling models that the caller supplies, loaded once in a worker, and cutting audio that is too long for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from speechlake.operators.workers import once

LONGEST_SECONDS, SHORTEST_SECONDS = 1200.0, 0.5


def balanced(df: DataFrame, parts: int, samples: str = "samples") -> DataFrame:
    """Rows dealt to ``parts`` partitions by a hash of each row, so that total lengths even out, whatever the order they came in."""
    return df.withColumn("_n", F.size(samples)).repartition(parts, F.xxhash64("_n", F.monotonically_increasing_id())).drop("_n")


def transcribe_segments(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], on_error: str = "raise", worker: str = "asr") -> DataFrame:
    """Adds raw_text, elapsed_ms and error to each row.

    The model is made once in a worker; it gets rows and returns raw_text and elapsed_ms for them in order.  With
    ``on_error="row"`` the rows of a call that fails are tried one by one, and one that fails then has ``worker: message`` in error
    instead of ending the job.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error must be raise or row")
    make_model = once(make_model)
    out = StructType([*df.schema.fields, StructField("raw_text", StringType()), StructField("elapsed_ms", DoubleType()), StructField("error", StringType())])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            try:
                got = model(pdf)
                yield pdf.assign(raw_text=got["raw_text"].to_numpy(), elapsed_ms=got["elapsed_ms"].to_numpy(), error=None)
                continue
            except Exception:
                if on_error == "raise":
                    raise
            texts, times, errors = [], [], []
            for i in range(len(pdf)):
                try:
                    got = model(pdf.iloc[i : i + 1])
                    texts.append(got["raw_text"].iloc[0])
                    times.append(got["elapsed_ms"].iloc[0])
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    times.append(None)
                    errors.append(f"{worker}: {e}")
            yield pdf.assign(raw_text=texts, elapsed_ms=pd.array(times, "Float64").astype(object), error=errors)

    return df.mapInPandas(rows, out)


def quiet_cut(x: np.ndarray, longest: int, around: int, width: int) -> int:
    """Where audio of more than ``longest`` samples is cut first: at the quietest sample of the quietest ``width`` samples near the limit."""
    left, right = max(0, longest - around), min(len(x), longest + around)
    if right - left <= width:
        return min(max(longest, 1), len(x))
    level = np.abs(x[left:right].astype(np.float64))
    total = np.concatenate(([0.0], np.cumsum(level)))
    first = int(np.argmin(total[width:] - total[:-width]))
    return min(max(left + first + int(np.argmin(level[first : first + width])), 1), len(x))


def _lengths(rate: int, longest_s: float, around_s: float, quiet_s: float) -> tuple[int, int, int]:
    return int(longest_s * rate), int(around_s * rate), max(4, int(quiet_s * rate))


def quiet_cuts(x: np.ndarray, rate: int, longest_s: float = LONGEST_SECONDS, around_s: float = 5.0, quiet_s: float = 0.1) -> list[int]:
    """Where long audio is cut: at quiet samples near each limit; 0 and the end included."""
    lengths, cuts = _lengths(rate, longest_s, around_s, quiet_s), [0]
    while len(x) - cuts[-1] > lengths[0]:
        cuts.append(cuts[-1] + quiet_cut(x[cuts[-1] : cuts[-1] + lengths[0] + lengths[1]], *lengths))
    return [*cuts, len(x)]


def split_long_audio(audio: DataFrame, longest_s: float = LONGEST_SECONDS, shortest_s: float = SHORTEST_SECONDS, around_s: float = 5.0, key: str = "audio_id", on_error: str = "raise") -> DataFrame:
    """(key, piece, offset, samples): recordings over the limit cut at quiet places, short pieces padded with zeros.  Rows: key, sample_rate, samples.

    With ``on_error="row"`` there is a column error too, and a recording without a usable rate is one row with ``split: message`` there.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error must be raise or row")
    kind, with_error = audio.schema[key].dataType.simpleString(), on_error == "row"
    names = [key, "piece", "offset", "samples", *(["error"] if with_error else [])]

    def row(batch, i, piece, offset, samples, error):
        values = [pa.array([batch.column(0)[i].as_py()], batch.schema.field(0).type), pa.array([piece], pa.int64()), pa.array([offset], pa.int64()), pa.array([samples], pa.list_(pa.float32())), pa.array([error], pa.string())]
        return pa.RecordBatch.from_arrays(values[: len(names)], names)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    x = batch.column(2)[i]
                    x = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) else np.zeros(0, np.float32)
                    rate = batch.column(1)[i].as_py()
                    if not rate or rate < 0:
                        raise ValueError(f"sample rate {rate}")
                    cuts = quiet_cuts(x, rate, longest_s, around_s)
                except Exception as e:
                    if not with_error:
                        raise
                    yield row(batch, i, None, None, None, f"split: {e}")
                    continue
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    yield row(batch, i, k, a, np.pad(x[a:b], (0, max(0, int(shortest_s * rate) - (b - a)))), None)

    schema = f"{key} {kind}, piece long, offset long, samples array<float>" + (", error string" if with_error else "")
    return audio.select(key, "sample_rate", F.col("samples").cast("array<float>").alias("samples")).mapInArrow(rows, schema)


def split_long_pieces(pieces: DataFrame, longest_s: float = LONGEST_SECONDS, shortest_s: float = SHORTEST_SECONDS, around_s: float = 5.0, key: str = "audio_id", offset: str = "offset") -> DataFrame:
    """The rows of ``split_long_audio`` from recordings that come in pieces (key, sample_rate, ``offset``, samples) which follow one another.

    A recording's pieces pass by in order in one task.  It holds what came since the last cut, and cuts as soon as what a cut looks
    at is there, so never more than a row that it gives and one that it gets, however long the recording is.
    """
    kind = pieces.schema[key].dataType.simpleString()

    def rows(batches):
        now, like = None, None

        def told(final: bool):
            """Cuts what can be cut; at the end of the recording, all."""
            lengths = _lengths(now["rate"], longest_s, around_s, 0.1)
            while now["n"] > lengths[0] and (final or now["n"] >= lengths[0] + lengths[1]):
                x = np.concatenate(now["held"])
                at = quiet_cut(x[: lengths[0] + lengths[1]], *lengths)
                yield given(x[:at])
                now.update(held=[x[at:]], n=len(x) - at, piece=now["piece"] + 1, at=now["at"] + at)
            if final:
                yield given(np.concatenate([*now["held"], np.zeros(0, np.float32)]))

        def given(x):
            values = [pa.array([now["key"]], like), pa.array([now["piece"]], pa.int64()), pa.array([now["at"]], pa.int64())]
            return pa.RecordBatch.from_arrays([*values, pa.array([np.pad(x, (0, max(0, int(shortest_s * now["rate"]) - len(x))))], pa.list_(pa.float32()))], [key, "piece", "offset", "samples"])

        for batch in batches:
            like = batch.schema.field(0).type
            keys, rates, offsets = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                x = batch.column(3)[i]
                x = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) else np.zeros(0, np.float32)
                if now is None or keys[i] != now["key"]:
                    if now is not None:
                        yield from told(True)
                    if not rates[i] or rates[i] < 0:
                        raise ValueError(f"sample rate {rates[i]}")
                    now = {"key": keys[i], "rate": rates[i], "held": [], "n": 0, "piece": 0, "at": 0}
                if offsets[i] != now["at"] + now["n"]:
                    raise ValueError("pieces that don't follow one another")
                now["held"].append(x)
                now["n"] += len(x)
                yield from told(False)
        if now is not None:
            yield from told(True)

    rows_in = pieces.select(F.col(key), F.col("sample_rate").cast("int"), F.col(offset).cast("long").alias("offset"), F.col("samples").cast("array<float>").alias("samples"))
    return rows_in.repartition(key).sortWithinPartitions(key, "offset", F.size("samples")).mapInArrow(rows, f"{key} {kind}, piece long, offset long, samples array<float>")
