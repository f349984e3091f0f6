"""Features of recordings that come in pieces, equal to those of whole recordings.

Pieces are dealt anew to slices of one length, each with the samples of its neighbours that its frames reach into (the halo), so a
row never holds more than a slice and its halo.  A frame belongs to the slice in which it is anchored.  What a front end needs of
the whole recording - its length for the mirrored ends, the maximum of log-mel values - is found from small rows per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.operators import features
from speechlake.operators.kept import kept

#: Samples of a slice, a minute at 16 kHz; less than a slice on either side is looked at.
SLICE_SAMPLES = 960_000


@dataclass(frozen=True)
class FrontEnd:
    """Frame f covers ``size`` samples from ``f * hop - pad`` on; a recording is mirrored at its ends where ``pad`` isn't 0."""

    size: int
    hop: int
    pad: int
    of_frames: Callable[..., np.ndarray]
    whole: Callable[..., np.ndarray]
    beside: int = 0
    maximum: bool = False

    def frames(self, n: int) -> int:
        """How many frames a recording has that is longer than a slice."""
        return n // self.hop if self.pad else max(0, 1 + (n - self.size) // self.hop)

    @property
    def left(self) -> int:
        return self.pad + self.beside * self.hop

    @property
    def right(self) -> int:
        return self.size - self.pad + self.beside * self.hop


FRONT_ENDS = {
    "log_mel": FrontEnd(400, 160, 200, features.log_mel_of_frames, features.log_mel_raw, maximum=True),
    "mel_spectrogram": FrontEnd(1024, 256, 384, features.mel_of_frames, features.mel_spectrogram),
    "fbank": FrontEnd(400, 160, 0, features.fbank_of_frames, features.fbank),
    "stacked_fbank": FrontEnd(400, 160, 0, features.fbank_of_frames, features.FRONT_ENDS["stacked_fbank"], beside=2),
    "stacked_fbank_short": FrontEnd(400, 160, 0, features.fbank_of_frames, features.FRONT_ENDS["stacked_fbank_short"], beside=2),
}
RAW = "id string, slice long, first long, n long, top double, feats binary"


def audio_slices(pieces: DataFrame, left: int, right: int, size: int, key: str = "audio_id", offset: str = "offset", kind: str = "float") -> DataFrame:
    """(id, slice, n_all, start, samples): slices of ``size`` samples of pieces (key, ``offset`` in samples, samples), with their halos.

    ``start`` is the place in the recording of the first sample, ``n_all`` the recording's length.
    """
    rows = pieces.select(F.to_json(F.struct(F.col(key).alias("k"))).alias("id"), F.col(offset).cast("long").alias("at"), F.col("samples").cast(f"array<{kind}>").alias("samples"))
    rows = rows.where(F.size("samples") > 0).withColumn("to", F.col("at") + F.size("samples"))
    lengths = rows.groupBy("id").agg(F.max("to").alias("n_all"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("at") - right) / size)), F.floor((F.col("to") - 1 + left) / size)
    dealt = rows.select("id", "at", "to", "samples", F.explode(F.sequence(first, last)).alias("slice"))
    low, high = F.greatest("at", F.col("slice") * size - left), F.least("to", (F.col("slice") + 1) * size + right)
    parts = dealt.where(high > low).select("id", "slice", low.alias("low"), F.slice("samples", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("low", "part")))
    whole = parts.groupBy("id", "slice").agg(ordered.alias("p"))
    whole = whole.select("id", "slice", F.col("p")[0]["low"].alias("start"), F.flatten(F.transform("p", lambda x: x["part"])).alias("samples"))
    return whole.join(lengths, "id").where(F.col("slice") * size < F.col("n_all")).select("id", "slice", "n_all", "start", "samples")


def slice_features(x: np.ndarray, start: int, number: int, n: int, size: int, end: FrontEnd, kind: type = np.float32) -> tuple[int, np.ndarray]:
    """(first frame, features) of slice ``number``, whose samples with the halo are ``x``, of a recording of ``n``."""
    if len(x) != min(n, (number + 1) * size + end.right) - max(0, number * size - end.left):
        raise ValueError("pieces that don't follow one another")
    if n <= size:
        return 0, end.whole(x, kind=kind)
    frames = end.frames(n)
    first, stop = -(-number * size // end.hop), min(frames, -(-(number + 1) * size // end.hop))
    if stop <= first:
        return first, np.zeros((0, 0), kind)
    low, high = max(0, first - end.beside), min(frames, stop + end.beside)
    at = np.arange(low * end.hop - end.pad, (high - 1) * end.hop - end.pad + end.size)
    at = np.abs(at)
    at = np.where(at >= n, 2 * n - 2 - at, at)
    feats = end.of_frames(features.frame_signal(x[at - start], end.size, end.hop), kind)
    if end.beside:
        place = np.clip(np.arange(first, stop)[:, None] + np.arange(2 * end.beside + 1) - end.beside, 0, frames - 1) - low
        feats = feats[place].reshape(stop - first, -1)
    return first, feats


def _raw(end: FrontEnd, size: int, kind: type):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ident, number, n, start = (batch.column(c)[i].as_py() for c in ("id", "slice", "n_all", "start"))
                first, feats = slice_features(batch.column("samples")[i].values.to_numpy(zero_copy_only=False), start, number, n, size, end, kind)
                if feats.size:
                    values = [[ident], [number], [first], [len(feats)], [float(feats.max())], pa.array([feats.astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], [c.split()[0] for c in RAW.split(", ")])

    return rows


def _framed(kind: type):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                feats = np.frombuffer(r["feats"], kind).reshape(r["n"], -1)
                if r["most"] is not None:
                    feats = features.with_maximum(feats, r["most"])
                for a in range(0, len(feats), 2048):
                    part = np.ascontiguousarray(feats[a : a + 2048])
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    values = [pa.array([r["id"]] * len(part)), pa.array(r["first"] + a + np.arange(len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))]
                    yield pa.RecordBatch.from_arrays(values, ["id", "frame_idx", "feat"])

    return rows


def sliced_features(pieces: DataFrame, front_end: str, key: str = "audio_id", offset: str = "offset", slice_samples: int = SLICE_SAMPLES, kind: str = "float") -> DataFrame:
    """(key, frame_idx, feat): the rows of ``features`` over whole recordings, from rows (key, ``offset``, samples) of their pieces.

    Pieces of a recording follow one another, its first at offset 0; their lengths don't matter, and null or empty ones are
    passed over.  Gaps and overlaps are an error.  ``kind``: as in ``features``.
    """
    end, number = FRONT_ENDS[front_end], features.KINDS[kind]
    if slice_samples <= end.left + end.right:
        raise ValueError("a slice must be longer than what its frames reach beyond it")
    slices = audio_slices(pieces, end.left, end.right, slice_samples, key, offset, kind)
    raw = slices.mapInArrow(_raw(end, slice_samples, number), RAW)
    if end.maximum:
        raw = kept(raw)
        most = raw.select("id", "slice", F.max("top").over(Window.partitionBy("id")).alias("most"))  # a few bytes per slice
        raw = raw.join(most, ["id", "slice"])
    else:
        raw = raw.withColumn("most", F.lit(None).cast("double"))
    rows = raw.select("id", "first", "n", "feats", "most").mapInArrow(_framed(number), f"id string, frame_idx long, feat array<{kind}>")
    value = F.from_json("id", f"struct<k:{pieces.schema[key].dataType.simpleString()}>")["k"].alias(key)
    return rows.select(value, "frame_idx", "feat")
