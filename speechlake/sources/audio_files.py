"""WAV files to rows of samples, and changing their rate."""

from __future__ import annotations

import struct
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from speechlake.operators.blocks import blocks

#: Zero crossings of the resampler's windowed sinc on each side, and output samples computed at once.
CROSSINGS, BLOCK = 16, 1 << 15


class UnsupportedAudio(ValueError):
    """Not a WAV file of 16-bit or 32-bit float PCM."""


def decode_wav(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(rate, channels, bits, interleaved float32 samples).  Chunks other than the format and the data are skipped."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise UnsupportedAudio("not a RIFF/WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data) and body is None:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or body is None:
        raise UnsupportedAudio("no format or no data chunk")
    kind, channels, rate, _, _, bits = fmt
    if (kind, bits) == (1, 16):
        samples = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
    elif (kind, bits) == (3, 32):
        samples = np.frombuffer(body[: len(body) // 4 * 4], "<f4").astype(np.float32)
    else:
        raise UnsupportedAudio(f"format {kind} with {bits} bits")
    if channels < 1:
        raise UnsupportedAudio("no channels")
    return rate, channels, bits, samples[: len(samples) // channels * channels]


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """The inverse of ``decode_wav``, for exports and tests."""
    body = (np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2") if bits == 16 else samples.astype("<f4")).tobytes()
    fmt = struct.pack("<HHIIHH", 1 if bits == 16 else 3, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


SCHEMA = "path string, sample_rate int, channels int, bits int, samples array<float>, error string"


def decode_files(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """(path, sample_rate, channels, bits, samples, error) of rows (path, content); ``row``: a bad file has its message in error."""

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rate, channels, bits, samples = decode_wav(content.as_py() or b"")
                    error = None
                except (UnsupportedAudio, struct.error) as e:
                    if on_error == "raise":
                        raise
                    rate, channels, bits, samples, error = None, None, None, None, f"{path}: {e}"
                values = [pa.array([path], pa.string()), *(pa.array([x], pa.int32()) for x in (rate, channels, bits)), pa.array([samples], pa.list_(pa.float32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(values, ["path", "sample_rate", "channels", "bits", "samples", "error"])

    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def read_wav(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path), on_error)


@lru_cache(maxsize=16)
def _weights(up: int, down: int) -> np.ndarray:
    """(up, taps): the filter at each of the ``up`` places between two samples that outputs fall on, in turn."""
    cutoff = min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / cutoff))
    distance = np.arange(-half + 1, half + 1) - (np.arange(up) * down % up / up)[:, None]
    return cutoff * np.sinc(cutoff * distance) * np.cos(np.pi / 2 * np.clip(distance / half, -1, 1)) ** 2


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Windowed-sinc interpolation; round(n * target / rate) samples.  Not bit-identical to any library's filter."""
    if rate == target or not len(x):
        return x.astype(np.float32)
    g = gcd(rate, target)
    up, down = target // g, rate // g
    weights, n = _weights(up, down), int(round(len(x) * target / rate))
    taps = weights.shape[1]
    spans = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(np.float64), taps), taps)
    out = np.empty(n, np.float32)
    for a in range(0, n, BLOCK):
        j = np.arange(a, min(a + BLOCK, n))
        out[a : a + len(j)] = np.einsum("ij,ij->i", spans[np.minimum(j * down // up + taps // 2 + 1, len(spans) - 1)], weights[j % up])
    return out


class Resampler:
    """``resampled`` over a signal that comes in parts: what it gives, put together, is the whole signal's result at any cut.

    State is three things: how many samples came, how many went, and the last samples that the filter still reaches.
    """

    def __init__(self, rate: int, target: int, seen: int = 0, made: int = 0, tail: np.ndarray | None = None):
        if rate <= 0 or target <= 0:
            raise ValueError(f"sample rates {rate} and {target}")
        g = gcd(rate, target)
        self.rate, self.target, self.up, self.down = rate, target, target // g, rate // g
        self.weights = _weights(self.up, self.down)
        self.seen, self.made, self.tail = seen, made, np.zeros(self.weights.shape[1]) if tail is None else tail

    def feed(self, pcm: np.ndarray, final: bool = False) -> np.ndarray:
        """The samples that are complete with ``pcm``; ``final``: all that are left."""
        if self.rate == self.target:
            self.seen += len(pcm)
            self.made = self.seen
            return pcm.astype(np.float32)
        taps = self.weights.shape[1]
        half, x = taps // 2, np.concatenate((self.tail, pcm.astype(np.float64), np.zeros(taps if final else 0)))
        base = self.seen - len(self.tail)
        self.seen += len(pcm)
        count = int(round(self.seen * self.target / self.rate)) if final else max(self.made, -(-(self.seen - half) * self.up // self.down))
        out = np.empty(max(0, count - self.made), np.float32)
        for a in range(0, len(out), BLOCK):
            j = np.arange(self.made + a, self.made + min(a + BLOCK, len(out)))
            spans = np.lib.stride_tricks.sliding_window_view(x, taps)
            out[a : a + len(j)] = np.einsum("ij,ij->i", spans[j * self.down // self.up - half + 1 - base], self.weights[j % self.up])
        self.made += len(out)
        self.tail = x[max(0, min(self.made * self.down // self.up - half + 1 - base, len(x))) :]
        return out


def resample_pieces(pieces: DataFrame, target: int = 16_000, key: str = "path", offset: str = "offset") -> DataFrame:
    """(key, sample_rate, offset, samples) at ``target`` of recordings in pieces (key, sample_rate, ``offset``, samples) that follow one another.

    A recording's pieces pass by in order in one task, which holds one piece and the filter's tail; each gives a piece with what is
    complete by then, the last one also what is left, so pieces together are ``resample`` of the whole.  One without a rate raises.
    """
    kind = pieces.schema[key].dataType.simpleString()
    names = [key, "sample_rate", "offset", "samples"]

    def rows(batches):
        held, made = None, None  # the last piece waits, as it may be its recording's end

        def told(piece, final):
            nonlocal made
            own, rate, at, x = piece
            if made is None:
                made = Resampler(rate, target)
            if at != made.seen:
                raise ValueError("pieces that don't follow one another")
            first = made.made
            out = made.feed(x, final)
            values = [pa.array([own], like), pa.array([target], pa.int32()), pa.array([first], pa.int64()), pa.array([out], pa.list_(pa.float32()))]
            made = None if final else made
            return pa.RecordBatch.from_arrays(values, names)

        like = None
        for batch in batches:
            like = batch.schema.field(0).type
            keys, rates, offsets = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                x = batch.column(3)[i]
                piece = (keys[i], rates[i], offsets[i], x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) else np.zeros(0, np.float32))
                if held is not None:
                    yield told(held, held[0] != piece[0])
                held = piece
        if held is not None:
            yield told(held, True)

    rows_in = pieces.select(F.col(key), F.col("sample_rate").cast("int"), F.col(offset).cast("long").alias("offset"), F.col("samples").cast("array<float>").alias("samples"))
    ordered = rows_in.repartition(key).sortWithinPartitions(key, "offset", F.size("samples"))
    return ordered.mapInArrow(rows, f"{key} {kind}, sample_rate int, offset long, samples array<float>")


def resample(audio: DataFrame, target: int = 16_000, on_error: str = "raise") -> DataFrame:
    """Rows (..., sample_rate, samples) at ``target``; rows that are already stay untouched, rows without samples or rate too.

    With ``on_error="row"`` a row that can't be resampled has no samples and ``resample: message`` in the column error, which
    is added where there is none; an error that stands there already stays.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error must be raise or row")
    with_error = on_error == "row"
    fields = [StructField(f.name, ArrayType(FloatType()) if f.name == "samples" else IntegerType() if f.name == "sample_rate" else f.dataType) for f in audio.schema.fields]
    if with_error and "error" not in audio.columns:
        fields.append(StructField("error", StringType()))
    names = [f.name for f in fields]

    def changed(x, rate) -> np.ndarray | None:
        if not x.is_valid or rate is None:
            return None if not x.is_valid else x.values.to_numpy(zero_copy_only=False)
        if rate <= 0:
            raise ValueError(f"sample rate {rate}")
        return resampled(x.values.to_numpy(zero_copy_only=False), rate, target)

    def rows(batches):
        for batch in (part for whole in batches for part in blocks(whole, whole.schema.get_field_index("samples"))):
            rates, errors = batch.column(batch.schema.get_field_index("sample_rate")).to_pylist(), [None] * batch.num_rows
            samples: list[np.ndarray | None] = []
            for i, x in enumerate(batch.column(batch.schema.get_field_index("samples"))):
                try:
                    samples.append(changed(x, rates[i]))
                except Exception as e:
                    if not with_error:
                        raise
                    samples.append(None)
                    errors[i] = f"resample: {e}"
            own = dict(zip(batch.schema.names, batch.columns, strict=True))
            offsets = pa.array([None if x is None else n for x, n in zip([*samples, ()], np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in samples]))).tolist(), strict=True)], pa.int32())
            flat = [x for x in samples if x is not None]
            own["samples"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat).astype(np.float32) if flat else np.zeros(0, np.float32)))
            own["sample_rate"] = pa.array([None if r is None else target for r in rates], pa.int32())
            if with_error:
                before = own["error"].to_pylist() if "error" in own else errors
                own["error"] = pa.array([b or e for b, e in zip(before, errors, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names)

    return audio.withColumns({"samples": F.col("samples").cast("array<float>"), "sample_rate": F.col("sample_rate").cast("int")}).mapInArrow(rows, StructType(fields))
