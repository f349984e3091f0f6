"""WAV files of any size as a data source: tasks read byte ranges, rows hold pieces of bounded length.

Planning lists files with their sizes and nothing else: a large file is cut into ranges of bytes, small ones are put together.
A task walks the file's RIFF heads - a few bytes each, whatever lies between them - and decodes the frames that begin in its range.
Files are opened through Arrow's file systems, so a path may be local, mounted, or in a store that Arrow knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from speechlake.sources.audio_files import UnsupportedAudio, encode_wav

RANGE_BYTES = 64 << 20
PIECE_BYTES = 4 << 20
SCHEMA = "path string, sample_rate int, channels int, bits int, offset long, samples array<float>, error string"


@dataclass
class Head:
    """Where a file's samples are and what they are."""

    rate: int
    channels: int
    bits: int
    begin: int
    end: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def read_head(file, size: int) -> Head:
    """The first format and data chunks, from the chunk heads alone."""
    if size < 12 or (top := file.read_at(12, 0))[:4] != b"RIFF" or top[8:] != b"WAVE":
        raise UnsupportedAudio("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
        elif name == b"data":
            break
        at += 8 + n + n % 2
    else:
        fmt = None
    if fmt is None:
        raise UnsupportedAudio("no format or no data chunk")
    kind, channels, rate, _, _, bits = fmt
    if (kind, bits) not in ((1, 16), (3, 32)):
        raise UnsupportedAudio(f"format {kind} with {bits} bits")
    if channels < 1:
        raise UnsupportedAudio("no channels")
    return Head(rate, channels, bits, at + 8, min(size, at + 8 + n))


def decoded(raw: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2").astype(np.float32) / 32768 if bits == 16 else np.frombuffer(raw, "<f4")


@dataclass
class Ranges(InputPartition):
    """(path, size, from, to) of the byte ranges of one task."""

    parts: list[tuple[str, int, int, int]]


def planned(files: list[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """Ranges of ``range_bytes`` of large files; small files are put together up to that many."""
    out, held, total = [], [], 0
    for path, size in sorted(files):
        if size > range_bytes:
            out += [Ranges([(path, size, a, min(size, a + range_bytes))]) for a in range(0, size, range_bytes)]
        else:
            if held and total + size > range_bytes:
                out.append(Ranges(held))
                held, total = [], 0
            held.append((path, size, 0, max(1, size)))
            total += size
    return [*out, Ranges(held)] if held else out


class WavReader(DataSourceReader):
    def __init__(self, options):
        if "path" not in options:
            raise ValueError("load needs a path")
        self.path, self.raising = options["path"], options.get("onError", "raise") == "raise"
        self.range_bytes, self.piece_bytes = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("pieceBytes", PIECE_BYTES))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Ranges]:
        store, path = self._store()
        top = store.get_file_info(path)
        found = [top] if top.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return planned([(f.path, f.size) for f in found if f.is_file and f.path.endswith(".wav")], self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path, size, a, b in partition.parts:
            try:
                with store.open_input_file(path) as file:
                    head = read_head(file, size)
                    yield from self._pieces(file, head, path, a, b)
            except (UnsupportedAudio, struct.error) as e:
                if self.raising:
                    raise
                if a == 0:
                    yield self._row(path, None, None, None, f"{path}: {e}")

    def _pieces(self, file, head: Head, path: str, a: int, b: int) -> Iterator[pa.RecordBatch]:
        frames = (head.end - head.begin) // head.frame
        first, stop = (min(frames, max(0, -(-(x - head.begin) // head.frame))) for x in (a, b))
        if frames == 0 and a == 0:
            yield self._row(path, head, 0, np.zeros(0, np.float32), None)
        step = max(1, self.piece_bytes // head.frame)
        for at in range(first, stop, step):
            n = min(step, stop - at)
            raw = file.read_at(n * head.frame, head.begin + at * head.frame)
            yield self._row(path, head, at, decoded(raw, head.bits), None)

    def _row(self, path: str, head: Head | None, offset: int | None, samples: np.ndarray | None, error: str | None) -> pa.RecordBatch:
        facts = (None, None, None) if head is None else (head.rate, head.channels, head.bits)
        lists = pa.nulls(1, pa.list_(pa.float32())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))
        values = [pa.array([path]), *(pa.array([x], pa.int32()) for x in facts), pa.array([offset], pa.int64()), lists, pa.array([error], pa.string())]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in SCHEMA.split(", ")])


class WavSource(DataSource):
    """Format ``wav_ranges``; options: rangeBytes of a task, pieceBytes of a row, onError (raise or row)."""

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_wav_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, piece_bytes: int = PIECE_BYTES, on_error: str = "raise") -> DataFrame:
    """(path, sample_rate, channels, bits, offset, samples, error): the WAV files at ``path`` in pieces that follow one another.

    ``offset`` is a piece's first frame in its file, samples are interleaved.  A task reads ``range_bytes`` of one file, or whole
    small files; a row holds ``piece_bytes`` of samples.  A file without samples is one empty piece; with ``on_error="row"`` one that can't be
    read is one row with its message in error.
    """
    if on_error not in ("raise", "row"):
        raise ValueError("on_error must be raise or row")
    spark.dataSource.register(WavSource)
    return spark.read.format("wav_ranges").options(rangeBytes=str(range_bytes), pieceBytes=str(piece_bytes), onError=on_error).load(path)


def write_wav(audio: DataFrame, folder: str, name: str = "audio_id", bits: int = 16) -> None:
    """One file ``<name>.wav`` in ``folder`` for each row (name, sample_rate, samples); a task that is repeated writes the same files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for own, rate, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                samples = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) else np.zeros(0, np.float32)
                with store.open_output_stream(f"{path}/{own}.wav") as out:
                    out.write(encode_wav(samples.astype(np.float64), rate, 1, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["name"])

    audio.selectExpr(f"cast({name} as string) as name", "sample_rate", "cast(samples as array<float>) as samples").mapInArrow(rows, "name string").write.format("noop").mode("overwrite").save()
