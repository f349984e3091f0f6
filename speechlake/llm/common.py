"""Helpers that the operators of this subpackage share.

``settle`` cuts lineage with a Parquet table in the shared checkpoint folder, so a lost executor costs only the stage that
ran on it.  ``WordHashes`` turns a batch of texts into one flat table of 64-bit word hashes with numpy, without creating a
Python object per word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, as in ``[^\x20\x09-\x0D]+``.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java pattern.
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles at most (a longer document is cut at separators).
PIECE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset a temporary one serves on a single machine (master ``local`` or ``local[...]``); on a cluster it raises,
    as no executor would find what another one wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.speechlake.scratch", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-speechlake-")
        spark.conf.set("spark.speechlake.scratch", folder)
    return folder.rstrip("/")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``settle`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Column: number of words of a text column (null: 0)."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATOR_PATTERN, " "))
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of pairs; which one stands first counts."""
    return mixed(mixed(left, salt) + right * np.uint64(0x9E3779B97F4A7C15), salt)


_LANE_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans aren't empty.

    A span is cut into lanes of eight bytes.  Each lane is mixed with its place by a function that isn't linear, so no rule of
    exchanging bytes or lanes cancels out in the sum; spans of eight bytes at most and of one length never collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    lengths = ends - starts
    count = (lengths + 7) >> 3
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    if len(starts) == int(count.sum()):
        total = mixed(mixed(lanes[starts].view("<u8")[:, 0] & _LANE_MASKS[lengths], 1), 2)
    else:
        place = np.arange(int(count.sum())) - np.repeat(first, count)
        at = np.repeat(starts, count) + 8 * place
        left = np.minimum(np.repeat(ends, count) - at, 8)
        each = mixed(mixed(lanes[at].view("<u8")[:, 0] & _LANE_MASKS[left], 1) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 2)
        total = np.add.reduceat(each, first)
    return mixed(total + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 3)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values (null: empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that have ``limit`` bytes at most together; a longer value stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class WordHashes:
    """The words of some texts: ``hashes`` of all words in order, ``first`` the index of each text's first word.

    ``separators`` flags the bytes that stand between words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False, separators: np.ndarray = _IS_SEPARATOR):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        found, starts_all, ends_all, at = [], [], [], 0
        while at < n:
            to = self._cut(data, edge, at, n, separators)
            part = data[at:to]
            apart = separators[part]
            inside = ~apart
            before = np.empty(len(part), bool)
            before[0] = True
            np.logical_or(apart[:-1], edge[at + 1 : to], out=before[1:])
            after = np.empty(len(part), bool)
            after[-1] = True
            np.logical_or(apart[1:], edge[at + 1 : to], out=after[:-1])
            starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
            if lower:
                part = _ASCII_LOWER[part]
            found.append(span_hashes(part, starts, ends))
            starts_all.append(starts + at)
            if spans:
                ends_all.append(ends + at)
            at = to
        self.hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
        self.first = np.searchsorted(starts, offsets)
        if spans:
            self.starts, self.ends = starts, np.concatenate(ends_all) if ends_all else np.zeros(0, np.int64)

    @staticmethod
    def _cut(data: np.ndarray, edge: np.ndarray, at: int, n: int, separators: np.ndarray) -> int:
        """The end of the piece that begins at ``at``: a place between words, after PIECE_BYTES or soon after."""
        to = at + PIECE_BYTES
        while to < n:
            ahead = np.flatnonzero(edge[to : min(to + 4096, n)] | separators[data[to : to + 4096]])
            if len(ahead):
                return to + int(ahead[0])
            to += 4096
        return n

    def grams(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each position on; only positions with k words left in their text are meaningful.

        Built by doubling: runs of 2, 4, 8, ... words from two runs of half their length, and k from those that it consists of.
        """
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        run, size, out, done = mixed(self.hashes, 11 + which), 1, None, 0
        while True:
            if k & size:
                out = run if out is None else joined(out[: len(out) - size], run[done:], 40 + size)
                done += size
            if done == k:
                return mixed(out[: n - k + 1], 21 + which)
            run = joined(run[:-size], run[size:], 70 + size)
            size *= 2
