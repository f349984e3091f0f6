"""Context-triggered piecewise hashing of documents.

A rolling hash over 7 bytes decides where a chunk ends, so an edit changes only the chunks around it.  Each chunk becomes one
character; a fingerprint is ``block size:signature:signature at twice the block size``.  Two fingerprints are compared where
their block sizes are equal or one is twice the other, by the edit distance (insertions and deletions) of the signatures.

All of a batch is hashed in one pass of numpy: the level of a place - how often its rolling hash can be halved - tells every
block size's chunk ends at once, and chunk hashes are differences of prefix sums.  Edit distances run bit-parallel over all
pairs of a batch, one 64-bit word for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import mixed

#: Characters of a signature at most; the last chunk takes what is left.
LENGTH = 64
SMALLEST = 3
WINDOW = 7
#: Signatures of this many characters or more need a run of as many in common to be alike at all.
COMMON = 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes hashed at once, unless a text is longer.
PIECE = 1 << 20


def levels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the largest k such that a chunk of block size 3 * 2 ** k ends after it, or -1."""
    n = len(data)
    x = data.astype(np.uint32)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    total = np.zeros(n, np.uint32)
    for back in range(WINDOW):
        own = np.zeros(n, np.uint32)
        own[back:] = x[: max(n - back, 0)]
        own[place < back] = 0  # before the text
        total += own * np.uint32(WINDOW + 1 - back) + (own << np.uint32(5 * back % 32)) * np.uint32(0x9E3779B1)
    z = ((total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(13))) + np.uint64(1)
    low = z & (~z + np.uint64(1))
    return np.where(z % np.uint64(3) == 0, np.log2(low.astype(np.float64)).astype(np.int8), np.int8(-1)).astype(np.int8)


PRIME = (1 << 31) - 1
BASE = 0x2545F491
_BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64), 77) % np.uint64(PRIME)
_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of ``base`` modulo PRIME, at least ``n``; by doubling, and remembered."""
    x = _KNOWN.get(base, np.ones(1, np.uint64))
    while len(x) < n:
        x = np.concatenate((x, x * np.uint64(pow(base, len(x), PRIME)) % np.uint64(PRIME)))
    _KNOWN[base] = x
    return x[:n]


def prefix_residues(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of BASE modulo PRIME, before each byte and at the end, none of them reduced."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(BASE, len(data)) % np.uint64(PRIME), out=total[1:])
    return total


def span_residues(total: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The polynomial hash modulo PRIME of each span between two edges, from ``prefix_residues``; the same wherever a span stands."""
    back = _powers(pow(BASE, -1, PRIME), int(edges[-1]) + 1)[edges[:-1]]
    return (total[edges[1:]] - total[edges[:-1]]) % np.uint64(PRIME) * back % np.uint64(PRIME)


def _signature(hashes: np.ndarray) -> str:
    return LETTERS[hashes >> np.uint64(58)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[tuple[int, str, str]]:
    """(block size, signature, signature at twice the size) of each text."""
    out, i = [], 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= PIECE):
            n += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts[i:j]]))).astype(np.int64)
        level = levels(data, offsets)
        total = prefix_residues(data)
        places = np.flatnonzero(level >= 0)
        level = level[places]
        bounds = np.searchsorted(places, offsets)
        for k in range(j - i):
            a, b = int(offsets[k]), int(offsets[k + 1])
            own, ends = level[bounds[k] : bounds[k + 1]], places[bounds[k] : bounds[k + 1]] + 1

            def chunks(size: int, own=own, ends=ends, a=a, b=b) -> np.ndarray:
                cut = ends[own >= size][: LENGTH - 1]
                edges = np.concatenate(([a], cut[cut < b], [b])) if b > a else np.array([a])
                return mixed(span_residues(total, edges), 61) if len(edges) > 1 else np.zeros(0, np.uint64)

            size = 0
            while (SMALLEST << size) * LENGTH < b - a:
                size += 1
            while size and int((own >= size).sum()) + 1 < LENGTH // 2:
                size -= 1
            out.append((SMALLEST << size, _signature(chunks(size)), _signature(chunks(size + 1))))
        i = j
    return out


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as a matrix of byte codes (0: none) and their lengths."""
    lengths = np.array([len(s) for s in signatures], np.int64)
    codes = np.frombuffer("".join(s.ljust(LENGTH, "\0") for s in signatures).encode(), np.uint8).reshape(len(signatures), LENGTH)
    return codes, lengths


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / both lengths, for each pair; 0 where long signatures share no run of COMMON characters."""
    if not left:
        return np.zeros(0)
    a, n = _codes(left)
    b, m = _codes(right)
    rows = np.arange(len(left))
    at = np.zeros((len(left), 256), np.uint64)
    for i in range(LENGTH):
        at[rows, a[:, i]] |= np.uint64(1 << i)
    at[:, 0] = 0
    v = np.full(len(left), 2**64 - 1, np.uint64)
    for i in range(int(m.max(initial=0))):
        u = v & at[rows, b[:, i]]
        v = (v + u) | (v - u)
    inside = np.where(n < 64, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    common = np.bitwise_count(~v & inside).astype(np.int64)
    # length of the longest common run: runs of equal characters on each diagonal
    long = np.flatnonzero((n >= COMMON) & (m >= COMMON))
    good = np.ones(len(left), bool)
    if len(long):
        x, y = a[long], b[long]
        met = np.zeros(len(long), bool)
        for shift in range(-(LENGTH - COMMON), LENGTH - COMMON + 1):
            p, q = (x[:, shift:], y[:, : LENGTH - shift]) if shift >= 0 else (x[:, : LENGTH + shift], y[:, -shift:])
            same = (p == q) & (p != 0)
            run = same
            for step in (1, 2, 3):  # runs of 2, 4, 7
                run = run[:, :-step] & run[:, step:]
            met |= run.any(1)
        good[long] = met
    both = n + m
    return np.where(both == 0, 1.0, np.where(good, 2.0 * common / np.maximum(both, 1), 0.0))


def likeness(left: list[tuple[int, str, str]], right: list[tuple[int, str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: the most alike of their signatures at one block size; 0 if no size is common."""
    best = np.zeros(len(left))
    for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
        pairs = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if x[0] << i == y[0] << j]
        if pairs:
            got = signature_likeness([left[k][1 + i] for k in pairs], [right[k][1 + j] for k in pairs])
            best[pairs] = np.maximum(best[pairs], got)
    same = np.array([x == y for x, y in zip(left, right, strict=True)], bool)
    return np.where(same, 1.0, best)


def written(print_: tuple[int, str, str]) -> str:
    return ":".join(map(str, print_))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], edited: list[str], own: list, after: list) -> pa.RecordBatch:
    """Result rows of texts, their edited forms, their fingerprints and those of the next ones."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in edited]
    theirs = fingerprints(encoded)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in encoded], pa.string()),
        pa.array(map(written, own), pa.string()),
        pa.array(map(written, theirs), pa.string()),
        pa.array(likeness(own, theirs), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _beside_first(shared):
    """Rows without an id: the first document follows each of them; where there is none, each follows itself."""

    def rows(batches):
        first = shared.value
        encode = lambda t: t.encode("utf-8", "surrogatepass")
        following = None if first is None else fingerprints([encode(first)])[0]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = fingerprints(list(map(encode, texts)))
            edited = [t[: len(t) - len(t) // 4] + (t if first is None else first)[: len(t) // 4] for t in texts]
            yield _compared([None] * len(texts), texts, edited, own, own if first is None else [following] * len(texts))

    return rows


def _rows(batches):
    """Rows come sorted within each range; the last of a range only serves as the next of the one before."""
    held, held_print = None, None
    for batch in batches:
        kinds = batch.column("part").to_pylist()
        ids, extra, texts = batch.column("doc_id").to_pylist(), batch.column("extra").to_pylist(), batch.column("text").to_pylist()
        rows = ([held] if held else []) + list(zip(kinds, ids, extra, texts, strict=True))
        prints = ([held_print] if held else []) + fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
        here, edited = [], []
        for k in range(len(rows) - 1):
            if rows[k][0] == rows[k + 1][0] and not rows[k][2]:
                text, following = rows[k][3], rows[k + 1][3]
                n = len(text) // 4
                here.append(k)
                edited.append(text[: len(text) - n] + following[:n])
        if here:
            yield _compared([rows[k][1] for k in here], [rows[k][3] for k in here], edited, [prints[k] for k in here], [prints[k + 1] for k in here])
        if rows:
            held, held_print = rows[-1], prints[-1]


#: Documents in a range, about, and ranges at most, about (their first ids are sent to all tasks); characters in a task, about.
#: Tasks get several ranges each, as few would fall to them unevenly.
RANGE_DOCS, RANGES, TASK_CHARS = 500, 100_000, 8 << 20


def with_following(docs: DataFrame) -> DataFrame:
    """(part, doc_id, extra, text) dealt to ranges of doc_id and sorted; each range ends with the first document of the next.

    The ranges begin at the ids that a hash picks, one in ``RANGE_DOCS`` or so many fewer that there are about RANGES of them,
    and at the very first; the last one ends with the very first document (``extra``), so every document stands once beside
    the one that follows it.
    """
    whole = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum(F.length("text")).alias("chars")).first()
    every = max(RANGE_DOCS, whole["n"] // RANGES)
    marks = docs.select("doc_id").where(F.pmod(F.xxhash64(F.lit("range"), "doc_id"), F.lit(every)) == 0).distinct().toPandas()["doc_id"].to_numpy(np.int64)
    starts = np.unique(np.concatenate((marks, [whole["first"] or 0]))).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("array<struct<part:int,extra:int>>")
    def places(ids: pd.Series) -> pd.Series:
        starts, ids = shared.value, ids.to_numpy()
        own = np.searchsorted(starts, ids, side="right") - 1
        first = starts[own] == ids
        last = len(starts) - 1
        return pd.Series([[(p, 0), (last if p == 0 else p - 1, 1)] if f else [(p, 0)] for p, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.explode(places("doc_id")).alias("at")).select("at.part", "doc_id", "at.extra", "text")
    return dealt.repartition(min(len(starts), int(whole["chars"] or 0) // TASK_CHARS + 1), "part").sortWithinPartitions("part", "extra", "doc_id", "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text, as SCHEMA says.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the next document in ascending
    doc_id, after the last the first.  A null text is empty; rows with one doc_id follow each other by text; a single document follows
    itself.  A row with a null doc_id has no place in that order: the first document follows it, or it follows itself if there is none.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = docs.where("doc_id is not null")
    least = some.agg(F.min("doc_id")).first()[0]
    first = None if least is None else some.where(F.col("doc_id") == least).agg(F.min("text")).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast(first)  # one document
    rest = docs.where("doc_id is null").mapInArrow(_beside_first(shared), SCHEMA)
    return with_following(some).mapInArrow(_rows, SCHEMA).union(rest)
