"""Byte-level BPE: pieces, merges by rank, special tokens, and decoding.

The tables are three small DataFrames (vocab, merges, added tokens); encoding and decoding broadcast them, bounded by the
vocabulary.  A Python worker keeps the ids of pieces it has seen, as text repeats its pieces.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from speechlake.operators.blocks import blocks

#: Pieces that a worker remembers at most, and the code points that one to be remembered has at most.
PIECES, PIECE_LENGTH = 400_000, 64
#: Bytes of a piece whose merges are found by looking through all pairs; longer ones take a heap.
SHORT = 32
#: Different pieces that a task counts before it hands them on.
COUNTED = 50_000
#: The marks beyond ASCII that don't count as letters, and the English contraction tails.
MARKS = "，。、；：？！（）《》“”‘’—…"
TAILS = ("s", "t", "re", "ve", "m", "ll", "d", "S", "T", "RE", "VE", "M", "LL", "D")

_LETTER = rf"[A-Za-z]|[^\x00-\x7f{MARKS}]"
_MARK = rf"[^\sA-Za-z0-9\x80-\U0010ffff]|[{MARKS}]|[\x0b\x0c\x1c-\x1f]"
_PIECES = re.compile(
    rf" +(?= [^ \n\r\t])"  # all but the last of several spaces
    rf"| ?(?:{_LETTER})+"
    rf"| ?(?:{_MARK})+[\n\r]*"
    rf"| (?=[0-9])|[0-9]"
    rf"| +|[\n\r\t][ \n\r\t]*"
)
_CONTRACTION = re.compile("'(?:" + "|".join(TAILS) + ")")


def pretokenize(text: str) -> list[str]:
    """Letter runs, single digits, and mark runs with the line breaks after them; one space before joins letters or marks.

    Contractions are cut out first, so what stands before one is split as if the text ended there.
    """
    out, at = [], 0
    for m in _CONTRACTION.finditer(text):
        out += [*_PIECES.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + _PIECES.findall(text[at:])


def byte_characters() -> list[str]:
    """The printable character of each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Known(dict):
    """Piece -> its ids as little-endian 32-bit integers, made by ``ids`` when first asked for.

    When it is half full its pieces grow old; those that are asked for again before it is half full once more stay.
    """

    def __init__(self, ids: Callable[[str], list[int]]):
        self.ids, self.old = ids, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            ids = self.ids(piece)
            made = pack(f"<{len(ids)}i", *ids)
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= PIECES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = made
        return made


class Tokenizer:
    """Encoding and decoding over plain Python tables."""

    def __init__(self, vocab: dict[str, int], merges: dict[tuple[str, str], int], added: dict[str, int]):
        self.vocab, self.merges, self.added = vocab, merges, added
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.characters)}
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {i: t for t, i in added.items()}
        names = sorted(added, key=lambda t: (-len(t.encode()), t))
        self.marks = re.compile("|".join(map(re.escape, names))) if names else None
        self._start()

    def _start(self) -> None:
        self.known, self.said = _Known(self._piece), {}

    def __getstate__(self) -> dict:
        """The tables; what was made of them is made anew where they are sent."""
        return {k: v for k, v in vars(self).items() if k not in ("known", "said")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._start()

    def bpe(self, piece: str) -> list[str]:
        """Merges the adjacent pair of the lowest rank, the leftmost on ties, until none is known."""
        parts: list[str | None] = [self.characters[b] for b in piece.encode("utf-8", "replace")]
        n = len(parts)
        if n <= SHORT:
            return self._short(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.merges.get((parts[i], parts[after[i]])) if after[i] < n else None
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue  # one of the two was merged since
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]

    def _short(self, parts: list[str]) -> list[str]:
        """``bpe`` of few parts: all ranks are looked through at each step, which takes less time than a heap."""
        rank, none = self.merges.get, float("inf")
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _piece(self, piece: str) -> list[int]:
        try:
            return [self.vocab[t] for t in self.bpe(piece)]
        except KeyError as e:
            raise ValueError(f"token {e} is not in the vocabulary") from None

    def encoded(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        ids, out, at = self.known.__getitem__, [], 0
        for m in self.marks.finditer(text) if self.marks else ():
            out += map(ids, pretokenize(text[at : m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little", signed=True))
            at = m.end()
        out += map(ids, pretokenize(text[at:]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<i4").tolist()

    def decode(self, ids: Iterable[int], keep_special: bool = False) -> str:
        """Special tokens are dropped or kept, unknown ids skipped; bytes that aren't UTF-8 become U+FFFD."""
        if keep_special not in self.said:
            said = {i: bytes(self.bytes[c] for c in t if c in self.bytes) for i, t in self.tokens.items()}
            self.said[keep_special] = said | {i: t.encode() if keep_special else b"" for i, t in self.special.items()}
        return b"".join(map(self.said[keep_special].get, ids, repeat(b""))).decode("utf-8", "replace")

    def rollback(self, ids: list[int], back: int) -> str:
        """The text without the last ``back`` tokens, and without more while it holds U+FFFD."""
        end = max(0, len(ids) - max(0, back))
        while end > 0 and "�" in (text := self.decode(ids[:end])):
            end -= 1
        return text if end > 0 else ""


def collected(vocab: DataFrame, merges: DataFrame, added: DataFrame) -> Tokenizer:
    """The tables on the driver; they are as large as a vocabulary, not as the data."""
    v = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
    m = {(r["left"], r["right"]): r["rank"] for r in merges.select("left", "right", "rank").collect()}
    return Tokenizer(v, m, {r["token"]: r["id"] for r in added.select("token", "id").collect()})


def order_special_tokens(added: DataFrame) -> DataFrame:
    """Longest first in bytes, so that matching is longest-match."""
    return added.orderBy(F.octet_length("token").desc(), "token")


def with_column(df: DataFrame, source: str, name: str, kind: DataType, values: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with ``name`` made from the column ``source``, a block of an Arrow batch at a time; a column of that name is replaced."""
    kept = [c for c in df.columns if c != name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, -1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values(part.columns[-1])], [*kept, name])

    schema = StructType([*df.select(*kept).schema.fields, StructField(name, kind)])
    return df.select(*kept, F.col(source).alias("_source")).mapInArrow(rows, schema)


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Adds ids (array<int>); a null text has none.  A token that the vocabulary lacks fails the job."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def ids(texts: pa.Array) -> pa.Array:
        of = shared.value.encoded
        each = [of(t.as_py() or "") for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in each]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(each), "<i4")))

    return with_column(df, text, "ids", ArrayType(IntegerType()), ids)


def id_lists(ids: pa.Array) -> Iterator[list[int]]:
    """The lists of an Arrow list array; a null is an empty one."""
    for x in ids:
        yield x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid and len(x) else []


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", keep_special: bool = False) -> DataFrame:
    """Adds decoded."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    return with_column(df, ids, "decoded", StringType(), lambda x: pa.array([shared.value.decode(i, keep_special) for i in id_lists(x)], pa.string()))


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): how often each piece occurs, combined before the shuffle."""

    def rows(batches):
        counts: Counter[str] = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["piece", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                counts.update(pretokenize(t.as_py() or ""))
                if len(counts) >= COUNTED:
                    yield told()
        yield told()

    return df.select(text).mapInArrow(rows, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def tokens_to_ids(df: DataFrame, vocab: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(ids, unknown): rows (key, pos, token, id) of an array ``tokens`` by an equi-join, and those that the vocabulary lacks."""
    rows = df.select(key, F.posexplode("tokens").alias("pos", "token"))
    return rows.join(vocab.select("token", "id"), "token").select(key, "pos", "token", "id"), rows.join(vocab, "token", "left_anti")


def ids_to_tokens(df: DataFrame, vocab: DataFrame, added: DataFrame, key: str = "item_id", keep_special: bool = False) -> DataFrame:
    """(key, tokens) of an array ``ids``, in order; unknown ids are skipped, special ones too unless kept."""
    rows = df.select(key, F.posexplode("ids").alias("pos", "id"))
    table = vocab.select("id", "token").join(added.select("id"), "id", "left_anti")
    table = table.unionByName(added.select("id", "token")) if keep_special else table
    found = rows.join(table, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return df.select(key).distinct().join(found, key, "left").select(key, F.coalesce(F.transform("t", lambda x: x["token"]), F.array().cast("array<string>")).alias("tokens"))
