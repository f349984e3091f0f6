"""Exact BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens finds the longest token from each place on; a table leads to the shorter ones that
begin like it.  The encoder keeps two tokens side by side only if a pair-compatibility check says that merging would keep them
apart; where nothing fits it steps back, and a place where it failed once is never tried again, since the tokens before a place are
always the same.  That gives what merging by rank gives, in time linear in the piece.  Decoding gathers each id's bytes from
one buffer with an offset per id.

The vocabulary is read from a tokenizer file whose path is a parameter; its tables are broadcast (bounded by the vocabulary).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs that a Python worker remembers at most; it forgets all when there are more.
PIECES = 200_000
PAIRS = 400_000
#: Tokens that are decoded at once.
DECODE = 200_000
WORD_END = "</w>"
#: The white space and the piece pattern of this tokenizer kind.
SPACE = r"\t-\r\x85\p{Z}"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
#: Which characters the tokenizers library knows, as far as other Unicode versions differ.  It takes letters and
#: numbers from version 16; these ranges came later.
LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATE_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Capitals with small letters that older versions lack: range, and first small letter.
LATE_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Marks that it neither orders nor composes, as they are newer than its version of the normal form.
LATE_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def _ranges(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b, *_ in ranges)


_LETTERS, _NUMBERS = rf"[\p{{L}}--[{_ranges(LATE_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(LATE_NUMBERS)}]]"
_ALL_PIECES = regex.compile(PIECE.format(letters=_LETTERS, numbers=_NUMBERS, space=SPACE), regex.V1).findall
_NARROW = {name: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(f"[{own}]", chr(c), regex.V1)) for name, own in (("letters", _LETTERS), ("numbers", _NUMBERS), ("space", SPACE))}
_ASCII_PIECES = re.compile(PIECE.format(letters="a-z", numbers="0-9", space=r"\t-\r ")).findall
_NARROW_PIECES = re.compile(PIECE.format(**_NARROW)).findall
_MARKS = regex.compile(f"([{_ranges(LATE_MARKS)}])")
_CAPITALS = {c: chr(to + c - a) for a, b, to in LATE_CAPITALS for c in range(a, b + 1)}
_ANY_CAPITAL = regex.compile(f"[{_ranges(LATE_CAPITALS)}]")


def narrow(text: str) -> bool:
    """Whether all characters are below U+0100; such a text is in composed normal form, and ``re`` knows its classes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def normalised(text: str) -> str:
    """The composed normal form in small letters, as the library makes them."""
    if text.isascii() or narrow(text):
        return text.lower()
    parts = _MARKS.split(text) if _MARKS.search(text) else [text]
    text = "".join([unicodedata.normalize("NFC", p) for p in parts])
    if _ANY_CAPITAL.search(text):
        text = text.translate(_CAPITALS)
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in token strings -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables from the text of a tokenizer file: word-end BPE over the byte alphabet."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE file with the word end </w> is needed")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.rank = [-1] * size
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole = ids[a + b]
            self.rank[whole], self.parts[whole] = rank, (ids[a], ids[b])
            self.merged[ids[a], ids[b]] = rank
        alphabet = byte_alphabet()
        #: A token's symbols: one character for each byte, plus 256 for the byte that ends a word.
        self.symbols: list[tuple[str, int]] = []
        for token, i in ids.items():
            end = token.endswith(WORD_END)
            codes = [alphabet[c] for c in (token[: -len(WORD_END)] if end else token)]
            if end:
                codes[-1] += 256
            self.symbols.append(("".join(map(chr, codes)), i))
        shown = [b""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            shown[i] = token.encode() + b" "
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        known = dict(vocabulary.symbols)
        #: A token's length in symbols, and the longest token that is a proper beginning of it (-1: none).
        self.sizes, self.shorter = [0] * len(vocabulary.rank), [-1] * len(vocabulary.rank)
        for symbols, i in vocabulary.symbols:
            self.automaton.add_word(symbols, i)
            self.sizes[i] = len(symbols)
            self.shorter[i] = next((known[symbols[:k]] for k in range(len(symbols) - 1, 0, -1) if symbols[:k] in known), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        encode_piece = self.encode_piece

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= PIECES:
                    self.clear()
                ids = encode_piece(piece)
                ids = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) < 256:
                    self[piece] = ids
                return ids

        self.known = Known()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps these tokens apart when they stand side by side.

        Going back from the last merge that built either, no merge across the border may come earlier than those undone.
        """
        merged, rank, parts, limit = self.v.merged, self.v.rank, self.v.parts, 1 << 60
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 1, parts[right][0]
            else:
                return True

    def fits(self, pair: tuple[int, int]) -> bool:
        """``compatible``, remembered."""
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.compatible(*pair)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The tokens of a piece: longest matches one after the other, as long as each pair is compatible.

        Where one isn't, the next shorter token that begins like it is tried; where there is none the encoder steps back, and never
        comes to that place again.
        """
        symbols = piece.encode("utf-8", "replace").decode("latin-1")
        symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
        n, sizes, shorter, pairs, failed = len(symbols), self.sizes, self.shorter, self.pairs, None
        out, at = [], 0
        while True:
            for last, token in self.automaton.iter_long(symbols, at):
                if failed is not None and failed[last + 1] or out and not (pairs.get((out[-1], token)) or self.fits((out[-1], token))):
                    break
                out.append(token)
                at = last + 1
            else:
                if at != n:
                    raise ValueError(f"no token for what begins at byte {at} of {piece!r}")
                return out
            failed = bytearray(n + 1) if failed is None else failed
            while True:
                token = shorter[token]
                while token >= 0 and (failed[at + sizes[token]] or out and not self.fits((out[-1], token))):
                    token = shorter[token]
                if token >= 0:
                    out.append(token)
                    at += sizes[token]
                    break
                failed[at] = 1
                token = out.pop()
                at -= sizes[token]

    def _plain(self, text: str) -> bytes:
        text = normalised(text)
        pieces = _ASCII_PIECES if text.isascii() else _NARROW_PIECES if narrow(text) else _ALL_PIECES
        return b"".join(map(self.known.__getitem__, pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  A special token's string in the text is that token."""
        if self.marks is None or "<" not in text or not self.marks.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.v.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The token strings, joined by one space, in parts."""
        for i in range(0, len(ids), DECODE):
            part = ids[i : i + DECODE]
            lengths = self.v.lengths[part]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(self.v.offsets[part] - (ends - lengths), lengths)
            out = self.v.shown[places]
            yield (out[:-1] if i + DECODE >= len(ids) else out).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(key: str, load: Callable[[], Vocabulary]) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load())
    return _ENCODERS[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return hashlib.sha256(text.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(Vocabulary(text))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``: doc_id, text.

    A null text is empty: no ids, and the decoded text is empty.  Other columns are ignored; repeated rows stay.
    """
    key, shared = _shared(docs, path)

    def rows(batches):
        e = encoder_of(key, lambda: shared.value)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                raw = e.encode(text.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                decoded = hashlib.sha256()
                for part in e.decode(ids):
                    decoded.update(part)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                decoded_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, beside: tuple[str, ...] = ("source",)) -> DataFrame:
    """(doc_id, source, n_tokens, ids) for each row of ``docs``: doc_id, text, source; a null text has no ids.

    ``beside``: the columns that stand between doc_id and n_tokens.
    """
    key, shared = _shared(docs, path)

    def rows(batches):
        e = encoder_of(key, lambda: shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(e.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in part.column(part.num_columns - 1)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", *beside, "n_tokens", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *beside, F.col("text").cast("string").alias("text"))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in beside)
    return docs.mapInArrow(rows, f"doc_id long, {kinds}n_tokens long, ids array<int>")
