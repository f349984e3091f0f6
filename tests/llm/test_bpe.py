import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from speechlake.llm.bpe import Encoder, Vocabulary, encoded, round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return Encoder(Vocabulary(f.read())), Tokenizer.from_file(PATH)


def texts(seed=4, n=1500):
    r = random.Random(seed)
    bits = ["the", "ing", "aaaa", "'s", "'RE", "'", "don't", "É", "é", "é", "ß", "İ", "Σ", "ΣΑΣ", "日本", "𝒳", "😀", "👩‍👩‍👧", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "​", "12", "٣", "½", "!!!", "%%%", "<|endoftext|>", "<|startoftext|>", "<|", "rendous", "th", "er", "\x00", "ǅ", "ŀ", "-", "_", "Hello", "WORLD", " "]
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüñ"
    for _ in range(n):
        yield "".join(r.choice(bits) if r.random() < 0.6 else "".join(r.choices(alphabet, k=r.randint(1, 14))) for _ in range(r.randint(0, 30)))
    yield "a" * 5000
    yield "ab" * 3000 + "é" * 999
    yield ""


def test_same_as_library(both):
    mine, theirs = both
    for t in texts():
        want = theirs.encode(t, add_special_tokens=False).ids
        raw = mine.encode(t)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == want, repr(t)
        import numpy as np

        assert b"".join(mine.decode(np.array(want, "<u4"))).decode() == theirs.decode(want, skip_special_tokens=False)


def test_every_code_point_is_as_in_the_library(both):
    mine, theirs = both
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2000):
        text = " ".join(f"x{c}y" for c in points[i : i + 2000])
        raw = mine.encode(text)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == theirs.encode(text, add_special_tokens=False).ids, hex(ord(points[i]))


def test_marks_are_ordered_as_in_the_library(both):
    import unicodedata

    from tokenizers import normalizers

    from speechlake.llm.bpe import normalised

    form, r = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), random.Random(5)
    marks = [chr(c) for c in range(0x80, 0x110000) if unicodedata.combining(chr(c))]
    texts = [s for c in marks for s in (f"a{c}\u0334", f"a\u0345{c}", f"e{c}\u0301\u0323")] + ["\U00011935\U00011930"]
    texts += ["".join(r.choices(["a", "É", "\u0301", "Σ", "\ua7cb"], k=2) + r.choices(marks, k=3)) for _ in range(3000)]
    assert [t for t in texts if normalised(t) != form.normalize_str(t)] == []


def test_every_token_encodes_to_itself(both):
    mine, _ = both
    seen = 0
    for symbols, i in mine.v.symbols:
        if ord(symbols[-1]) >= 256:
            try:
                text = bytes(ord(c) % 256 for c in symbols).decode()
            except UnicodeDecodeError:
                continue
            seen += 1
            assert mine.encode_piece(text) == [i]
    assert seen > 30_000


def test_round_trip(spark, both):
    _, theirs = both
    rows = list(enumerate(list(texts(9, 100)))) + [(500, None), (501, "x"), (501, "x"), (None, "y z")]
    df = spark.createDataFrame([(i, t, "a", "clash") for i, t in rows], "doc_id long, text string, source string, n_tokens string")
    got = sorted(round_trip(df, PATH).collect(), key=str)
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {(x.doc_id, len(x.ids)) for x in encoded(df, PATH).collect()} == {(i, n) for i, n, *_ in want}
    assert round_trip(df.limit(0), PATH).collect() == []


def test_very_long_texts(spark, both):
    _, theirs = both
    r = random.Random(21)
    rows = [(1, " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 12))) for _ in range(150_000))), (2, "x" * 300_000), (3, "é" * 100_000 + " end"), (4, "short")]
    got = {x.doc_id: x for x in round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for i, t in rows:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
