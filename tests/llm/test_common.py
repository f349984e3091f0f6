import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from speechlake.llm import common
from speechlake.llm.common import WordHashes, slices, utf8, word_count
from speechlake.llm.components import connected_components


def test_word_hashes_are_per_word(monkeypatch):
    r = random.Random(1)
    bits = ["a", "b", "ab", "é", "日", " ", " ", "\t", "\x0b", "\x1c", "\xa0", "A"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(300)] + ["", None, " ", "x" * 5000, "y " * 3000]
    words = [(t or "").encode().split() for t in texts]
    data, offsets = utf8(pa.array(texts))
    for piece in (7, 64, 1 << 20):
        monkeypatch.setattr(common, "PIECE_BYTES", piece)
        found = WordHashes(data, offsets, spans=True)
        assert np.diff(found.first).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert [bytes(data[a:b]) for a, b in zip(found.starts, found.ends, strict=True)] == flat
        by_word = {}
        assert all(by_word.setdefault(w, h) == h for w, h in zip(flat, found.hashes.tolist(), strict=True))
        assert len(set(by_word.values())) == len(by_word)
        grams = found.grams(3)
        seen = {}
        for a, b in zip(found.first[:-1], found.first[1:], strict=True):
            for i in range(a, b - 2):
                assert seen.setdefault(tuple(flat[i : i + 3]), grams[i]) == grams[i]
        assert len(set(map(int, seen.values()))) == len(seen)
    lower = WordHashes(*utf8(pa.array(["AbÉ", "abÉ", "abé"])), lower=True).hashes
    assert lower[0] == lower[1] != lower[2]
    assert [j for _, j in slices(np.array([0, 5, 9, 40, 41, 41]), 10)] == [2, 3, 5]


def test_word_count(spark):
    rows = [("a b",), ("",), (None,), (" \n",), (" a\x0bb\x1cc ",), ("é\xa0x",)]
    got = spark.createDataFrame(rows, "text string").select(word_count(F.col("text")).alias("n")).collect()
    assert [x.n for x in got] == [len((t or "").encode().split()) for t, in rows]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (900, None)]
    r.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((x.node, x.component) for x in got) == sorted((i, find(i)) for i in list(root))
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
