import numpy as np
import pyarrow as pa
from pyspark.sql.types import IntegerType

from speechlake.operators import tokens
from speechlake.operators.blocks import blocks
from speechlake.operators.tokens import with_column
from tests.speech.test_tokens import small


def test_blocks_hold_every_row_once():
    texts = ["a" * 700, None, "b" * 400, "", "c" * 5000, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "t"])
    got = [b.column(0).to_pylist() for b in blocks(batch, 1, 1000)]
    assert got == [[0, 1], [2, 3], [4], [5]]
    lists = pa.RecordBatch.from_arrays([pa.array([[1.0] * 200, None, [2.0] * 100, []], pa.list_(pa.float32()))], ["x"])
    assert [b.num_rows for b in blocks(lists, 0, 1000)] == [2, 2] and not list(blocks(lists.slice(0, 0), 0))


def test_columns_are_made_a_block_at_a_time(spark):
    df = spark.createDataFrame([(i, "x" * 100_000) for i in range(40)], "id long, t string").coalesce(1)
    sizes = with_column(df, "t", "rows", IntegerType(), lambda t: pa.array([len(t)] * len(t), pa.int32())).collect()
    assert len(sizes) == 40 and max(x.rows for x in sizes) <= 10


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 20)
    t = small()
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    for w in words + words:
        assert t.encode(w) == [t.vocab[p] for p in t.bpe(w)]
        assert len(t.known) + len(t.known.old) <= 20
    long = "the " * 40
    monkeypatch.setattr(tokens, "SHORT", 0)
    heap = [t.bpe(w) for w in [*words, long, "aaaaaa", "thethe"]]
    monkeypatch.setattr(tokens, "SHORT", 1000)
    assert heap == [t.bpe(w) for w in [*words, long, "aaaaaa", "thethe"]]
    assert np.frombuffer(t.encoded("<|im_start|>a"), "<i4").tolist() == t.encode("<|im_start|>a") == [900, t.vocab["a"]]
