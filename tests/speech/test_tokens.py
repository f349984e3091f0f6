import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlake.operators import partials
from speechlake.operators.tokens import MARKS, TAILS, Tokenizer, byte_characters, collected, decode, encode, ids_to_tokens, order_special_tokens, piece_counts, pretokenize, tokens_to_ids
from speechlake.sources.tables import read_added_tokens, read_merges, read_vocab

CHARS = byte_characters()


def small() -> Tokenizer:
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("a", "a"), ("aa", "a"), ("Ã", "©"), ("Ġ", "a"), ("1", "2")]
    vocab = {c: i for i, c in enumerate(CHARS)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    return Tokenizer(vocab, {p: i for i, p in enumerate(merges)}, {"<|im_start|>": 900, "<|im_end|>": 901, "<|im": 902})


def letter(c):
    return c.isascii() and c.isalpha() or not c.isascii() and c not in MARKS


def walk(text):
    """The piece rules, one character at a time."""
    cuts, at = [], 0
    while at < len(text):
        tail = next((t for t in TAILS if text[at] == "'" and text.startswith(t, at + 1)), None)
        cuts.append("'" + tail if tail else None)
        at += len(cuts[-1]) if tail else 1
    out, run, at = [], "", 0
    for c in cuts:
        if c is None:
            run += text[at]
            at += 1
        else:
            out += plain(run) + [c]
            run = ""
            at += len(c)
    return out + plain(run)


def plain(s):
    out, i = [], 0
    space = lambda c: c in " \n\r\t"
    digit = lambda c: c in "0123456789"
    mark = lambda c: not space(c) and not letter(c) and not digit(c)
    while i < len(s):
        lead = ""
        if s[i] == " ":
            j = i
            while j < len(s) and s[j] == " ":
                j += 1
            if j == len(s) or space(s[j]):
                out.append(s[i:j])
                i = j
                continue
            if j - i > 1:
                out.append(" " * (j - i - 1))
            lead, i = " ", j
        j = i
        if letter(s[i]):
            while j < len(s) and letter(s[j]):
                j += 1
            out.append(lead + s[i:j])
        elif digit(s[i]):
            j += 1
            out += [lead] * bool(lead) + [s[i]]
        elif mark(s[i]):
            while j < len(s) and mark(s[j]):
                j += 1
            while j < len(s) and s[j] in "\n\r":
                j += 1
            out.append(lead + s[i:j])
        else:
            while j < len(s) and space(s[j]):
                j += 1
            out.append(s[i:j])
        i = j
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aZé1 \n\t\r.,'stre，。𝒳-_\x0b\x1c\x85\xa0"), max_size=24))
def test_pieces(text):
    assert pretokenize(text) == walk(text)
    assert "".join(pretokenize(text)) == text


def test_encoding():
    t = small()
    assert t.encode("the the") == [t.vocab["the"], t.vocab["Ġthe"]]
    assert t.bpe("aaaaa") == ["aa", "aaa"]
    assert t.encode("<|im_start|>aé<|im12") == [900, t.vocab["a"], t.vocab["Ã©"], 902, t.vocab["1"], t.vocab["2"]]
    assert t.decode([900, t.vocab["a"], 5000, 901]) == "a" and t.decode([900, t.vocab["a"]], True) == "<|im_start|>a"
    with pytest.raises(ValueError):
        Tokenizer({}, {}, {}).encode("a")
    cut = t.encode("a日")
    assert t.rollback(cut, 1) == "a" and t.rollback(cut, 0) == "a日" and t.rollback(cut, 9) == "" and t.decode(cut[:-1]) != "a"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_round_trip(text):
    t = small()
    if "<|im" not in text and all(not 0xD800 <= ord(c) < 0xE000 for c in text):
        assert t.decode(t.encode(text)) == text


def test_tables_and_joins(spark, tmp_path):
    import json

    t = small()
    (tmp_path / "vocab.json").write_text(json.dumps(t.vocab))
    (tmp_path / "added.json").write_text(json.dumps(t.added))
    (tmp_path / "merges.txt").write_text("".join(f"{a} {b}\n" for a, b in sorted(t.merges, key=t.merges.get)))
    vocab, merges, added = read_vocab(spark, f"{tmp_path}/vocab.json"), read_merges(spark, f"{tmp_path}/merges.txt"), read_added_tokens(spark, f"{tmp_path}/added.json")
    same = collected(vocab, merges, added)
    assert (same.vocab, same.merges, same.added) == (t.vocab, t.merges, t.added)
    assert [r.token for r in order_special_tokens(added).collect()] == ["<|im_start|>", "<|im_end|>", "<|im"]
    df = spark.createDataFrame([(1, "the the é"), (2, None), (3, "12<|im_end|>")], "item_id long, text string")
    got = decode(encode(df, same), same, keep_special=True).collect()
    assert {r.item_id: r.decoded for r in got} == {1: "the the é", 2: "", 3: "12<|im_end|>"}
    assert {r.piece: r.n for r in piece_counts(df).collect()}["the"] == 1
    named = ids_to_tokens(encode(df, same), vocab, added).collect()
    assert {r.item_id: r.tokens for r in named}[3] == ["1", "2"] and {r.item_id: len(r.tokens) for r in named}[2] == 0
    known, unknown = tokens_to_ids(spark.createDataFrame([(1, ["the", "zzz"])], "item_id long, tokens array<string>"), vocab)
    assert known.count() == 1 and unknown.first().token == "zzz"


def fold(texts, mode):
    confirmed = pending = ""
    out = []
    for k, text in enumerate(texts):
        final, delta, revised = k == len(texts) - 1, "", False
        if not text:
            pending = ""
        elif text.startswith(confirmed):
            rest, n = text[len(confirmed) :], 0
            while n < min(len(pending), len(rest)) and pending[n] == rest[n]:
                n += 1
            n = len(rest) if final else n
            delta, pending, confirmed = rest[:n], rest[n:], confirmed + rest[:n]
        elif final:
            revised, confirmed, pending = True, text, ""
        else:
            revised, confirmed, pending = True, "" if mode == "clear" else confirmed, text
        out.append((delta, confirmed, pending, revised))
    return out


def test_partials(spark):
    r = random.Random(7)
    utterances = {u: ["".join(r.choices("abé", k=r.randint(0, 3))) if r.random() < 0.3 else "abéab"[: r.randint(0, 5)] for _ in range(r.randint(1, 7))] for u in range(60)}
    rows = [(u, i, t, i == len(ts) - 1) for u, ts in utterances.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "utterance_id long, chunk_id long, text string, is_final boolean")
    for mode in ("clear", "keep_stable"):
        got = partials.track_partials(df, mode).orderBy("utterance_id", "chunk_id").collect()
        assert [(x.confirmed_delta, x.confirmed_text, x.pending_text, x.revised) for x in got] == [y for u in sorted(utterances) for y in fold(utterances[u], mode)]


def test_stable_prefix_and_greedy(spark):
    t = small()
    df = spark.createDataFrame([(k, "the 日", k == 5) for k in range(6)], "chunk_id long, raw_text string, is_final boolean")
    got = partials.stable_prefix(encode(df, t, "raw_text"), t, 2, 2).orderBy("chunk_id").collect()
    assert [x.stable for x in got] == ["", "", "the ", "the ", "the ", "the 日"]
    scores = spark.createDataFrame([(1, 0, [0.0, 2.0, 2.0]), (1, 1, [3.0, 0.0, 1.0]), (1, 2, [0.0, 0.0, 1.0]), (2, 0, [0.0, 0.0, 9.0]), (3, 0, [1.0, 0.0, 0.0])], "item_id int, step int, logits array<double>")
    assert {x.item_id: x.ids for x in partials.greedy_sequence(scores, [2], 5).collect()} == {1: [1, 0], 2: [], 3: [0]}
    assert {x.item_id: x.ids for x in partials.greedy_sequence(scores, [7], 1).collect()} == {1: [1], 2: [2], 3: [0]}
    with pytest.raises(ValueError):
        partials.greedy_sequence(scores, [2], -1)
    assert df.select(F.lit(1)).count() == 6
