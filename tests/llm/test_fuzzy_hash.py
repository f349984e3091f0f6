import hashlib
import random

import numpy as np

from speechlake.llm.fuzzy_hash import fingerprint_pairs, fingerprints, likeness, signature_likeness, written


def edit_likeness(a, b):
    d = list(range(len(b) + 1))
    for x in a:
        new = [d[0] + 1]
        for j, y in enumerate(b):
            new.append(d[j] if x == y else 1 + min(d[j + 1], new[j]))
        d = new
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) >= 7 and not any(a[i : i + 7] in b for i in range(len(a) - 6)):
        return 0.0
    return 1 - d[-1] / (len(a) + len(b))


def test_signature_likeness_is_edit_distance():
    r = random.Random(1)
    pairs = []
    for _ in range(400):
        a = "".join(r.choices("ABCD", k=r.choice([0, 1, 6, 7, 20, 63, 64])))
        b = list(a)
        for _ in range(r.randint(0, 12)):
            b[r.randint(0, len(b)) : r.randint(0, len(b))] = r.choices("ABCDE", k=r.randint(0, 3))
        pairs.append((a, "".join(b)[:64]))
    got = signature_likeness(*map(list, zip(*pairs, strict=True)))
    assert np.allclose(got, [edit_likeness(a, b) for a, b in pairs])


def test_fingerprints_do_not_depend_on_the_batch():
    r = random.Random(2)
    texts = [bytes(r.choices(range(256), k=n)) for n in (0, 1, 3, 7, 190, 5000, 70_000, 5000)] + [b"a" * 3000]
    together = fingerprints(texts)
    assert together == [fingerprints([t])[0] for t in texts]
    assert all(len(a) <= 64 and len(b) <= 64 for _, a, b in together)
    assert len(together[5][1]) >= 32 and len(together[6][1]) >= 32
    changed = texts[6][:30_000] + b"inserted" + texts[6][30_000:]
    near = likeness(fingerprints([texts[6]]), fingerprints([changed]))[0]
    far = likeness(fingerprints([texts[6]]), fingerprints([bytes(r.choices(range(256), k=70_000))]))[0]
    assert near > 0.9 and far == 0


def plain_fingerprint(text):
    """Byte by byte: a rolling sum over the last seven bytes ends chunks, a polynomial modulo a prime names them."""
    from speechlake.llm.fuzzy_hash import _BYTE_VALUES, BASE, PRIME
    from speechlake.llm.common import mixed

    window, ends = [], []
    for i, byte in enumerate(text):
        window = [byte, *window[:6]]
        z = sum(x * (8 - back) + (x << 5 * back) * 0x9E3779B1 for back, x in enumerate(window)) % 2**32
        z = (z ^ z >> 15) * 0x85EBCA6B % 2**32
        z = (z ^ z >> 13) + 1
        if z % 3 == 0:
            ends.append((i + 1, (z & -z).bit_length() - 1))

    def signature(size):
        cuts = [e for e, level in ends if level >= size][:63]
        edges = [0, *(c for c in cuts if c < len(text)), len(text)] if text else [0]
        out = ""
        for a, b in zip(edges, edges[1:]):
            value = sum(int(_BYTE_VALUES[x]) * pow(BASE, k, PRIME) for k, x in enumerate(text[a:b])) % PRIME
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[int(mixed(np.array([value], np.uint64), 61)[0]) >> 58]
        return out

    size = 0
    while (3 << size) * 64 < len(text):
        size += 1
    while size and sum(level >= size for _, level in ends) + 1 < 32:
        size -= 1
    return 3 << size, signature(size), signature(size + 1)


def test_fingerprints_are_those_of_a_plain_loop():
    r = random.Random(12)
    texts = [bytes(r.choices(b"abc ~", k=n)) for n in (0, 1, 2, 6, 7, 8, 50, 191, 192, 193, 700, 3000)] + [bytes(r.choices(range(256), k=9000)), b"z" * 500]
    word = bytes(b"ab"[bin(i).count("1") & 1] for i in range(2048))
    texts += [word, word.translate(bytes.maketrans(b"ab", b"ba"))]
    assert fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_pairs(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefé", k=r.randint(1, 8))) for _ in range(200)]
    rows = [(7 * i, " ".join(r.choices(words, k=r.choice([1, 30, 600])))) for i in range(120)]
    rows += [(5, None), (6, ""), (12, rows[0][1]), (1, "x𝒳y é" * 9)]
    got = {x.doc_id: x for x in fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        x, own, theirs = got[i], fingerprints([t.encode()]), fingerprints([edited.encode()])
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (written(own[0]), written(theirs[0]))
        assert x.near_edited == likeness(own, theirs)[0] and x.near_next == likeness(own, fingerprints([after.encode()]))[0]
    assert got[0].fingerprint == got[12].fingerprint
    long = [x for x in got.values() if x.n_chars > 1500]
    assert np.mean([x.near_edited for x in long]) > 0.6 > 0.2 > np.mean([x.near_next for x in long])


def test_rows_without_an_id(spark):
    rows = [(None, "some words and more " * 40), (None, None), (None, "x"), (9, "later " * 9), (3, "first text " * 50), (3, "second"), (None, "first text " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [x for x in fingerprint_pairs(df).collect() if x.doc_id is None]
    assert len(got) == 4 and len(fingerprint_pairs(df).collect()) == 7
    for _, t in rows[:3] + rows[6:]:
        t = t or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + rows[4][1][:n]
        x = next(x for x in got if x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        own = fingerprints([t.encode()])
        assert x.fingerprint == written(own[0]) and x.near_next == likeness(own, fingerprints([rows[4][1].encode()]))[0]
    alone = fingerprint_pairs(df.where("doc_id is null")).collect()
    assert len(alone) == 4 and all(x.near_next == 1.0 for x in alone)


def test_ranges_and_edge_rows(spark, monkeypatch):
    import speechlake.llm.fuzzy_hash as m

    rows = [(i, f"text {i} " * (i % 7), "clash") for i in range(100)] + [(50, "other", None), (None, "gone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    one = sorted(map(str, fingerprint_pairs(df).collect()))
    monkeypatch.setattr(m, "RANGE_DOCS", 9)
    many = fingerprint_pairs(df)
    assert sorted(map(str, many.collect())) == one and len(one) == 102
    assert fingerprint_pairs(df.limit(0)).collect() == []
    single = fingerprint_pairs(df.where("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_very_long_texts(spark):
    r = random.Random(8)
    text = "".join(r.choices("abcdefgh é", k=2_000_000))
    rows = [(1, text), (2, "short"), (3, text[:900_000] + "some words put in" + text[900_000:]), (4, "z" * 3_000_000)]
    got = {x.doc_id: x for x in fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {i: fingerprints([t.encode()]) for i, t in rows}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), written(own[i][0]))
    assert likeness(own[1], own[3])[0] > 0.9
