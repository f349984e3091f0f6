import hashlib
import random
import re

import pytest

from speechlake.llm import decontamination
from speechlake.llm.decontamination import build_index, decontaminate, proximity_matches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out, sizes = [], {len(k) for k in windows}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for p in range(len(w)):
            for k in sizes:
                own = windows.get(tuple(w[p : p + k])) if p + k <= len(w) else None
                if own:
                    hit |= set(range(p, p + k))
                    found |= own
        names = sorted({str(x) for x in found if x is not None})
        turns = [p for p in sorted(hit) if p - 1 not in hit]
        spans = [(a, next(e for e in range(a + 1, len(w) + 2) if e not in hit)) for a in turns]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), spans))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(*r[:6], [tuple(x) for x in r.spans]) for r in df.collect()], key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abCé1日", k=r.randint(1, 3))) for _ in range(60)]
    items = [(i, r.choice([" ", ", ", "\x1f"]).join(r.choices(words[: r.choice([4, 60])], k=r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(3, items[8][1]), (77, items[9][1]), (None, " ".join(words[:12])), (78, None)]
    docs = []
    for i in range(150):
        own = []
        for _ in range(r.randint(0, 4)):
            own += r.choices(words, k=r.choice([0, 2, 15, 60]))
            w = words_of(r.choice(items)[1])
            a = r.randint(0, 2) if len(w) > 4 else 0
            own += w[a : len(w) - r.randint(0, 1)]
        docs.append((i, r.choice([" ", "-", "\n"]).join(own)))
    docs += [(5, docs[5][1]), (5, "other"), (None, docs[7][1]), (None, None), (200, ""), (201, items[9][1])]
    docs += [(300 + i, docs[9][1]) for i in range(60)]
    return docs, items


@pytest.mark.parametrize(("seed", "segment", "block", "vocabulary"), [(1, 1 << 22, 1 << 16, 1 << 21), (2, 500, 1 << 16, 1 << 21), (3, 3000, 60, 5)])
def test_same_as_all_windows(spark, monkeypatch, seed, segment, block, vocabulary):
    monkeypatch.setattr(decontamination, "VOCABULARY", vocabulary)
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", segment)
    docs, items = corpus(seed)
    got = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=block)
    want = brute(docs, items)
    assert rows_of(got) == want
    assert 50 < sum(r[5] for r in want) < len(want)


def test_edge_tables(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs, items = [(1, "a b"), (None, None), (3, "b a b a b a b a b a b a")], [(1, "A b"), (2, "a b " * 5), (3, "")]
    d = spark.createDataFrame([(*x, 1) for x in docs], DOCS + ", class_id long")
    i = spark.createDataFrame([(*x, 1) for x in items], ITEMS + ", spans int")
    assert decontaminate(none_d, i).collect() == []
    assert rows_of(decontaminate(d, none_i)) == brute(docs, [])
    assert rows_of(decontaminate(d, i)) == brute(docs, items)


def test_very_long_text(spark):
    r = random.Random(4)
    words = r.choices([f"w{i}" for i in range(5000)], k=900_000)
    item = " ".join(words[700_000:700_040])
    got = decontaminate(spark.createDataFrame([(1, " ".join(words)), (2, "x " * 30 + item)], DOCS), spark.createDataFrame([(9, item)], ITEMS))
    assert [(x[0], x[1], x[2], x[3], x[6]) for x in rows_of(got)] == [(1, 900_000, 40, 1, [(700_000, 700_040)]), (2, 70, 40, 1, [(30, 70)])]


@pytest.mark.parametrize("within", [3, 6, 15])
def test_proximity_same_as_all_spans(spark, monkeypatch, within):
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 2000)
    r = random.Random(within)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 40, 80])))) for i in range(60)] + [(70, None), (None, "w1 w2 w3")]
    items = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 4])))) for i in range(30)]
    want = []
    for d, t in docs:
        w = words_of(t)
        for i, x in items:
            need = set(words_of(x))
            sizes = [n for n in range(1, within + 1) for p in range(len(w) - n + 1) if need and need <= set(w[p : p + n])]
            if sizes:
                want.append((d, str(i), min(sizes)))
    index = build_index(spark.createDataFrame(docs, DOCS))
    got = proximity_matches(index, spark.createDataFrame(items, ITEMS), within, block=7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
