import hashlib
import random
import re

import pytest

from speechlake.llm.substring_dedup import remove_repeats


def brute(rows, n=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone |= set(range(s, s + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(300)]
    passages = [r.choices(words, k=r.choice([49, 50, 51, 60, 130])) for _ in range(6)]
    rows = []
    for _ in range(40):
        own = []
        for _ in range(r.randint(0, 4)):
            own += r.choices(words, k=r.choice([0, 1, 20, 70]))
            p = r.choice(passages)
            own += p[r.randint(0, 3) :] if r.random() < 0.5 else p
        rows.append(r.choice([" ", "\n", "  "]).join(own))
    rows += [rows[3], rows[3], rows[5] + " ", None, "", "a " * 200, "a " * 80, "x\x1cy " * 60, "x\x1cy " * 60]
    r.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_same_as_all_windows(spark, seed):
    rows = corpus(seed)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute(rows)


def test_edge_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, seed long")).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, 1), (5, long, 1), (None, long, 2), (7, long, 3), (6, None, None), (4, " ", 0), (9, "z" * 3_000_000 + " " + long, 1)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, starts long")).collect()
    found = sorted((x.doc_id or -1, x.n_words, x.n_removed, x.repeats) for x in got)
    assert found == [(-1, 60, 0, ""), (4, 0, 0, ""), (5, 60, 0, ""), (5, 60, 0, ""), (6, 0, 0, ""), (7, 60, 60, "0:60"), (9, 61, 60, "1:61")]


def test_words_of_a_thue_morse_kind_differ(spark):
    """Words over which a polynomial modulo a power of two takes the same value make different windows."""
    rows, tail = [], " ".join(f"w{i}" for i in range(49))
    for n in (1024, 2048, 4096, 8192):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        rows += [f"{word} {tail}", f"{word.translate(str.maketrans('ab', 'ba'))} {tail}"]
    rows.append(rows[3])
    got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: 50 if i == 8 else 0 for i in range(9)}
