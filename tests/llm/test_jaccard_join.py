import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from speechlake.llm.jaccard_join import bands_of, comparison_lists, jaccard_components, most_apart, rarest, set_keys


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k=3, percent=90):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed=1, groups=12):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(500)]
    rows, line = [], " ".join(words[:40])
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([4, 9, 30, 120, 400]))]
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(int(len(own) * r.choice([0, 0.01, 0.03, 0.06]))):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((" " if r.random() < 0.2 else "") + r.choice([" ", "\n", "\t "]).join(own) + (" " + line if r.random() < 0.3 else ""))
    rows += ["", None, " \n", "One", "one", "two words", "TWO words", "É x y", "é x y", "a\x0bb\x0cc", "a b c", "x y z w"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [200, 400_000])
def test_same_as_all_pairs(spark, tile):
    rows = corpus()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), tile_shingles=tile).collect()
    want = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id if x.n_shingles else x.doc_id) for x in got} == want


def random_pair(r, percent):
    import numpy as np

    n, part = int(r.integers(1, 700)), percent // (100 - percent) + 3
    a = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
    return a, np.unique(np.concatenate((a[int(r.integers(0, max(1, n // part + 2))) :], r.integers(0, 2**64 - 1, int(r.integers(0, n // part + 2)), dtype=np.uint64))))


def is_linked(a, b, percent):
    both = len(set(a.tolist()) & set(b.tolist()))
    return len(a) > 0 < len(b) and 100 * both >= percent * (len(a) + len(b) - both)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_keep_a_common_key(percent):
    """Whatever else has their keys, so in any order of rarity, the keys that two linked sets keep have one in common."""
    import numpy as np

    r, linked = np.random.default_rng(5), 0
    for _ in range(1500):
        a, b = random_pair(r, percent)
        if is_linked(a, b, percent) and len(set(a.tolist()) ^ set(b.tolist())):
            linked += 1
            (ka, more_a), (kb, more_b) = set_keys(a, percent), set_keys(b, percent)
            met = False
            for kind in range(4):
                x, y = ([int(k) for k in own if int(k) & 3 == kind] for own in (ka, kb))
                common = set(x) & set(y)
                others = {k for k in [*x, *y] if k not in common and r.random() < 0.5}  # what sets besides these two have
                rank = {k: (int(r.integers(2, 6)), k) for k in [*x, *y]}
                kept = [set(sorted((k for k in own if k in common or k in others), key=rank.get)[: max(0, len([k for k in own if k in common or k in others]) + more[kind])]) for own, more in ((x, more_a), (y, more_b))]
                met |= bool(kept[0] & kept[1])
            assert met
    assert linked > 300


def test_how_far_apart():
    for percent in (80, 90):
        for n in range(1, 120):
            far = max(a + n - 2 * both for a in range(1, 160) for both in range(min(a, n) + 1) if 100 * both >= percent * (a + n - both))
            assert far <= most_apart(n, percent) <= far + 1
            partners = {a for a in range(1, 160) for both in range(min(a, n) + 1) if 100 * both >= percent * (a + n - both)}
            assert all(min(a, n).bit_length() - 1 in bands_of(n, percent) for a in partners)


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component long, key string")
    assert jaccard_components(empty).collect() == []
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 6), (3, "a b c d", None), (4, "p " * 5000, 0)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, block long")).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in got) == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 1, 4)]


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    from speechlake.llm.jaccard_join import linked, parity, possible_forest

    r = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(200):
        n = int(r.integers(1, 700))
        a = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        gone, new = int(r.integers(0, n // 3 + 1)), int(r.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate((a[gone:], r.integers(0, 2**64 - 1, new, dtype=np.uint64))))
        if not len(b):
            continue
        for percent in (80, 90):
            kept = possible_forest(np.array([1, 2]), np.array([len(a), len(b)]), [parity(a), parity(b)], percent)
            assert kept or not linked(a, b, percent)
            ruled_out += not kept
    assert ruled_out > 50


def test_lists_hold_all_pairs(spark):
    members = {1: range(2), 2: range(3), 3: range(1), 4: range(2), 5: range(40, 63), 6: range(100, 108)}
    df = spark.createDataFrame([(k, d) for k, own in members.items() for d in own], "key long, doc_id long")
    lists = {}
    for x in comparison_lists(df, 4).collect():
        lists.setdefault(x["list"], []).append(x.doc_id)
    assert sorted(map(tuple, map(sorted, lists.values())))[:2] == [(0, 1), (0, 1, 2)]  # one of two equal ones, none of one member
    pairs = {p for own in lists.values() for p in combinations(sorted(own), 2)}
    assert pairs == {p for own in members.values() for p in combinations(own, 2)}
    assert max(map(len, lists.values())) < 20


def test_rarest_keys_are_kept(spark):
    rows = [(10 * k, d, -1) for k, own in ((4, range(9)), (8, range(5)), (12, range(2)), (16, range(1))) for d in own]
    rows += [(3, 100, -5), (7, 100, -5), (3, 101, 3), (7, 102, 0)]
    df = spark.createDataFrame(rows, "key long, doc_id long, more int")
    got = {}
    for x in rarest(df, spark.createDataFrame([(100,)], "doc_id long")).collect():
        got.setdefault(x.doc_id, []).append(x.key)
    assert {d: sorted(k) for d, k in got.items()} == {0: [80, 120], 1: [80, 120], 2: [80], 3: [80], 4: [80], 100: [3, 7], 101: [3], 102: [7]}


def test_forest_over_batches():
    import numpy as np
    import pyarrow as pa

    from speechlake.llm.jaccard_join import _forest_rows, parity

    def batches(table, size, names):
        for i in range(0, len(table), size):
            cols = list(zip(*table[i : i + size], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bitmap" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    a = np.arange(100, dtype=np.uint64) * np.uint64(977)
    sets = {1: a, 2: a[1:], 3: a + np.uint64(5), 4: np.concatenate((a, np.array([3], np.uint64)))}
    table = [(k, d, len(sets[d]), parity(sets[d])) for k, own in ((1, (1, 2)), (2, (1, 3)), (3, (1, 2, 3, 4))) for d in own]
    for size in (1, 3, 100):
        found = {p for b in _forest_rows(90)(batches(table, size, ["list", "doc_id", "size", "bitmap"])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert found == {(2, 1), (4, 1)}


def templated(n, seed=7):
    """Short texts that share a template, each with a few words of its own; some are near copies of the one before."""
    r = random.Random(seed)
    head, rows = " ".join(f"t{i}" for i in range(60)), []
    for i in range(n):
        own = [f"{r.randrange(10**9)}" for _ in range(12)]
        if i % 50 == 49:
            own = [*last[:-1], f"{r.randrange(10**9)}"]
        rows.append((i, f"{head} {' '.join(own)}"))
        last = own
    return rows


def test_template(spark):
    rows = templated(600)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows)
    assert sum(x.doc_id != x.component_id for x in got) == 12


def near_copies(n, words, seed=3):
    """Copies of one template with words changed: most linked with many others, some with few, and every 40th with none."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(template)
        for at in r.sample(range(words), r.choice([0, 1, 1, 2]) if i % 40 else words // 90):
            own[at] = f"{r.randrange(10**9)}"
        rows.append((3 * i, " ".join(own[r.randrange(3) :])))
    return rows


def planned_copies(monkeypatch):
    """Copies of sets that the plans of the tiles ask for, and sets in them."""
    from speechlake.llm import jaccard_join as m

    counts = []

    def counted(plan):
        def run(*args):
            out = plan(*args)
            row = out.agg(F.sum(F.size("tiles")).alias("copies"), F.max(F.size("tiles")).alias("most"), F.count("*").alias("sets")).first()
            counts.append((plan.__name__, row["copies"] or 0, row["most"] or 0, row["sets"]))
            return out

        return run

    for name in ("small_plan", "hub_plan", "rest_plan"):
        monkeypatch.setattr(m, name, counted(getattr(m, name)))
    return counts


@pytest.mark.parametrize(("tile", "hubs"), [(1500, 0), (1500, 4)])
def test_a_large_block_of_near_copies(spark, monkeypatch, tile, hubs):
    """Without hubs many sets are left outside the base and compared with all of the block."""
    monkeypatch.setattr("speechlake.llm.jaccard_join.HUBS", hubs)
    counts = planned_copies(monkeypatch)
    rows = near_copies(400, 120)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), tile_shingles=tile).collect()
    want = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert len({c for _, c in want.values()}) < 60
    assert [c[0] for c in counts] == ["small_plan", "hub_plan", "rest_plan"] and (counts[2][3] > 100 or hubs)


def test_copies_of_a_large_block(spark, monkeypatch):
    """Thousands of near copies: few copies of each set, whatever the number of tiles."""
    counts = planned_copies(monkeypatch)
    rows = near_copies(6000, 120)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), tile_shingles=12_000).collect()
    sets = len({t for _, t in rows})
    assert len(got) == 6000 and max(Counter(x.component_id for x in got).values()) > 5000
    assert sum(c[1] for c in counts) < 5 * sets


def test_words_of_a_thue_morse_kind_differ(spark):
    """Words over which a polynomial modulo a power of two takes the same value."""
    rows = []
    for n in (1024, 2048, 4096, 8192):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        rows += [word, word.translate(str.maketrans("ab", "ba"))]
    got = jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(x.component_id == x.doc_id and x.n_shingles == 1 for x in got)


def test_very_long_texts(spark):
    """Texts of some megabytes beside short ones: near copies link, one with a tenth of its words changed doesn't."""
    words = [f"w{(i * 7919) % 1_000_003}" for i in range(400_000)]
    near, far = list(words), list(words)
    near[1000::4000] = ["other"] * len(near[1000::4000])
    far[::10] = ["other"] * len(far[::10])
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words[:50])), (5, " ".join(words)), (6, "x" * 2_000_000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id if x.n_shingles else x.doc_id) for x in got} == brute(rows)
