import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from speechlake.llm.mixing import RANKED, halves, hypergeometric, mixed_documents, mixture, shard_quotas, source_targets


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / open_ for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets(spark):
    r = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"k{i:02d}": r.choice([0, 5, 100, 1000, 5000]) + 1 for i in range(n)}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source_key string, size long")).collect()
        want = filled(sizes)
        assert all(abs(x.target - want[x.source_key]) < 1e-6 * (1 + x.target) for x in got) and len(got) == n


def test_hypergeometric(spark):
    from math import comb

    cases = [(10, 4, 5), (50, 20, 25), (7, 7, 3), (9, 0, 4), (300, 150, 150), (5, 2, 0)]
    u = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999]
    rows = [(x, *c) for c in cases for x in u]
    got = spark.createDataFrame(rows, "u double, n long, k long, d long").withColumn("x", hypergeometric(F.col("u"), F.col("n"), F.col("k"), F.col("d"))).collect()
    for g in got:
        cum, x = 0, max(0, g.d - (g.n - g.k))
        while (cum := cum + comb(g.k, x) * comb(g.n - g.k, g.d - x)) <= g.u * comb(g.n, g.d) * (1 - 1e-12):
            x += 1
        assert g.x == x, g


def test_quotas_sum_up(spark):
    quotas = {0: 400, 1: 37, 2: 0, 3: 5}
    got = shard_quotas(spark.createDataFrame(list(quotas.items()), "rank int, n long"), 3).collect()
    assert {k: sum(x.n for x in got if x.rank == k) for k in quotas} == quotas
    loads = Counter()
    for x in got:
        loads[x.shard] += x.n
        assert x.n >= 0
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 3
    own = sorted(x.n for x in got if x.rank == 0)
    assert 35 < own[0] and own[-1] < 56


def test_quotas_of_many_sources(spark):
    r = random.Random(3)
    quotas = {k: r.choice([0, 1, 2, 40]) for k in range(3000)}
    got = shard_quotas(spark.createDataFrame(list(quotas.items()), "rank long, n long"), 3, 8).collect()
    loads, own = Counter(), Counter()
    for x in got:
        loads[x.shard] += x.n
        own[x["rank"]] += x.n
        assert x.n >= 0
    assert own == Counter(quotas) and [loads[k] for k in range(8)] == halves(sum(quotas.values()), 3)
    by_shard = [[x.n for x in got if quotas[x["rank"]] == 40 and x.shard == k] for k in range(8)]
    for own in by_shard:  # as if dealt at random: 40 draws in 8 shards have a mean of 5 and a variance of 40 * 7 / 64
        mean = sum(own) / len(own)
        assert abs(mean - 5) < 0.3 and abs(sum((n - mean) ** 2 for n in own) / len(own) - 40 * 7 / 64) < 0.8


def test_quotas_are_hypergeometric(spark):
    """Two shards, four sources: how often each table comes up, against the exact distribution."""
    from math import comb

    from speechlake.llm.mixing import split_group

    quotas, seen, tables, runs = (2, 3, 1, 2), Counter(), defaultdict(list), 1500
    rows = [(0, [(10 * run + k, n) for k, n in enumerate(quotas)], [4, 4]) for run in range(runs)]
    df = spark.createDataFrame(rows, "group long, own array<struct<rank:bigint,n:bigint>>, room array<bigint>")
    for x in split_group(df, 0, 1).where("shard = 0").orderBy("rank").collect():
        tables[x["rank"] // 10].append(x.n)
    for table in tables.values():
        seen[tuple(table)] += 1
    worst = 0
    for table, n in seen.items():
        assert sum(table) == 4
        p = comb(2, table[0]) * comb(3, table[1]) * comb(1, table[2]) * comb(2, table[3]) / comb(8, 4)
        worst = max(worst, abs(n - runs * p) / (runs * p) ** 0.5)
    assert worst < 5 and len(seen) > 15


def test_numbers_over_ranges(spark, monkeypatch):
    import speechlake.llm.mixing as m

    assert RANKED > 1000
    monkeypatch.setattr(m, "RANKED", 7)
    sizes = {f"k{i:03d}": i % 5 * 10 + 1 for i in range(60)}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source_key string, size long")).collect()
    assert sorted((x.source_key, x["rank"]) for x in got) == [(k, i) for i, k in enumerate(sorted(sizes))]
    want = filled(sizes)
    assert all(abs(x.target - want[x.source_key]) < 1e-6 * (1 + x.target) for x in got)


def test_mixture_of_many_sources(spark):
    rows = [(i, "w " * (i % 7), f"site{i % 2500}.org") for i in range(5000)]
    got = mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += i % 7
    want, taken, source = filled(sizes), Counter(), {i: s for i, _, s in rows}
    for x in got:
        taken[source[x.doc_id]] += x.taken
        assert abs(x.target - want[source[x.doc_id]]) < 1e-6 and x.taken <= 2 * x.size
    assert len(got) == 5000 and abs(sum(taken.values()) / (1.5 * sum(sizes.values())) - 1) < 0.05


def docs(seed=1, n=900):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 3, 20, 90]))) if r.random() > 0.02 else None, r.choice(["b", "b", "b", "a", "c", None, "é"])) for i in range(n)]


def test_mixture(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture(df).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: "~~" if s is None else s for i, _, s in rows}
    sizes = defaultdict(int)
    for i in size:
        sizes[source[i]] += size[i]
    want, taken = filled(sizes), defaultdict(int)
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == sizes[source[x.doc_id]] and abs(x.target - want[source[x.doc_id]]) < 1e-6
        assert x.taken == x.size * len(x.shards) <= 2 * x.size
        taken[source[x.doc_id]] += x.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * sizes[s] + 90 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixture(df.repartition(3)).collect()))
    rows = mixed_documents(df, levels=2, piece_words=2000).collect()
    assert len({(x.shard, x.piece) for x in rows}) > 8 and len({x.shard for x in rows}) == 4
    draws = Counter(x.doc_id for x in rows)
    assert draws == Counter({x.doc_id: len(x.shards) for x in got if x.shards})


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, size string, block int")
    assert mixture(empty).collect() == [] and mixed_documents(empty).collect() == []
    rows = [(1, "a b", None, "x"), (1, "a b", None, "x"), (None, None, "s", None), (2, " \n", "z", "y")]
    got = mixture(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")).collect()
    assert len(got) == 4 and sum(x.size for x in got) == 4
    assert {x.target for x in got} == {0.0, 6.0}
