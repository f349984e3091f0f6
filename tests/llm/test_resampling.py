import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from speechlake.llm import resampling
from speechlake.llm.resampling import global_ranks, position_table, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s = Counter(bucket(g) for _, t in docs for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, text in docs:
        n, own = grams(text)
        weight = sum(gain[bucket(g)] for g in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    among = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(among[: percent * len(among) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n=400, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choices("abcDÉé日0", k=r.randint(1, 4))) for _ in range(200)]
    texts = [r.choice(["", " ", "-"]) + r.choice([" ", ", ", "\n", "\x00"]).join(r.choices(words, k=r.choice([0, 1, 2, 3, 25, 60]))) for _ in range(n)]
    texts += [texts[7]] * (n // 2) + [None, "", "...", "İstanbul ÉCOLE Éa " * 10]
    return [(3 * i, t) for i, t in enumerate(texts)], [" ".join(r.choices(words[:40], k=30)) for _ in range(10)] + [None, "x"]


def test_same_as_brute_force(spark, monkeypatch):
    docs, target = corpus()
    want = brute(docs, target)
    for run in (4000, 7):
        monkeypatch.setattr(position_table, "__defaults__", (3, run))
        got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) > 3


def test_long_text_over_many_runs(spark):
    text = " ".join(f"w{i % 977}" for i in range(9001))
    got = resample(spark.createDataFrame([(1, text, 5), (2, "b " * 30, 6)], "doc_id long, text string, run int"), spark.createDataFrame([("w1 w2",)], "text string"), percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(1, text), (2, "b " * 30)], ["w1 w2"], 50)


def test_edge_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(None, "a b " * 15, 1), (None, "a b " * 15, 2), (4, None, 3), (4, "a b " * 15, 4)], "doc_id long, text string, bucket long")
    none = spark.createDataFrame([], "text string")
    assert resample(docs, none).collect() == []
    got = sorted(map(tuple, resample(some, none, percent=100).collect()), key=repr)
    want = brute([(None, "a b " * 15), (None, "a b " * 15), (4, None), (4, "a b " * 15)], [], 100)
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == [0, 1, 2, 3]


def test_ranks_over_many_ties(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("row"), (F.col("id") % 50).alias("doc_id"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 9).cast("long").alias("score"))
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id, r.row))[:2500]
    got = global_ranks(rows, 2500).collect()
    assert sorted((r["rank"], r["row"]) for r in got) == [(k, r["row"]) for k, r in enumerate(want, 1)]
    assert global_ranks(rows, 0).count() == 0


def test_sql_crc32_is_the_checksum():
    import duckdb

    texts = ["a", "", "é日", "word " * 9]
    got = duckdb.sql(f"SELECT {resampling.sql_crc32('s')} FROM (SELECT unnest({texts}) AS s)").fetchall()
    assert [x for (x,) in got] == [zlib.crc32(t.encode()) for t in texts]
