"""Importance resampling towards a target distribution of hashed word n-grams.

1. Position table.  Texts are cut into runs of words, each with the next run's first words as a halo; the words of a run are
   exploded with their positions, and ``lead`` over the run concatenates the words that follow for each order.  A run is one
   window of bounded size, however long its text is.
2. Hash.  Each n-gram falls into one of ``BUCKETS`` buckets by the CRC-32 of its bytes.  Buckets are counted over all documents
   and over the target texts, combined before the shuffle; a bucket's gain is the scaled log ratio of its two shares.
3. Join.  The gains - a row per bucket, so of fixed size - are broadcast to the same position table (its exchange is used
   again) and summed per document.
4. Draw.  Gumbel noise from a hash of the id is added to the weight; the highest scores are a draw without replacement.  Ranks
   are global: scores are dealt to ranges, counted per range, and numbered in each range.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import discard, settle

#: What separates words, as a Java pattern: all of ASCII but digits and lower-case letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
ORDERS = 3
#: Words of a text that stand in one window of the position table.
RUN_WORDS = 4_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else unchanged; ``lower`` does that where there are only ASCII characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), APART), "")


def position_table(texts: DataFrame, orders: int = ORDERS, run_words: int = RUN_WORDS) -> DataFrame:
    """(row, doc_id, order, gram) from (row, doc_id, text), where ``row`` tells texts apart.

    An n-gram of each order (0: one word) starts at each word; ``gram`` is null where the text ends before, and for each order of a
    text without words.
    """
    split = texts.select("row", "doc_id", words_of(F.col("text")).alias("words"))
    runs = split.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size(words) - 1) div {run_words}").cast("int")))).alias("run"))
    text = F.array_join(F.slice("words", F.col("run") * run_words + 1, run_words + orders - 1), " ")
    runs = runs.select("row", "doc_id", "run", text.alias("text")).repartition("row", "run")
    placed = runs.select("row", "doc_id", "run", F.posexplode_outer(F.when(F.col("text") != "", F.split("text", " "))).alias("pos", "word"))
    following = Window.partitionBy("row", "doc_id", "run").orderBy("pos")
    placed = placed.select("row", "doc_id", "pos", "word", *[F.lead("word", i).over(following).alias(f"word{i}") for i in range(1, orders)])
    grams = [F.col("word")]
    for i in range(1, orders):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"word{i}")))
    starts = placed.where((F.col("pos") < run_words) | F.col("pos").isNull())
    return starts.select("row", "doc_id", F.posexplode(F.array(*grams)).alias("order", "gram"))


def hashed(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The position table with ``bucket`` in place of ``gram``."""
    return grams.select("row", "doc_id", "order", (F.crc32(F.col("gram").cast("binary")) % buckets).alias("bucket"))


def numbered(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each bucket that occurs, from the hashed features of both sides."""
    side = lambda df, n, m: df.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", n.alias("s"), m.alias("t"))
    zero = F.lit(0).cast("long")
    both = side(source, F.col("n"), zero).union(side(target, zero, F.col("n"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    double = lambda c, more: (F.col(c) + more).cast("double")
    ratio = double("t", 1) * double("all_s", buckets) / (double("s", 1) * double("all_t", buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from a hash of the id (null: as an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def importance_scores(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) for each row of ``docs``: doc_id, text; ``target``: text.

    A text without words, empty or null, has no features and the weight 0.  ``docs`` is a stored table, so that ``row`` doesn't change
    when a task is repeated.  Rows that repeat an id are documents of their own with the same noise.  Other columns are ignored.
    """
    features = hashed(position_table(numbered(docs, "doc_id")), buckets)
    wanted = hashed(position_table(target.select(F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("doc_id"), "text")), buckets)
    gains = F.broadcast(bucket_gains(features, wanted, buckets))  # a row per bucket
    sums = features.join(gains, "bucket", "left").groupBy("row", "doc_id").agg(
        F.count(F.when(F.col("order") == 0, F.col("bucket"))).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")
    )
    return sums.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def global_ranks(rows: DataFrame, first: int) -> DataFrame:
    """(row, rank) of the ``first`` rows of (row, doc_id, score): highest scores, then smaller ids (null last), then smaller rows.

    Rows are dealt to ranges in that order; the driver sees a count per range.  Only ranges that begin among the first are numbered.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = settle(rows.select("row", "doc_id", "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    offsets, upto = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").agg(F.count("*")).collect())):
        if upto < first:
            offsets.append((part, upto))
        upto += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, offset long"))
    numbered_in = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranks = dealt.join(offsets, "part").select("row", (F.col("offset") + numbered_in).alias("rank")).where(F.col("rank") <= first)
    ranks = settle(ranks, "ranks")
    discard(dealt)
    return ranks


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``: doc_id, text.

    Of the rows with ``least_words`` words, ``percent`` percent (down) with the highest scores get a rank, from 1; the others have
    none.  An empty table gives an empty result; an empty target makes gains of the documents' own counts.
    """
    scores = settle(importance_scores(docs, target, seed), "scores")
    among = scores.where(F.col("n_words") >= least_words)
    ranks = global_ranks(among, percent * among.count() // 100)
    return scores.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's bytes, four bits at a time."""
    steps = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        steps.append(n)
    digits = f"hex(encode({text}))"
    halves = f"list_transform(range(length({digits})), lambda i: (instr('0123456789ABCDEF', {digits}[xor(i, 1) + 1]) - 1)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: xor(c >> 4, ({steps}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295)"


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_NOISE = f"floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))"
#: DuckDB SQL for the rows of ``resample`` of documents towards benchmark.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
starts AS (SELECT true AS own, doc_id AS id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d UNION ALL SELECT false, item_id, ws, unnest(range(1, len(ws) + 1)) FROM b),
orders AS (SELECT *, unnest([0, 1, 2]) AS more FROM starts),
grams AS (SELECT own, id, array_to_string(ws[p : p + more], ' ') AS g, count(*) AS n FROM orders WHERE p + more <= len(ws) GROUP BY ALL),
codes AS (SELECT g, {sql_crc32("g")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM grams)),
f AS (SELECT own, id, bucket, n FROM grams JOIN codes USING (g)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM f GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM c),
w AS (SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN gains USING (bucket) WHERE own GROUP BY id),
s AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + {_NOISE})::BIGINT AS score FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {PERCENT} // 100 AS n FROM s WHERE n_words >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, rank FROM s LEFT JOIN (SELECT * FROM r WHERE rank <= n) r ON s.doc_id = r.doc_id"""
