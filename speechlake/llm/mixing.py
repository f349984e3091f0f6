"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets.  Sources in code point order (null last) weigh 5, 2, 1, repeating; they share ``share`` of all words; a target
   stops at ``cap`` times its source, and the excess is shared again by weight until no target is above its cap.
2. Blocks.  A keyed hash deals each source's documents to the same number of blocks, whatever the source's size, so that a
   hot source isn't a hot group.  A source's quota is a whole number of block draws: as many full passes as fit into the
   target, and of one more pass the blocks, in permuted order, that come nearest to the rest.
3. Splitting tree.  The quotas of all sources stand at the root.  Each node halves its draws; how many of each source go left
   is drawn from the hypergeometric distribution given what is left (inverse of the distribution function at a keyed hash), so
   every shard's quotas are whole numbers, sum up exactly, and are distributed as if the draws had been dealt at random.
   Sources form a tree too, ``FAN`` to a group: the groups' quotas are split first, then those of each group's members given the
   group's, so that a row never holds more than ``FAN`` sources and the groups are split side by side.
4. Each source's permuted draws are dealt to the shards by these quotas; within a shard documents are shuffled locally, in
   pieces of bounded size: a hash deals a shard's documents to its pieces, so the pieces one after the other are a shuffled shard.

Only DataFrame functions are used.  What is gathered per source is one row, and what is gathered per block is one row; all
sources together are only sorted in ranges and summed up, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import settle, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCKS = 256
#: Levels of the tree; it has 2 ** LEVELS shards.
LEVELS = 5
#: Words in a piece of a shard, about: what one task shuffles.
PIECE_WORDS = 2_000_000
SEED = 20
#: Sources in a group of the splitting tree; sources that one task numbers, about.
FAN, RANKED = 64, 100_000


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(u: Column, population: Column, marked: Column, draws: Column) -> Column:
    """How many of ``draws`` out of ``population`` are ``marked``, at quantile ``u`` in [0, 1).

    Numbers twelve standard deviations and forty off the mean aren't tried: all of them together have less weight than the
    2 ** -52 that quantiles are apart.
    """
    share = F.when(population > 0, marked / population).otherwise(0.0)
    mean = draws * share
    spread = F.sqrt(mean * (1 - share) * (population - draws) / F.greatest(population - 1, F.lit(1)))
    far = (F.ceil(spread * 12) + 40).cast("long")
    least = F.greatest(F.lit(0).cast("long"), draws - (population - marked), F.floor(mean).cast("long") - far)
    most = F.greatest(least, F.least(marked, draws, F.ceil(mean).cast("long") + far))
    start = F.struct(u.alias("u"), population.alias("n"), marked.alias("k"), draws.alias("d"), least.alias("lo"), most.alias("hi"))

    def ratio(s, x):  # of the weights at x + 1 and at x
        return F.log(((s["k"] - x) * (s["d"] - x)).cast("double") / ((x + 1) * (s["n"] - s["k"] - s["d"] + x + 1)).cast("double"))

    def steps(s):
        return F.slice(F.sequence(s["lo"], s["hi"]), 1, (s["hi"] - s["lo"]).cast("int"))

    zero = F.lit(0.0)

    def highest(s):
        return F.aggregate(steps(s), F.struct(zero.alias("w"), zero.alias("top")), lambda a, x: bound(a["w"] + ratio(s, x), lambda w: F.struct(w.alias("w"), F.greatest(a["top"], w).alias("top"))), lambda a: a["top"])

    def total(s, top):
        return F.aggregate(steps(s), F.struct(zero.alias("w"), F.exp(-top).alias("sum")), lambda a, x: bound(a["w"] + ratio(s, x), lambda w: F.struct(w.alias("w"), (a["sum"] + F.exp(w - top)).alias("sum"))), lambda a: a["sum"])

    def quantile(s, top, aim):
        first = F.struct(zero.alias("w"), F.exp(-top).alias("sum"), s["lo"].alias("at"))
        step = lambda a, x: bound(a["w"] + ratio(s, x), lambda w: F.struct(w.alias("w"), (a["sum"] + F.exp(w - top)).alias("sum"), F.when(a["sum"] <= aim, x + 1).otherwise(a["at"]).alias("at")))
        return F.aggregate(steps(s), first, step, lambda a: a["at"])

    return bound(start, lambda s: bound(highest(s), lambda top: bound(s["u"] * total(s, top), lambda aim: quantile(s, top, aim))))


def uniform(*keys) -> Column:
    """A number in [0, 1) from a keyed hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_key (no null) and block."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(BLOCKS)).cast("int"))


def ranked_sources(own: DataFrame) -> DataFrame:
    """(source_key, source_size, rank): rows numbered from 0 in the order of source_key, which is dealt to tasks in ranges."""
    parts = own.count() // RANKED + 1
    ranges = settle(own.repartitionByRange(parts, "source_key").withColumn("part", F.spark_partition_id()), "ranges")
    counts, before, starts = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()), 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    starts = own.sparkSession.createDataFrame(starts, "part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    return ranges.withColumn("place", place).join(starts, "part").select("source_key", "source_size", (F.col("place") + F.col("start")).alias("rank"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source_key, rank, source_size, target) from (source_key, size); keys sort as the sources do, null last.

    The excess is shared again until no more sources fill up; a round is one sum over the sources, exact in any order.
    """
    ranked = ranked_sources(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = settle(ranked.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight")), "ranked")
    water, full = 0.0, -1
    while True:
        is_full = (F.col("level") <= water) if full >= 0 else F.lit(False)
        exact = F.col("weight").cast("decimal(20,6)")
        state = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(is_full, F.col("source_size")).otherwise(0)).alias("filled"), F.sum(F.when(~is_full, exact)).alias("open"), F.count(F.when(is_full, 1)).alias("n")).first()
        if state["n"] == full or not state["open"]:
            break
        full, water = state["n"], (state["all"] * share - state["filled"] * cap) / float(state["open"])
    reached = F.least("most", F.col("weight") * water) if state["open"] else F.col("most")
    return ranked.select("source_key", "rank", "source_size", reached.alias("target"))


def halves(total: int, levels: int) -> list[int]:
    """``total`` cut in two ``levels`` times; the one more of an odd number goes left at nodes of an odd number, right at others."""
    nodes = [(1, total)]
    for _ in range(levels):
        cut = [(node, n, (n + node % 2) // 2) for node, n in nodes]
        nodes = [x for node, n, left in cut for x in ((2 * node, left), (2 * node + 1, n - left))]
    return [n for _, n in nodes]


def split_group(rows: DataFrame, height: int, levels: int) -> DataFrame:
    """(rank, shard, n) from (group, own, room): the draws of a group's members dealt to shards that have room for so many of the group."""
    nodes = rows.select("own", "room", F.lit(1).cast("long").alias("node"))
    zero = F.lit(0).cast("long")
    for _ in range(levels):
        half = (F.size("room") / 2).cast("int")
        nodes = nodes.withColumns({"total": F.aggregate("own", zero, lambda a, x: a + x["n"]), "first": F.slice("room", 1, half), "second": F.slice("room", half + 1, half)})
        start = F.struct(F.col("total").alias("n"), F.aggregate("first", zero, lambda a, x: a + x).alias("d"), F.array().cast("array<struct<rank:bigint,n:bigint>>").alias("left"))

        def deal(a, x):
            drawn = hypergeometric(uniform(F.lit(height), F.col("node"), x["rank"]), a["n"], x["n"], a["d"])
            return bound(drawn, lambda k: F.struct((a["n"] - x["n"]).alias("n"), (a["d"] - k).alias("d"), F.concat(a["left"], F.array(F.struct(x["rank"].alias("rank"), k.alias("n")))).alias("left")))

        nodes = nodes.withColumn("left", F.aggregate("own", start, deal, lambda a: a["left"]))
        right = F.zip_with("own", "left", lambda x, y: F.struct(x["rank"].alias("rank"), (x["n"] - y["n"]).alias("n")))
        side = lambda node, own, room: F.struct(node.alias("node"), own.alias("own"), room.alias("room"))
        both = F.array(side(F.col("node") * 2, F.col("left"), F.col("first")), side(F.col("node") * 2 + 1, right, F.col("second")))
        nodes = nodes.select(F.explode(both).alias("x")).select("x.*")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.explode("own").alias("x")).select("x.rank", "shard", "x.n")


def shard_quotas(quotas: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(rank, shard, n) from (rank, n): whole draws of each source in each of 2 ** levels shards."""
    quotas = settle(quotas.select(F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n")), "quotas")
    whole = quotas.agg(F.max("rank").alias("last"), F.sum("n").alias("n")).first()
    depth = 1
    while fan**depth <= (whole["last"] or 0):
        depth += 1
    room = quotas.sparkSession.createDataFrame([(0, halves(whole["n"] or 0, levels))], "group long, room array<long>")
    for height in reversed(range(depth)):
        members = quotas.groupBy(F.floor(F.col("rank") / fan**height).alias("rank")).agg(F.sum("n").alias("n"))
        own = F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("own")
        groups = members.groupBy(F.floor(F.col("rank") / fan).alias("group")).agg(own).join(room, "group")
        dealt = settle(split_group(groups, height, levels), "dealt")
        shards = F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"])
        room = dealt.groupBy(F.col("rank").alias("group")).agg(shards.alias("room"))
    return dealt


def draw_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, levels: int = LEVELS) -> DataFrame:
    """(source_key, block, source_size, target, draws, shards) for each block, from rows of (source_key, block, size)."""
    blocks = settle(sized.groupBy("source_key", "block").agg(F.sum("size").alias("size")), "blocks")
    targets = settle(source_targets(blocks, weights, share, cap), "targets")
    order = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(SEED + 1), "source_key", "block"), "block")
    plan = blocks.join(targets, "source_key").withColumn("upto", F.sum("size").over(order))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    plan = plan.withColumn("draws", F.least(F.col("passes") + (F.col("upto") - F.col("size") / 2 < rest).cast("long"), F.lit(int(cap))))
    plan = settle(plan.select("source_key", "block", "rank", "source_size", "target", "draws"), "draws")

    slots = shard_quotas(plan.groupBy("rank").agg(F.sum("draws").alias("n")), levels)
    slots = slots.select("rank", "shard", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i")).where("i > 0")
    slots = slots.select("rank", "shard", F.row_number().over(Window.partitionBy("rank").orderBy("shard", "i")).alias("slot"))
    units = plan.select("source_key", "block", "rank", F.explode(F.sequence(F.lit(0).cast("long"), "draws")).alias("turn")).where("turn > 0")
    units = units.withColumn("slot", F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(SEED + 2), "source_key", "block", "turn"), "block", "turn")))
    dealt = units.join(slots, ["rank", "slot"]).groupBy("source_key", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    out = plan.join(dealt, ["source_key", "block"], "left").select("source_key", "block", "source_size", "target", "draws", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    return settle(out, "plan")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for each row of ``docs``: doc_id, text, source.

    ``taken`` is size times the number of draws, ``shards`` the shard of each draw.  A null text has size 0; a null source is
    a source, the last one; rows with one doc_id are drawn together; a source without words has target 0.  Other columns are ignored.
    """
    sized = settle(with_sizes(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_key", "block"), "sizes")
    plan = draw_plan(sized, **options)
    return sized.join(plan, ["source_key", "block"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("draws")).alias("taken"), "shards")


def mixed_documents(docs: DataFrame, levels: int = LEVELS, piece_words: int = PIECE_WORDS, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn, with its shard and piece, the rows of a piece shuffled.

    Columns of ``docs`` that this adds (shard, piece) are replaced.
    """
    columns = [c for c in docs.columns if c not in ("shard", "piece")]
    named = docs.select(F.col("doc_id"), "text", "source", F.struct(*columns).alias("row"))
    sized = with_sizes(named)
    plan = draw_plan(sized.select("source_key", "block", "size"), levels=levels, **options)
    words = plan.groupBy("source_key").agg(F.max("target").alias("target")).agg(F.sum("target")).first()[0] or 0
    shards = 1 << levels
    pieces = int(words / shards / piece_words) + 1
    drawn = sized.join(plan.where("draws > 0"), ["source_key", "block"]).select("row", F.posexplode("shards").alias("turn", "shard"))
    drawn = drawn.withColumn("piece", F.pmod(F.xxhash64(F.lit(SEED + 4), "row.doc_id", "turn"), F.lit(pieces)).cast("int"))
    order = F.xxhash64(F.lit(SEED + 3), "shard", "row.doc_id", "turn")
    return drawn.repartition(shards * pieces, "shard", "piece").sortWithinPartitions("shard", "piece", order).select("row.*", "shard", "piece")
