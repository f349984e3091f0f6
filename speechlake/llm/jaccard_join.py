"""Exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

1. Every text becomes the sorted set of its word shingles' 64-bit hashes.  Texts with equal sets form one class; only the
   first of a class goes on, so a group of copies costs one row.
2. Seeds.  Sets meet by bands of sizes, each band twice as wide as the one below; a set also stands in the band below if it
   can be linked with a set there.  For a band the hash space is cut into more parts than two linked sets can have differing
   shingles, so linked sets agree on whole parts that aren't empty: (band, part, contents) is a key that both have.  A set gives
   as many keys as can differ, one, and a third more; the fullest parts come first.  The few sets that have too few full parts
   also take their shingles one by one as keys.
3. Keys are counted, and keys of a single set dropped.  Of the others each set keeps its rarest ones, so many that with its
   dropped ones they are one more than can differ: linked sets still meet, and a key that very many sets have is only
   used by sets that have hardly any rare one.  Sets without a chance of a partner end here.
4. The members of a key are compared by hashed parity bitmaps: differing bits bound the differing shingles from below, so pairs
   that can't reach the threshold are dropped, and a spanning forest of the others is kept.  Keys with the same members are
   compared once; the members of a large key are dealt to chunks, and each pair of chunks is a list of its own.
5. A component of these forests (a block) is compared in one tile if it is small.  The sets of a large one are dealt to tiles, one copy
   of each, and a few hubs - the sets with most copies and those with most possible links - go to every tile; what is linked so is one group.  Only sets outside
   a block's largest group are compared with all others: their tiles meet the group's tiles and each other where size bands are
   compatible.  In a tile bit counts bound the overlap from above, and only pairs that can still reach the threshold and aren't
   connected yet are intersected exactly.  A tile returns a spanning forest of its links, never all pairs.  Tiles are planned
   on ids and sizes; the sets themselves are shuffled to where they are compared.
6. Components of these links, over all classes, are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlake.llm.common import WordHashes, discard, mixed, settle, slices, utf8
from speechlake.llm.components import connected_components

#: Ratio of the sizes in a band of tiles: a little over 1 / 0.9, so that linked sets are at most one band apart.
SPREAD = 1.005
#: Shingles that a tile of the exact comparison holds at most (8 bytes each); a larger set is a tile of its own.
TILE_SHINGLES = 400_000
#: Sets of a large block, of each of two kinds, that every one of its sets is compared with first.
HUBS = 4
#: Members of a key that are compared in one place, about; twice as many or more are dealt to chunks of that size.
CHUNK = 2048


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data, offsets = utf8(texts)
    for i, j in slices(offsets):
        found = WordHashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        grams = found.grams(words)
        for a, b in zip(found.first[:-1], found.first[1:], strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for h in found.hashes[a:b]:
                    whole = mixed(whole ^ mixed(h.reshape(1), 5), 6)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def most_apart(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` and one that it is linked with have not in common, at most."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def bands_of(n: int, percent: int) -> list[int]:
    """The bands in which a set of ``n`` meets others: that of the smaller set of a linked pair."""
    own = n.bit_length() - 1
    return [own, own - 1] if -(-percent * n // 100) < 1 << own else [own]


def parts_of(band: int, percent: int) -> int:
    """Parts for pairs whose smaller set is in ``band``: a third more than the shingles that any of them can have apart."""
    return most_apart((2 << band) * 100 // percent, percent) * 4 // 3 + 2


@lru_cache(maxsize=256)
def _inner_edges(parts: int) -> np.ndarray:
    return np.minimum(np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts), 2.0**64 - 4096).astype(np.uint64)


def part_keys(s: np.ndarray, band: int, percent: int, single: bool = False) -> tuple[np.ndarray, int]:
    """Keys of a sorted set in ``band``, those of the fullest parts, and how many full parts it has.  ``single``: each shingle is a part.

    The last two bits of a key tell its kind, so that keys of two bands, or of parts and shingles, are told apart.
    """
    if single:
        keys, counts = mixed(s ^ mixed(np.full(1, band, np.uint64), 34), 35), np.ones(len(s), np.int64)
    else:
        m = parts_of(band, percent)
        at = np.concatenate(([0], np.searchsorted(s, _inner_edges(m)), [len(s)]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(s, 31), dtype=np.uint64)))
        sums, counts = total[at[1:]] - total[at[:-1]], np.diff(at)
        full = np.flatnonzero(counts)
        keys, counts = mixed(sums[full] ^ mixed(full.astype(np.uint64) + np.uint64(band << 32), 32), 33), counts[full]
    wanted = most_apart(len(s), percent) + 1 + (most_apart(1 << band, percent) + 3) // 3
    keys = (keys & ~np.uint64(3)) | np.uint64(band & 1 | single << 1)
    return keys[np.lexsort((keys, -counts))[:wanted]], len(counts)


def set_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """All keys of a sorted set; and for each kind of key how many more of the shared ones than there are must be kept (under 0: fewer).

    A set that can only be linked with an equal one has no keys.
    """
    apart, keys, more = most_apart(len(s), percent), [], [0, 0, 0, 0]
    for band in bands_of(len(s), percent) if apart else ():
        own, full = part_keys(s, band, percent)
        keys.append(own)
        more[band & 1] = apart + 1 - len(own)
        if full <= apart:
            own, _ = part_keys(s, band, percent, True)
            keys.append(own)
            more[band & 1 | 2] = apart + 1 - len(own)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), more


SETS = "doc_id long, n_shingles long, set_low long, set_high long, bitmap binary, keys array<long>, more array<int>"


def _set_rows(words: int, percent: int):
    def rows(batches):
        for batch in batches:
            low, high, sizes, bitmaps, keys, more = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                low.append(int(np.sum(mixed(s, 41), dtype=np.uint64)))
                high.append(int(np.sum(mixed(s, 42), dtype=np.uint64)))
                bitmaps.append(parity(s) if len(s) else None)
                own, rest = set_keys(s, percent)
                keys.append(own)
                more.append(rest)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
            values = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(np.array(high, np.uint64).view(np.int64)),
                pa.array(bitmaps, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))), pa.array(more, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(values, [x.split()[0] for x in SETS.split(", ")])

    return rows


def rarest(keyed: DataFrame, several: DataFrame) -> DataFrame:
    """(key, doc_id) that are to be compared, from all (key, doc_id, more).

    Keys of one set are dropped; of the others each document keeps the rarest, ``more`` than it has (so fewer, where ``more`` is
    under 0); the documents in ``several`` (doc_id), which have several sets, keep all.
    """
    counts = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    kind = Window.partitionBy("doc_id", F.col("key").bitwiseAND(3))
    shared = keyed.join(counts.hint("shuffle_hash"), "key").join(several.withColumn("several", F.lit(True)), "doc_id", "left")
    place, have = F.row_number().over(kind.orderBy("n", "key")), F.count("*").over(kind)
    ranked = shared.withColumns({"place": place, "have": have}).where((F.col("place") <= F.col("have") + F.col("more")) | F.col("several"))
    return ranked.select("key", "doc_id")


def comparison_lists(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(list, doc_id): lists in which all pairs of a key's members (key, doc_id) stand together; equal member lists are kept once.

    A key with ``2 * chunk`` members or more is dealt to chunks by a hash of the id; each pair of chunks is a list.
    """
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "doc_id")).alias(f"sum{i}") for i in (1, 2)]
    named = members.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    keys = settle(named.groupBy("n", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    rows = members.join(keys.hint("shuffle_hash"), "key")
    chunks = F.when(F.col("n") < 2 * chunk, 1).otherwise(F.ceil(F.col("n") / chunk)).cast("int")
    rows = rows.select("key", "doc_id", chunks.alias("chunks")).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i != F.col("own"))
    pairs = F.transform(others, lambda i: F.xxhash64("key", F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    return rows.select(F.explode(F.when(F.col("chunks") == 1, F.array("key")).otherwise(pairs)).alias("list"), "doc_id")


def parity(s: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as shingles; a bit tells whether an odd number of shingles fell there."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((mixed(s, 61) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bitmap: bytes, size: int) -> bytes:
    """The bitmap that fewer bits would have given: halves are added until ``size`` bytes are left."""
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def possible_forest(ids: np.ndarray, sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bitmaps don't rule a link out."""
    least = min(map(len, bitmaps))
    maps = np.frombuffer(b"".join(folded(b, least) for b in bitmaps), np.uint64).reshape(len(ids), -1)
    group, out = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if len(rest):
            apart = np.bitwise_count(maps[i] ^ maps[rest]).sum(1, dtype=np.int64)
            low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
            good = ((100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[rest])) & (100 * low >= percent * high)
            for j in rest[good]:
                if group[j] != group[i]:
                    out.append((int(ids[j]), int(ids[i])))
                    group[group == group[j]] = group[i]
    return out


def _forest_rows(percent: int):
    """Edges (id, head) from rows (list, id, size, bitmap) sorted by list; a list's rows may go over batches."""

    def edges(lists, ids, sizes, bitmaps):
        out = []
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(lists) != 0)))
        for a, b in zip(starts, np.concatenate((starts[1:], [len(lists)])), strict=True):
            if b - a == 2 and len(bitmaps[a]) == len(bitmaps[a + 1]):
                n, m = int(sizes[a]), int(sizes[a + 1])
                apart = (int.from_bytes(bitmaps[a]) ^ int.from_bytes(bitmaps[a + 1])).bit_count()
                if (100 + percent) * apart <= (100 - percent) * (n + m) and 100 * min(n, m) >= percent * max(n, m):
                    out.append((int(ids[a + 1]), int(ids[a])))
            elif b - a > 1:
                out += possible_forest(ids[a:b], sizes[a:b], list(bitmaps[a:b]), percent)
        pairs = sorted(set(out))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["doc_id", "head"])

    def rows(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [np.array(batch.column(3).to_pylist(), object)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(now[0]):
                cut = int(np.searchsorted(now[0], now[0][-1]))
                held = [x[cut:] for x in now]
                if cut:
                    yield edges(*(x[:cut] for x in now))
        if held is not None and len(held[0]):
            yield edges(*held)

    return rows


TILES = "array<struct<bucket:bigint,tile:bigint,one:bigint,other:bigint>>"
PAYLOAD = "bucket long, one long, other long, tile long, block long, doc_id long, shingles binary"


def _payload_rows(words: int):
    """The set of each text as bytes, once for each place where it is compared.  Rows: doc_id, block, tiles, text."""

    def rows(batches):
        for batch in batches:
            docs, blocks, tiles = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), batch.column("tiles").to_pylist()
            out: list[tuple] = []
            size = 0
            for doc, block, places, s in zip(docs, blocks, tiles, shingle_sets(batch.column("text"), words), strict=True):
                raw = s.tobytes()
                for t in places:
                    out.append((t["bucket"], t["one"], t["other"], t["tile"], block, doc, raw))
                    size += len(raw)
                if size > 8 << 20:
                    yield _payload_batch(out)
                    out, size = [], 0
            if out:
                yield _payload_batch(out)

    return rows


def _payload_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if n == "shingles" else pa.int64()) for i, n in enumerate(names)], names)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_links(ids: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile, or between two tiles (``tile`` holds at most two values)."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets, tile = ids[order], [sets[i] for i in order], tile[order]
    sizes = np.array([len(s) for s in sets])
    bits = 1 << max(8, int(16 * sizes.max() - 1).bit_length())
    while len(sets) * bits > 1 << 28 and bits > 1 << 10:
        bits >>= 1
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        places = np.unique(mixed(s, 51) & np.uint64(bits - 1)).astype(np.int64)
        flags = np.zeros(bits, bool)
        flags[places] = True
        maps[i] = np.packbits(flags)
    maps = maps.view(np.uint64)
    group, found, across = np.arange(len(sets)), [], tile.min() != tile.max()
    for i in range(len(sets)):
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        rest = np.arange(i + 1, last)
        rest = rest[(group[rest] != group[i]) & ((tile[rest] != tile[i]) | (not across))]
        if not len(rest):
            continue
        # what only set i has fills bits that the other lacks, at least as many shingles as bits
        over = sizes[i] - np.bitwise_count(maps[i] & ~maps[rest]).sum(1, dtype=np.int64)
        for j in rest[100 * over >= percent * (sizes[i] + sizes[rest] - over)]:
            if group[j] != group[i] and linked(sets[i], sets[j], percent):
                found.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return found


def _compare(percent: int):
    def compare(key, t):
        ids, blocks, tiles = (t.column(c).to_numpy() for c in ("doc_id", "block", "tile"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in t.column("shingles").chunks for x in chunk]
        links, order = [], np.argsort(blocks, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            if len(own) > 1:
                links += tile_links(ids[own], [sets[i] for i in own], tiles[own], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: doc_id, text.

    A null, empty or blank text has 0 shingles and is linked with nothing.  Rows that repeat a doc_id are one node with
    several texts.  A row with a null doc_id is returned with a null component.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = settle(docs.mapInArrow(_set_rows(words, percent), SETS).withColumn("row", F.monotonically_increasing_id()), "sets")
    by_set, real = ["n_shingles", "set_low", "set_high"], "n_shingles > 0 and doc_id is not null"
    some, slim = sets.where(real), settle(sets.select("doc_id", *by_set), "slim")
    classes = settle(some.groupBy(*by_set).agg(F.min("doc_id").alias("class_id"), F.min_by("row", "doc_id").alias("row"), F.count("*").alias("copies")), "classes")
    firsts = settle(classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.max("n_shingles").alias("size"), F.count("*").alias("sets"), F.sum("copies").alias("copies")), "firsts")
    chosen = some.where(F.size("keys") > 0).join(classes.select("row").hint("shuffle_hash"), "row", "left_semi")
    chosen = settle(chosen.select("doc_id", F.col("n_shingles").alias("size"), "bitmap", "keys", "more"), "chosen")
    discard(sets)  # keys are most of what is stored, so they go once they have been used

    keyed = chosen.select("doc_id", "more", F.explode("keys").alias("key"))
    keyed = keyed.select("key", "doc_id", F.element_at("more", (F.col("key").bitwiseAND(3) + 1).cast("int")).alias("more"))
    members = settle(rarest(keyed, firsts.where("sets > 1").select("doc_id")), "members")
    bitmaps = settle(chosen.select("doc_id", "size", "bitmap"), "bitmaps")
    discard(chosen)
    met = settle(comparison_lists(members), "lists").join(bitmaps.hint("shuffle_hash"), "doc_id")
    met = met.select("list", "doc_id", "size", "bitmap").repartition("list").sortWithinPartitions("list", "doc_id")
    near = settle(met.mapInArrow(_forest_rows(percent), "doc_id long, head long"), "near")
    blocks = connected_components(near, "doc_id", "head").select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    sized = settle(blocks.join(firsts.select("doc_id", "size", "copies"), "doc_id"), "blocks")

    def compared(plan: DataFrame) -> DataFrame:
        payload = docs.where("doc_id is not null").join(plan.hint("shuffle_hash"), "doc_id").mapInArrow(_payload_rows(words), PAYLOAD)
        return settle(payload.groupBy("bucket", "one", "other").applyInArrow(_compare(percent), "a long, b long"), "links")

    total = settle(sized.groupBy("block").agg(F.sum("size").alias("total"), F.count("*").alias("n")).where("n > 1"), "totals")
    large = sized.join(total.where(F.col("total") > tile_shingles), "block")
    links = compared(settle(small_plan(sized, total, tile_shingles).union(hub_plan(large, near, tile_shingles)), "plan"))
    if not total.where(F.col("total") > tile_shingles).isEmpty():
        plan = settle(rest_plan(settle(grouped(large, links), "grouped"), percent, tile_shingles), "plan")
        if not plan.isEmpty():
            links = links.union(compared(plan))
    copies = slim.where(real).join(classes.drop("row", "copies"), by_set).select("doc_id", "class_id")
    joined = connected_components(links.union(copies.where("doc_id <> class_id")), "a", "b")
    out = slim.select("doc_id", "n_shingles").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _place(bucket, tile, one, other):
    return F.struct(bucket.cast("long").alias("bucket"), tile.cast("long").alias("tile"), one.cast("long").alias("one"), other.cast("long").alias("other"))


def small_plan(sized: DataFrame, total: DataFrame, tile_shingles: int) -> DataFrame:
    """(doc_id, block, tiles) of the blocks of ``tile_shingles`` at most: each is one tile, dealt to buckets of about that size."""
    small = total.where(F.col("total") <= tile_shingles)
    buckets = int((small.agg(F.sum("total")).first()[0] or 0) // tile_shingles) + 1
    zero = F.lit(0)
    return sized.join(small.select("block"), "block").select("doc_id", "block", F.array(_place(F.pmod(F.xxhash64("block"), F.lit(buckets)), zero, zero, zero)).cast(TILES).alias("tiles"))


def hub_plan(large: DataFrame, near: DataFrame, tile_shingles: int) -> DataFrame:
    """(doc_id, block, tiles) of large blocks (doc_id, block, size, copies, total): each set goes to one tile, the hubs of its block to all.

    Hubs are the sets that most documents have, and those with most edges in ``near``.
    """
    degree = near.groupBy(F.col("head").alias("doc_id")).agg(F.count("*").alias("degree"))
    by = lambda c: F.struct(F.coalesce(c, F.lit(0)).alias("most"), F.xxhash64(F.lit("hub"), "doc_id").alias("h"), "doc_id")
    ranked = large.join(degree, "doc_id", "left").select("block", F.pmod(F.xxhash64("doc_id"), F.lit(1024)).alias("part"), by("copies").alias("first"), by("degree").alias("second"))
    # the best of each part of a block, then of the block, so that no group holds more than the parts
    parts = ranked.groupBy("block", "part").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    top = lambda c: F.slice(F.sort_array(F.collect_list(c), False), 1, HUBS)["doc_id"]
    hubs = parts.groupBy("block").agg(F.array_union(top("first"), top("second")).alias("hubs"))
    slices = F.ceil(F.col("total") / tile_shingles).cast("long")
    dealt = large.join(hubs, "block").select("doc_id", "block", slices.alias("slices"), F.array_contains("hubs", F.col("doc_id")).alias("hub"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("slices"))
    zero = F.lit(0)
    tiles = F.transform(F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(own)), lambda x: _place(F.col("block"), zero, -1 - x, -1 - x))
    return dealt.select("doc_id", "block", tiles.cast(TILES).alias("tiles"))


def grouped(large: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, block, size, base): whether a set of a large block is in the block's largest group of linked sets."""
    own = links.join(large.select(F.col("doc_id").alias("a")).hint("shuffle_hash"), "a", "left_semi")
    joined = connected_components(own, "a", "b")
    rows = large.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "block", "size", F.coalesce("component", "doc_id").alias("of"))
    sizes = rows.groupBy("block", "of").agg(F.sum("size").alias("weight"))
    largest = sizes.groupBy("block").agg(F.max_by("of", F.struct("weight", "of")).alias("base_of"))
    return rows.join(largest, "block").select("doc_id", "block", "size", (F.col("of") == F.col("base_of")).alias("base"))


def rest_plan(rows: DataFrame, percent: int, tile_shingles: int) -> DataFrame:
    """(doc_id, block, tiles) that compare the sets outside a block's base with all of the block, from (doc_id, block, size, base).

    The base is cut into tiles (size band, slice of the band by a hash of the id), the rest into slices.  A set of the rest goes to the
    base's tiles of its own and the neighbouring bands, a set of the base meets the rest's slices once each where the rest has sets in
    these bands, and slices of the rest meet each other.  Sets of the base, which are linked with one another, never meet.
    """
    rows = rows.withColumn("band", F.floor(F.log("size") / math.log(100 / percent * SPREAD)))
    base_size, rest_size = F.sum(F.when(F.col("base"), F.col("size"))), F.sum(F.when(~F.col("base"), F.col("size")))
    slices = lambda total: F.ceil(F.coalesce(total, F.lit(0)) / tile_shingles).cast("long")
    bands = settle(rows.groupBy("block", "band").agg(slices(base_size).alias("bases"), F.coalesce(rest_size, F.lit(0)).alias("rest")), "bands")
    plan = bands.join(bands.groupBy("block").agg(slices(F.sum("rest")).alias("rests")), "block")
    for by, side in ((-1, "above"), (1, "below")):
        plan = plan.join(bands.select("block", (F.col("band") + by).alias("band"), *[F.col(n).alias(f"{n}_{side}") for n in ("bases", "rest")]), ["block", "band"], "left")
    dealt = rows.join(settle(plan.na.fill(0), "beside"), ["block", "band"])
    code = lambda band, part: band * F.lit(1 << 32) + part
    numbers = lambda n: F.slice(F.sequence(F.lit(0).cast("long"), n), 1, n.cast("int"))
    of_band = lambda by, n: F.transform(numbers(n), lambda x: code(F.col("band") + by, x))
    bases = F.concat(of_band(0, F.col("bases")), of_band(1, F.col("bases_above")), of_band(-1, F.col("bases_below")))
    near = F.col("rest") + F.col("rest_above") + F.col("rest_below") > 0
    rests = numbers(F.col("rests"))
    own_base, own_rest = code(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("bases"))), F.pmod(F.xxhash64("doc_id"), F.col("rests"))
    # a pair of a base's tile and a rest's slice is told from a pair of two slices by the last bit of ``one``
    met = F.transform(rests, lambda x: _place(F.col("block"), F.lit(0), own_base * 2 + 1, x))
    visited = F.transform(bases, lambda x: _place(F.col("block"), F.lit(1), x * 2 + 1, own_rest))
    among = F.transform(rests, lambda x: _place(F.col("block"), own_rest, F.least(own_rest, x) * 2, F.greatest(own_rest, x)))
    places = F.when(F.col("base") & near, met).when(~F.col("base"), F.concat(visited, among)).otherwise(F.array().cast(TILES))
    return dealt.select("doc_id", "block", places.cast(TILES).alias("tiles")).where(F.size("tiles") > 0)


#: DuckDB SQL for the rows of ``jaccard_components`` with three words and 90 percent, over all pairs that share a shingle.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
t AS (SELECT doc_id, p, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM w),
s AS (SELECT DISTINCT doc_id, k FROM t WHERE p <= greatest(1, n - 2)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * shared >= 90 * (cx.n + cy.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS seen FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) m USING (doc_id)"""
