"""Benchmark decontamination over a distributed positional inverted index.

1. Index.  Documents are dealt to segments of a few MB; a segment is a row with its terms and, per term, the positions at which
   they stand - a positional inverted index of these documents, stored in the shared folder.  Terms are 64-bit hashes of words.
   For a given benchmark only postings of its terms are stored, as no other list is ever read.
2. Windows.  Equal windows of the benchmark are one; each knows the class of items it comes from.  Counts of terms over the whole
   index order its terms from the rarest on.
3. Search.  In each segment the windows of which a term is absent are dropped, rarest terms first.  Windows that share their two
   rarest terms at one distance are searched as one: the rarest term's list is intersected with the next one's, moved by the distance;
   what is left is checked against the remaining lists, each moved by its offset.  Matches that cross documents are dropped.
4. Proximity.  With the same lists: occurrences of an item's rarest term stay as long as each further term, by rarity, has an
   occurrence near enough; the shortest span over all terms is found among what is left.

Windows are broadcast in blocks of a fixed number, each searched in a pass over the index, so a benchmark of any size can be used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import WordHashes, discard, settle, slices, utf8

WINDOW = 10
#: Bytes of text in a segment, about; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Distinct terms of a benchmark up to which the index leaves out all others; with more it holds every term.
VOCABULARY = 1 << 21
#: Windows, or items of the proximity search, that one pass over the index looks for.
BLOCK = 1 << 16
#: Occurrences that are intersected in one step.
STEP = 1 << 21

#: All of ASCII but digits and letters stands between words.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

INDEX = "segment long, doc_ids array<long>, first array<long>, terms array<long>, ends array<long>, gaps array<int>"
FOUND = "segment long, place int, doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, classes array<long>"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.replace("start:bigint,end", "start:end").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _index_rows(vocabulary):
    def rows(batches):
        wanted = None if vocabulary is None else vocabulary.value
        count, base = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SEGMENT_BYTES):
                found = WordHashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True, separators=SEPARATORS)
                terms, positions = found.hashes, np.arange(len(found.hashes), dtype=np.int64)
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, terms), max(len(wanted) - 1, 0))
                    positions = np.flatnonzero(wanted[at] == terms) if len(wanted) else positions[:0]
                    terms = terms[positions]
                order = np.argsort(terms, kind="stable")
                terms, positions = terms[order], positions[order]
                ends = np.flatnonzero(np.concatenate((terms[1:] != terms[:-1], np.ones(min(1, len(terms)), bool)))) + 1
                gaps = np.diff(positions, prepend=0).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids.slice(i, j - i))
                lists = [_one_list(x) for x in (found.first.astype(np.int64), terms[ends - 1].view(np.int64), ends.astype(np.int64), gaps)]
                yield _batch(INDEX, [[base + count], own, *lists])
                count += 1

    return rows


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): a row per segment.

    ``vocabulary`` (term): only these are indexed, if they are ``VOCABULARY`` at most.  A null text has no words; a document without
    an id, or with one that others have too, is a document of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY:
        terms = np.sort(vocabulary.select("term").toArrow().column(0).to_numpy().view(np.uint64))
        wanted = docs.sparkSession.sparkContext.broadcast(terms)
    return settle(docs.mapInArrow(_index_rows(wanted), INDEX), "index")


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of each term in the whole index."""
    length = F.transform("ends", lambda x, i: x - F.when(i == 0, 0).otherwise(F.element_at("ends", F.greatest(i, F.lit(1)).cast("int"))))
    listed = index.select(F.explode(F.arrays_zip("terms", length.alias("n"))).alias("x"))
    return listed.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("n"))


class Segment:
    """One row of the index."""

    def __init__(self, row):
        values = lambda c: row[c].values.to_numpy(zero_copy_only=False)
        self.number, self.doc_ids = row["segment"].as_py(), row["doc_ids"].as_py()
        self.first, self.terms, self.ends = values("first"), values("terms").view(np.uint64), values("ends")
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.positions = np.cumsum(values("gaps"), dtype=np.int64)
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.span + self.positions

    def which(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def stands(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a term stands at a position."""
        inside = (position >= 0) & (position < self.span)
        key = term * self.span + np.where(inside, position, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return inside & (self.keys[at] == key)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def segments_of(batches) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment({c: batch.column(c)[i] for c in batch.schema.names})


class Block:
    """Windows as arrays: ``terms`` and ``offsets`` by rarity, rows filled up with their rarest one, ``lengths`` and ``classes``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, offsets: np.ndarray, width: int):
        first = np.cumsum(lengths) - lengths
        place = first[:, None] + np.where(np.arange(width) < lengths[:, None], np.arange(width), 0)
        self.classes, self.lengths, self.terms, self.offsets = ids, lengths, terms[place], offsets[place]


def occurrences(s: Segment, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all occurrences of a block's windows in a segment."""
    alive, width = np.arange(len(block.lengths)), block.terms.shape[1]
    place = np.empty(block.terms.shape, np.int64)
    for k in range(width):
        place[alive, k] = s.which(block.terms[alive, k])
        alive = alive[place[alive, k] >= 0]
    nothing = np.zeros(0, np.int64)
    if not len(alive):
        return nothing, nothing
    second = min(1, width - 1)
    anchors = np.stack((place[alive, 0], place[alive, second], block.offsets[alive, second] - block.offsets[alive, 0]))
    anchors, of = np.unique(anchors, axis=1, return_inverse=True)
    of = of.reshape(-1)
    alive = alive[np.argsort(of, kind="stable")]  # windows by anchor
    upto = np.cumsum(np.bincount(of, minlength=anchors.shape[1]))
    sizes = (s.ends - s.begins)[anchors[0]]
    windows, starts = [nothing], [nothing]
    for a, b in _pieces(sizes):
        which = np.repeat(np.arange(a, b), sizes[a:b])
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
        at = s.positions[s.begins[anchors[0][which]] + inside]
        good = s.stands(anchors[1][which], at + anchors[2][which])
        which, at = which[good], at[good]
        n = upto[which] - np.where(which > 0, upto[which - 1], 0)  # windows of the anchor
        for c, d in _pieces(n):
            own = np.repeat(upto[which[c:d]] - n[c:d], n[c:d]) + np.arange(n[c:d].sum()) - np.repeat(np.cumsum(n[c:d]) - n[c:d], n[c:d])
            window = alive[own]
            start = np.repeat(at[c:d], n[c:d]) - block.offsets[window, 0]
            for k in range(2, width):
                good = s.stands(place[window, k], start + block.offsets[window, k])
                window, start = window[good], start[good]
            good = start >= 0
            window, start = window[good], start[good]
            doc = s.document(start)
            good = start + block.lengths[window] <= s.first[doc + 1]
            windows.append(window[good])
            starts.append(start[good])
    return np.concatenate(windows), np.concatenate(starts)


def _pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``n`` whose sums are about ``STEP``."""
    total = np.cumsum(n)
    if len(n):
        cuts = np.unique(np.searchsorted(total, np.arange(0, max(1, total[-1]), STEP))).tolist()
        yield from zip(cuts, [*cuts[1:], len(n)], strict=True)


def _found_rows(shared, every_document: bool):
    def rows(batches):
        block = shared.value
        for s in segments_of(batches):
            window, start = occurrences(s, block)
            cover = np.zeros(s.span + 1, np.int32)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + block.lengths[window], -1)
            edge = s.first[:-1][np.diff(s.first) > 0]
            hit = np.cumsum(cover[:-1]) > 0
            turn = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1])) | hit & np.isin(np.arange(len(hit)), edge))
            stop = np.searchsorted(np.flatnonzero(~hit), turn)
            stop = np.minimum(np.flatnonzero(~hit)[stop], s.first[s.document(turn) + 1])
            spans, classes = {}, {}
            for d, a, b in zip(s.document(turn).tolist(), turn.tolist(), stop.tolist(), strict=True):
                spans.setdefault(d, []).append({"start": a - int(s.first[d]), "end": b - int(s.first[d])})
            pairs = np.unique(np.stack((s.document(start), block.classes[window])), axis=1)
            for d, c in pairs.T.tolist():
                classes.setdefault(d, []).append(c)
            docs = range(len(s.doc_ids)) if every_document else sorted(spans)
            yield _batch(FOUND, [
                pa.array([s.number] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([s.doc_ids[d] for d in docs], pa.int64()),
                pa.array([int(s.first[d + 1] - s.first[d]) for d in docs], pa.int64()),
                pa.array([spans.get(d, []) for d in docs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([classes.get(d, []) for d in docs], pa.list_(pa.int64())),
            ])

    return rows


def _item_rows(window: int):
    def rows(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = WordHashes(data, offsets, lower=True, separators=SEPARATORS)
            ids, terms = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
                own = found.hashes[a:b].view(np.int64)
                for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                    ids.append(item)
                    terms.append(own[i : i + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    return rows


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((window_id, terms, class_id), (class_id, items)) of ``items``: item_id, text.

    A text of fewer than ``window`` words, but not none, is one window.  A class is a sorted array of ids as strings; windows of an item
    without an id are windows too, of a class that lacks it.
    """
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = own.mapInArrow(_item_rows(window), "item_id string, terms array<long>").groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = settle(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    classes = settle(windows.groupBy("items").agg(F.min("window_id").alias("class_id")), "classes")
    return settle(windows.join(classes, "items").select("window_id", "terms", "class_id"), "windows"), classes


def _blocks(windows: DataFrame, index: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Class ids, lengths, terms and offsets of the windows all of whose terms are in the index; terms by rarity, those of one window
    after those of another.  Blocks of about ``block`` windows, at least one block.
    """
    placed = windows.select("window_id", "class_id", F.posexplode("terms").alias("at", "term")).join(term_counts(index), "term", "left")
    plan = F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("plan")
    plans = placed.groupBy("window_id", "class_id").agg(F.bool_and(F.col("n").isNotNull()).alias("whole"), plan).where("whole").select("window_id", "class_id", "plan")
    plans = settle(plans, "plans")
    many = -(-plans.count() // block) or 1
    for i in range(many):
        own = plans.where(F.pmod(F.xxhash64("window_id"), F.lit(many)) == i).orderBy("window_id")
        rows = own.select("class_id", F.size("plan").cast("long").alias("n"), "plan.term", F.transform("plan.at", lambda x: x.cast("long")).alias("at")).toArrow().combine_chunks()
        flat = [rows.column(c).to_numpy() if c in ("class_id", "n") else rows.column(c).combine_chunks().flatten().to_numpy() for c in rows.column_names]
        yield flat[0], flat[1], flat[2].view(np.uint64), flat[3]


def phrase_matches(index: DataFrame, windows: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(segment, place, doc_id, n_words, spans, classes) for each document of the index.

    ``spans``: disjoint sorted (start, end) of the words that stand in an occurrence of a window; ``classes``: sorted class ids of
    the windows that occur; both empty where none does.
    """
    context, parts = index.sparkSession.sparkContext, []
    for rows in _blocks(windows, index, block):
        parts.append(index.mapInArrow(_found_rows(context.broadcast(Block(*rows, window)), not parts), FOUND))
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    flat = lambda c: F.flatten(F.collect_list(c))
    found = found.groupBy("segment", "place", "doc_id", "n_words").agg(F.sort_array(flat("spans")).alias("all"), F.sort_array(F.array_distinct(flat("classes"))).alias("classes"))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def join(done, x):
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), wider).otherwise(F.concat(done, F.array(x)))

    return found.select("segment", "place", "doc_id", "n_words", F.aggregate("all", start, join).alias("spans"), "classes")


def named_items(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(found_classes, n_items, items_sha256) for each distinct array ``classes`` of ``found``; the ids are sorted as strings."""
    sets = found.select(F.col("classes").alias("found_classes")).distinct()
    ids = sets.select("found_classes", F.explode("found_classes").alias("class_id")).join(classes, "class_id").select("found_classes", F.explode("items").alias("item"))
    return ids.groupBy("found_classes").agg(F.sort_array(F.collect_set("item")).alias("items")).select("found_classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of ``docs``: doc_id, text; ``items``: item_id, text.

    Null and empty texts have no words; an item without words has no window.  Rows that repeat an id are documents of their own,
    items that repeat one are the same item.  A window of an item with a null id marks words, but the item isn't counted.
    """
    windows, classes = item_windows(items, window)
    index = build_index(docs, windows.select(F.explode("terms").alias("term")).distinct())
    found = settle(phrase_matches(index, windows, window, block), "found")
    discard(index)
    named = settle(named_items(found.where(F.size("classes") > 0), classes), "named")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    own = lambda df, n, sha: df.select("doc_id", "n_words", length.alias("n_hit"), n.alias("n_items"), F.coalesce(sha, F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")
    hit = found.where(F.size("classes") > 0).withColumnRenamed("classes", "found_classes").join(named, "found_classes", "left")
    clean = found.where(F.size("classes") == 0)
    return own(hit, F.coalesce("n_items", F.lit(0).cast("long")), F.col("items_sha256")).union(own(clean, F.lit(0).cast("long"), F.lit(None).cast("string")))


def shortest_spans(s: Segment, terms: np.ndarray, within: int) -> dict[int, int]:
    """Per document of a segment the words of the shortest span over all ``terms``, rarest first, that has ``within`` at most."""
    place = s.which(terms)
    if (place < 0).any():
        return {}
    lists = [s.positions[s.begins[p] : s.ends[p]] for p in place]
    centre = lists[0]
    for other in lists[1:]:  # an occurrence stays while the next term has one near it in the same document
        doc = s.document(centre)
        low, high = np.maximum(centre - within + 1, s.first[doc]), np.minimum(centre + within, s.first[doc + 1])
        centre = centre[np.searchsorted(other, low) < np.searchsorted(other, high)]
    out: dict[int, int] = {}
    if not len(centre):
        return out
    near = [x[(np.searchsorted(centre, x - within + 1) < np.searchsorted(centre, x + within))] for x in lists]
    at, slot = np.concatenate(near), np.repeat(np.arange(len(near)), [len(x) for x in near])
    order = np.argsort(at, kind="stable")
    at, slot, doc = at[order], slot[order], s.document(at[order])
    last: dict[int, int] = {}
    now = -1
    for p, k, d in zip(at.tolist(), slot.tolist(), doc.tolist(), strict=True):
        if d != now:
            last, now = {}, d
        last[k] = p
        if len(last) == len(lists):
            n = p - min(last.values()) + 1
            if n <= min(within, out.get(d, within)):
                out[d] = n
    return out


def proximity_matches(index: DataFrame, items: DataFrame, within: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, words): documents in which all distinct words of an item stand, in any order, in ``within`` words or fewer.

    ``words`` is the length of the shortest such span.  Items without words match nothing; a repeated id counts as items of its own.
    """
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    whole = own.mapInArrow(_item_rows(1 << 30), "item_id string, terms array<long>").select("item_id", F.array_distinct("terms").alias("terms"))
    whole = settle(whole.select(F.monotonically_increasing_id().alias("window_id"), "item_id", "terms"), "items")
    context, out = index.sparkSession.sparkContext, None
    for rows in _blocks(whole.withColumn("class_id", F.col("window_id")), index, block):
        ids, lengths, terms, _ = rows
        shared = context.broadcast(list(zip(ids.tolist(), np.split(terms, np.cumsum(lengths)[:-1]), strict=True)) if len(ids) else [])

        def near(batches, shared=shared):
            for s in segments_of(batches):
                got = [(s.doc_ids[d], item, n) for item, terms in shared.value for d, n in shortest_spans(s, terms, within).items()]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], ["doc_id", "window_id", "words"])

        part = index.mapInArrow(near, "doc_id long, window_id long, words long")
        out = part if out is None else out.union(part)
    return out.join(whole.select("window_id", "item_id"), "window_id").select("doc_id", "item_id", "words")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: DuckDB SQL for the rows of ``decontaminate``, over all windows of a benchmark's lengths.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[p : p + least(len(ws), {WINDOW}) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS p FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
dw AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS k FROM w, lens WHERE p + n - 1 <= len(ws)),
hit AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
