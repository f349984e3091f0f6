"""Substring deduplication by seed and extend.

1. Seeds.  Winnowing picks from every window of ``min_words`` words the smallest of its ``seed_words``-gram hashes, so equal
   windows always pick the same seed, and only about one word position in 13 is a seed at all.
2. Join.  Seeds are counted over all documents (combined before the shuffle); documents meet only on seeds that at least two
   different texts have.  Equal texts are one class, of which only the smallest id goes on.
3. Extend.  In documents with such a seed each match is extended to both sides: every full window over the seed is hashed
   with a second hash function, and (seed, window) - 128 bits - finds the smallest document in which it starts.
4. Windows that also start in a smaller document are fused into maximal repeats, and their words are taken out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import WordHashes, discard, settle, slices, utf8

MIN_WORDS = 50
SEED_WORDS = 25


def rolling_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of ``x[i : i + n]`` for each i that has n values."""
    step = 1
    while 2 * step <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def window_seeds(found: WordHashes, min_words: int, seed_words: int) -> np.ndarray:
    """The seed of the window that starts at each word; meaningless where the text ends before the window does."""
    if len(found.hashes) < min_words:
        return np.zeros(0, np.uint64)
    return rolling_least(found.grams(seed_words), min_words - seed_words + 1)


def _batches(columns: dict[str, list], names: list[str], rows: int = 200_000):
    arrays = [np.concatenate(columns[n]) if columns[n] else np.zeros(0, np.int64) for n in names]
    for i in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + rows]) for a in arrays], names)


def _seed_rows(min_words: int, seed_words: int):
    def rows(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                found = WordHashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seeds = window_seeds(found, min_words, seed_words)
                out = {"seed": [], "doc_id": [], "text_key": []}
                for k, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True), i):
                    if b - a >= min_words:
                        own = np.unique(seeds[a : b - min_words + 1]).view(np.int64)
                        out["seed"].append(own)
                        out["doc_id"].append(np.full(len(own), ids[k]))
                        out["text_key"].append(np.full(len(own), keys[k]))
                yield from _batches(out, ["seed", "doc_id", "text_key"])

    return rows


def _window_rows(min_words: int, seed_words: int):
    def rows(batches):
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            wanted = batch.column("seeds")
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                found = WordHashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seeds = window_seeds(found, min_words, seed_words)
                windows = found.grams(min_words, 1)
                out = {"seed": [], "window": [], "doc_id": [], "text_key": [], "start": []}
                for k, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True), i):
                    if b - a >= min_words:
                        own = seeds[a : b - min_words + 1].view(np.int64)
                        starts = np.flatnonzero(np.isin(own, wanted[k].values.to_numpy(zero_copy_only=False)))
                        out["seed"].append(own[starts])
                        out["window"].append(windows[a + starts].view(np.int64))
                        out["doc_id"].append(np.full(len(starts), ids[k]))
                        out["text_key"].append(np.full(len(starts), keys[k]))
                        out["start"].append(starts)
                yield from _batches(out, ["seed", "window", "doc_id", "text_key", "start"])

    return rows


def covered(starts: np.ndarray, n: int, min_words: int) -> np.ndarray:
    """Flags of the n words that the windows at ``starts`` cover."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + min_words, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept_rows(min_words: int):
    def rows(batches):
        for batch in batches:
            texts, starts, copies = (batch.column(c) for c in ("text", "starts", "is_copy"))
            n_words, n_removed, digests, spans, kept_texts = [], [], [], [], []
            for text, own, copy in zip(texts, starts, copies, strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                gone = np.full(n, bool(copy.as_py()) and n >= min_words)
                if own.is_valid and len(own):
                    gone |= covered(own.values.to_numpy(zero_copy_only=False), n, min_words)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                    spans.append(",".join(f"{a}:{b}" for a, b in turns.reshape(-1, 2)))
                    words = [w for w, out in zip(words, gone, strict=True) if not out]
                else:
                    spans.append("")
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "repeats": pa.array(spans, pa.string()), "kept": pa.array(kept_texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return rows


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats, kept) for each row of ``docs``: doc_id, text.

    A word goes if a window of ``min_words`` words over it also starts in a document with a smaller doc_id; ``repeats`` are
    the maximal runs of such words as start:end in words, ``kept`` the rest joined by one space.  A null text has no words.
    Rows with a null doc_id keep everything and take nothing from others; rows that repeat a doc_id are one document, within
    which nothing counts as a repeat.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    some = docs.where("doc_id is not null")
    row = ["doc_id", "text_key"]

    texts = settle(some.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("check"), F.length("text").alias("size")).distinct(), "texts")
    same = ["text_key", "check", "size"]
    classes = settle(texts.groupBy(*same).agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = classes.select(F.col("first_id").alias("doc_id"), "text_key")
    copies = texts.join(classes, same).where("doc_id > first_id").select(*row)

    seeds = settle(some.mapInArrow(_seed_rows(min_words, seed_words), "seed long, doc_id long, text_key long"), "seeds")
    shared = lambda df: settle(df.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "shared")
    several = settle(seeds.join(shared(seeds.select("seed")), "seed"), "met")  # settled, or the planner would shuffle all seeds for the next join first
    discard(seeds)
    met = settle(several.join(firsts, row, "left_semi"), "met")
    discard(several)
    wanted = met.join(shared(met), "seed").groupBy(*row).agg(F.collect_set("seed").alias("seeds"))

    windows = some.join(wanted.hint("shuffle_hash"), row).mapInArrow(_window_rows(min_words, seed_words), "seed long, window long, doc_id long, text_key long, start long")
    windows = settle(windows, "windows")
    key = ["seed", "window"]
    least = windows.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    discard(met)
    hits = windows.join(settle(least.drop("last_id"), "least"), key).where("doc_id > first_id")
    gone = hits.groupBy(*row).agg(F.collect_set("start").alias("starts"), F.lit(False).alias("is_copy"))
    gone = settle(gone.union(copies.select(*row, F.array().cast("array<long>"), F.lit(True))), "gone")
    discard(texts, classes, windows)
    out = docs.join(gone.hint("shuffle_hash"), row, "left").select("doc_id", "text", "starts", "is_copy")
    return out.mapInArrow(_kept_rows(min_words), "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats string, kept string")


#: DuckDB SQL for the rows of ``remove_repeats`` without the texts, over all windows.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
win AS (SELECT doc_id, p, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS k FROM w),
least AS (SELECT k, min(doc_id) AS f FROM win WHERE p <= n - {MIN_WORDS - 1} GROUP BY k),
hit AS (SELECT doc_id, p, 1 AS hit FROM win JOIN least USING (k) WHERE p <= n - {MIN_WORDS - 1} AND f < doc_id),
g AS (SELECT doc_id, p, w, count(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM w LEFT JOIN hit USING (doc_id, p)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, gone ORDER BY p) AS run FROM g),
runs AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM r WHERE gone GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS repeats FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS n_removed FROM g GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(repeats, '') AS repeats
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)"""
