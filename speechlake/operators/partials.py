"""Stable and unstable text over successive hypotheses of an utterance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from speechlake.operators.tokens import Tokenizer, id_lists, with_column


def common_prefix(a: str, b: str) -> int:
    """Code points that both begin with, by halving: slices are compared, not characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def next_partial(confirmed: str, pending: str, text: str, final: bool, mode: str) -> tuple[str, str, str, bool]:
    """(delta, confirmed, pending, revised) after one more hypothesis."""
    if not text:
        return "", confirmed, "", False
    if text.startswith(confirmed):
        rest = text[len(confirmed) :]
        n = len(rest) if final else common_prefix(pending, rest)
        return rest[:n], confirmed + rest[:n], rest[n:], False
    if final:
        return ("", text, "", True) if confirmed or pending else ("", confirmed, "", False)
    return "", "" if mode == "clear" else confirmed, text, True


def track_partials(hypotheses: DataFrame, mode: str = "clear", key: str = "utterance_id", order: str = "chunk_id") -> DataFrame:
    """(key, order, confirmed_delta, confirmed_text, pending_text, text, revised) for each hypothesis (key, order, text, is_final).

    A fold in order, per utterance: on a revision confirmed text is cleared (``keep_stable``: kept) and the text waits; at a
    revised end the whole text is taken.  Utterances are sorted within partitions and pass by row by row.
    """
    kinds = [hypotheses.schema[c].dataType.simpleString() for c in (key, order)]
    columns = [key, order, "confirmed_delta", "confirmed_text", "pending_text", "text", "revised"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, confirmed, pending, started = None, "", "", False
        for batch in batches:
            out: list[tuple] = []
            for own, text, final in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not started or own != now:
                    now, confirmed, pending, started = own, "", "", True
                delta, confirmed, pending, revised = next_partial(confirmed, pending, text, final, mode)
                out.append((delta, confirmed, pending, confirmed + pending, revised))
            made = [pa.array([r[i] for r in out], pa.string()) for i in range(4)] + [pa.array([r[4] for r in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], columns)

    ordered = hypotheses.select(key, order, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_final", F.lit(False)).alias("is_final"))
    schema = f"{key} {kinds[0]}, {order} {kinds[1]}, confirmed_delta string, confirmed_text string, pending_text string, text string, revised boolean"
    return ordered.repartition(key).sortWithinPartitions(key, order, "text", "is_final").mapInArrow(rows, schema)


def rollback_decode(df: DataFrame, tokenizer: Tokenizer, back: int, ids: str = "ids") -> DataFrame:
    """Adds rolled_back: the text without the last tokens, shortened while it ends in a broken character."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    return with_column(df, ids, "rolled_back", StringType(), lambda x: pa.array([shared.value.rollback(i, back) for i in id_lists(x)], pa.string()))


def stable_prefix(df: DataFrame, tokenizer: Tokenizer, unfixed_chunks: int = 2, unfixed_tokens: int = 5) -> DataFrame:
    """Adds stable: nothing in the first chunks, then all but the last tokens; everything at the end.  Rows: chunk_id, raw_text, is_final, ids."""
    back = rollback_decode(df, tokenizer, unfixed_tokens)
    stable = F.when(F.col("is_final"), F.col("raw_text")).when(F.col("chunk_id") < unfixed_chunks, F.lit("")).otherwise(F.col("rolled_back"))
    return back.withColumn("stable", stable).drop("rolled_back")


def greedy_sequence(df: DataFrame, end_ids: list[int], max_new_tokens: int, key: str = "item_id") -> DataFrame:
    """(key, ids): each step's argmax in order, up to the first end token and at most ``max_new_tokens``.  Rows: key, step, logits."""
    if max_new_tokens < 0:
        raise ValueError("max_new_tokens must not be negative")
    from speechlake.functions.arrays import greedy_argmax

    steps = df.where(F.size("logits") > 0).select(key, "step", greedy_argmax(F.col("logits")).alias("id"))
    rows = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "id"))).alias("s"))
    ids = F.transform("s", lambda x: x["id"])
    ends = F.filter(F.transform("s", lambda x, i: F.when(x["id"].isin(end_ids), i)), lambda i: i.isNotNull())
    n = F.least(F.coalesce(F.array_min(ends), F.size("s")), F.lit(max_new_tokens))
    return rows.select(key, F.slice(ids, F.lit(1), n).alias("ids"))
