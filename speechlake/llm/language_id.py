"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are gathered by Spark from labelled texts; the log-probability matrix, languages x buckets, is
broadcast - in passes over slices of the languages where they are many, of which the best is kept.  Scoring is a sparse matrix product in numpy: each n-gram of a text picks its row of the matrix, and rows are
summed per text.  An n-gram is a run of lower-cased code points, so equal texts always get equal predictions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import settle

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 15
#: Lengths of n-grams, 3 at most.
ORDERS = (1, 2, 3)
SMOOTHING = 0.2
#: Labelled texts that the classifier learns from, about: a hash of the id keeps that share of all labelled texts.
SAMPLE = 20_000
#: Labelled texts of each language that it learns from at least, about; of a language with fewer, all.
LEAST = 1_000
#: Languages that one vectorised step scores at most.
SLICE = 64
#: Languages whose matrix is broadcast at once, 64 MB at most; with more, texts are scored in several passes.
AT_ONCE = 256
#: Code points that one vectorised step takes at most; a longer text is cut, and the pieces' sums are added.
PIECE = 1 << 17
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pieces_of(texts: list[str]):
    """Lists of (text's index, piece, the two characters after it), together about PIECE code points; pieces are lower-cased.

    Two spaces follow a text's last piece, so an n-gram belongs to the piece that it begins in.
    """
    out, n = [], 0
    for i, text in enumerate(texts):
        text = text.lower()
        for a in range(0, len(text), PIECE):
            piece = text[a : a + PIECE]
            if out and n + len(piece) > PIECE:
                yield out
                out, n = [], 0
            out.append((i, piece, (text[a + PIECE : a + PIECE + 2] + "  ")[:2]))
            n += len(piece)
    if out:
        yield out


def buckets_of(pieces: list[tuple[int, str, str]]):
    """For each order: (bucket of the n-gram at each place, starts of the pieces, their lengths)."""
    codes = np.frombuffer(("".join([piece + after for _, piece, after in pieces]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(piece) for _, piece, _ in pieces], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))[:-1]
    own, shift = codes, np.uint64(64 - BUCKETS.bit_length() + 1)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            own = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in ORDERS:
            yield ((own + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64), starts, sizes


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    priors: np.ndarray
    matrix: np.ndarray  # buckets x languages

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the most likely language of each text, and its posterior."""
        best, _, rest = self.likely(texts)
        return best, 1 / rest

    def likely(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the most likely language of each text, its log score, and the sum over all languages of what they have of it."""
        if not texts:
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        total = np.repeat(self.priors[None, :], len(texts), 0)
        for pieces in pieces_of(texts):
            index = np.array([i for i, _, _ in pieces])
            for buckets, starts, sizes in buckets_of(pieces):
                edges = np.empty(2 * len(starts), np.int64)
                edges[0::2], edges[1::2] = starts, starts + sizes
                for k in range(0, len(self.languages), SLICE):
                    np.add.at(total[:, k : k + SLICE], index, np.add.reduceat(self.matrix[:, k : k + SLICE][buckets], edges, 0)[0::2])
        top = total.max(1)
        return total.argmax(1), top, np.exp(total - top[:, None]).sum(1)


@dataclass(frozen=True)
class Slices:
    """A model of more languages than are broadcast at once: ``counted`` (lang, bucket, n) stays a table."""

    languages: tuple[str, ...]
    priors: np.ndarray
    counted: DataFrame

    def models(self):
        """Models of ``AT_ONCE`` languages each, one after the other; priors are those among all."""
        for a in range(0, len(self.languages), AT_ONCE):
            own = self.languages[a : a + AT_ONCE]
            yield Model(own, self.priors[a : a + AT_ONCE], log_matrix(self.counted.where(F.col("lang").between(own[0], own[-1])), own))


def log_matrix(counted: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probabilities, buckets x languages, from rows (lang, bucket, n)."""
    rows = counted.select("lang", "bucket", "n").toArrow()
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows.column("bucket").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    totals = counts.sum(0) + SMOOTHING * BUCKETS
    np.log(counts + SMOOTHING, out=counts)
    counts -= np.log(totals)
    return counts


def _counts(batches):
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        texts = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            total = np.zeros(BUCKETS, np.int64)
            for pieces in pieces_of([texts[i] for i in np.flatnonzero(langs == lang)]):
                for buckets, starts, sizes in buckets_of(pieces):
                    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
                    total += np.bincount(buckets[inside], minlength=BUCKETS)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total[found])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | Slices | None:
    """A model from rows of (doc_id, text, lang) with nothing null; None where there are no rows.

    Every language is learned.  About ``sample`` texts are used, picked by a hash of the id, and as many more as give each
    language ``LEAST`` of its own or all that it has; with fewer than ``sample``, all.  Priors are from the counts of all rows.
    """
    priors = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not priors:
        return None
    n, whole = sum(priors.values()), 1 << 20
    shares = [(lang, math.ceil(min(1.0, max(sample / n, LEAST / own)) * whole)) for lang, own in sorted(priors.items())]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, share long"))
    picked = labelled.join(shares, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(whole)) < F.col("share"))
    counted = picked.select("text", "lang").mapInArrow(_counts, "lang string, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = tuple(sorted(priors))
    prior = np.log(np.array([priors[x] for x in languages], float)) - np.log(n)
    if len(languages) > AT_ONCE:
        return Slices(languages, prior, settle(counted, "counted"))
    return Model(languages, prior, log_matrix(counted, languages))


def predictor(df: DataFrame, model: Model | None):
    """Function of a text column: struct of lang_pred and score.  No model, a null text or one without a letter: und, 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        good = np.array([model is not None and has_letter(t) for t in texts], bool)
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if good.any():
            best, sure = model.scores([t for t, g in zip(texts, good, strict=True) if g])
            langs[good], scores[good] = np.array(model.languages, object)[best], sure
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def in_passes(df: DataFrame, slices: Slices, columns: list[Column]) -> DataFrame:
    """``columns`` of ``df`` and the struct p of ``predictor``: texts (column ``text``) are scored slice by slice, and the best is kept."""
    rows = settle(df.select(F.struct(*columns).alias("kept"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found, kind = None, "row long, lang string, top double, rest double"
    for model in slices.models():
        shared = df.sparkSession.sparkContext.broadcast(model)

        def score(batches, shared=shared):
            model = shared.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                good = [i for i, t in enumerate(texts) if has_letter(t)]
                best, top, rest = model.likely([texts[i] for i in good])
                langs = pa.array([model.languages[k] for k in best], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(good, pa.int64())), langs, pa.array(top, pa.float64()), pa.array(rest, pa.float64())], ["row", "lang", "top", "rest"])

        part = settle(rows.select("row", "text").mapInArrow(score, kind), "pass")
        shared.destroy()
        found = part if found is None else found.union(part)
    each = F.struct("top", "lang", "rest")
    best = found.groupBy("row").agg(F.max("top").alias("top"), F.collect_list(each).alias("all"))  # one of each pass
    lang = F.array_min(F.transform(F.filter("all", lambda x: x["top"] == F.col("top")), lambda x: x["lang"]))  # the first in order
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["rest"] * F.exp(x["top"] - F.col("top")))
    best = best.select("row", F.struct(lang.alias("lang_pred"), (1 / total).alias("score")).alias("p"))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.join(best, "row", "left").select("kept.*", F.coalesce("p", none).alias("p"))


def with_prediction(df: DataFrame, model: Model | Slices | None, columns: list[Column]) -> DataFrame:
    """``columns`` of ``df`` and p, the struct of lang_pred and score of its column ``text``."""
    if isinstance(model, Slices):
        return in_passes(df, model, columns)
    return df.select(*columns, predictor(df, model)(F.col("text").cast("string")).alias("p"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model | Slices | None:
    """The model learned from rows of ``docs`` with an id, a text and a language that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return fit(own.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id"))), sample)


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``: doc_id, text, lang.  Other columns are ignored."""
    doc_id = F.col("doc_id").cast("long")
    rows = with_prediction(docs, fitted(docs, sample), [doc_id.alias("doc_id"), held_out(doc_id).alias("held_out")])
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(docs: DataFrame, least_score: float = 0.0, sample: int = SAMPLE, relabel: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a posterior of ``least_score`` at least; all columns stay as they are.

    A row goes if its text is null or has no letter.  Where nothing is labelled, rows with a letter stay.  With ``relabel`` the
    column lang becomes the language that was recognised.
    """
    model = fitted(docs, sample)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = with_prediction(docs, model, [F.struct(*[F.col(c) for c in docs.columns]).alias("row")])
    kept = rows.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least_score))
    return kept.select(*(F.col("p.lang_pred" if relabel and c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns))
