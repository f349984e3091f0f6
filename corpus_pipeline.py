"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.bpe import encoded
from speechlake.llm.common import settle
from speechlake.llm.jaccard_join import jaccard_components
from speechlake.llm.language_id import identified
from speechlake.llm.mixing import mixed_documents
from speechlake.llm.queries import tokenizer_path
from speechlake.llm.secret_scan import redacted

#: The near-duplicate stage works on word shingles of this length, at this similarity in percent.
WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is recognised, with that as their lang; one goes if its text is null or has no letter.

    Where nothing is labelled, none can be recognised: documents with a letter stay, without a lang.
    """
    return identified(docs, relabel=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id; of rows that repeat id and text, one stays.

    Which one: that with the least values in the other columns, in their order, null before all.  Rows that share an id but not a
    text are one document with several texts, which stay or go together.  A document without words is linked with nothing, so it
    stays; so does a row without an id.
    """
    groups = jaccard_components(docs, words=WORDS, percent=PERCENT)
    firsts = settle(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "firsts")
    of = lambda which: docs.join(firsts.where(which).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    once = of("rows = 1")
    if firsts.where("rows > 1").isEmpty():
        return once.union(docs.where("doc_id is null"))
    same = of("rows > 1").groupBy(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.union(same.select("row.*")).union(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; all documents stay."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix: each document as often as its source's target asks for, 0 to 2 times, in shuffled shards."""
    return mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) for each row; lang is what the first stage recognised."""
    return encoded(docs, tokenizer_path(), ("source", "lang"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: The language stage and the encoder aren't expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
