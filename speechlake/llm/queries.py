"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechlake.llm import conversation_repair, decontamination, jaccard_join, matroska, resampling, secret_scan, substring_dedup, warc
from speechlake.llm.bpe import round_trip
from speechlake.llm.common import table
from speechlake.llm.fuzzy_hash import fingerprint_pairs
from speechlake.llm.jaccard_join import jaccard_components
from speechlake.llm.language_id import predictions
from speechlake.llm.mixing import mixture
from speechlake.llm.pseudonyms import pseudonymised
from speechlake.llm.substring_dedup import remove_repeats

#: Key of the registered query's pseudonyms; a real run passes its own secret.
DEMO_KEY = "an example key, not a secret"


def tokenizer_path() -> str:
    """The word-end BPE vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.text_media(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over a history of two versions and a raised rule."""
    return secret_scan.history_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_matroska": op2_matroska,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_fuzzy_hash": op8_fuzzy_hash,
    "op9_bpe": op9_bpe,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
    "ledger_history": ledger_history,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_secret_scan": secret_scan.oracle_sql(),
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_resampling": resampling.ORACLE_SQL,
    "op12_decontamination": decontamination.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.oracle_sql(),
    "ledger_history": secret_scan.history_sql(),
}
