"""Small tables that models come with: CMVN vectors and tokenizer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_cmvn(text: Column) -> Column:
    """struct(shift, scale) of a file's text: the bracketed numbers on the line after <AddShift> and after <Rescale>."""
    numbers = lambda tag: F.transform(F.filter(F.split(F.regexp_extract(text, rf"<{tag}>[^\n]*\n[^\n\[]*\[([^\]\n]*)\]", 1), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return F.struct(numbers("AddShift").alias("shift"), numbers("Rescale").alias("scale"))


def read_cmvn(spark: SparkSession, path: str) -> DataFrame:
    """One row (shift, scale)."""
    return spark.read.text(path, wholetext=True).select(parse_cmvn(F.col("value")).alias("c")).select("c.*")


def _map_file(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "id"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON object."""
    return _map_file(spark, path)


def read_added_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON object."""
    return _map_file(spark, path)


def parse_merges(text: Column) -> Column:
    """array(struct(left, right)): the lines of a file's text that hold two words; no line is taken for a head."""
    pairs = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), " ")), lambda x: F.size(x) == 2)
    return F.transform(pairs, lambda x: F.struct(x[0].alias("left"), x[1].alias("right")))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, rank): the pairs of a text file, ranked in their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(parse_merges(F.col("value"))).alias("rank", "pair"))
    return lines.select("pair.left", "pair.right", "rank")


def read_tokenizer_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocab, merges, added) of one file that holds all three."""
    parts = "struct<model:struct<vocab:map<string,bigint>,merges:array<{}>>,added_tokens:array<struct<id:bigint,content:string>>>"
    raw = spark.read.text(path, wholetext=True)
    paired = F.from_json("value", parts.format("array<string>"))
    plain = F.from_json("value", parts.format("string"))
    vocab = raw.select(F.explode(plain["model"]["vocab"]).alias("token", "id"))
    pairs = F.transform(plain["model"]["merges"], lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.split(x, " ")))
    merges = raw.select(F.posexplode(F.coalesce(pairs, paired["model"]["merges"])).alias("rank", "p")).select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), "rank")
    added = raw.select(F.explode(plain["added_tokens"]).alias("t")).select(F.col("t.content").alias("token"), F.col("t.id").alias("id"))
    return vocab, merges, added


def write_segments(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet, in directories by the values of ``by``; rows of a directory are gathered before, so it has few files."""
    if by:
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_event_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
