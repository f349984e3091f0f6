"""A table of events that a stream can write again without repeating a row.

Each batch has its own directory of rows, which a repeated batch overwrites, and an entry in a commit log, which is written once
the rows are there.  Readers take committed batches only, so a batch that failed halfway doesn't show; and rows that another run of the
stream wrote in other batches are the same rows by their key (stream_id, result_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("stream_id", "result_id")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Writes one batch and commits it; the same batch again replaces its rows."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
    commit = rows.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch"))
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch_id={batch_id}")


def write_events(events: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Starts a stream of event rows into the table at ``path``; ``shape`` is applied to each batch first.  ``trigger`` as of writeStream."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        write_batch(shape(rows) if shape else rows, batch_id, path)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_events(spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """(``schema``, batch_id): the rows of all committed batches, of each key that of the first batch.

    Rows with a null in their key, such as those of late chunks, have no number to be told by, and all stay.
    """
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{path}/rows")
    commits = spark.read.schema("batch bigint, batch_id bigint").parquet(f"{path}/commits").select("batch_id")
    rows = rows.join(commits, "batch_id", "left_semi")
    numbered = F.lit(True)
    for c in key:
        numbered = numbered & F.col(c).isNotNull()
    first = Window.partitionBy(*key).orderBy("batch_id")
    once = rows.where(numbered).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    columns = [*[c for c in rows.columns if c != "batch_id"], "batch_id"]
    return once.select(*columns).union(rows.where(~numbered).select(*columns))
