import time

import pytest
from pyspark.sql import functions as F

from speechlake.sources.event_sink import read_events, write_batch, write_events

SCHEMA = "stream_id string, result_id bigint, text string"


def test_a_batch_run_twice_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, None)], SCHEMA)
    for _ in range(2):
        write_batch(first, 0, path)
    write_batch(spark.createDataFrame([("a", 2, "z"), ("a", 1, "other"), (None, None, "late"), (None, None, "late")], SCHEMA), 1, path)
    got = sorted(map(str, map(tuple, read_events(spark, path, SCHEMA).collect())))
    assert got == sorted(map(str, [("a", 0, "x", 0), ("a", 1, "y", 0), ("b", 0, None, 0), ("a", 2, "z", 1), (None, None, "late", 1), (None, None, "late", 1)]))
    write_batch(first.limit(0), 2, path)
    assert read_events(spark, path, SCHEMA).count() == 6


def test_a_stream_that_stops_between_rows_and_commit(spark, tmp_path):
    """The batch that failed isn't seen; the restarted query writes it again, and every row is there once."""
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("a", 2 * i, "x"), ("a", 2 * i + 1, "y")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    state = {"fail": True}

    def broken(rows):
        if state["fail"] and rows.where("result_id = 3").count():
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id=1")
            raise RuntimeError("stopped")
        return rows

    q = write_events(stream, path, str(tmp_path / "c"), broken, availableNow=True)
    with pytest.raises(Exception, match="stopped"):
        q.awaitTermination(120)
    assert sorted(x.result_id for x in read_events(spark, path, SCHEMA).collect()) == [0, 1]
    state["fail"] = False
    for checkpoint in ("c", "another"):  # the second run has forgotten what it wrote, and its batches are cut in another way
        more = stream if checkpoint == "c" else spark.readStream.schema(SCHEMA).parquet(source)
        write_events(more, path, str(tmp_path / checkpoint), None, availableNow=True).awaitTermination(120)
        rows = read_events(spark, path, SCHEMA)
        assert sorted(x.result_id for x in rows.collect()) == list(range(6)) and rows.where(F.col("batch_id").isNull()).count() == 0
