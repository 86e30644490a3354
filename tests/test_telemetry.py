"""Rows of the telemetry table after stream runs: batches, failures, streams that nobody asked for."""

import pytest
from pyspark.sql import functions as F

from orrery.streaming import telemetry


def run(spark, tmp_path, name, column="value"):
    src = f"{tmp_path}/src"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("overwrite").parquet(f"{src}/{k}")
    s = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(src)
    s = s.select(F.when(F.col("id") == 25, F.raise_error(F.lit("no 25")).cast("long")).otherwise(F.col("id")) if column == "bad" else F.col("id"))
    return s.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()


def test_a_row_for_each_batch(spark, tmp_path):
    path = f"{tmp_path}/t"
    with telemetry.recorded(spark, path, "watched", "failing"):
        run(spark, tmp_path, "watched").awaitTermination()
        run(spark, tmp_path, "other").awaitTermination()
        with pytest.raises(Exception, match="no 25"):
            run(spark, tmp_path, "failing", "bad").awaitTermination()
    rows = spark.read.schema(telemetry.SCHEMA).parquet(path)
    assert {r.name for r in rows.collect()} == {"watched", "failing"}
    own = rows.where("name = 'watched'").orderBy("at").collect()
    assert [own[0].event, own[-1].event] == ["started", "ended"] and {r.event for r in own[1:-1]} == {"progress"}
    batches = [r.batch for r in own[1:-1] if r.input_rows]
    assert batches == sorted(set(batches)) and sum(r.input_rows for r in own[1:-1]) == 30
    assert all(r.cpu_seconds > 0 and r.peak_mb > 1 for r in own) and own[1].trigger_ms > 0
    got = {r.name: r for r in telemetry.summary(rows).collect()}
    assert got["watched"].input_rows == 30 and got["watched"].failed == 0 and got["failing"].failed == 1
    assert len(rows.inputFiles()) <= 4  # not a file a batch


def test_the_listener_goes(spark, tmp_path):
    with telemetry.recorded(spark, f"{tmp_path}/a", "one"):
        run(spark, tmp_path, "one").awaitTermination()
    n = spark.read.parquet(f"{tmp_path}/a").count()
    run(spark, tmp_path, "again").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/a").count() == n
