"""Streams of states, one job at a time, versioned state tables."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.sources.state_table import Conflict, StateTable
from quire.streaming import ingest, jobs


def test_updates_go_on_after_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def add(rows):
        spark.createDataFrame(rows, "user_id string, at long, revision string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("user_id string, at long, revision string").option("maxFilesPerTrigger", 1).parquet(source)
        ingest.run_available(jobs.updates(stream, "user_id", "at", "revision"), check, out)
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    add([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "x"), ("a", 3, "y")])
    first = [("a", "full", 1, "x"), ("a", "update", 2, "y"), ("b", "full", 5, "x")]
    assert run() == first
    assert run() == first  # nothing is told again
    add([("a", 3, "z"), ("a", 4, "y"), ("b", 6, "z"), ("c", 1, "x")])  # what was told before, no change, a change, a new key
    assert run() == sorted([*first, ("b", "update", 6, "z"), ("c", "full", 1, "x")])


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(5).select(F.col("id").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.run_available(ingest.first_seen(stream, ["k"]), str(tmp_path / "c"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_one_job_at_a_time(spark):
    held, runner = threading.Event(), jobs.Jobs(spark)
    runner.submit("w", lambda: (held.wait(30), spark.range(10).count())[1])
    with pytest.raises(jobs.Busy):
        runner.submit("w", print)
    runner.submit("other", lambda x: x + 1, 4)
    assert runner.wait("other") == {"status": "done", "error": None, "result": 5}
    held.set()
    assert runner.wait("w")["result"] == 10
    runner.submit("w", lambda: 1 / 0)
    assert (runner.wait("w")["status"], runner.wait("w")["error"]) == ("failed", "division by zero")

    @F.udf("long")
    def slow(x):
        time.sleep(60)
        return x

    runner.submit("w", lambda: spark.range(4, numPartitions=4).select(slow("id")).collect())
    time.sleep(3)
    begin = time.time()
    runner.stop("w")
    assert runner.wait("w", 40)["status"] == "stopped" and time.time() - begin < 40


def test_state_tables_have_versions(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, at long, state string", ["k"], "at")
    assert table.version() == 0 and table.latest().collect() == []
    rows = lambda *r: spark.createDataFrame(r, "k string, at long, state string")
    assert table.save(rows(("a", 1, "x"), ("b", 1, "y"))) == 1
    assert table.save(rows(("a", 2, "z")), expected=1) == 2
    with pytest.raises(Conflict):
        table.save(rows(("a", 3, "lost")), expected=1)
    want = {("a", 2, "z"), ("b", 1, "y")}
    assert set(map(tuple, table.latest().collect())) == want and table.version() == 2
    assert set(map(tuple, table.latest(1).collect())) == {("a", 1, "x"), ("b", 1, "y")}
    assert table.compact() == 3 and table.read().count() == 2 and set(map(tuple, table.read().collect())) == want
    rows(("c", 1, "crash")).write.parquet(str(tmp_path / "t" / "rows-dead"))  # a writer that was lost before its commit
    again = StateTable(spark, str(tmp_path / "t"), "k string, at long, state string", ["k"], "at")
    assert set(map(tuple, again.latest().collect())) == want and again.read(2).count() == 3


def test_updates_are_files_and_not_rows_of_the_driver(spark, tmp_path):
    from quire.plans.flow_queries import revision_updates

    rows = spark.range(3000).selectExpr("id AS event_id", "id % 7 AS user_id", "cast(id % 2 AS string) AS event_type", "timestamp_seconds(id) AS ts", "0.5D AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    told = revision_updates(spark, str(tmp_path))
    assert len(told.inputFiles()) > 0  # a table in memory has none
    assert {(r.kind, r["count"]) for r in told.groupBy("kind").count().collect()} == {("full", 7), ("update", 2993)}
