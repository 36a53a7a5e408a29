"""Streams over several runs: what is final, what is kept, what is read of the target."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinflow.streaming import jobs

SCHEMA = "site_id string, observed_at timestamp, streamflow_cfs double, gage_height_ft double"


def reading(day: int, hour: int, minute: int = 0, site: str = "a", value: float = 1.0) -> tuple:
    return site, datetime(2024, 1, day, hour, minute), value, value


def run(spark, tmp_path, *rows, lateness: str = "2 hours"):
    """Lands the rows and runs to the end of what is there, from the one checkpoint."""
    land = str(tmp_path / "land")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)
    stream = jobs.hourly(jobs.landing(spark, land, SCHEMA), "observed_at", lateness)
    running = jobs.run_to_table(stream, str(tmp_path / "target"), str(tmp_path / "checkpoint"))
    running.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "target"))
    return running, sorted((r.observation_hour.day, r.observation_hour.hour, r.observation_count) for r in found.collect())


def test_hours_are_given_once_and_late_readings_dropped(spark, tmp_path):
    first, found = run(spark, tmp_path, reading(1, 1), reading(1, 1, 30), reading(1, 2), reading(1, 5, 10))
    assert found == [(1, 1, 2), (1, 2, 1)]  # the watermark is 03:10
    assert jobs.state_rows(first)[-1] == 1  # only hour 5 is still open
    second, found = run(spark, tmp_path, reading(1, 2, 59), reading(1, 3, 20), reading(1, 5, 40), reading(1, 9))
    assert found == [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 5, 2)]  # 02:59 came too late, 03:20 did not
    assert jobs.state_rows(second)[-1] == 1
    _, found = run(spark, tmp_path, reading(1, 5, 45), reading(2, 0))
    assert found == [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 5, 2), (1, 9, 1)]


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    """Each load is a day of hours; the state has the open hours only, however many days went by."""
    kept = []
    for day in range(1, 6):
        running, found = run(spark, tmp_path, *[reading(day, h, site=s) for h in range(24) for s in "abc"])
        kept.append(jobs.state_rows(running)[-1])
    assert max(kept) == kept[0] == 3 * 3  # the hours 21 to 23 of three sites
    assert len(found) == 3 * (5 * 24 - 3)


def test_an_ingest_reads_its_own_days_only(spark, tmp_path):
    target, schema = str(tmp_path / "target"), StructType.fromDDL("k int, t timestamp_ntz, v string")
    put = jobs.stored_batches(target, ["k", "t"], lambda: "run", time="t")
    read = []
    for n in range(6):
        days = [date(2024, 1, 1) + timedelta(days=n + i) for i in range(2)]
        rows = [(k, datetime(d.year, d.month, d.day, k), f"batch {n}") for d in days for k in range(3)]
        put(spark.createDataFrame(rows, schema).coalesce(1), n)
        known = jobs.stored_rows(spark, target, schema, days)
        read.append(len(known.inputFiles()))
    assert read[1:] == [2] * 5  # one file of each day: what a batch repeats of the day before is not stored again
    assert len(jobs.stored_rows(spark, target, schema).inputFiles()) == 7
    found = spark.read.parquet(target)
    assert found.count() == 7 * 3 and found.where("t < '2024-01-02'").select("v").distinct().first()[0] == "batch 0"


def test_replays_other_runs_and_null_times(spark, tmp_path):
    target, schema = str(tmp_path / "target"), StructType.fromDDL("k int, t timestamp_ntz, v string")
    t = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t + timedelta(days=1), "b"), (3, None, "c")], schema)
    one, other = (jobs.stored_batches(target, ["k", "t"], lambda name=name: name, time="t") for name in ("one", "other"))
    for _ in range(2):
        one(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(target).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    other(spark.createDataFrame([(1, t, "z"), (4, t, "d")], schema), 0)
    assert sorted(map(tuple, spark.read.parquet(target).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    other(spark.createDataFrame([], schema), 1)
    one(spark.createDataFrame([(5, t, "e")], schema), 0)  # what a batch wrote before goes where it runs again
    assert sorted(r.k for r in spark.read.parquet(target).where(F.col(jobs.DAY) == "2024-01-01").collect()) == [4, 5]


def test_ingest_by_day_over_restarts(spark, tmp_path):
    land, target, schema = str(tmp_path / "land"), str(tmp_path / "target"), StructType.fromDDL("k int, t timestamp_ntz, v string")

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        jobs.ingest(stream, target, ["k", "t"], str(tmp_path / "checkpoint"), time="t").awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(target).collect())

    t = datetime(2024, 1, 1)
    assert put((1, t, "a"), (1, t, "a"), (2, t, "b")) == [(1, "a"), (2, "b")]
    assert put((2, t, "later"), (2, t + timedelta(days=1), "next day")) == [(1, "a"), (2, "b"), (2, "next day")]
