"""Hand-made edge cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinflow.functions.scalars import merge_qualifiers, schema_fingerprint
from basinflow.operators import explore, incremental, ml, publish
from basinflow.plans import marts
from basinflow.sources import tables
from basinflow.streaming import jobs


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("a", day(1), 1.0), (None, day(1), 2.0)], "site_id string, t timestamp_ntz, v double")


def test_insert_twice_adds_nothing_but_null_keys(spark, stored):
    batch = spark.createDataFrame([("a", day(1), 9.0), ("b", day(2), 1.0), ("b", day(2), 2.0), (None, day(1), 3.0)], stored.schema)
    new = incremental.insert_new(stored, batch, ["site_id", "t"], time="t")
    assert sorted((r.site_id or "", r.v) for r in new.collect()) == [("", 3.0), ("b", 1.0), ("b", 2.0)]
    again = incremental.insert_new(stored.union(new), batch, ["site_id", "t"])
    assert [r.site_id for r in again.collect()] == [None]
    assert incremental.insert_new(None, batch, ["site_id", "t"]).count() == 4
    assert incremental.insert_new(stored, batch, ["site_id", "t"], dedupe_batch=True).where("site_id = 'b'").count() == 1


def test_watermark_of_nothing_and_of_dates(spark, stored):
    assert incremental.table_watermark(spark, "no_such_table", "t") is None
    assert incremental.high_watermark(stored.limit(0), "t").first()[0] is None
    assert incremental.high_watermark(stored.select(F.col("t").cast("date").alias("t")), "t").first()[0] == day(1)


def test_merge(spark, stored):
    local = spark.createDataFrame([("a", day(1), 7.0)], stored.schema)
    assert sorted(r.v for r in incremental.merge_snapshot(local, stored, ["site_id", "t"]).collect()) == [2.0, 7.0]
    assert incremental.merge_snapshot(local, None, ["site_id", "t"]).count() == 1


def test_lead_is_the_next_row_and_strict_step_is_the_next_hour(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, h), float(h), float(h)) for h in (0, 1, 5)], "site_id string, t timestamp_ntz, streamflow_cfs_mean double, gage_height_ft_mean double")
    plain = {r.t.hour: r.streamflow_cfs_target_1h for r in marts.with_targets(rows, "t", "1h").collect()}
    strict = {r.t.hour: r.streamflow_cfs_target_1h for r in marts.with_targets(rows, "t", "1h", "1 hour").collect()}
    assert plain == {0: 1.0, 1: 5.0, 5: None} and strict == {0: 1.0, 1: None, 5: None}


def test_qualifiers_and_fingerprint(spark):
    row = spark.range(1).select(merge_qualifiers(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("a"), merge_qualifiers().alias("b")).first()
    assert row.a == "" and row.b is None
    one, same, other = (StructType.fromDDL(x) for x in ("a int, b string", "b string, a int", "a bigint, b string"))
    assert schema_fingerprint(one) == schema_fingerprint(same) != schema_fingerprint(other)


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    found = {(r.x, r.y): r.r for r in explore.correlation_matrix(rows, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == pytest.approx(1) and found["a", "c"] is None and found["c", "c"] is None


def test_series_and_tables(spark):
    series = spark.createDataFrame([(1, 0, 7200, 3600, [1.0, 2.0, 3.0]), (2, 0, 0, 3600, []), (3, 0, 3600, 3600, None)], "k int, start long, end long, step long, v array<double>")
    assert [(r.k, r.v) for r in tables.unpack_series(series, ["v", "none"], ["k"]).collect()] == [(1, 1.0), (1, 2.0)]
    assert tables.ensure_table(spark, "predictions_empty", StructType.fromDDL("a int")).count() == 0
    tables.drop_table(spark, "predictions_empty")


@pytest.mark.parametrize(("best", "live", "promote"), [(1.0, None, True), (0.951, 1.0, False), (0.95, 1.0, True)])
def test_promotion(spark, best, live, promote):
    rows = [(1, day(9), "finished", best, True, False)] + ([(2, day(1), "finished", live, True, True)] if live else [])
    runs = spark.createDataFrame(rows, "run_id long, created_at timestamp_ntz, state string, test_mae double, has_model boolean, is_production boolean")
    assert ml.promotion_decision(runs, F.lit(day(10)).cast("timestamp_ntz")).first().promote is promote


def test_publish(spark, stored, tmp_path):
    first = publish.publish(spark, stored, str(tmp_path), "v1", ["site_id", "t"], "site_id", "t").first()
    local = spark.createDataFrame([("c", day(3), 7.0)], stored.schema)
    second = publish.publish(spark, local, str(tmp_path), "v2", ["site_id", "t"], "site_id", "t", previous="v1").first()
    assert (first.n_rows, second.n_rows) == (2, 3)
    changed = publish.publish(spark, local.withColumn("x", F.lit(1)), str(tmp_path), "v3", ["site_id", "t"], "site_id", "t", previous="v2").first()
    assert changed.n_rows == 1 and changed.fingerprint != second.fingerprint


def test_series_and_runs_come_from_all_events(spark):
    from basinflow.fixtures import Views

    views = Views(spark, "/root/testdata/sf0.001")
    events = views.table("events")
    assert views.model_runs.count() == events.count()
    assert views.timeseries_metadata.count() == events.select("user_id", "event_type").distinct().count()
    gaps = views.timeseries_metadata.where("computation_identifier is null or computation_period_identifier is null")
    assert 0 < gaps.count() < views.timeseries_metadata.count()


def test_forests_and_grid_are_of_the_reference_size(spark):
    import inspect

    from basinflow import queries
    from basinflow.operators import ml

    last = ml.forest().getStages()[-1]
    assert (last.getNumTrees(), last.getMaxDepth(), last.getMinInstancesPerNode()) == (100, 30, 1)
    given = {k: v.default for f in (ml.predictions, ml.param_search) for k, v in inspect.signature(f).parameters.items()}
    assert [given[k] for k in ("depth", "depths", "rows")] == [30, (5, 10, 20), (1, 3, 5)]
    assert inspect.signature(ml.predictions).parameters["trees"].default == 100
    assert inspect.signature(ml.param_search).parameters["trees"].default == (50, 100, 200)
    assert "ml.forest().fit(frame)" in inspect.getsource(queries)


def test_ingest_loses_nothing(spark, tmp_path):
    """Several batches, a new checkpoint over a target with rows, and a batch that runs again."""
    schema = "k int, v string"
    land, target = str(tmp_path / "land"), str(tmp_path / "target")

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        jobs.ingest(stream, target, ["k"], str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.k, r.v) for r in spark.read.parquet(target).collect())

    put((1, "a"), (1, "a"), (2, "b"))
    put((2, "later"), (3, "c"))
    first = run("one")
    assert [k for k, _ in first] == [1, 2, 3]
    put((4, "d"))
    assert run("one") == [*first, (4, "d")]
    put((5, "e"), (1, "z"))
    assert run("two") == [*first, (4, "d"), (5, "e")]
    again = jobs.stored_batches(target, ["k"], lambda: "run")
    for _ in range(2):
        again(spark.createDataFrame([(6, "f"), (1, "y")], schema), 0)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [*first, (4, "d"), (5, "e"), (6, "f")]


def test_tables_by_layer(spark, stored, tmp_path):
    tables.ensure_schema(spark, "layers")
    for v in (stored, stored.limit(1)):
        tables.replace_table(v, "layers.readings", str(tmp_path / "readings"))
        assert spark.table("layers.readings").count() == v.count()
    assert "readings" in tables.list_tables(spark, "layers")
    assert tables.materialize_model(stored, "stored_view", as_table=False).count() == 2
    tables.drop_table(spark, "layers.readings")
    assert tables.list_tables(spark, "layers").count("readings") == 0
    assert [f.name for f in tables.with_extracted_at(stored, day(9)).schema][-1] == "extracted_at"


def test_features_of_none_one_and_many(spark):
    rows = spark.createDataFrame([([],), (None,), ([((1,),), ((2,),)],)], "features array<struct<properties: struct<a: int>>>")
    assert sorted(r.a for r in tables.flatten_features(rows, ["a", "b"]).collect()) == [1, 2]


def test_weather_twice_doubles_the_fact_and_squares_in_the_model(spark):
    hour = datetime(2024, 1, 1, 5)
    readings = spark.createDataFrame([("a", hour, 1.0, 2.0), ("a", datetime(2024, 1, 1, 6), 1.0, 2.0)], "site_id string, observed_at timestamp_ntz, streamflow_cfs double, gage_height_ft double")
    sites = spark.createDataFrame([("a", 1.0, 2.0)], "site_id string, latitude double, longitude double")
    weather = spark.createDataFrame([(2.0, 1.0, hour, p, 0.0, 0.0, 0.0) for p in (1.0, 3.0)], "longitude double, latitude double, observed_at timestamp_ntz, precipitation_mm double, temperature_c double, wind_speed_ms double, humidity_pct double")
    attributes = sites.select("site_id", *[F.lit(None).cast("string").alias(c) for c in marts.attribute_columns(soils=False)])
    fact = marts.fct_streamflow_hourly(readings, sites, weather)
    assert sorted((r.observation_hour.hour, r.precipitation_mm or 0) for r in fact.collect()) == [(5, 1.0), (5, 3.0), (6, 0)]
    again = fact.select("site_id", "observation_hour", "latitude", "longitude").join(weather.withColumnRenamed("observed_at", "observation_hour"), ["longitude", "latitude", "observation_hour"])
    model = marts.flood_model(marts.with_coordinates(marts.hourly_streamflow(readings), sites), attributes, weather)
    assert sorted(r.precipitation_mm for r in model.collect()) == sorted(r.precipitation_mm for r in again.collect()) == [1.0, 1.0, 3.0, 3.0]


def test_approximate_quartiles(spark):
    rows = spark.range(1000).select(F.lit("a").alias("site_id"), F.col("id").cast("double").alias("v"))
    exact, near = explore.site_distribution(rows, "v").first(), explore.site_distribution(rows, "v", 1000).first()
    assert abs(exact.median - near.median) <= 2 and near.n == 1000
    assert abs(explore.profile_columns(rows, ["v"], 1000).first().median - 499.5) <= 2


def test_forest_learns_and_repeats_itself(spark):
    rows = spark.range(600).select(F.concat(F.lit("s"), F.col("id") % 7).alias("site_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("observation_hour"), ((F.col("id") % 20) * 3.0).alias(ml.TARGET), (F.col("id") % 20).cast("double").alias("precipitation_mm"), *[F.lit(1.0).alias(c) for c in ml.FEATURES[1:]])
    made = [ml.predictions(rows, 10, 6).orderBy("site_id", "observation_hour").collect() for _ in range(2)]
    assert made[0] == made[1] and {(r.site_id, r.observation_hour) for r in made[0]} == {(r.site_id, r.observation_hour) for r in rows.where(ml.in_test()).collect()}
    assert ml.regression_metrics(spark.createDataFrame(made[0]), ml.TARGET, "prediction").first().r2 > 0.9
    found = ml.param_search(rows, (2, 4), (2, 5), (1,)).collect()
    assert {(r.trees, r.depth) for r in found} == {(2, 2), (2, 5), (4, 2), (4, 5)} and max(r.r2 for r in found) > 0.8
    scored = ml.score(ml.forest(4, 4).fit(rows), rows.limit(5), "v1", F.lit(day(1)).cast("timestamp_ntz")).collect()
    assert len(scored) == 5 and {r.model_version for r in scored} == {"v1"}
