"""Landed files, buckets, partitions, stored models and sketches: what is read, shuffled and kept."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinflow import queries
from basinflow.operators import explore, ml
from basinflow.plans import marts
from basinflow.schemas import schema
from basinflow.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def models(spark):
    return queries.Models(spark, SF)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_collections(spark, tmp_path):
    fields = StructType.fromDDL("features array<struct<properties: struct<id: string, code: string>>>")
    texts = {
        "good": '{"type": "FeatureCollection",\n "features": [\n {"properties": {"id": "a", "code": "10"}, "extra": 1},\n {"properties": {"id": "b"}}, {"properties": null}, {}\n]}',
        "empty": '{"features": []}', "none": "{}", "null": '{"features": null}', "cut": '{"features": [\n {"properties": {"id":', "other": '{"features": 7}',
    }
    for name, text in texts.items():
        (tmp_path / f"state={name}").mkdir()
        (tmp_path / f"state={name}" / "page.json").write_text(text)
    landed = tables.read_landed_json(spark, str(tmp_path), fields, whole_files=True)
    found = tables.landed_features(landed, ["id", "code"]).collect()
    assert sorted((r.state, r.id or "", r.code or "") for r in found) == [("good", "", ""), ("good", "", ""), ("good", "a", "10"), ("good", "b", "")]
    assert sorted(r.state for r in tables.malformed(landed).select("state").collect()) == ["cut", "other"]
    assert tables.well_formed(landed).count() == 4


def test_landed_series(spark, tmp_path):
    lines = [
        '{"longitude": 1.5, "latitude": 2, "hourly": {"start": 0, "end": 7200, "step": 3600, "temperature": [1.5, 2.5, 9.0], "wind": [3, null]}}',
        '{"longitude": 2.5, "latitude": 2, "hourly": {"start": 0, "end": 7200, "step": 3600, "wind": [4, 5]}}',
        '{"longitude": 3.5, "latitude": 2}', '{"longitude": 4.5, "latitude": 2, "hourly": {"start": 0, "end": 0, "step": 3600}}', '{"longitude": 5.5, "hourly": {"temperature": [1]}}', '{"longitude": 6.5, "la', "", "no json",
    ]
    (tmp_path / "responses.json").write_text("\n".join(lines))
    landed = tables.read_landed_json(spark, str(tmp_path), schema("weather_responses"))
    found = tables.landed_series(landed, ["temperature", "wind"]).collect()
    assert sorted(((r.longitude, r.datetime.hour, r.temperature, r.wind) for r in found), key=str) == [(1.5, 0, 1.5, 3.0), (1.5, 1, 2.5, None), (2.5, 0, None, 4.0), (2.5, 1, None, 5.0)]
    assert tables.malformed(landed).count() == 2


def test_buckets_spare_the_shuffle_of_both_sides(spark, models):
    """Below the join of stored facts with stored weather there is no exchange; only the sites' attributes and the lead shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(queries.QUERIES["flood_model_bucketed"](spark, SF))
        plain = plan_of(models.flood_model())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def shuffled_by_place(text: str) -> int:
        return len(re.findall(r"Exchange hashpartitioning\([^\n]*(?:place#|longitude#)", text))

    assert plan.count("Bucketed: true") == 2 and shuffled_by_place(plan) == 0
    assert shuffled_by_place(plain) == 2


def test_places_that_share_a_number_are_told_apart(spark, models):
    flow = marts.with_coordinates(marts.hourly_streamflow(models.staged("streamflow")), models.dim_sites())
    weather, attributes = models.staged("weather"), models.attributes()
    same = [df.withColumn("place", F.lit(1)) for df in (flow, weather)]
    one, other = (sorted(map(str, f.collect())) for f in (marts.flood_model(flow, attributes, weather), marts.flood_model(same[0], attributes, same[1])))
    assert one == other and one


def test_partitions_are_pruned_by_constants_and_by_joins(spark, models, tmp_path):
    stored = queries.orders_by_region_and_year(models, str(tmp_path / "orders"))
    every = stored.select("_metadata.file_path").distinct().count()
    static = stored.where("region = 'ASIA' and year between 1996 and 1997")
    folders = {re.search(r"region=(\w+).*year=(\d+)", r[0]).groups() for r in static.select(F.input_file_name()).distinct().collect()}
    assert folders == {("ASIA", "1996"), ("ASIA", "1997")}
    text = plan_of(static)
    assert re.search(r"PartitionFilters: \[[^\]]*region#\d+ = ASIA", text) and "DataFilters: []" in text
    few = tmp_path / "few"
    models.table("region").where("r_name = 'ASIA'").select(F.col("r_name").alias("region"), F.lit("x").alias("mark")).write.parquet(str(few))
    joined = stored.join(spark.read.parquet(str(few)).where("mark = 'x'"), "region")
    assert "dynamicpruning" in plan_of(joined)
    joined.write.format("noop").mode("overwrite").save()
    read = files_read(joined)
    assert 0 < read < every and read == stored.where("region = 'ASIA'").select("_metadata.file_path").distinct().count()


def files_read(df) -> int:
    """Files that the scan with the most of them opened, by the metrics of the plan that ran."""
    df.collect()

    def scans(node) -> list[int]:
        own = [node.metrics().apply("numFiles").value()] if node.metrics().contains("numFiles") and "named" not in node.toString() else []
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        return own + [n for child in inner for n in scans(child)]

    return max(scans(df._jdf.queryExecution().executedPlan()))


def test_a_stored_model_scores_in_another_session_as_the_fitted_one(spark, tmp_path):
    hour = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
    rows = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 7).alias("site_id"), hour.alias("observation_hour"), ((F.col("id") % 20) * 3.0).alias(ml.TARGET), (F.col("id") % 20).cast("double").alias("precipitation_mm"), *[F.lit(1.0).alias(c) for c in ml.FEATURES[1:]])
    model, root, target = ml.forest(5, 5).fit(rows), str(tmp_path / "models"), str(tmp_path / "predictions")
    ml.save_model(model, root, "v1")
    with pytest.raises(Exception, match="already exists"):
        ml.save_model(model, root, "v1")
    times = [F.lit(datetime(2024, 1, d)).cast("timestamp_ntz") for d in (1, 2)]
    other = spark.newSession()
    rows.write.parquet(str(tmp_path / "rows"))
    given = other.read.parquet(str(tmp_path / "rows"))
    for at in (*times, times[1]):
        ml.score_batch(root, "v1", given, at, target)
    found = ml.read_predictions(spark, target)
    assert found.count() == 600 and found.select("predicted_at").distinct().count() == 2
    own = {(r.site_id, r.timestamp): r.prediction for r in ml.score(model, rows, "v1", times[0]).collect()}
    assert {(r.site_id, r.timestamp): r.prediction for r in found.where(F.col("predicted_at") == times[0]).collect()} == own
    assert re.search(r"PartitionFilters: \[[^\]]*model_version", plan_of(found.where("model_version = 'v1'")))


def test_sketches_merge_and_stay_small(spark):
    rows = spark.range(40_000).select((F.col("id") % 2).cast("string").alias("site_id"), F.timestamp_seconds(F.col("id") * 60).alias("t"), ((F.col("id") * 7919) % 40_000).cast("double").alias("v"))
    days = explore.quantile_sketches(rows, "v", "t")
    assert days.count() == 2 * 28 and days.agg(F.max(F.octet_length("sketch"))).first()[0] < 16_000
    for r in explore.merged_distribution(days).collect():
        assert r.n == 20_000 and abs(r.q1 - 10_000) < 800 and abs(r.median - 20_000) < 800 and abs(r.q3 - 30_000) < 800
    whole = explore.merged_distribution(days, ()).first()
    assert (whole.n, whole.low, whole.high) == (40_000, 0.0, 39_999.0) and abs(whole.median - 20_000) < 800
    assert explore.quantile_sketches(rows.withColumn("v", F.lit(None).cast("double")), "v", "t").count() == 0
