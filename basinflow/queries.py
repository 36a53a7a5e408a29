"""Every registered query over the given tables, and its SQL oracle."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinflow import fixtures, store
from basinflow.functions import scalars
from basinflow.operators import explore, features, incremental, ingest, ml, publish, quality
from basinflow.plans import marts
from basinflow.plans.staging import select_list, staged
from basinflow.schemas import schema
from basinflow.session import scratch
from basinflow.sources import tables
from basinflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Models(fixtures.Views):
    """Staged tables, dimensions and facts, each a lazy plan."""

    def staged(self, name: str) -> DataFrame:
        source = {"streamflow": "streamflow_15min", "weather": "weather_forcing"}.get(name, name)
        return staged(name, getattr(self, source if name in RAW else f"seed_{name}"))

    def dim_sites(self) -> DataFrame:
        return marts.dim_sites(self.staged("site_metadata"))

    def attributes(self) -> DataFrame:
        return marts.dim_catchment_attributes(self.staged("site_metadata"), {n: self.staged(n) for n in marts.ATTRIBUTES})

    def hourly(self) -> DataFrame:
        return marts.fct_streamflow_hourly(self.staged("streamflow"), self.dim_sites(), self.staged("weather"))

    def daily(self) -> DataFrame:
        return marts.fct_streamflow_daily(self.staged("streamflow_daily"), self.dim_sites(), self.staged("weather"))

    def flood_model(self) -> DataFrame:
        flow = marts.with_coordinates(marts.hourly_streamflow(self.staged("streamflow")), self.dim_sites())
        return marts.flood_model(flow, self.attributes(), self.staged("weather"))


RAW = {"site_metadata": "fx_site_metadata", "streamflow": "fx_streamflow_15min", "streamflow_daily": "fx_streamflow_daily", "weather": "fx_weather_forcing"}


def query(name: str, sql: str | None = None, **parts: str):
    def put(f: Callable[[Models], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Models(spark, sf_dir))
        if sql:
            ORACLES[name] = fixtures.oracle(sql, **parts)
        return f

    return put


# SQL of the models, for oracles

SITES_SQL = f"select {select_list('site_metadata')} from fx_site_metadata where latitude is not null and longitude is not null"
WEATHER_SQL = f"select {select_list('weather')} from fx_weather_forcing"
HOUR_SQL = """select site_id, date_trunc('hour', datetime) as observation_hour,
  avg(streamflow_cfs) as streamflow_cfs_mean, max(streamflow_cfs) as streamflow_cfs_max, min(streamflow_cfs) as streamflow_cfs_min,
  avg(gage_height_ft) as gage_height_ft_mean, max(gage_height_ft) as gage_height_ft_max, min(gage_height_ft) as gage_height_ft_min,
  count(*) as observation_count from fx_streamflow_15min group by 1, 2"""
DAY_SQL = """select latitude, longitude, cast(observed_at as date) as observed_date, sum(precipitation_mm) as precipitation_mm,
  avg(temperature_c) as temperature_c_mean, max(temperature_c) as temperature_c_max, min(temperature_c) as temperature_c_min,
  avg(wind_speed_ms) as wind_speed_ms_mean, avg(humidity_pct) as humidity_pct_mean from weather group by 1, 2, 3"""
COORDS_SQL = """select h.site_id, h.observation_hour, s.latitude, s.longitude, h.* exclude (site_id, observation_hour)
  from hours h join sites s on h.site_id = s.site_id"""
HOURLY_SQL = """select c.*, w.precipitation_mm, w.temperature_c, w.wind_speed_ms, w.humidity_pct from coords c
  left join weather w on c.longitude = w.longitude and c.latitude = w.latitude and c.observation_hour = w.observed_at"""
DAILY_SQL = """select f.site_id, f.date as observed_date, s.latitude, s.longitude, f.streamflow_cfs_mean, f.gage_height_ft_mean, d.precipitation_mm,
  d.temperature_c_mean, d.temperature_c_max, d.temperature_c_min, d.wind_speed_ms_mean, d.humidity_pct_mean
  from fx_streamflow_daily f join sites s on f.site_id = s.site_id
  left join days d on s.longitude = d.longitude and s.latitude = d.latitude and f.date = d.observed_date"""



ATTRIBUTES_SQL = (
    "select m.site_id, m.station_name, m.latitude, m.longitude, m.huc_code, "
    + ", ".join(f"{t}.{c.split(':')[0]} as {c.split(':')[-1]}" for t, text in marts.ATTRIBUTES.items() for c in text.split())
    + " from fx_site_metadata m "
    + " ".join(
        f"left join (select {select_list(t)} from fx_seed_{t}) {t} on m.site_id = {t}.site_id" if t != "hydroatlas" else "left join fx_seed_hydroatlas hydroatlas on m.site_id = hydroatlas.staid"
        for t in marts.ATTRIBUTES
    )
)
BASE = {"sites": SITES_SQL, "weather": WEATHER_SQL}
HOURLY = BASE | {"hours": HOUR_SQL, "coords": COORDS_SQL, "hourly": HOURLY_SQL}
DAILY = BASE | {"days": DAY_SQL, "daily": DAILY_SQL}
NO_SOILS = ", ".join(f"a.{c}" for c in marts.attribute_columns(soils=False))
FLOOD = HOURLY | {
    "attributes": ATTRIBUTES_SQL,
    "flood": f"""select c.*, w.precipitation_mm, w.temperature_c, w.wind_speed_ms, w.humidity_pct, {NO_SOILS},
  lead(c.streamflow_cfs_mean) over (partition by c.site_id order by c.observation_hour) as streamflow_cfs_target_1h,
  lead(c.gage_height_ft_mean) over (partition by c.site_id order by c.observation_hour) as gage_height_ft_target_1h
  from (select * exclude (precipitation_mm, temperature_c, wind_speed_ms, humidity_pct) from hourly) c join attributes a on c.site_id = a.site_id
  join weather w on a.longitude = w.longitude and a.latitude = w.latitude and c.observation_hour = w.observed_at""",
}
FLOOD_DAILY = DAILY | {
    "attributes": ATTRIBUTES_SQL,
    "flood": f"""select d.*, {NO_SOILS}, lead(d.streamflow_cfs_mean) over (partition by d.site_id order by d.observed_date) as streamflow_cfs_target_1d,
  lead(d.gage_height_ft_mean) over (partition by d.site_id order by d.observed_date) as gage_height_ft_target_1d
  from daily d join attributes a on d.site_id = a.site_id""",
}

# Staging and marts

for _name, _view in RAW.items():
    query(f"stg_{_name}", f"select {select_list(_name)} from {_view}")(lambda m, n=_name: m.staged(n))
for _name in ("basin", "topo", "soils", "geology", "climate"):
    query(f"stg_{_name}", f"select {select_list(_name)} from fx_seed_{_name}")(lambda m, n=_name: m.staged(n))
query("stg_hydroatlas", "select * exclude (staid), staid as site_id from fx_seed_hydroatlas")(lambda m: m.staged("hydroatlas"))
query("dim_sites", SITES_SQL)(Models.dim_sites)
query("dim_catchment_attributes", ATTRIBUTES_SQL)(Models.attributes)
query("hourly_streamflow", HOUR_SQL)(lambda m: marts.hourly_streamflow(m.staged("streamflow")))
query("daily_weather", "select * from days", weather=WEATHER_SQL, days=DAY_SQL)(lambda m: marts.daily_weather(m.staged("weather")))
query("streamflow_with_coords", COORDS_SQL, sites=SITES_SQL, hours=HOUR_SQL)(lambda m: marts.with_coordinates(marts.hourly_streamflow(m.staged("streamflow")), m.dim_sites()))
query("fct_streamflow_hourly", "select * from hourly", **HOURLY)(Models.hourly)
query("fct_streamflow_daily", "select * from daily", **DAILY)(Models.daily)
query("flood_model", "select * from flood", **FLOOD)(Models.flood_model)
query("flood_model_daily", "select * from flood", **FLOOD_DAILY)(lambda m: marts.flood_model_daily(m.daily(), m.attributes()))


@query(
    "target_lead_hourly",
    """select site_id, observation_hour, lead(streamflow_cfs_mean) over w as streamflow_cfs_target_1h, lead(gage_height_ft_mean) over w as gage_height_ft_target_1h
    from hours window w as (partition by site_id order by observation_hour)""",
    hours=HOUR_SQL,
)
def _(m):
    return marts.with_targets(marts.hourly_streamflow(m.staged("streamflow")), "observation_hour", "1h").select("site_id", "observation_hour", "streamflow_cfs_target_1h", "gage_height_ft_target_1h")


@query(
    "target_lead_daily",
    """select site_id, date as observed_date, lead(streamflow_cfs_mean) over w as streamflow_cfs_target_1d, lead(gage_height_ft_mean) over w as gage_height_ft_target_1d
    from fx_streamflow_daily window w as (partition by site_id order by date)""",
)
def _(m):
    return marts.with_targets(m.staged("streamflow_daily"), "observed_date", "1d").select("site_id", "observed_date", "streamflow_cfs_target_1d", "gage_height_ft_target_1d")


# Sources

NOW_LOADED = "2024-02-01 00:00:00"


@query("seed_csv_typed", "select staid, staname, drain_sqkm, huc02, state from fx_seed_basin")
def _(m):
    path = scratch(m.spark, "seed")
    m.seed_basin.write.csv(path, header=True)
    return tables.read_seed(m.spark, path, schema("seed_basin")).select("staid", "staname", "drain_sqkm", "huc02", "state")


@query("conform_columns", "select site_id, cast(datetime as timestamp) as datetime, streamflow_cfs, gage_height_ft, qualifiers, cast(null as varchar) as agency from fx_streamflow_15min")
def _(m):
    raw = m.streamflow_15min.withColumnRenamed("site_id", "monitoring_location").withColumn("unused", F.lit(1))
    wanted = StructType.fromDDL("site_id string, datetime timestamp_ntz, streamflow_cfs double, gage_height_ft double, qualifiers string, agency string")
    return tables.conform(raw, wanted, {"monitoring_location": "site_id"})


@query(
    "unpack_series",
    """select vec_id, make_timestamp((i - 1) * 3600 * 1000000) as datetime, embedding[i] as value from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)""",
)
def _(m):
    series = m.table("embeddings").select("vec_id", F.lit(0).cast("long").alias("start"), (F.size("embedding") * 3600).cast("long").alias("end"), F.lit(3600).cast("long").alias("step"), F.col("embedding").alias("value"))
    return tables.unpack_series(series, ["value", "absent"], ["vec_id"]).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query("flatten_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(m):
    """A collection for each customer, with as many features as the customer has events, or none."""
    feature = F.struct(F.struct("event_id", F.from_json("props", "k long").getField("k").alias("k")).alias("properties"))
    found = m.table("events").groupBy("user_id").agg(F.collect_list(feature).alias("features"))
    collections = m.table("customer").select(F.col("c_custkey").alias("user_id")).join(found, "user_id", "full")
    return tables.flatten_features(collections.select(F.coalesce("features", F.array().cast(found.schema["features"].dataType)).alias("features")), ["event_id", "k"])


PAGE = 100
#: Page 0 is cut off, the features of page 1 lack their code, and one more page has no features.
LANDED_SQL = f"""select (c_custkey // {PAGE})::int as page, m.monitoring_location_id, m.state_name, case when c_custkey // {PAGE} <> 1 then m.hydrologic_unit_code end as hydrologic_unit_code
    from fx_monitoring_locations m join customer on m.monitoring_location_id = lpad(c_custkey::varchar, 8, '0')"""


def _landed_pages(m):
    """Feature collections as a catalog service gives them: pages of PAGE features, one in each file, over many lines."""
    page = F.expr(f"cast(monitoring_location_id as int) div {PAGE}").cast("int")
    code = F.when(page != 1, F.col("hydrologic_unit_code"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("monitoring_location_id", "state_name", code.alias("hydrologic_unit_code")).alias("properties"))
    pages = m.monitoring_locations.groupBy(page.alias("page")).agg(F.collect_list(feature).alias("features"))
    empty = pages.limit(0).schema["features"].dataType
    pages = pages.union(m.spark.range(1).select(F.lit(-1).alias("page"), F.array().cast(empty).alias("features")))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"), {"pretty": "true"})
    cut = F.when(F.col("page") == 0, F.expr("substr(body, 1, length(body) div 2)")).otherwise(F.col("body")).alias("value")
    path = scratch(m.spark, "landed-json")
    pages.select("page", text.alias("body")).select("page", cut).write.partitionBy("page").text(path)
    return tables.read_landed_json(m.spark, path, schema("location_pages"), whole_files=True)


@query("landed_features", f"select * from ({LANDED_SQL}) where page > 0")
def _(m):
    return tables.landed_features(_landed_pages(m), ["monitoring_location_id", "state_name", "hydrologic_unit_code"])


@query(
    "landed_files",
    f"""select page, count(*) as n_features, count(hydrologic_unit_code) as n_codes, false as is_malformed from ({LANDED_SQL}) where page > 0 group by page
    union all select -1, 0, 0, false union all select 0, null, null, true""",
)
def _(m):
    """What each file gave; one that does not parse is named, and the others are read."""
    landed = _landed_pages(m)
    codes = F.size(F.filter("features", lambda f: f["properties"]["hydrologic_unit_code"].isNotNull())).cast("long")
    good = tables.well_formed(landed).select("page", F.size("features").cast("long").alias("n_features"), codes.alias("n_codes"), F.lit(False).alias("is_malformed"))
    none = F.lit(None).cast("long")
    return good.union(tables.malformed(landed).select("page", none, none, F.lit(True)))


@query(
    "landed_series",
    """select vec_id::double as longitude, label::double as latitude, make_timestamp((i - 1) * 3600 * 1000000) as datetime, embedding[i]::double as temperature,
    case when label <> 2 then embedding[i]::double + 1 end as wind
    from (select vec_id, label, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings where label not in (0, 1))""",
)
def _(m):
    """A response in each line: those of label 0 are cut off, those of label 1 have no hourly block, those of label 2 lack wind."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    wind = F.when(F.col("label") != 2, F.transform(values, lambda v: v + 1))
    block = F.struct(F.lit(0).alias("start"), (F.size("embedding") * 3600).alias("end"), F.lit(3600).alias("step"), values.alias("temperature"), wind.alias("wind"))
    body = F.to_json(F.struct(F.col("vec_id").cast("double").alias("longitude"), F.col("label").cast("double").alias("latitude"), F.when(F.col("label") != 1, block).alias("hourly")))
    path = scratch(m.spark, "landed-json")
    m.table("embeddings").select("label", body.alias("body")).select(F.when(F.col("label") == 0, F.expr("substr(body, 1, length(body) - 9)")).otherwise(F.col("body")).alias("value")).write.text(path)
    found = tables.landed_series(tables.read_landed_json(m.spark, path, schema("weather_responses")), ["temperature", "wind"])
    return found.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query("raw_table", "select cast(user_id as varchar) as site_id, cast(ts as timestamp) as datetime, value as streamflow_cfs, cast(null as double) as gage_height_ft, event_type as qualifiers, timestamp '2024-02-01 00:00:00' as extracted_at from events")
def _(m):
    """A landed batch, its columns in another order and one too many, read by the declared schema."""
    path, at = scratch(m.spark, "raw"), F.lit(NOW_LOADED).cast("timestamp_ntz")
    landed = m.table("events").select(F.col("value").alias("streamflow_cfs"), F.col("event_type").alias("qualifiers"), F.lit(1).alias("agency"), F.col("ts").alias("datetime"), F.col("user_id").cast("string").alias("site_id"))
    tables.with_extracted_at(landed, at).write.parquet(path)
    found = tables.read_raw(m.spark, path, "streamflow_15min")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("datetime", "extracted_at")})


@query("materialized_layers", COORDS_SQL, sites=SITES_SQL, hours=HOUR_SQL)
def _(m):
    """Staging as views, the mart as a stored table over them."""
    tables.materialize_model(m.dim_sites(), "layer_dim_sites", as_table=False)
    tables.materialize_model(marts.hourly_streamflow(m.staged("streamflow")), "layer_hourly", as_table=False)
    mart = marts.with_coordinates(m.spark.table("layer_hourly"), m.spark.table("layer_dim_sites"))
    name = f"layer_streamflow_{uuid.uuid4().hex}"
    return tables.materialize_model(mart, name, as_table=True, path=scratch(m.spark, "layer"))


@query("union_batches", "select user_id, ts, value from fx_existing_rows union all select user_id, ts, value from fx_incoming_rows")
def _(m):
    return tables.union_batches([m.existing_rows, m.incoming_rows, m.incoming_rows.limit(0)])


@query("sample_sites", "select site_id, station_name from fx_site_metadata order by site_id limit 10")
def _(m):
    return tables.sample_sites(m.site_metadata.select("site_id", "station_name"), 10)


@query("partitioned_roundtrip", "select n_regionkey as region, n_name, count(*) as n_sites from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by 1, 2")
def _(m):
    path = scratch(m.spark, "partitioned")
    sites = m.table("customer").join(m.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tables.write_snapshot(sites.select("c_custkey", "n_name", F.col("n_regionkey").alias("region")), path, ["region"])
    return m.spark.read.parquet(path).where("region = 1").groupBy("region", "n_name").agg(F.count("*").alias("n_sites"))


ORDERS_SQL = """select r_name as region, year(o_orderdate)::int as year, o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def orders_by_region_and_year(m, path: str) -> DataFrame:
    """Orders stored in folders of region and year, read back."""
    m.table("region").join(m.table("nation"), F.col("n_regionkey") == F.col("r_regionkey")).createOrReplaceTempView("named_nations")
    rows = m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(m.spark.table("named_nations"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("o_orderkey", "o_totalprice", F.col("r_name").alias("region"), F.year("o_orderdate").alias("year"))
    tables.write_snapshot(rows.repartition("region", "year"), path, ["region", "year"])
    return m.spark.read.schema(rows.schema).parquet(path)


@query("pruned_partitions", f"select year, count(*) as n_orders, round(sum(o_totalprice), 2) as total from ({ORDERS_SQL}) where region = 'ASIA' and year between 1996 and 1997 group by year")
def _(m):
    """Folders are chosen by constants before any file is opened."""
    stored = orders_by_region_and_year(m, scratch(m.spark, "by-year"))
    return stored.where("region = 'ASIA' and year between 1996 and 1997").groupBy("year").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("pruned_by_join", f"select region, year, count(*) as n_orders from ({ORDERS_SQL}) where region in (select r_name from region where r_name like 'A%') group by region, year")
def _(m):
    """Folders are chosen by what another table has, when the query runs."""
    stored = orders_by_region_and_year(m, scratch(m.spark, "by-year"))
    named = m.table("region").where(F.col("r_name").startswith("A")).select(F.col("r_name").alias("region"))
    return stored.join(named, "region").groupBy("region", "year").agg(F.count("*").alias("n_orders"))


BUCKETS = 16


@query("flood_model_bucketed", "select * from flood", **FLOOD)
def _(m):
    """The learning table over stored facts and weather that are dealt out by place and hour: neither is shuffled for the join."""
    flow = marts.with_coordinates(marts.hourly_streamflow(m.staged("streamflow")), m.dim_sites())
    hours = m.staged("weather").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    stored = [
        tables.bucketed(marts.with_place(df), f"bucketed_{name}_{uuid.uuid4().hex}", ["place", time], BUCKETS, scratch(m.spark, "bucketed"))
        for name, df, time in (("flow", flow, "observation_hour"), ("weather", hours, "observed_at"))
    ]
    return marts.flood_model(stored[0], m.attributes(), stored[1])


# Ingest and increments


@query("discover_sites", "select site_id, huc_code from fx_site_metadata where huc_code like '10%'")
def _(m):
    return ingest.discover_sites(m.site_metadata, "10").select("site_id", "huc_code")


@query("discover_series", "select monitoring_location_id, computation_identifier from fx_timeseries_metadata where hydrologic_unit_code like '10%' and computation_identifier = 'Instantaneous'")
def _(m):
    """By region and data type, as a catalog's parameters allow."""
    return ingest.discover_sites(m.timeseries_metadata, "10", "hydrologic_unit_code", F.col("computation_identifier") == "Instantaneous").select("monitoring_location_id", "computation_identifier")


FLAGS_SQL = """select site_id, site_id in (select site_id from fx_streamflow_15min) as has_iv,
  site_id in (select site_id from fx_streamflow_daily where date >= date '2024-01-15') as has_daily from fx_site_metadata"""


def _flags(m):
    return ingest.flag_availability(m.site_metadata.select("site_id"), has_iv=m.streamflow_15min, has_daily=m.streamflow_daily.where("date >= date '2024-01-15'"))


query("availability_flags", FLAGS_SQL)(_flags)
query("availability_totals", "select count(*) as num_sites, count(*) filter (has_iv) as num_iv, count(*) filter (has_daily) as num_daily from flags", flags=FLAGS_SQL)(lambda m: ingest.availability_totals(_flags(m)))


@query("merge_qualifiers", "select event_id, concat_ws('|', nullif(event_type, 'error'), case when value > 50 then 'e' end) as qualifiers from events")
def _(m):
    codes = F.nullif(F.col("event_type"), F.lit("error")), F.when(F.col("value") > 50, "e")
    return m.table("events").select("event_id", scalars.merge_qualifiers(*codes).alias("qualifiers"))


@query("weather_coordinates", "select distinct s.site_id, s.longitude, s.latitude from fx_site_metadata s join fx_streamflow_15min f on s.site_id = f.site_id where s.latitude is not null and s.longitude is not null")
def _(m):
    return ingest.weather_coordinates(m.site_metadata, m.streamflow_15min)


@query("high_watermark", "select max(datetime) as high_watermark from fx_streamflow_15min")
def _(m):
    return incremental.high_watermark(m.streamflow_15min, "datetime")


@query("load_range", "select cast(max(datetime) - interval 2 day as date) as start_date, date '2024-02-01' as end_date, max(datetime) is not null as incremental from fx_streamflow_15min")
def _(m):
    return ingest.load_range(incremental.high_watermark(m.streamflow_15min, "datetime"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("load_range_weather", "select date '2024-01-24' as start_date, date '2024-01-31' as end_date, max(datetime) is not null as incremental from fx_streamflow_15min where datetime < timestamp '2020-01-01 00:00:00'")
def _(m):
    """Weather lags by a day; nothing is stored before 2020, so a week is loaded."""
    mark = incremental.high_watermark(m.streamflow_15min.where("datetime < timestamp_ntz'2020-01-01 00:00:00'"), "datetime")
    return ingest.load_range(mark, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), lag_days=1)


KEYS = ["user_id", "ts"]
NEW_SQL = "select i.user_id, i.ts, i.value from fx_incoming_rows i where not exists (select 1 from fx_existing_rows e where e.user_id = i.user_id and e.ts = i.ts)"


@query("upsert_insert_only", f"select * from fx_existing_rows union all {NEW_SQL}")
def _(m):
    return m.existing_rows.unionByName(incremental.insert_new(m.existing_rows, m.incoming_rows, KEYS, time="ts"))


@query(
    "load_report",
    f"""select (select count(*) from fx_incoming_rows) as fetched, (select count(distinct user_id) from fx_incoming_rows) as sites, (select min(ts) from fx_incoming_rows) as first_time,
    (select max(ts) from fx_incoming_rows) as last_time, (select count(*) from ({NEW_SQL})) as inserted, (select max(ts) from fx_existing_rows) as high_watermark, true as incremental""",
)
def _(m):
    return incremental.load_report(m.existing_rows, m.incoming_rows, KEYS, "user_id", "ts")


@query("merge_snapshot", "select * from fx_incoming_rows union all select e.* from fx_existing_rows e where not exists (select 1 from fx_incoming_rows i where e.user_id = i.user_id and e.ts = i.ts)")
def _(m):
    return incremental.merge_snapshot(m.incoming_rows, m.existing_rows, KEYS)


@query("merge_by_day", "select * from fx_incoming_rows union all select e.* from fx_existing_rows e where not exists (select 1 from fx_incoming_rows i where e.user_id = i.user_id and e.ts = i.ts)")
def _(m):
    """The same into a stored table that is kept by day: two loads, of which the second replaces only its own days."""
    target = scratch(m.spark, "by-day")
    for rows in (m.existing_rows, m.incoming_rows):
        incremental.merge_days(m.spark, rows, target, KEYS, "ts")
    return m.spark.read.parquet(target).drop("day")


@query("merge_policy_full_refresh", "select * from fx_incoming_rows")
def _(m):
    return incremental.merge_policy(m.incoming_rows, m.existing_rows, KEYS, full_refresh=True, schema_changed=False)


# Filters, joins, scalars

query("site_lookup", "select * from sites where site_id = '00000042'", sites=SITES_SQL)(lambda m: m.dim_sites().where(F.col("site_id") == "00000042"))


GAGE_SQL = "select site_id, latitude, longitude, strftime(observation_hour, '%Y-%m-%d %H:%M:%S') as observed_time, gage_height_ft_mean from flood where gage_height_ft_mean > 0"


def _gages(m):
    return m.flood_model().where("gage_height_ft_mean > 0").select("site_id", "latitude", "longitude", F.date_format("observation_hour", "yyyy-MM-dd HH:mm:ss").alias("observed_time"), "gage_height_ft_mean")


query("positive_gage", GAGE_SQL, **FLOOD)(_gages)
query("earliest_gage", f"{GAGE_SQL} order by observed_time, site_id limit 100", **FLOOD)(lambda m: _gages(m).orderBy("observed_time", "site_id").limit(100))


query("discharge_between", "select * from hours where streamflow_cfs_mean between 0 and 1000", hours=HOUR_SQL)(lambda m: marts.hourly_streamflow(m.staged("streamflow")).where(F.col("streamflow_cfs_mean").between(0, 1000)))


@query("sites_without_coords", "select a.site_id, a.station_name from attributes a where not exists (select 1 from sites s where s.site_id = a.site_id)", attributes=ATTRIBUTES_SQL, sites=SITES_SQL)
def _(m):
    return m.attributes().select("site_id", "station_name").join(m.dim_sites().select("site_id"), "site_id", "left_anti")


@query("normalize_utc", "select event_id, timezone('UTC', timezone('America/Denver', ts)) as ts_utc from events")
def _(m):
    return m.table("events").select("event_id", scalars.to_utc(F.col("ts").cast("timestamp"), "America/Denver").alias("ts_utc"))


# Quality


@query("dq_unique", "select site_id, count(*) as n_rows from fx_streamflow_15min where site_id is not null group by 1 having count(*) > 1")
def _(m):
    return quality.duplicate_keys(m.staged("streamflow"), ["site_id"])


@query("dq_not_null", " union all ".join(f"select 'stg_streamflow' as model, '{new}' as column_name, count(*) filter ({old} is null) as failures from fx_streamflow_15min" for old, new in (("site_id", "site_id"), ("datetime", "observed_at"), ("streamflow_cfs", "streamflow_cfs"))))
def _(m):
    return quality.null_counts(m.staged("streamflow"), "stg_streamflow", ["site_id", "observed_at", "streamflow_cfs"])


@query("primary_key_check", "select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, sum(n) = count(*) as is_key from (select count(*) as n from flood group by site_id, observation_hour)", **FLOOD)
def _(m):
    return quality.primary_key_check(m.flood_model(), ["site_id", "observation_hour"])


DOUBLED_SQL = "select user_id, ts from fx_existing_rows union all select user_id, ts from fx_incoming_rows"


@query("duplicate_rows", "select * from (select *, count(*) over (partition by user_id, ts) as n_rows from doubled) where n_rows > 1", doubled=DOUBLED_SQL)
def _(m):
    return quality.duplicate_rows(tables.union_batches([m.existing_rows, m.incoming_rows]).select(*KEYS), KEYS)


@query("first_duplicates", "select *, count(*) over (partition by user_id, ts) as n_rows from doubled qualify n_rows > 1 order by user_id, ts limit 10", doubled=DOUBLED_SQL)
def _(m):
    return quality.first_duplicates(tables.union_batches([m.existing_rows, m.incoming_rows]).select(*KEYS), KEYS)


TESTS = (
    ("stg_site_metadata", "fx_site_metadata", ["site_id"], ["site_id"]),
    ("stg_streamflow", f"(select {select_list('streamflow')} from fx_streamflow_15min)", [], ["site_id", "observed_at"]),
    ("stg_streamflow_daily", f"(select {select_list('streamflow_daily')} from fx_streamflow_daily)", [], ["site_id", "observed_date"]),
    ("dim_sites", "sites", ["site_id"], ["site_id"]),
)
REPORT_SQL = " union all ".join(
    [f"select '{n}' as model, '{c}' as column_name, 'unique' as test, (select count(*) from (select {c} from {v} where {c} is not null group by 1 having count(*) > 1)) as failures" for n, v, u, _ in TESTS for c in u]
    + [f"select '{n}', '{c}', 'not_null', (select count(*) from {v} where {c} is null)" for n, v, _, nn in TESTS for c in nn]
)


def _report(m):
    rows = {"stg_site_metadata": m.staged("site_metadata"), "stg_streamflow": m.staged("streamflow"), "stg_streamflow_daily": m.staged("streamflow_daily"), "dim_sites": m.dim_sites()}
    return quality.report([(name, rows[name], unique, not_null) for name, _, unique, not_null in TESTS])


query("quality_report", f"select *, case when failures = 0 then 'pass' else 'fail' end as status from ({REPORT_SQL})", sites=SITES_SQL)(_report)
query("quality_status", f"select case when failures = 0 then 'pass' else 'fail' end as status, count(*) as n_tests from ({REPORT_SQL}) group by 1", sites=SITES_SQL)(lambda m: quality.status_counts(_report(m)))

# Publishing

STATS_SQL = "select count(*) as n_rows, count(distinct site_id) as n_sites, min(observation_hour) as first_time, max(observation_hour) as last_time from hours"
query("dataset_stats", STATS_SQL, hours=HOUR_SQL)(lambda m: publish.dataset_stats(marts.hourly_streamflow(m.staged("streamflow")), "site_id", "observation_hour"))


@query("dataset_manifest", "select 'v1' as version, 'hourly' as source, n_rows, n_sites, first_time, last_time, 1.5 as size_mb from stats", hours=HOUR_SQL, stats=STATS_SQL)
def _(m):
    made = publish.manifest(marts.hourly_streamflow(m.staged("streamflow")), "site_id", "observation_hour", "hourly", "v1", 3 << 19)
    return made.select("version", "source", "n_rows", "n_sites", "first_time", "last_time", "size_mb")


#: Types of the learning table's columns, double where not named.
FLOOD_TYPES = {"site_id": "string", "observation_hour": "timestamp_ntz", "observation_count": "bigint"} | dict.fromkeys("station_name huc_code is_reference_hcdn2009 geology_class_reedbush geology_desc_hunt".split(), "string")
FLOOD_COLUMNS = [*"site_id observation_hour latitude longitude".split(), *(f"{c}_{f}" for c in marts.FLOW for f in ("mean", "max", "min")), "observation_count", *marts.WEATHER, *marts.attribute_columns(soils=False), *(f"{c}_target_1h" for c in marts.FLOW)]
FLOOD_JSON = json.dumps({c: "bigint" if c.startswith("hydroatlas") else FLOOD_TYPES.get(c, "double") for c in FLOOD_COLUMNS}, sort_keys=True)


@query("schema_fingerprint", f"select substr(sha256('{FLOOD_JSON}'), 1, 12) as fingerprint, {len(FLOOD_COLUMNS)} as n_columns, count(*) as n_rows from flood", **FLOOD)
def _(m):
    df = m.flood_model()
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(scalars.schema_fingerprint(df.schema)).alias("fingerprint"), F.lit(len(df.columns)).alias("n_columns"), "n_rows")


@query("schema_changed", "select 'v1' as version, count(*) as n_rows, true as schema_changed from hours", hours=HOUR_SQL)
def _(m):
    df = marts.hourly_streamflow(m.staged("streamflow"))
    before = publish.manifest(df.drop("observation_count"), "site_id", "observation_hour", "hourly", "v0").first()
    return publish.manifest(df, "site_id", "observation_hour", "hourly", "v1").select("version", "n_rows", F.lit(publish.schema_changed(df, before)).alias("schema_changed"))


@query("schema_unchanged", "select 'v1' as version, count(*) as n_rows, false as schema_changed from hours", hours=HOUR_SQL)
def _(m):
    """The same columns in another order, and no manifest at all, are no change."""
    df = marts.hourly_streamflow(m.staged("streamflow"))
    before = publish.manifest(df.select(*reversed(df.columns)), "site_id", "observation_hour", "hourly", "v0").first()
    changed = publish.schema_changed(df, before) or publish.schema_changed(df, None)
    return publish.manifest(df, "site_id", "observation_hour", "hourly", "v1").select("version", "n_rows", F.lit(changed).alias("schema_changed"))


#: Both loads name times of Denver, seven hours behind in January.
UTC_SQL = {
    "old_rows": "select user_id, ts + interval 7 hour as ts, value from fx_existing_rows",
    "new_rows": "select user_id, ts + interval 7 hour as ts, value from fx_incoming_rows",
    "merged": "select * from new_rows union all select o.* from old_rows o where not exists (select 1 from new_rows n where n.user_id = o.user_id and n.ts = o.ts)",
}


def _publish_twice(m, root: str) -> DataFrame:
    """A first version from texts with a zone, a second from instants; the manifest of the second."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" America/Denver"))
    instant = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/Denver")
    for version, rows, time in (("v1", m.existing_rows, text), ("v2", m.incoming_rows, instant)):
        made = publish.publish(m.spark, rows.withColumn("ts", time), root, version, KEYS, "user_id", "ts", source="readings")
    return made


@query(
    "publish_manifest",
    "select 'v2' as version, 'readings' as source, count(*) as n_rows, count(distinct user_id) as n_sites, min(ts) as first_time, max(ts) as last_time, true as size_is_that_of_the_folder from merged",
    **UTC_SQL,
)
def _(m):
    """Size and files of the manifest are compared with the listed folder."""
    root = scratch(m.spark, "published")
    made = _publish_twice(m, root)
    listed = store.files(m.spark, f"{root}/v2/data").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b")).first()
    right = (F.col("n_files") == listed["n"]) & (F.col("size_bytes") == listed["b"]) & (F.col("size_mb") == F.round(F.lit(listed["b"] / (1 << 20)), 2))
    return made.select("version", "source", "n_rows", "n_sites", "first_time", "last_time", right.alias("size_is_that_of_the_folder"))


@query("published_rows", "select * from merged", **UTC_SQL)
def _(m):
    """The rows of the version that the alias names after two runs."""
    root = scratch(m.spark, "published")
    _publish_twice(m, root)
    return publish.read_version(m.spark, root, publish.aliased(m.spark, root))


@query(
    "retained_versions",
    """select 'v2' as version, 'best' as alias, count(*) as n_rows from events where ts < timestamp '2024-01-15 00:00:00'
    union all select 'v4', 'latest', count(*) from events""",
)
def _(m):
    """Of four versions one has an alias of its own and one is the latest; the others are deleted, and a folder without a manifest is
    no version."""
    root, events = scratch(m.spark, "published"), m.table("events")
    for k in (1, 2, 3, 4):
        rows = events if k == 4 else events.where(F.col("ts") < F.lit(f"2024-01-{5 * k + 5} 00:00:00").cast("timestamp_ntz"))
        publish.publish(m.spark, rows, root, f"v{k}", ["event_id"], "user_id", "ts", full_refresh=True)
    publish.set_alias(m.spark, root, "best", "v2")
    tables.write_snapshot(events.limit(1), f"{root}/v5/data")
    publish.retire(m.spark, root)
    left = publish.versions(m.spark, root).collect()
    counts = [publish.read_version(m.spark, root, r.version).agg(F.lit(r.version).alias("version"), F.lit(a).alias("alias"), F.count("*").alias("n_rows")) for r in left for a in r.aliases]
    return tables.union_batches(counts)


@query("versions_to_drop", "select event_id as version from events where event_id % 7 <> 0")
def _(m):
    versions = m.table("events").select(F.col("event_id").alias("version"), F.when(F.col("event_id") % 7 == 0, F.array(F.lit("latest"))).alias("aliases"))
    return publish.versions_to_drop(versions)


# Learning path

FRAME_SQL = "select site_id, observation_hour, streamflow_cfs_mean, precipitation_mm, temperature_c, humidity_pct, wind_speed_ms from hourly where streamflow_cfs_mean is not null and precipitation_mm is not null"
SHARE_SQL = "('0x' || substr(md5(site_id || '|' || strftime(observation_hour, '%Y-%m-%d %H:%M:%S')), 1, 7))::bigint % 100"
query("training_frame", FRAME_SQL, **HOURLY)(lambda m: ml.training_frame(m.hourly()))
query("split_counts", f"select {SHARE_SQL} < 20 as is_test, count(*) as n_rows from frame group by 1", **HOURLY, frame=FRAME_SQL)(lambda m: ml.training_frame(m.hourly()).groupBy(ml.in_test().alias("is_test")).agg(F.count("*").alias("n_rows")))


def _stored_frame(m) -> DataFrame:
    """The frame, written once: fits read it several times."""
    path = scratch(m.spark, "frame")
    ml.training_frame(m.hourly()).write.parquet(path)
    return m.spark.read.parquet(path)


query("rf_predictions")(lambda m: ml.predictions(_stored_frame(m)))
query("param_search")(lambda m: ml.param_search(_stored_frame(m)))


@query(
    "regression_metrics",
    """select count(*) as n, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) as r2
    from (select streamflow_cfs_mean as y, streamflow_cfs_max as p from hours where streamflow_cfs_mean is not null)""",
    hours=HOUR_SQL,
)
def _(m):
    found = ml.regression_metrics(marts.hourly_streamflow(m.staged("streamflow")), "streamflow_cfs_mean", "streamflow_cfs_max")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


NOW = "2024-01-31 00:00:00"


@query(
    "promotion_decision",
    f"""with_best select best_run, best_mae, production_run, production_mae, best_run is not null and (production_mae is null or coalesce((production_mae - best_mae) / production_mae >= 0.05, false)) as promote
    from (select run_id as best_run, test_mae as best_mae from fx_model_runs where state = 'finished' and has_model and test_mae is not null and created_at >= timestamp '{NOW}' - interval 7 day order by test_mae, created_at desc, run_id desc limit 1),
    (select max(run_id) as production_run, max(test_mae) as production_mae from fx_model_runs where is_production)""".replace("with_best ", ""),
)
def _(m):
    return ml.promotion_decision(m.model_runs, F.lit(NOW).cast("timestamp_ntz"))


@query("score_recent")
def _(m):
    frame = _stored_frame(m)
    model = ml.forest().fit(frame)
    return ml.score(model, features.last_hours(frame, "observation_hour", 24), "v1", F.lit(NOW).cast("timestamp_ntz"))


@query(
    "scored_rows",
    f"""select site_id, observation_hour as timestamp, version as model_version, timestamp '{NOW}' as predicted_at, true as within_truth
    from frame, (select unnest(['v1', 'v2']) as version) where observation_hour > (select max(observation_hour) from frame) - interval 24 hour""",
    **HOURLY,
    frame=FRAME_SQL,
)
def _(m):
    """A model is fitted and stored once under two versions, each loaded to score the last day; what was written is read back. Every
    prediction of a forest lies within what it was fitted on. The smallest forest of the parameter grid does for that."""
    root, target, at = scratch(m.spark, "models"), scratch(m.spark, "predictions"), F.lit(NOW).cast("timestamp_ntz")
    frame = _stored_frame(m)
    model = ml.forest(50, 5).fit(frame)
    low, high = frame.agg(F.min(ml.TARGET), F.max(ml.TARGET)).first()
    recent = features.last_hours(frame, "observation_hour", 24)
    for version in ("v1", "v2"):
        ml.save_model(model, root, version)
        ml.score_batch(root, version, recent, at, target)
    ml.score_batch(root, "v2", recent, at, target)  # a repeated run adds nothing
    found = ml.read_predictions(m.spark, target)
    return found.select("site_id", "timestamp", "model_version", "predicted_at", F.col("prediction").between(low, high).alias("within_truth"))


@query(
    "prediction_summary",
    f"select count(*) as n_predictions, count(distinct user_id) as n_sites, max(ts) as latest, arg_max(event_type, (ts, event_type)) as model_version from events where ts >= timestamp '{NOW}' - interval 48 hour",
)
def _(m):
    made = m.table("events").select(F.col("user_id").alias("site_id"), F.col("ts").alias("predicted_at"), F.col("event_type").alias("model_version"))
    return ml.prediction_summary(made, F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 48 hours"))


@query(
    "recent_predictions",
    "select user_id as site_id, ts as predicted_at, event_type as model_version, value as prediction from events qualify row_number() over (partition by user_id order by ts desc, event_type desc, value desc) <= 3",
)
def _(m):
    made = m.table("events").select(F.col("user_id").alias("site_id"), F.col("ts").alias("predicted_at"), F.col("event_type").alias("model_version"), F.col("value").alias("prediction"))
    return ml.recent_predictions(made, 3)


# Exploration

CORR = ["gage_height_ft_mean", "streamflow_cfs_mean", "precipitation_mm", "temperature_c", "humidity_pct", "drainage_area_sq_km"]
query(
    "correlation_matrix",
    " union all ".join(f"select '{a}' as x, '{b}' as y, round(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end, 6) as r from flood where gage_height_ft_mean > 0" for a in CORR for b in CORR),
    **FLOOD,
)(lambda m: explore.correlation_matrix(m.flood_model().where("gage_height_ft_mean > 0"), CORR).withColumn("r", F.round("r", 6)))
query(
    "site_distribution",
    """select site_id, n, low, q[1] as q1, q[2] as median, q[3] as q3, high, round(q[1] - 1.5 * (q[3] - q[1]), 12) as lower_fence, round(q[3] + 1.5 * (q[3] - q[1]), 12) as upper_fence
    from (select site_id, count(*) as n, min(gage_height_ft_mean) as low, max(gage_height_ft_mean) as high, quantile_cont(gage_height_ft_mean, [0.25, 0.5, 0.75]) as q from hours where gage_height_ft_mean is not null group by 1)""",
    hours=HOUR_SQL,
)(lambda m: explore.site_distribution(marts.hourly_streamflow(m.staged("streamflow")), "gage_height_ft_mean").withColumns({c: F.round(c, 12) for c in ("lower_fence", "upper_fence")}))
#: Share of a site's values by which the rank of a sketched quartile may be off.
RANK_ERROR = 0.02


@query("sketched_distribution", "select site_id, count(*) as n, min(gage_height_ft_mean) as low, max(gage_height_ft_mean) as high, true as ranks_are_close from hours where gage_height_ft_mean is not null group by 1", hours=HOUR_SQL)
def _(m):
    """Box statistics from stored sketches of each site's days; the ranks of the quartiles are counted in the data."""
    hours, path = marts.hourly_streamflow(m.staged("streamflow")), scratch(m.spark, "sketches")
    explore.quantile_sketches(hours, "gage_height_ft_mean", "observation_hour").write.parquet(path)
    found = explore.merged_distribution(m.spark.read.parquet(path))
    return found.join(_ranks(hours, found, "gage_height_ft_mean", "site_id"), "site_id").select("site_id", "n", "low", "high", "ranks_are_close")


@query("sketched_profile", "select count(value) as n, min(value) as low, max(value) as high, true as ranks_are_close from events")
def _(m):
    """The same over all rows, from sketches of each event type's days."""
    events = m.table("events").withColumn("all", F.lit(1))
    found = explore.merged_distribution(explore.quantile_sketches(events, "value", "ts", ("event_type",)), ()).withColumn("all", F.lit(1))
    return found.join(_ranks(events, found, "value", "all"), "all").select("n", "low", "high", "ranks_are_close")


def _ranks(df: DataFrame, found: DataFrame, value: str, key: str) -> DataFrame:
    """Whether each quartile's exact rank, that of equal values as a range, is close to its share."""
    known = df.where(F.col(value).isNotNull()).join(found.select(key, "q1", "median", "q3"), key)
    close = []
    for q, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below, upto = (F.avg(x.cast("double")) for x in (F.col(value) < F.col(q), F.col(value) <= F.col(q)))
        close.append((below <= share + RANK_ERROR) & (upto >= share - RANK_ERROR))
    return known.groupBy(key).agg((close[0] & close[1] & close[2]).alias("ranks_are_close"))


query(
    "map_frames",
    """select site_id, latitude, longitude, strftime(observation_hour, '%Y-%m-%d %H:%M:%S') as frame, gage_height_ft_mean as value,
    min(gage_height_ft_mean) over () as range_low, max(gage_height_ft_mean) over () as range_high from flood where gage_height_ft_mean > 0""",
    **FLOOD,
)(lambda m: explore.map_frames(m.flood_model(), "gage_height_ft_mean", "observation_hour", scratch(m.spark, "points")))
PROFILE = ["streamflow_cfs_mean", "gage_height_ft_mean", "observation_count"]
query(
    "profile_columns",
    " union all ".join(
        f"""select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as n_null, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as low,
        quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.5) as median, quantile_cont({c}::double, 0.75) as q3, cast(max({c}) as double) as high from hours"""
        for c in PROFILE
    ),
    hours=HOUR_SQL,
)(lambda m: explore.profile_columns(marts.hourly_streamflow(m.staged("streamflow")), PROFILE).withColumns({c: F.round(c, 6) for c in ("mean", "std")}))

KNOWN_SQL = """select state_name, monitoring_location_id as id, coalesce(computation_identifier = 'Instantaneous', false) or coalesce(computation_period_identifier = 'Points', false) as is_iv,
  coalesce(computation_period_identifier = 'Daily', false) as is_daily from fx_timeseries_metadata where coalesce(hydrologic_unit_code, '') like '10%' and coalesce(monitoring_location_id, '') <> ''"""
COUNTS_SQL = "count(distinct id) as discharge, count(distinct case when is_iv then id end) as iv, count(distinct case when is_daily then id end) as daily"
TOTALS_SQL = f"select (select count(*) from fx_monitoring_locations where coalesce(hydrologic_unit_code, '') like '10%') as all_sites, {COUNTS_SQL} from known"


def _totals(m):
    return explore.coverage_totals(m.monitoring_locations, m.timeseries_metadata, "10")


query(
    "coverage_by_state",
    f"""select l.*, coalesce(discharge, 0) as discharge, coalesce(iv, 0) as iv, coalesce(daily, 0) as daily from
    (select state_name, count(*) as total, count(*) filter (coalesce(hydrologic_unit_code, '') like '10%') as in_region from fx_monitoring_locations group by 1) l
    left join (select state_name, {COUNTS_SQL} from known group by 1) k on l.state_name = k.state_name""",
    known=KNOWN_SQL,
)(lambda m: explore.coverage_by_state(m.monitoring_locations, m.timeseries_metadata, "10"))
query("coverage_totals", TOTALS_SQL, known=KNOWN_SQL)(_totals)
query(
    "coverage_summary",
    " union all ".join(
        f"select {k} as step, '{c}' as category, {c} as n_sites, round(100.0 * {c} / all_sites, 1)::double as pct_of_total, {'null' if k == 1 else f'round(100.0 * {c} / discharge, 1)::double'} as pct_of_discharge from totals"
        for k, c in ((1, "all_sites"), (2, "discharge"), (3, "iv"), (4, "daily"))
    ),
    known=KNOWN_SQL,
    totals=TOTALS_SQL,
)(lambda m: explore.coverage_summary(_totals(m)))
query(
    "coverage_bars",
    " union all ".join(
        f"select '{c}' as category, repeat('█', floor({c} / all_sites * 50)::int) || repeat('░', 50 - floor({c} / all_sites * 50)::int) as bar, format('{{:,}}', {c}) as n_text from totals" for c in ("all_sites", "discharge", "iv")
    ),
    known=KNOWN_SQL,
    totals=TOTALS_SQL,
)(lambda m: explore.coverage_bars(_totals(m)))

# Resampling, samples and windows


@query(
    "resample_std",
    "select user_id, date_trunc('hour', ts) as hour, round(avg(value), 6) as value_mean, max(value) as value_max, round(stddev_samp(value), 6) as value_std from events group by 1, 2",
)
def _(m):
    measures = F.round(F.avg("value"), 6).alias("value_mean"), F.max("value").alias("value_max"), F.round(F.stddev_samp("value"), 6).alias("value_std")
    return marts.resampled(m.table("events"), ["user_id"], "ts", "hour", "hour", *measures)


@query("region_daily", "select cast(ts as date) as day, c_nationkey as region, round(avg(value), 6) as value_mean, max(value) as value_max from events join customer on user_id = c_custkey group by 1, 2")
def _(m):
    rows = m.table("events").join(m.table("customer").select("c_custkey", F.col("c_nationkey").alias("region")), F.col("user_id") == F.col("c_custkey"))
    return marts.resampled(rows, ["region"], "ts", "day", "day", F.round(F.avg("value"), 6).alias("value_mean"), F.max("value").alias("value_max"))


query("recent_sample", "select * exclude (extracted_at) from fx_streamflow_15min where datetime > timestamp '2024-01-25 00:00:00'")(lambda m: m.streamflow_15min.drop("extracted_at").where("datetime > timestamp_ntz'2024-01-25 00:00:00'"))
query("stratified_sample", "select event_id, event_type, value from events where event_type = 'purchase' or ('0x' || substr(md5(event_id::varchar), 1, 7))::bigint % 100 < 10")(
    lambda m: features.stratified_sample(m.table("events").select("event_id", "event_type", "value"), F.col("event_type") == "purchase", "event_id", 10)
)
query(
    "lag_features",
    """select site_id, observation_hour, gage_height_ft_mean, lag(gage_height_ft_mean, 1) over w as gage_height_ft_mean_lag_1, lag(gage_height_ft_mean, 2) over w as gage_height_ft_mean_lag_2,
    lag(gage_height_ft_mean, 3) over w as gage_height_ft_mean_lag_3, round(avg(gage_height_ft_mean) over (partition by site_id order by observation_hour rows between 5 preceding and current row), 12) as gage_height_ft_mean_mean_6
    from hours window w as (partition by site_id order by observation_hour)""",
    hours=HOUR_SQL,
)(lambda m: features.lag_features(marts.hourly_streamflow(m.staged("streamflow")), "site_id", "observation_hour", "gage_height_ft_mean").withColumn("gage_height_ft_mean_mean_6", F.round("gage_height_ft_mean_mean_6", 12)))
query("inference_window", "select event_id, user_id, ts, value from events where ts > (select max(ts) from events) - interval 24 hour")(lambda m: features.last_hours(m.table("events").select("event_id", "user_id", "ts", "value"), "ts", 24))

# Streaming: each runs to the end of what is there


def _events(m):
    found = m.table("events")
    return _readings(jobs.landing(m.spark, f"{m.sf_dir}/events.parque[t]", found.schema))  # a glob may name a file or a folder


def _readings(stream: DataFrame) -> DataFrame:
    site = F.lpad(F.col("user_id").cast("string"), 8, "0").alias("site_id")
    flow = F.when(F.col("event_type") != "error", F.col("value")).alias("streamflow_cfs")
    return stream.select(site, F.col("ts").cast("timestamp").alias("observed_at"), flow, (F.col("value") / 64).alias("gage_height_ft"))


def _finished(m, start) -> DataFrame:
    target, checkpoint = scratch(m.spark, "stream"), scratch(m.spark, "stream-checkpoint")
    running = start(target, checkpoint)
    running.awaitTermination()
    return m.spark.read.parquet(target)


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


READ_SQL = "select site_id, datetime as observed_at, streamflow_cfs, gage_height_ft from fx_streamflow_15min"


@query("stream_ingest", READ_SQL)
def _(m):
    """The target is kept by day: a micro-batch is compared with its own days."""
    return _naive(_finished(m, lambda target, at: jobs.ingest(_events(m), target, ["site_id", "observed_at"], at, time="observed_at")).drop(jobs.BATCH, jobs.DAY))


@query("stream_hourly", "select site_id, observation_hour, streamflow_cfs_mean, gage_height_ft_mean, observation_count from hours", hours=HOUR_SQL)
def _(m):
    return _finished(m, lambda target, at: jobs.run_to_table(jobs.hourly(_events(m), "observed_at"), target, at, "complete"))


def stream_in_loads(m, target: str, lateness: str = "2 days") -> list:
    """Readings land in three loads, each followed by a run from the same checkpoint: those before the 16th, those since, and last
    the readings without discharge of any time, most of them too late. Final hours are appended. Returns the ended runs."""
    land, checkpoint, runs = scratch(m.spark, "landing"), scratch(m.spark, "stream-checkpoint"), []
    late, half = F.col("event_type") == "error", F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    events = m.table("events")
    for load in (~late & half, ~late & ~half, late):
        events.where(load).write.mode("append").parquet(land)
        stream = _readings(jobs.landing(m.spark, land, events.schema))
        running = jobs.run_to_table(jobs.hourly(stream, "observed_at", lateness), target, checkpoint)
        running.awaitTermination()
        runs.append(running)
    return runs


@query(
    "stream_hourly_append",
    """select lpad(user_id::varchar, 8, '0') as site_id, date_trunc('hour', ts) as observation_hour, avg(case when event_type <> 'error' then value end) as streamflow_cfs_mean,
    avg(value / 64) as gage_height_ft_mean, count(*) as observation_count
    from events, (select max(ts) filter (event_type <> 'error') - interval 2 day as second, max(ts) - interval 2 day as last from events)
    where (event_type <> 'error' or date_trunc('hour', ts) + interval 1 hour > second) and date_trunc('hour', ts) + interval 1 hour <= last group by 1, 2""",
)
def _(m):
    """Hours below the watermark, each once; hours above it are withheld and readings that come after it are dropped."""
    target = scratch(m.spark, "stream")
    stream_in_loads(m, target)
    return m.spark.read.parquet(target)


@query("stream_dedup", f"select distinct * from ({READ_SQL})")
def _(m):
    return _naive(_finished(m, lambda target, at: jobs.run_to_table(jobs.distinct_readings(_events(m), ["site_id", "observed_at"], "observed_at"), target, at)))


@query("stream_enrich", f"select r.*, s.latitude, s.longitude from ({READ_SQL}) r join sites s on r.site_id = s.site_id", sites=SITES_SQL)
def _(m):
    return _naive(_finished(m, lambda target, at: jobs.run_to_table(jobs.enriched(_events(m), m.dim_sites()), target, at)))
