"""Dimensions, facts and the learning tables.

Readings are aggregated before any join. Sides are broadcast only where Spark's own size statistics allow it: nothing is hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.functions.scalars import truncated

#: Fixed column names of the attribute dimension, by the table that has them.
ATTRIBUTES = {
    "basin": "drainage_area_sq_km is_reference_hcdn2009",
    "topo": "elev_mean_m elev_max_m elev_min_m slope_pct aspect_northness aspect_eastness",
    "soils": "soil_water_capacity_avg soil_permeability_avg clay_pct_avg silt_pct_avg sand_pct_avg rock_depth_avg",
    "geology": "geology_class_reedbush geology_desc_hunt",
    "climate": "p_mean pet_mean aridity_index p_seasonality frac_snow high_prec_freq low_prec_freq",
    "hydroatlas": "ele_mt_sav:hydroatlas_elev_m slp_dg_uav:hydroatlas_slope_deg tmp_dc_syr:hydroatlas_temp_mean_c pre_mm_syr:hydroatlas_precip_mm_yr pet_mm_syr:hydroatlas_pet_mm_yr ari_ix_uav:hydroatlas_aridity cly_pc_uav:hydroatlas_clay_pct snd_pc_uav:hydroatlas_sand_pct for_pc_use:hydroatlas_forest_pct crp_pc_use:hydroatlas_crop_pct urb_pc_use:hydroatlas_urban_pct",
}
WEATHER = ("precipitation_mm", "temperature_c", "wind_speed_ms", "humidity_pct")
FLOW = ("streamflow_cfs", "gage_height_ft")


def attribute_columns(*, soils: bool) -> list[str]:
    return ["station_name", "huc_code", *(c.split(":")[-1] for t, text in ATTRIBUTES.items() if soils or t != "soils" for c in text.split())]


def dim_sites(sites: DataFrame) -> DataFrame:
    """Sites with both coordinates."""
    return sites.select("site_id", "station_name", "latitude", "longitude", "drainage_area_sq_mi", "huc_code").where("latitude is not null and longitude is not null")


def dim_catchment_attributes(sites: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """All sites, with or without coordinates, and what each attribute table has of them."""
    out = sites.select("site_id", "station_name", "latitude", "longitude", "huc_code")
    for name, text in ATTRIBUTES.items():
        wanted = [(c.split(":")[0], c.split(":")[-1]) for c in text.split()]
        out = out.join(tables[name].select("site_id", *[F.col(a).alias(b) for a, b in wanted]), "site_id", "left")
    return out


def resampled(rows: DataFrame, keys: list[str], time: str, unit: str, out: str, *aggregates) -> DataFrame:
    """One row for each key and unit of time."""
    return rows.groupBy(*keys, truncated(F.col(time), unit).alias(out)).agg(*aggregates)


def hourly_streamflow(readings: DataFrame) -> DataFrame:
    """Mean, largest and smallest discharge and height by site and hour; the count has null readings too."""
    measures = [f(c).alias(f"{c}_{n}") for c in FLOW for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    return resampled(readings, ["site_id"], "observed_at", "hour", "observation_hour", *measures, F.count("*").alias("observation_count"))


def daily_weather(weather: DataFrame) -> DataFrame:
    measures = [F.sum("precipitation_mm").alias("precipitation_mm")]
    measures += [f("temperature_c").alias(f"temperature_c_{n}") for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    measures += [F.avg(c).alias(f"{c}_mean") for c in ("wind_speed_ms", "humidity_pct")]
    return resampled(weather, ["latitude", "longitude"], "observed_at", "day", "observed_date", *measures)


def with_coordinates(flow: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of sites that the site dimension has."""
    time = flow.columns[1]
    joined = flow.join(sites.select("site_id", "latitude", "longitude"), "site_id")
    return joined.select("site_id", time, "latitude", "longitude", *flow.columns[2:])


def with_place(df: DataFrame) -> DataFrame:
    """A whole number for the coordinates, to deal tables out by; different places seldom share one."""
    return df.withColumn("place", F.xxhash64("longitude", "latitude"))


def fct_streamflow_hourly(readings: DataFrame, sites: DataFrame, weather: DataFrame) -> DataFrame:
    """Hours without weather stay; weather that a place and hour has twice doubles them."""
    hours = weather.select("longitude", "latitude", F.col("observed_at").alias("observation_hour"), *WEATHER)
    flow = with_coordinates(hourly_streamflow(readings), sites)
    return flow.join(hours, ["longitude", "latitude", "observation_hour"], "left").select(*flow.columns, *WEATHER)


def fct_streamflow_daily(daily: DataFrame, sites: DataFrame, weather: DataFrame) -> DataFrame:
    flow = with_coordinates(daily.select("site_id", "observed_date", "streamflow_cfs_mean", "gage_height_ft_mean"), sites)
    days = daily_weather(weather)
    return flow.join(days, ["longitude", "latitude", "observed_date"], "left").select(*flow.columns, *days.columns[3:])


def with_targets(df: DataFrame, time: str, suffix: str, strict_step: str | None = None) -> DataFrame:
    """Discharge and height of the site's next row; with strict_step null where that row isn't so far ahead."""
    ahead = Window.partitionBy("site_id").orderBy(time)
    for column in FLOW:
        value = F.lead(f"{column}_mean", 1).over(ahead)
        if strict_step:
            value = F.when(F.lead(time, 1).over(ahead) == F.col(time) + F.expr(f"interval {strict_step}"), value)
        df = df.withColumn(f"{column}_target_{suffix}", value)
    return df


def flood_model(flow: DataFrame, attributes: DataFrame, weather: DataFrame, strict_step: str | None = None) -> DataFrame:
    """Hours with weather, their attributes, and targets one row ahead; flow: hours with the site's coordinates.

    The hourly fact joined with weather again would have, of an hour with k weather rows, k * k: each of them k times. Weather is so
    joined once, with k counted in the join's own partitioning; attributes name the same coordinates as the sites.

    Where both sides have their place as a whole number (with_place), they are joined by it and the hour, and coordinates are compared
    afterwards: Spark rewrites doubles among join keys, so tables dealt out by coordinates would be shuffled again.
    """
    time = F.col("observed_at").cast("timestamp_ntz").alias("observation_hour")
    if "place" in flow.columns and "place" in weather.columns:
        hours = weather.select("place", time, F.col("longitude").alias("w_longitude"), F.col("latitude").alias("w_latitude"), *WEATHER)
        hours = hours.withColumn("copies", F.count("*").over(Window.partitionBy("place", "observation_hour", "w_longitude", "w_latitude")))
        off = F.abs(F.col("longitude") - F.col("w_longitude")) + F.abs(F.col("latitude") - F.col("w_latitude"))
        met, kept = flow.join(hours, ["place", "observation_hour"]).where(off == 0), [c for c in flow.columns if c != "place"]
    else:
        keys = ["longitude", "latitude", "observation_hour"]
        hours = weather.select("longitude", "latitude", time, *WEATHER)
        hours = hours.withColumn("copies", F.count("*").over(Window.partitionBy(*keys)))
        met, kept = flow.join(hours, keys), flow.columns
    named = attributes.select("site_id", *attribute_columns(soils=False))
    joined = met.join(named, "site_id").select(*kept, *WEATHER, *attribute_columns(soils=False), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    return with_targets(joined, "observation_hour", "1h", strict_step)


def flood_model_daily(daily: DataFrame, attributes: DataFrame, strict_step: str | None = None, without: DataFrame | None = None) -> DataFrame:
    """Days with or without weather, and targets one row ahead; without: sites to leave out, such as those with 15-minute data."""
    if without is not None:
        daily = daily.join(without.select("site_id"), "site_id", "left_anti")
    joined = daily.join(attributes.select("site_id", *attribute_columns(soils=False)), "site_id")
    return with_targets(joined.select(*daily.columns, *attribute_columns(soils=False)), "observed_date", "1d", strict_step)
