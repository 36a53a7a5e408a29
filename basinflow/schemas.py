"""Declared schemas of the raw tables; reads conform to them by name."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Fixed names and types of the raw tables.
TEXTS = {
    "site_metadata": "site_id string, station_name string, latitude double, longitude double, huc_code string, drainage_area_sq_mi double, state_code string, county_code string, has_iv boolean, has_daily boolean",
    "streamflow_15min": "site_id string, datetime timestamp, streamflow_cfs double, gage_height_ft double, qualifiers string, extracted_at timestamp",
    "streamflow_daily": "site_id string, date date, streamflow_cfs_mean double, gage_height_ft_mean double, qualifiers string, extracted_at timestamp",
    "weather_forcing": "longitude double, latitude double, datetime timestamp, prcp double, temp double, humidity double, wind_speed double, wind_direction double, rsds double, rlds double, psurf double, pet double, extracted_at timestamp",
    "seed_basin": "staid string, staname string, drain_sqkm double, huc02 int, lat_gage double, lng_gage double, state string, hcdn_2009 string, hbn36 string",
    "location_pages": "type string, features array<struct<properties: struct<monitoring_location_id: string, state_name: string, hydrologic_unit_code: string>>>",
    "weather_responses": "longitude double, latitude double, hourly struct<start: bigint, end: bigint, step: bigint, temperature: array<double>, wind: array<double>>",
    "predictions": "site_id string, timestamp timestamp, prediction double, model_version string, predicted_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TEXTS[name])
