"""Site discovery, availability and load planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.functions.scalars import has_prefix

DAYS_BACK, OVERLAP_DAYS = 7, 2


def discover_sites(catalog: DataFrame, prefix: str, code: str = "huc_code", more: Column | None = None) -> DataFrame:
    """Sites of a region, and of a parameter or data type where the catalog has such columns."""
    found = catalog.where(has_prefix(F.col(code), prefix))
    return found if more is None else found.where(more)


def flag_availability(sites: DataFrame, **having: DataFrame) -> DataFrame:
    """A boolean column for each frame of site_ids: whether it has the site."""
    for name, rows in having.items():
        known = rows.select("site_id").distinct().withColumn(name, F.lit(True))
        sites = sites.join(known, "site_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return sites


def availability_totals(flagged: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(n) for c, n in (("has_iv", "num_iv"), ("has_daily", "num_daily"))]
    return flagged.agg(F.count("*").alias("num_sites"), *counts)


def weather_coordinates(sites: DataFrame, readings: DataFrame) -> DataFrame:
    """Sites with readings and coordinates: where weather is fetched."""
    return sites.join(readings.select("site_id"), "site_id", "left_semi").where("latitude is not null and longitude is not null").select("site_id", "longitude", "latitude").distinct()


def load_range(watermark: DataFrame, now: Column, overlap: int = OVERLAP_DAYS, days_back: int = DAYS_BACK, lag_days: int = 0) -> DataFrame:
    """From the watermark less an overlap, or so many days back, to now less a lag."""
    end = now - F.make_dt_interval(F.lit(lag_days))
    start = F.coalesce(F.col("high_watermark") - F.make_dt_interval(F.lit(overlap)), end - F.make_dt_interval(F.lit(days_back)))
    return watermark.select(start.cast("date").alias("start_date"), end.cast("date").alias("end_date"), F.col("high_watermark").isNotNull().alias("incremental"))
