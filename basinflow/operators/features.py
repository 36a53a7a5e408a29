"""Window features and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.functions.scalars import hashed_share


def lag_features(df: DataFrame, key: str, time: str, value: str, lags: tuple[int, ...] = (1, 2, 3), window: int = 6) -> DataFrame:
    """The key's earlier values, and the mean over its last rows, this one included; one sort serves all."""
    order = Window.partitionBy(key).orderBy(time)
    past = [F.lag(value, k).over(order).alias(f"{value}_lag_{k}") for k in lags]
    return df.select(key, time, value, *past, F.avg(value).over(order.rowsBetween(1 - window, 0)).alias(f"{value}_mean_{window}"))


def last_hours(df: DataFrame, time: str, hours: int) -> DataFrame:
    """Rows later than so many hours before the latest."""
    latest = df.agg(F.max(time).alias("__latest"))
    return df.join(latest, F.col(time) > F.col("__latest") - F.make_dt_interval(F.lit(0), F.lit(hours))).drop("__latest")


def stratified_sample(df: DataFrame, rare, key: str, percent: int) -> DataFrame:
    """All rare rows and a repeatable share of the others."""
    rare = F.coalesce(rare, F.lit(False))
    return df.where(rare | (hashed_share(F.col(key)) < percent))
