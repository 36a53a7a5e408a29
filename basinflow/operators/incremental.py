"""Watermarks, insert-only ingest and snapshot merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow import store
from basinflow.session import scratch


def high_watermark(rows: DataFrame, time: str) -> DataFrame:
    """The latest time, dates as their midnight; null over no rows."""
    return rows.agg(F.max(F.col(time).cast("timestamp_ntz")).alias("high_watermark"))


def table_watermark(spark: SparkSession, name: str, time: str):
    """The same of a stored table, None if there is none."""
    return high_watermark(spark.table(name), time).first()[0] if spark.catalog.tableExists(name) else None


def insert_new(target: DataFrame | None, batch: DataFrame, keys: list[str], time: str | None = None, dedupe_batch: bool = False) -> DataFrame:
    """Rows of the batch to append: those whose key the target lacks. Stored rows never change, and null keys never match.

    time names a key column by which the target is ordered or partitioned: only its rows since the batch's earliest are read.
    """
    if dedupe_batch:
        batch = batch.dropDuplicates(keys)
    if target is None:
        return batch
    if time:
        target = target.where(F.col(time) >= F.lit(batch.agg(F.min(time)).first()[0]))
    return batch.join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def load_report(target: DataFrame | None, batch: DataFrame, keys: list[str], site: str, time: str) -> DataFrame:
    """One row: fetched, inserted, sites, the range fetched, the watermark before."""
    new = insert_new(target, batch, keys).agg(F.count("*").alias("inserted"))
    seen = batch.agg(F.count("*").alias("fetched"), F.countDistinct(site).alias("sites"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    mark = high_watermark(target, time) if target is not None else batch.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("high_watermark"))
    return seen.join(new).join(mark).withColumn("incremental", F.col("high_watermark").isNotNull())


def merge_snapshot(local: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Local rows, and existing ones whose key isn't local."""
    if existing is None:
        return local
    return local.unionByName(existing.join(local.select(*keys), keys, "left_anti").select(*local.columns))


def merge_days(spark: SparkSession, local: DataFrame, target: str, keys: list[str], time: str, day: str = "day") -> None:
    """Merge into a stored target that is partitioned by the day of time, one of the keys. Only days that the local rows touch are
    read, merged and replaced; all other files stay as they are. The merged days are stored apart first, so that nothing is replaced
    by rows that are still being read, and a run that ends early can simply be run again."""
    placed = local.withColumn(day, F.to_date(time))
    days = [r[0] for r in placed.select(day).distinct().collect()]  # the days that the local rows span
    merged = placed
    if store.exists(spark, target):
        stored = spark.read.schema(placed.schema).parquet(target)
        touched = F.col(day).isin([d for d in days if d is not None])
        merged = merge_snapshot(placed, stored.where(touched | F.col(day).isNull() if None in days else touched), keys)
    draft = scratch(spark, "merged")
    merged.write.partitionBy(day).parquet(draft)
    ready = spark.read.schema(placed.schema).parquet(draft)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)
    store.delete(spark, draft)


def merge_policy(local: DataFrame, existing: DataFrame | None, keys: list[str], full_refresh: bool, schema_changed: bool) -> DataFrame:
    """A full refresh or a changed schema replaces the snapshot; else it is merged."""
    return local if full_refresh or schema_changed else merge_snapshot(local, existing, keys)
