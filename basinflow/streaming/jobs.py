"""Structured Streaming forms of ingest, resampling, de-duplication and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StringType, StructField, StructType

from basinflow import store
from basinflow.operators.incremental import insert_new


def landing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files as they arrive in a folder, or those of a glob."""
    return spark.readStream.schema(schema).parquet(path)


#: Folders of a target that is kept by day.
DAY, BATCH = "ingest_day", "batch"


def stored_rows(spark: SparkSession, target: str, schema: StructType, days: list | None = None) -> DataFrame | None:
    """Rows of a target with the batch that brought them, None if there are none. days: only those days' folders are listed and
    read, however many others there are."""
    kept = [*schema.fields, StructField(BATCH, StringType())]
    if days is not None:
        folders = [f for day in days if store.exists(spark, f := day_folder(target, day))]
        kept.append(StructField(DAY, DateType()))
        return spark.read.schema(StructType(kept)).option("basePath", target).parquet(*folders).drop(DAY) if folders else None
    return spark.read.schema(StructType(kept)).parquet(target) if store.exists(spark, target) else None


def day_folder(target: str, day) -> str:
    return f"{target}/{DAY}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def stored_batches(target: str, keys: list[str], run, dedupe_batch: bool = True, time: str | None = None):
    """A function of a micro-batch and its number that appends the rows whose key no other batch of the target has. A batch writes
    its own folders, by the name that run() gives and its number, and overwrites them if it runs again.

    time names a key column: the target is then kept by its days, and a batch is compared with its own days only.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        own, spark = f"{run()}-{number}", batch.sparkSession
        if time is None:
            known = stored_rows(spark, target, batch.schema)
        else:
            batch = batch.persist()
            days = [r[0] for r in batch.select(F.to_date(time)).distinct().collect()]  # the days that a batch spans
            known = stored_rows(spark, target, batch.schema, days)
        if known is not None:
            known = known.where(F.col(BATCH) != own).select(*batch.columns)
        new = insert_new(known, batch, keys, dedupe_batch=dedupe_batch)
        if time is None:
            new.write.mode("overwrite").parquet(f"{target}/{BATCH}={own}")
            return
        for day in days:  # what an earlier run of this batch left
            store.delete(spark, f"{day_folder(target, day)}/{BATCH}={own}")
        placed = new.withColumns({DAY: F.to_date(time), BATCH: F.lit(own)})
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(target)
        batch.unpersist()

    return store_batch


def ingest(stream: DataFrame, target: str, keys: list[str], checkpoint: str, dedupe_batch: bool = True, time: str | None = None) -> StreamingQuery:
    """Insert-only append of each micro-batch. Folders are named by the query's id, which is that of its checkpoint: a replay adds
    nothing, and a new checkpoint, whose numbers begin anew, overwrites nothing. With time, one of the keys, the target is kept by
    day and what a batch reads of it doesn't grow with the target."""
    put = stored_batches(target, keys, lambda: stream.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"], dedupe_batch, time)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, time: str, lateness: str = "2 days") -> DataFrame:
    """Mean and count by site and hour. In append mode an hour is given once, when the watermark has passed its end; its state goes
    then, and readings that come later are dropped. In complete mode all hours are given, and kept, with each micro-batch."""
    means = [F.avg(c).alias(f"{c}_mean") for c in ("streamflow_cfs", "gage_height_ft")]
    grouped = stream.withWatermark(time, lateness).groupBy("site_id", F.window(time, "1 hour").alias("w")).agg(*means, F.count("*").alias("observation_count"))
    return grouped.select("site_id", F.col("w.start").cast("timestamp_ntz").alias("observation_hour"), *grouped.columns[2:])


def distinct_readings(stream: DataFrame, keys: list[str], time: str, lateness: str = "60 days") -> DataFrame:
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def enriched(stream: DataFrame, sites: DataFrame) -> DataFrame:
    return stream.join(sites.select("site_id", "latitude", "longitude"), "site_id")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now. Complete results replace the folder with each micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        return writer.format("parquet").option("path", target).start()
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()


def state_rows(running: StreamingQuery) -> list[int]:
    """Rows that the state kept after each micro-batch of this run, the last one included."""
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in running.recentProgress if p.stateOperators]
