"""Versioned dataset snapshots: manifest, schema changes, aliases, retention.

A version is a folder with its data and its manifest. The manifest is moved into place last and in one step, so a version without one
isn't there: a run that ends early leaves nothing that readers see, and the next run may use the same name. Aliases are small files
that name a version and are replaced in one step; readers look an alias up once and then read the version's own folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

from basinflow import store
from basinflow.functions.scalars import schema_fingerprint
from basinflow.operators.incremental import merge_policy
from basinflow.sources.tables import read_snapshot, write_snapshot

LATEST = "latest"
#: Beside the versions in their root.
ALIASES = "_aliases"


def dataset_stats(df: DataFrame, site: str, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(site).alias("n_sites"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def manifest(df: DataFrame, site: str, time: str, source: str, version: str, size_bytes: int | None = None, n_files: int | None = None) -> DataFrame:
    """One row that describes a snapshot."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = F.to_json(F.create_map(*[F.lit(x) for name in sorted(fields) for x in (name, fields[name])]))
    size = F.lit(size_bytes).cast("long")
    return dataset_stats(df, site, time).select(
        F.lit(version).alias("version"), F.lit(source).alias("source"), F.lit(schema_fingerprint(df.schema)).alias("fingerprint"), schema.alias("schema"), "*",
        F.lit(n_files).cast("long").alias("n_files"), size.alias("size_bytes"), F.round(size.cast("double") / (1 << 20), 2).alias("size_mb"),
    )


def schema_changed(df: DataFrame, previous: Row | None) -> bool:
    """Whether the previous manifest has another fingerprint; no manifest is no change."""
    return previous is not None and previous["fingerprint"] != schema_fingerprint(df.schema)


def normalized(df: DataFrame, time: str) -> DataFrame:
    """The time as UTC wall-clock time without a zone. Instants and texts with an offset or zone are converted, whatever the
    session's zone; times without a zone are UTC already."""
    kind = df.schema[time].dataType
    if not isinstance(kind, (StringType, TimestampType)):
        return df
    instant = F.col(time).cast("timestamp")
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn(time, epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def set_alias(spark: SparkSession, root: str, alias: str, version: str) -> None:
    store.put_text(spark, f"{root}/{ALIASES}/{alias}", version)


def aliased(spark: SparkSession, root: str, alias: str = LATEST) -> str | None:
    """The version that an alias names, None if there is no such alias."""
    return store.get_text(spark, f"{root}/{ALIASES}/{alias}")


def _published(spark: SparkSession, root: str, version: str) -> bool:
    return store.exists(spark, f"{root}/{version}/manifest")


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The rows of a version."""
    if not _published(spark, root, version):
        raise ValueError(f"no version {version} in {root}")
    return read_snapshot(spark, f"{root}/{version}/data")


def read_manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    return read_snapshot(spark, f"{root}/{version}/manifest")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, aliases) of all published versions, as many rows as the root has folders."""
    naming: dict[str, list[str]] = {}
    for alias in store.names(spark, f"{root}/{ALIASES}"):
        if not alias.startswith("."):
            naming.setdefault(aliased(spark, root, alias), []).append(alias)
    found = [(v, naming.get(v, [])) for v in store.names(spark, root) if v != ALIASES and _published(spark, root, v)]
    return spark.createDataFrame(found, "version string, aliases array<string>")


def versions_to_drop(versions: DataFrame) -> DataFrame:
    """Versions without an alias."""
    return versions.where(F.coalesce(F.size("aliases"), F.lit(0)) <= 0).select("version")


def retire(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions without an alias, and say which. Each loses its manifest first: what is half gone is not there. Folders
    without a manifest stay, as a run may be filling them."""
    gone = sorted(r.version for r in versions_to_drop(versions(spark, root)).collect())
    for version in gone:
        store.delete(spark, f"{root}/{version}/manifest")
        store.delete(spark, f"{root}/{version}")
    return gone


def publish(
    spark: SparkSession, local: DataFrame, root: str, version: str, keys: list[str], site: str, time: str,
    previous: str | None = None, full_refresh: bool = False, alias: str = LATEST, source: str | None = None,
) -> DataFrame:
    """Merge with the previous version (the aliased one if none is named) by policy, both in UTC, write the new version, describe what
    was written, and let the alias name it; returns the manifest."""
    if _published(spark, root, version):
        raise ValueError(f"{root} has a version {version}")
    local = normalized(local, time)
    previous = previous or aliased(spark, root, alias)
    existing = before = None
    if previous:
        existing = normalized(read_version(spark, root, previous), time)
        before = read_manifest(spark, root, previous).first()
    merged = merge_policy(local, existing, keys, full_refresh, schema_changed(local, before))
    data = f"{root}/{version}/data"
    store.delete(spark, data)  # left by a run that ended early
    write_snapshot(merged, data)
    stored = read_snapshot(spark, data)
    size = store.files(spark, data).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b")).first()
    draft = f"{root}/{version}/_manifest-{uuid.uuid4().hex}"
    write_snapshot(manifest(stored, site, time, source or root, version, size["b"] or 0, size["n"]), draft)
    store.move(spark, draft, f"{root}/{version}/manifest")
    set_alias(spark, root, alias, version)
    return read_manifest(spark, root, version)
