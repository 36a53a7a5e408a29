"""Versions, aliases, retention and merges by day, with runs that end early and readers in between."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basinflow import store
from basinflow.operators import incremental, publish

KEYS = ["site_id", "t"]


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("a", at(1), 1.0), ("b", at(2), 2.0)], "site_id string, t timestamp_ntz, v double")


def run(spark, local, root, version, **more):
    return publish.publish(spark, local, root, version, KEYS, "site_id", "t", **more)


def files_of(folder) -> dict[str, float]:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_manifest_has_the_size_of_the_folder(spark, rows, tmp_path):
    made = run(spark, rows.repartition(3), str(tmp_path), "v1").first()
    sizes = [os.path.getsize(f) for f in files_of(tmp_path / "v1/data")]
    assert (made.n_files, made.size_bytes) == (len(sizes), sum(sizes)) and made.size_mb == round(sum(sizes) / (1 << 20), 2)
    empty = run(spark, rows.limit(0), str(tmp_path), "v2", full_refresh=True).first()
    assert empty.n_rows == 0 and empty.first_time is None and empty.size_bytes == sum(map(os.path.getsize, files_of(tmp_path / "v2/data")))


def test_times_become_utc_whatever_the_session_zone(spark, rows, tmp_path):
    denver = spark.createDataFrame([("a", "2023-12-31 17:00:00 America/Denver", 9.0), ("c", "2024-06-01T00:00:00+02:00", 3.0), ("d", None, 4.0)], "site_id string, t string, v double")
    run(spark, rows, str(tmp_path), "v1")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for version, session in (("v2", "UTC"), ("v3", "America/Denver")):
            spark.conf.set("spark.sql.session.timeZone", session)
            run(spark, denver, str(tmp_path), version, previous="v1")
            instants = denver.withColumn("t", F.col("t").cast("timestamp"))
            assert publish.normalized(instants, "t").collect() == publish.normalized(denver, "t").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    expected = {("a", at(1), 9.0), ("b", at(2), 2.0), ("c", datetime(2024, 5, 31, 22), 3.0), ("d", None, 4.0)}
    for version in ("v2", "v3"):
        assert set(map(tuple, publish.read_version(spark, str(tmp_path), version).collect())) == expected
    assert publish.normalized(rows, "t") is rows


def test_what_ends_early_is_no_version(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path)
    run(spark, rows, root, "v1")
    with monkeypatch.context() as broken:
        broken.setattr(publish, "manifest", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(spark, rows.withColumn("v", F.lit(7.0)), root, "v2")
    assert os.path.isdir(tmp_path / "v2/data")
    assert [r.version for r in publish.versions(spark, root).collect()] == ["v1"] and publish.aliased(spark, root) == "v1"
    with pytest.raises(ValueError):
        publish.read_version(spark, root, "v2")
    assert publish.retire(spark, root) == []
    run(spark, rows.limit(1), root, "v2", full_refresh=True)
    assert publish.read_version(spark, root, "v2").count() == 1 and publish.aliased(spark, root) == "v2"
    with pytest.raises(ValueError):
        run(spark, rows, root, "v2")


def test_readers_of_kept_versions_go_on_while_others_are_deleted(spark, rows, tmp_path):
    root = str(tmp_path)
    for k in range(1, 4):
        run(spark, rows.withColumn("v", F.lit(float(k))), root, f"v{k}")
    publish.set_alias(spark, root, "best", "v1")
    reading = {v: publish.read_version(spark, root, v) for v in ("v1", "v3")}  # files are listed now, read later
    assert {r.version: r.aliases for r in publish.versions(spark, root).collect()} == {"v1": ["best"], "v2": [], "v3": ["latest"]}
    assert publish.retire(spark, root) == ["v2"] and not os.path.exists(tmp_path / "v2")
    assert {v: df.agg(F.max("v")).first()[0] for v, df in reading.items()} == {"v1": 1.0, "v3": 3.0}
    publish.set_alias(spark, root, "best", "v3")
    assert publish.retire(spark, root) == ["v1"]
    assert [tuple(r) for r in publish.versions(spark, root).collect()] == [("v3", ["best", "latest"])]


def test_merge_by_default_is_with_the_latest(spark, rows, tmp_path):
    root = str(tmp_path)
    assert publish.aliased(spark, root) is None
    run(spark, rows, root, "v1")
    made = run(spark, spark.createDataFrame([("a", at(1), 5.0), ("c", at(3), 6.0)], rows.schema), root, "v2").first()
    assert made.n_rows == 3 and {r.site_id: r.v for r in publish.read_version(spark, root, "v2").collect()} == {"a": 5.0, "b": 2.0, "c": 6.0}


def test_small_texts(spark, tmp_path):
    path = f"{tmp_path}/deep/er/name"
    assert store.get_text(spark, path) is None and store.names(spark, f"{tmp_path}/deep") == []
    for text in ("one", "two"):
        store.put_text(spark, path, text)
        assert store.get_text(spark, path) == text
    store.delete(spark, path)
    assert not store.exists(spark, path)


def test_merge_by_day_leaves_other_days_alone(spark, tmp_path):
    schema, target = "k int, t timestamp_ntz, v double", str(tmp_path / "by-day")
    first = spark.createDataFrame([(1, at(1, 5), 1.0), (2, at(2, 5), 2.0), (3, at(2, 6), 3.0), (4, None, 4.0)], schema)
    incremental.merge_days(spark, first, target, ["k", "t"], "t")
    before = files_of(target)
    incremental.merge_days(spark, spark.createDataFrame([(3, at(2, 6), 30.0), (5, at(9), 5.0)], schema), target, ["k", "t"], "t")
    after = files_of(target)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("day=")[1].split("/")[0] for f in same} == {"2024-01-01", "__HIVE_DEFAULT_PARTITION__"}
    found = {(r.k, r.v) for r in spark.read.parquet(target).collect()}
    assert found == {(1, 1.0), (2, 2.0), (3, 30.0), (4, 4.0), (5, 5.0)}
    incremental.merge_days(spark, first.limit(0), target, ["k", "t"], "t")
    assert files_of(target) == after
    incremental.merge_days(spark, spark.createDataFrame([(4, None, 40.0)], schema), target, ["k", "t"], "t")
    assert {r.v for r in spark.read.parquet(target).where("k = 4").collect()} == {4.0, 40.0}  # null keys never match
