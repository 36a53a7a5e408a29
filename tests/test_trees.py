"""Forests whose trees stay in tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basinflow.operators import ml, trees


@pytest.fixture(scope="module")
def noisy(spark):
    """Rows of hardly related features: deep trees have about as many leaves as rows."""
    hour = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("observation_hour")
    known = [(F.xxhash64(F.lit(i), "id") % 97 / 4.0).alias(c) for i, c in enumerate(ml.FEATURES)]
    rows = spark.range(1500).select(F.concat(F.lit("s"), F.col("id") % 7).alias("site_id"), hour, *known)
    return rows.withColumn(ml.TARGET, F.col("precipitation_mm") * F.col("temperature_c") + F.xxhash64("observation_hour") % 50).localCheckpoint()


def plain(cells, n, total, depth, least):
    """(depth, cells, value) of each leaf by trying every split of 2 features with 4 bits each."""
    count, amount, best = sum(n), sum(total), (0.0,)
    if depth:
        for f in range(2):
            for cut in range(16):
                left = [c >> 4 * f & 15 for c in cells]
                ln, ls = sum(k for k, b in zip(n, left) if b <= cut), sum(t for t, b in zip(total, left) if b <= cut)
                if ln >= least and count - ln >= least:
                    gain = (ls / ln - (amount - ls) / (count - ln)) ** 2 * ln * (count - ln) / count
                    if gain > best[0] * (1 + 1e-12) and gain > 1e-9:
                        best = (gain, f, cut)
    if len(best) == 1:
        return {c: amount / count for c in cells}
    parts = [[i for i, c in enumerate(cells) if (c >> 4 * best[1] & 15 <= best[2]) == side] for side in (True, False)]
    return {c: v for own in parts for c, v in plain([cells[i] for i in own], [n[i] for i in own], [total[i] for i in own], depth - 1, least).items()}


@pytest.mark.parametrize("depth, least", [(0, 1), (2, 1), (4, 3), (30, 1), (30, 5)])
def test_tree_equals_trying_every_split(depth, least):
    rng = np.random.default_rng(depth + least)
    cells = np.sort(rng.choice(256, 60, replace=False))
    n, shape = rng.integers(1, 5, 60), {"bits": 4, "cuts": [0, 0], "whole": 40}
    total = rng.integers(-(2**30), 2**30, 60) * n
    tree = trees.grow(pd.DataFrame({"cell": cells, "n": n, "total": total}), shape, depth, least)
    found = trees.walk(tree, cells, shape, [depth])[0] / 2.0 ** (trees.VALUE_BITS - 40)
    wanted = plain(cells.tolist(), n.tolist(), total.tolist(), depth, least)
    assert np.allclose(found, [wanted[c] for c in cells.tolist()], rtol=1e-9, atol=1e-3)


def test_draws_are_of_mean_one_and_variance_one():
    keys = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    drawn = np.array([trees.poisson(keys, t) for t in range(3)])
    assert np.allclose(drawn.mean(1), 1, atol=0.01) and np.allclose(drawn.var(1), 1, atol=0.02)
    assert np.abs(np.corrcoef(drawn) - np.eye(3)).max() < 0.01


def test_equal_rows_are_drawn_apart(spark):
    rows = spark.range(4000).select(F.lit(1.0).alias("x"), F.lit(5.0).alias("y"))
    shape = trees.measure(rows, ["x"], "y", 32)
    n = [r.n for r in trees.draws(rows, shape, 20, 7).groupBy("tree").agg(F.sum("n").alias("n")).collect()]
    assert len(n) == 20 and all(abs(k - 4000) < 400 for k in n) and len(set(n)) > 10


def test_forest_does_not_depend_on_partitions_and_one_row_is_enough(spark, noisy):
    made = []
    for k in (1, 7):
        model = ml.forest(5, 30).fit(noisy.repartition(k))
        made.append(sorted((r.observation_hour, r.prediction) for r in model.transform(noisy).collect()))
    assert made[0] == made[1] and len(made[0]) == 1500
    one = ml.forest(6, 30).fit(noisy.limit(1)).transform(noisy).select("prediction").distinct().collect()
    assert [r.prediction for r in one] == [noisy.limit(1).first()[ml.TARGET]]


def test_deep_forest_fits_what_it_draws(spark, noisy):
    model = ml.forest(20, 30).fit(noisy)
    assert ml.regression_metrics(model.transform(noisy), ml.TARGET, "prediction").first().r2 > 0.9
    nodes = spark.read.parquet(model.stages[-1].path).groupBy("tree").count().collect()
    assert len(nodes) == 20 and all(r["count"] > 1000 for r in nodes)


def test_search_equals_fits_one_by_one_and_takes_few_jobs(spark, noisy):
    group = "search of the whole grid"
    spark.sparkContext.setJobGroup(group, group)
    found = {(r.trees, r.depth, r.min_rows): r.r2 for r in ml.param_search(noisy).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 27 and jobs < 60
    for t, d, m in ((50, 20, 1), (100, 5, 5)):
        fitted = ml.forest(t, d, m).fit(noisy.where(~ml.in_test())).transform(noisy.where(ml.in_test()))
        assert abs(ml.regression_metrics(fitted, ml.TARGET, "prediction").first().r2 - found[t, d, m]) < 1e-9


def test_jobs_of_a_fit_do_not_grow_with_its_depth(spark, noisy):
    counts = []
    for depth in (2, 14):
        group = f"fit of depth {depth}"
        spark.sparkContext.setJobGroup(group, group)
        ml.forest(4, depth).fit(noisy)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 25


def test_trees_are_dealt_evenly_to_tasks(spark, noisy):
    tasks = 2 * spark.sparkContext.defaultParallelism
    model = ml.forest(2 * tasks, 3).fit(noisy)
    grown = spark.read.parquet(model.stages[-1].path).select("tree", F.input_file_name().alias("file")).distinct()
    assert [r["count"] for r in grown.groupBy("file").count().collect()] == [2] * tasks
