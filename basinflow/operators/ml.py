"""The learning path: frame, split, forest, scores, choice of a model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinflow.functions.scalars import hashed_share
from basinflow.operators import trees as forests

TARGET = "streamflow_cfs_mean"
FEATURES = ("precipitation_mm", "temperature_c", "humidity_pct", "wind_speed_ms")
TEST_PERCENT, SEED = 20, 42
#: The deepest trees that Spark fits.
DEEPEST = 30


def training_frame(hourly: DataFrame) -> DataFrame:
    """Key, target and features where target and precipitation are known."""
    return hourly.where(F.col(TARGET).isNotNull() & F.col("precipitation_mm").isNotNull()).select("site_id", "observation_hour", TARGET, *FEATURES)


def in_test() -> Column:
    return hashed_share(F.col("site_id"), F.date_format("observation_hour", "yyyy-MM-dd HH:mm:ss")) < TEST_PERCENT


def forest(trees: int = 100, depth: int = DEEPEST, min_rows: int = 1) -> Pipeline:
    """Missing features are imputed by their means. A node of min_rows in each child has twice as many rows: no least size for a
    split itself is set, as in Spark's own trees. Every split looks at all features. Spark's own forest sends its nodes through the
    driver and keeps counts of all bins for each node, of which trees of this depth have about as many as rows."""
    filled = [f"{c}_filled" for c in FEATURES]
    return Pipeline(stages=[Imputer(inputCols=list(FEATURES), outputCols=filled), forests.Forest(filled, TARGET, trees, depth, min_rows, SEED)])


def predictions(frame: DataFrame, trees: int = 100, depth: int = DEEPEST) -> DataFrame:
    """The test part with its predictions by a forest fitted on the rest."""
    model = forest(trees, depth).fit(frame.where(~in_test()))
    return model.transform(frame.where(in_test())).select("site_id", "observation_hour", TARGET, "prediction")


def regression_metrics(scored: DataFrame, truth: str, prediction: str) -> DataFrame:
    """n, mae, rmse, r2 in one pass; r2 is null where the truth doesn't vary."""
    y, p = F.col(truth), F.col(prediction)
    sums = scored.where(y.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("spread"))
    return sums.select("n", "mae", "rmse", (1 - F.try_divide("sse", F.col("n") * F.col("spread"))).alias("r2"))


def param_search(frame: DataFrame, trees=(50, 100, 200), depths=(5, 10, 20), rows=(1, 3, 5)) -> DataFrame:
    """r2 on the test part of each setting of a grid, fitted on the rest; null where the truth doesn't vary. Rows 1, 3 and 5 in a leaf
    stand for splits of 2, 5 and 10 rows at least."""
    imputer, last = forest().getStages()
    filled = imputer.fit(frame.where(~in_test()))
    train, held = (filled.transform(frame.where(part)) for part in (~in_test(), in_test()))
    shape = forests.measure(train, last.getInputCols(), TARGET, last.getMaxBins())
    made = forests.searched(train, held, shape, trees, depths, rows, SEED)
    y = F.col(TARGET)
    r2 = [F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth"), F.lit(m).alias("min_rows"), (1 - F.try_divide(F.sum((y - F.col(f"p_{t}_{d}_{m}")) ** 2), F.count("*") * F.var_pop(y))).alias("r2")) for t in trees for d in depths for m in rows]
    return made.agg(F.array(*r2).alias("found")).select(F.inline("found"))


def promotion_decision(runs: DataFrame, now: Column, days: int = 7, least_gain: float = 0.05) -> DataFrame:
    """The best finished run with a model of the last days, the production run, and whether to promote: if it is better by a share,
    or there is none in production. The lowest error wins; ties go to the newest, then the largest run_id."""
    recent = runs.where((F.col("state") == "finished") & F.col("has_model") & F.col("test_mae").isNotNull() & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days))))
    order = F.struct(F.col("test_mae"), -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("run_id"))
    best = recent.agg(F.min_by("run_id", order).alias("best_run"), F.min("test_mae").alias("best_mae"))
    live = runs.where("is_production").agg(F.max("run_id").alias("production_run"), F.max("test_mae").alias("production_mae"))
    gain = F.try_divide(F.col("production_mae") - F.col("best_mae"), F.col("production_mae"))
    return best.join(live).withColumn("promote", F.col("best_run").isNotNull() & (F.col("production_mae").isNull() | F.coalesce(gain >= least_gain, F.lit(False))))


def score(model, rows: DataFrame, version: str, at: Column) -> DataFrame:
    """Prediction rows for what has precipitation."""
    scored = model.transform(rows.where(F.col("precipitation_mm").isNotNull()))
    return scored.select("site_id", F.col("observation_hour").alias("timestamp"), "prediction", F.lit(version).alias("model_version"), at.alias("predicted_at"))


def save_model(model: PipelineModel, root: str, version: str) -> None:
    """A fitted pipeline under its version, which must be a new one."""
    model.write().save(f"{root}/{version}")


def load_model(root: str, version: str) -> PipelineModel:
    """A stored pipeline; the session that loads it need not be the one that fitted it."""
    return PipelineModel.load(f"{root}/{version}")


def score_batch(root: str, version: str, rows: DataFrame, at: Column, target: str) -> None:
    """Predictions of a stored model, appended to a table that is kept by model version and time of prediction. A run at the same
    time with the same version replaces what it wrote before, so that it can be repeated."""
    made = score(load_model(root, version), rows, version, at).withColumn("predicted_at", F.date_format("predicted_at", "yyyy-MM-dd HH-mm-ss"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version", "predicted_at").parquet(target)


def read_predictions(spark: SparkSession, target: str) -> DataFrame:
    """All stored predictions; those of one version or time are found by their folders."""
    kept = "site_id string, timestamp timestamp_ntz, prediction double, model_version string, predicted_at string"
    return spark.read.schema(kept).parquet(target).withColumn("predicted_at", F.to_timestamp_ntz("predicted_at", F.lit("yyyy-MM-dd HH-mm-ss")))


def prediction_summary(made: DataFrame, since: Column) -> DataFrame:
    """Totals of predictions since a time, the latest, and the newest model version."""
    recent = made.where(F.col("predicted_at") >= since)
    order = F.struct("predicted_at", "model_version")
    return recent.agg(F.count("*").alias("n_predictions"), F.countDistinct("site_id").alias("n_sites"), F.max("predicted_at").alias("latest"), F.max_by("model_version", order).alias("model_version"))


def recent_predictions(made: DataFrame, n: int) -> DataFrame:
    """The newest n predictions of each site; of equal times the later version, then the larger prediction, comes first."""
    newest = Window.partitionBy("site_id").orderBy(F.col("predicted_at").desc(), F.col("model_version").desc(), F.col("prediction").desc())
    return made.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n).drop("k")
