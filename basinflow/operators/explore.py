"""Exploration statistics, each in one aggregate pass."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.functions.scalars import bar, has_prefix, percent


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for all pairs, over rows that have both; null where a column doesn't vary."""
    sums, pairs = [], list(combinations_with_replacement(columns, 2))
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        sums += [F.count(x).cast("double").alias(f"n{k}")]
        sums += [F.sum(v).alias(f"{n}{k}") for n, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))]
    moments = df.agg(*sums)

    def r(k: int) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"{m}{k}") for m in ("n", "x", "y", "xx", "yy", "xy"))
        spread = (n * xx - x * x) * (n * yy - y * y)
        return F.when(spread > 0, F.try_divide(n * xy - x * y, F.sqrt(F.greatest(spread, F.lit(0.0)))))

    rows = []
    for k, (a, b) in enumerate(pairs):
        rows += [F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), r(k).alias("r")) for p, q in dict.fromkeys(((a, b), (b, a)))]
    return moments.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def site_distribution(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """Box statistics by site: interpolated quartiles, fences at 1.5 times their distance, and the extremes. Quartiles hold all
    different values of a site in its task; with an accuracy they are approximate, of bounded size, and values of the data."""
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = F.percentile_approx(value, shares, accuracy) if accuracy else F.percentile(value, shares)
    q = df.where(F.col(value).isNotNull()).groupBy("site_id").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), quartiles.alias("q"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    reach = 1.5 * (q3 - q1)
    return q.select("site_id", "n", "low", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "high", (q1 - reach).alias("lower_fence"), (q3 + reach).alias("upper_fence"))


#: Items of a sketch's largest level: a rank error of about 0.7 % for one quantile, 8 kB a sketch at most.
SKETCH_ITEMS = 400


def quantile_sketches(df: DataFrame, value: str, time: str, keys: tuple[str, ...] = ("site_id",), items: int = SKETCH_ITEMS) -> DataFrame:
    """A mergeable quantile sketch (KLL) of the values of each key and day, of bounded size however many there are. Stored, they
    serve any span of days, and a new day adds rows without reading old ones."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(F.col(value).cast("double"), items).alias("sketch"))


def merged_distribution(sketches: DataFrame, keys: tuple[str, ...] = ("site_id",), items: int = SKETCH_ITEMS) -> DataFrame:
    """Box statistics of each key (of all, without one) from its days' sketches. Count and extremes are exact, quartiles are values
    of the data whose rank is close."""
    whole = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", items).alias("sketch"))
    q1, q2, q3 = (F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for share in (0.25, 0.5, 0.75))
    return whole.select(*keys, "n", "low", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "high")


def map_frames(df: DataFrame, value: str, time: str, path: str | None = None) -> DataFrame:
    """A point for each site and time with its value, and the colour range over all points. With a path, points are stored there
    first, so that what makes them runs once."""
    points = df.where(F.col(value) > 0).select("site_id", "latitude", "longitude", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("frame"), F.col(value).alias("value"))
    if path:
        points.write.parquet(path)
        points = df.sparkSession.read.schema(points.schema).parquet(path)
    return points.join(points.agg(F.min("value").alias("range_low"), F.max("value").alias("range_high")))


def profile_columns(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Count, nulls, mean, standard deviation, extremes and interpolated quartiles of each column; approximate ones with an accuracy."""
    quantile = (lambda x, q: F.percentile_approx(x, q, accuracy)) if accuracy else (lambda x, q: F.percentile(x, F.lit(q)))
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), quantile(x, 0.25).alias("q1"), quantile(x, 0.5).alias("median"), quantile(x, 0.75).alias("q3"), F.max(x).alias("high")).alias(f"s_{c}"))
    return df.agg(*parts).select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("s.*")


def _classes(series: DataFrame, prefix: str) -> DataFrame:
    """Series of the region that name a site, with two classes that may overlap."""
    known = series.where(has_prefix(F.col("hydrologic_unit_code"), prefix) & (F.coalesce("monitoring_location_id", F.lit("")) != ""))
    iv = (F.col("computation_identifier") == "Instantaneous") | (F.col("computation_period_identifier") == "Points")
    return known.select("state_name", "monitoring_location_id", F.coalesce(iv, F.lit(False)).alias("is_iv"), F.coalesce(F.col("computation_period_identifier") == "Daily", F.lit(False)).alias("is_daily"))


def _site_counts() -> list[Column]:
    site = F.col("monitoring_location_id")
    return [F.countDistinct(site).alias("discharge"), F.countDistinct(F.when(F.col("is_iv"), site)).alias("iv"), F.countDistinct(F.when(F.col("is_daily"), site)).alias("daily")]


def coverage_by_state(locations: DataFrame, series: DataFrame, prefix: str) -> DataFrame:
    """Stream sites of each state, those of the region, and its sites with discharge, 15-minute and daily series."""
    inside = F.count_if(has_prefix(F.col("hydrologic_unit_code"), prefix)).alias("in_region")
    sites = locations.groupBy("state_name").agg(F.count("*").alias("total"), inside)
    found = _classes(series, prefix).groupBy("state_name").agg(*_site_counts())
    return sites.join(found, "state_name", "left").na.fill(0, ["discharge", "iv", "daily"])


def coverage_totals(locations: DataFrame, series: DataFrame, prefix: str) -> DataFrame:
    """Totals of the region; sites are counted anew, since one may stand in two states."""
    total = locations.where(has_prefix(F.col("hydrologic_unit_code"), prefix)).agg(F.count("*").alias("all_sites"))
    return total.join(_classes(series, prefix).agg(*_site_counts()))


def coverage_summary(totals: DataFrame) -> DataFrame:
    """The funnel in four rows, with shares of all sites and of sites with discharge."""
    rows = totals.selectExpr("*", "stack(4, 1, 'all_sites', all_sites, 2, 'discharge', discharge, 3, 'iv', iv, 4, 'daily', daily) as (step, category, n_sites)")
    of_discharge = F.when(F.col("step") > 1, percent(F.col("n_sites"), F.col("discharge")))
    return rows.select("step", "category", "n_sites", percent(F.col("n_sites"), F.col("all_sites")).alias("pct_of_total"), of_discharge.alias("pct_of_discharge"))


def coverage_bars(totals: DataFrame) -> DataFrame:
    rows = totals.selectExpr("*", "stack(3, 'all_sites', all_sites, 'discharge', discharge, 'iv', iv) as (category, n_sites)")
    return rows.select("category", bar(F.col("n_sites"), F.col("all_sites")).alias("bar"), F.format_number("n_sites", 0).alias("n_text"))
