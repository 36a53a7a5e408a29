"""Data tests and their report; each counts violations in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once, and how often."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys))).where("n_rows > 1")


def first_duplicates(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n of them by key."""
    return duplicate_rows(df, keys).orderBy(*keys).limit(n)


def null_counts(df: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """(model, column_name, failures) for each column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"'{model}' as model", f"stack({len(columns)}, {stack}) as (column_name, failures)")


def primary_key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, different keys, and whether the keys are one."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("is_key", F.col("n_rows") == F.col("n_keys"))


def report(tests: list[tuple[str, DataFrame, list[str], list[str]]]) -> DataFrame:
    """(model, column_name, test, failures, status) for (model, rows, unique columns, non-null columns)."""
    parts = []
    for model, rows, unique, not_null in tests:
        for column in unique:
            failures = duplicate_keys(rows, [column]).agg(F.count("*").alias("failures"))
            parts.append(failures.select(F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit("unique").alias("test"), "failures"))
        if not_null:
            parts.append(null_counts(rows, model, not_null).select("model", "column_name", F.lit("not_null").alias("test"), "failures"))
    status = F.when(F.col("failures") == 0, "pass").otherwise("fail")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n_tests"))
