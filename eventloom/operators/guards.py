"""Checks that end a job with a message instead of writing a wrong result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 10


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key comes more than once, none of them left out."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows themselves; raises ValueError with up to ten keys that come more than once. Counts keys, gathers only the samples."""
    bad = df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(SAMPLES).collect()
    if bad:
        raise ValueError(f"{name}: duplicate {keys}: " + "; ".join(str(tuple(r[:-1])) for r in bad))
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The rows themselves; raises ValueError with the message where there is none."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_output(df: DataFrame, keys: list[str], not_null: list[str], holds: Column | None = None) -> DataFrame:
    """The rows themselves if there are any, none lacks a value of not_null, all satisfy holds and keys are unique; else ValueError naming what failed."""
    bad = F.lit(False) if holds is None else ~F.coalesce(holds, F.lit(False))
    r = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in not_null], F.count(F.when(bad, 1)).alias("bad")).first()
    failed = ([] if r.n else ["no rows"]) + [f"{r[f'null_{c}']} rows without {c}" for c in not_null if r[f"null_{c}"]] + ([f"{r.bad} rows that break the rule"] if r.bad else [])
    if failed:
        raise ValueError("; ".join(failed))
    return require_unique(df, keys, "output")
