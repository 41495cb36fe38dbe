"""Small helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions are evaluated exactly once per row.

    Plain projections are merged into whatever uses them, which repeats a costly expression at every
    use; a one-element generator keeps it in one place.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("__once")).select(*df.columns, *[F.col(f"__once.{n}").alias(n) for n in columns])
