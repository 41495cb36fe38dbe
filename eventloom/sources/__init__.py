"""Scans and sinks: explicit schemas, recursive parquet archives, CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet_archive(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every parquet file under ``root``, at any depth; names that start with a dot or an underscore are skipped.

    A missing root raises FileNotFoundError rather than an analysis error, so that callers can tell
    an absent archive from a bad query.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(root)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header under an explicit schema: ids stay strings, no inference pass."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def paired_topic_files(names: list[str]) -> list[tuple[str, str, str]]:
    """(slug, first venue's file, second venue's file) of every slug that has both, in order of the slug."""
    found = set(names)
    tail = "_pm_topics.csv"
    slugs = sorted(n[: -len(tail)] for n in names if n.endswith(tail))
    return [(s, s + tail, f"{s}_k_topics.csv") for s in slugs if f"{s}_k_topics.csv" in found]
