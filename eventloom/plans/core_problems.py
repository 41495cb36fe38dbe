"""Queries of the data-preparation problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.hexid import canonical_hex
from eventloom.operators.instants import PACIFIC, UTC, named_instants, with_instant
from eventloom.operators.orphans import orphan_references, orphan_report
from eventloom.operators.wide import melt, to_wide
from eventloom.sources import table

#: table, id column, field, zone of a text without one
INSTANT_FIELDS = [
    ("resolution_risk_event_timeseries", "row_id", "cutoff_local", PACIFIC),
    ("resolution_risk_event_timeseries", "row_id", "cutoff_utc", UTC),
    ("k_topics", "row_id", "created_time", PACIFIC),
    ("uma_event_timeline", "row_id", "block_timestamp", UTC),
]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(to_wide(table(spark, sf_dir, "k_attributes")))


def p2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_wide(table(spark, sf_dir, "k_attributes"))


def _instant_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four fields as one relation, so that they are read into instants in one pass."""
    out = None
    for t, i, f, z in INSTANT_FIELDS:
        one = table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.lit(f).alias("field_name"), F.col(f).alias("text"), F.lit(z).alias("zone"))
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_instants(_instant_texts(spark, sf_dir))


def p4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each field are readable, ambiguous, nonexistent, blank or unreadable."""
    texts = _instant_texts(spark, sf_dir).distinct()
    return with_instant(texts, F.col("text"), F.col("zone")).groupBy("table_name", "field_name", "instant_state").agg(F.count("*").alias("n_rows"))


def _link_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    links = table(spark, sf_dir, "pm_neg_risk_uma_request_link")
    fields = F.array(*[F.struct(F.lit(f).alias("space"), canonical_hex(F.col(f)).alias("key")) for f in ("condition_id", "request_id")])
    refs = links.select(F.col("link_id").alias("ref_id"), us("_fetched_at").alias("us"), F.explode(fields).alias("x")).select("x.space", "x.key", "ref_id", "us")
    pm = table(spark, sf_dir, "pm_markets").select(F.lit("condition_id").alias("space"), canonical_hex(F.col("condition_id")).alias("key"), us("_fetched_at").alias("us"), F.col("is_deleted").alias("deleted"))
    uma = (
        table(spark, sf_dir, "uma_event_timeline").where(F.lower(F.trim("event")) == "requestprice")
        .select(F.lit("request_id").alias("space"), canonical_hex(F.col("request_id")).alias("key"), us("_fetched_at").alias("us"), F.col("removed").alias("deleted"))
    )
    return orphan_references(refs, pm.unionByName(uma))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_orphans(spark, sf_dir).select(F.col("ref_id").alias("link_id"), F.col("space").alias("ref_field"), F.col("kind").alias("orphan_kind")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referenced table, month of the link's _fetched_at and kind."""
    month = F.date_format(F.timestamp_micros("us"), "yyyy-MM")
    owner = F.when(F.col("space") == "condition_id", "pm_markets").otherwise("uma_event_timeline")
    return orphan_report(_link_orphans(spark, sf_dir), owner, month)


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p4_found": p4_found, "p4_states": p4_states, "p5_found": p5_found, "p5_report": p5_report}
