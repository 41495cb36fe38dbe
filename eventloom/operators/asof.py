"""Cutoff calendars and as-of lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACIFIC = "America/Los_Angeles"
#: The two daily cutoffs, their labels and local hours.
TAGS = [("open_0500_PT", 5), ("close_1700_PT", 17)]


def cutoff_grid(spark: SparkSession, first: dt.date, last: dt.date, zone: str = PACIFIC) -> DataFrame:
    """(cutoff_label, local_date, cutoff_utc): each local day at 05:00 and 17:00 by the wall clock."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("local_date"))
    tags = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(h).alias("hour")) for t, h in TAGS]))
    g = days.select("local_date", tags.alias("t"))
    at = F.make_timestamp(F.year("local_date"), F.month("local_date"), F.dayofmonth("local_date"), F.col("t.hour"), F.lit(0), F.lit(0), F.lit(zone))
    return g.select(F.concat_ws("_", F.date_format("local_date", "yyyy_MM_dd"), F.col("t.tag")).alias("cutoff_label"), "local_date", at.alias("cutoff_utc"))


DAY_US = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str, payload: list[str], chunk: int = DAY_US) -> DataFrame:
    """Every left row with the latest right row of its key at or before its time, nulls where there is none.

    Times are whole numbers (microseconds, for the default chunk). Among equal times the greatest
    tie-breaker wins; a right row with null payload still wins over an older one. Right rows without key or
    time can never be latest; a left row without key or time finds nothing.

    A key's time is cut into chunks, so that a hot key is spread over as many windows as it has chunks. The
    latest right row of each chunk, found by a map-side combine, is carried into the key's next chunks
    that ask; these carried rows are one per key and chunk.
    """
    cols = [c for c in left.columns if c not in (key, left_time)]
    at = lambda c: F.floor(F.col(c) / chunk).cast("long")
    rank = F.struct(F.length(F.col(tie).cast("string")), F.col(tie).cast("string"))
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key), at(right_time).alias("__chunk"), F.col(right_time).alias("__t"), rank.alias("__tie"), F.struct(F.col(right_time).alias("__rt"), *payload).alias("__r"))
    l = left.select(F.col(key), at(left_time).alias("__chunk"), F.col(left_time).alias("__t"), *cols)
    kind = r.schema["__r"].dataType
    null_r = F.lit(None).cast(kind).alias("__r")
    latest = r.groupBy(key, "__chunk").agg(F.max_by("__r", F.struct("__t", "__tie")).alias("__r"))
    asked = l.select(key, "__chunk").distinct().select(key, "__chunk", null_r)
    before = Window.partitionBy(key).orderBy("__chunk").rangeBetween(Window.unboundedPreceding, -1)
    carried = latest.select(key, "__chunk", "__r", F.lit(False).alias("__asks")).unionByName(asked.withColumn("__asks", F.lit(True))).withColumn("__r", F.last("__r", ignorenulls=True).over(before)).where("__asks AND __r IS NOT NULL")
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols]
    no_tie = F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie")
    side = lambda df, n, t, tie_, r_, more: df.select(key, "__chunk", t.alias("__t"), F.lit(n).alias("__side"), tie_, r_, *more)
    rows = side(r, 1, F.col("__t"), F.col("__tie"), F.col("__r"), none).unionByName(side(carried, 0, F.col("__chunk") * chunk, no_tie, F.col("__r"), none)).unionByName(side(l, 2, F.col("__t"), no_tie, null_r, cols))
    # a carried row stands before all others of its chunk
    w = Window.partitionBy(key, "__chunk").orderBy((F.col("__side") != 0).cast("int"), "__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 2")
    return got.select(F.col(key), F.col("__t").alias(left_time), *cols, F.col("__r.__rt").alias(f"source_{right_time}"), *[F.col(f"__r.{p}").alias(p) for p in payload])


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w x over sum of w, where both are there and w is positive; null if nowhere."""
    ok = x.isNotNull() & w.isNotNull() & (w > 0)
    return F.sum(F.when(ok, w * x)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))
