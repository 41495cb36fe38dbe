"""Texts that name an instant, in any notation and zone, to microseconds since 1970-01-01 UTC.

A text is rewritten to its civil parts and a zone. A zone given as an offset answers directly. A named
zone goes through the as-of join: zone-offset intervals, exploded by civil years, are looked up with the
civil time; two matching intervals make it ambiguous, none nonexistent, one gives the offset.
"""

from __future__ import annotations

import datetime as dt
import os
import struct
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.plan import computed_once
from eventloom.operators.wide import OUTER, month_number

#: Years whose intervals are in the table. Earlier years have each zone's first offset; the rules that hold
#: from STEADY_YEAR on repeat, so a later year is read as the one of the last 28 that begins on the same
#: weekday and has as many days.
FIRST_YEAR, STEADY_YEAR, LAST_YEAR = 1840, 2038, 2065
BLOCK = 8
PACIFIC, UTC = "America/Los_Angeles", "UTC"
#: Abbreviations with a fixed offset in minutes, and those that mean a zone's civil time.
FIXED = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240,
    "AKST": -540, "AKDT": -480, "HST": -600, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "BST": 60, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
}
CIVIL = {"PT": "America/Los_Angeles", "MT": "America/Denver", "CT": "America/Chicago", "ET": "America/New_York"}

_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
_MON = r"([a-z]{3,9})"
_CLOCK = r"(\d{1,2})(?::(\d{2}))?(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*([ap])\.?m\b\.?)?"
_ZONE = r"\s*((?:z|utc|gmt|ut)?[+-]\d{1,2}(?::?\d{2})?(?:\s*\[[a-z_/+-]+\])?|\[?[a-z]+(?:[_/+-][a-z0-9_]+)*\]?|\([a-z]+\))?"
#: pattern -> how its groups make year|month|day|hour|minute|second|fraction|half|zone
NOTATIONS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t\s,]+{_CLOCK}{_HALF}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:\.(\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:[,\s]+{_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:{_DAY},?\s+)?{_MON}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:[,\s]+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:{_DAY},?\s+)?(\d{{1,2}})[\s-]+{_MON}\.?,?[\s-]+(\d{{4}})(?:[,\s]+{_CLOCK}{_HALF}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}\s+{_MON}\s+(\d{{1,2}})\s+(\d{{2}}):(\d{{2}}):(\d{{2}})(?:\.(\d+))?\s+([a-z]+|[+-]\d{{4}})\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
]


def _listed_changes(name: str) -> list[int]:
    """UTC seconds at which a zone's compiled file (RFC 8536) lists a change."""
    for root in TZPATH:
        if os.path.isfile(os.path.join(root, name)):
            with open(os.path.join(root, name), "rb") as f:
                raw = f.read()
            break
    else:
        raw = resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    head = struct.Struct(">4sc15x6l")
    _, version, isut, isstd, leaps, times, types, chars = head.unpack_from(raw)
    width, at = 4, head.size
    if version >= b"2":
        at += times * 5 + types * 6 + chars + leaps * 8 + isstd + isut
        times, width, at = head.unpack_from(raw, at)[5], 8, at + head.size
    return list(struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", raw, at))


@lru_cache(maxsize=4)
def offset_intervals(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> pa.Table:
    """(zone, u0, u1, off): first UTC second, end UTC second and offset in seconds of every stretch of constant offset."""
    names = sorted(n for n in available_timezones() if "/" in n and not n.startswith(("posix", "right", "Etc/"))) + ["UTC"]
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in (first, last + 1))
    step = 28 * 86400
    out: dict[str, list] = {"zone": [], "u0": [], "u1": [], "off": []}
    for name in names:
        z = ZoneInfo(name)
        off = lambda s, z=z: int(dt.datetime.fromtimestamp(s, z).utcoffset().total_seconds())
        listed = [c for c in _listed_changes(name) if lo < c < hi]
        changes, t = listed, max([lo, *listed])
        now = off(t)
        while t < hi:  # what a rule makes after the last listed change
            nxt = min(t + step, hi)
            if off(nxt) != now:
                a, b = t, nxt
                while b - a > 1:
                    m = (a + b) // 2
                    a, b = (m, b) if off(m) == now else (a, m)
                changes.append(b)
                t, now = b, off(b)
            else:
                t = nxt
        start, now = -(2**40), off(lo)
        for c in [*changes, None]:
            if c is None or off(c) != now:
                out["zone"].append(name.lower()), out["u0"].append(start), out["u1"].append(hi if c is None else c), out["off"].append(now)
                start, now = c, c and off(c)
    return pa.table(out)


def _year_of(days: Column) -> Column:
    return F.year(F.date_add(F.lit(dt.date(1970, 1, 1)), days.cast("int")))


def _block(year: Column) -> Column:
    return F.when(year.isNotNull(), F.floor((F.greatest(year, F.lit(FIRST_YEAR)) - FIRST_YEAR) / BLOCK).cast("int"))


def zone_table(spark: SparkSession) -> DataFrame:
    """(zone, block, stretches): the intervals exploded by blocks of civil years. Its size is zones times years, whatever the data."""
    civil = spark.createDataFrame(offset_intervals()).select("zone", (F.col("u0") + F.col("off")).alias("c0"), (F.col("u1") + F.col("off")).alias("c1"), "off")
    block = lambda s: _block(_year_of(F.floor(F.greatest(s, F.lit(-(2**32))) / 86400)))
    by_block = civil.withColumn("block", F.explode(F.sequence(block(F.col("c0")), block(F.col("c1") - 1))))
    return by_block.groupBy("zone", "block").agg(F.collect_list(F.struct("c0", "c1", "off")).alias("stretches"))


def _like_year(y: Column) -> Column:
    """A year of the table with the same calendar: the year itself up to LAST_YEAR."""
    kind = lambda y: (y + (y - 1) // 4 - (y - 1) // 100 + (y - 1) // 400) % 7 * 2 + (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))
    twin = {kind(x): x for x in range(LAST_YEAR, STEADY_YEAR - 1, -1)}
    before = y - 1
    weekday = F.pmod(y + F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400), F.lit(7))
    leap = ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")
    return F.when(y <= LAST_YEAR, y).otherwise(F.get(F.array(*[F.lit(twin[k]) for k in range(14)]), (weekday * 2 + leap).cast("int")))


def _number_us(t: Column) -> Column:
    """Microseconds of a bare number; its size tells seconds, milli-, micro- and nanoseconds apart."""
    hexed = F.regexp_extract(t, r"^0x0*([0-9a-f]{1,15})$", 1)
    text = F.when(t.rlike(r"^[+-]?\d{1,19}(\.\d*)?(e[+]?\d{1,2})?$"), t).when(hexed != "", F.conv(F.nullif(hexed, F.lit("")), 16, 10))
    n = text.try_cast("decimal(28,9)")
    size = F.abs(n)
    million = F.lit(1_000_000).cast("decimal(7,0)")
    us = F.when(size < 10**11, n * million).when(size < 10**14, n * F.lit(1000).cast("decimal(7,0)")).when(size < 10**17, n * F.lit(1).cast("decimal(7,0)")).otherwise(n / F.lit(1000).cast("decimal(7,0)"))
    return F.when(us < 0, F.ceil(us)).otherwise(F.floor(us)).try_cast("long")


def _digits(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).try_cast("long")


def with_instant(df: DataFrame, text: Column, default_zone: str | Column, prefix: str = "") -> DataFrame:
    """Adds {prefix}instant_us and {prefix}instant_state to every row.

    State: ok; ambiguous (civil time that a clock change repeats); nonexistent (skipped by one);
    blank (null or empty text); unreadable. Only ok has an instant. A text without zone is civil time of
    default_zone, parts left out are zero, digits beyond microseconds are cut off. Where a text gives an
    offset and a zone's name, the offset counts. No row is dropped or repeated, nothing is shuffled.
    """
    zone_default = F.lit(default_zone) if isinstance(default_zone, str) else default_zone
    t = F.lower(F.regexp_replace(text, OUTER, ""))
    tidy = computed_once(df, __t=F.regexp_replace(t, r"(?U)\s+", " "), __default=F.lower(zone_default))
    rewritten = F.coalesce(*[F.when(F.col("__t").rlike(p), F.regexp_replace("__t", p, r)) for p, r in NOTATIONS])
    tidy = computed_once(tidy, __p=F.split(rewritten, r"\|", -1))
    tidy = computed_once(tidy, __n=F.when(F.col("__p").isNull(), _number_us(F.col("__t"))))
    p = lambda i: F.get(F.col("__p"), F.lit(i))
    tidy = computed_once(
        tidy, __y=F.when(F.length(p(0)) == 2, F.lit(2000) + p(0).try_cast("int")).otherwise(p(0).try_cast("int")), __m=F.coalesce(p(1).try_cast("int"), month_number(p(1))),
        __h=_digits(p(3)), __mi=_digits(p(4)), __s=_digits(p(5)), __frac=F.rpad(F.substring(p(6), 1, 6), 6, "0").try_cast("long"),
        __z=F.trim(F.regexp_replace(F.coalesce(p(8), F.lit("")), r"[\[\]()]", " ")),
    )
    day = F.concat_ws("-", F.lpad(F.col("__y").cast("string"), 4, "0"), F.lpad(F.col("__m").cast("string"), 2, "0"), F.lpad(p(2), 2, "0")).try_cast("date")
    h, z = F.col("__h"), F.col("__z")
    hour = F.when(p(7) == "", h).when(h.between(1, 12), h % 12 + F.when(p(7) == "p", 12).otherwise(0))
    shape = r"^(?:z|utc|gmt|ut)?([+-])(\d{1,2})(?::?(\d{2}))?"
    part = lambda i: F.nullif(F.regexp_extract(z, shape, i), F.lit(""))
    fixed = F.create_map(*[F.lit(x) for k, v in FIXED.items() for x in (k.lower(), v)])
    civil = F.create_map(*[F.lit(x) for k, v in CIVIL.items() for x in (k.lower(), v.lower())])
    minutes = (part(2).try_cast("long") * 60 + F.coalesce(part(3).try_cast("long"), F.lit(0))) * F.when(part(1) == "-", -1).otherwise(1)
    tidy = computed_once(tidy, __day=day, __hour=hour, __off=F.coalesce(minutes, fixed[z].cast("long"), F.when((z == "") & (F.col("__default") == "utc"), F.lit(0).cast("long"))))
    good = F.col("__day").isNotNull() & F.col("__y").isNotNull() & F.col("__m").isNotNull() & F.col("__hour").between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59)
    seconds = F.datediff("__day", F.lit(dt.date(1970, 1, 1))).cast("long") * 86400 + F.col("__hour") * 3600 + F.col("__mi") * 60 + F.col("__s")
    tidy = computed_once(tidy, __sec=F.when(good, seconds), __zone=F.when(F.col("__off").isNull(), F.when(z == "", F.col("__default")).otherwise(F.coalesce(civil[z], z))))
    year = F.year("__day")
    jan1 = lambda y: F.datediff(F.make_date(y, F.lit(1), F.lit(1)), F.lit(dt.date(1970, 1, 1))).cast("long") * 86400
    tidy = computed_once(tidy, __like=F.when(F.col("__zone").isNotNull() & F.col("__sec").isNotNull(), _like_year(year)))
    # later years are looked up in the table's year of the same calendar
    tidy = computed_once(tidy, __at=F.when(F.col("__like") == year, F.col("__sec")).otherwise(F.col("__sec") - jan1(year) + jan1(F.col("__like"))), __block=_block(F.col("__like")))
    zones = zone_table(df.sparkSession).select(F.col("zone").alias("__zone"), F.col("block").alias("__block"), F.col("stretches").alias("__stretches"))
    joined = tidy.join(F.broadcast(zones), ["__zone", "__block"], "left")
    joined = computed_once(joined, __hits=F.filter("__stretches", lambda x: (x["c0"] <= F.col("__at")) & (F.col("__at") < x["c1"])))
    n = F.size("__hits")
    off_s = F.coalesce(F.col("__off") * 60, F.when(n == 1, F.col("__hits")[0]["off"]))
    joined = computed_once(joined, __us=F.coalesce((F.col("__sec") - off_s) * 1_000_000 + F.col("__frac"), F.col("__n")))
    state = (
        F.when(F.col("__t").isNull() | (F.col("__t") == ""), "blank")
        .when(F.col("__us").isNotNull(), "ok")
        .when(F.col("__hits").isNotNull() & (n > 1), "ambiguous")
        .when(F.col("__hits").isNotNull() & (n == 0), "nonexistent")
        .otherwise("unreadable")
    )
    out = joined.withColumns({f"{prefix}instant_us": F.col("__us"), f"{prefix}instant_state": state})
    return out.select(*df.columns, f"{prefix}instant_us", f"{prefix}instant_state")


def named_instants(texts: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, instant_us) of the (table_name, row_id, field_name, text, zone) rows that name one instant; repeated rows count once."""
    got = with_instant(texts, F.col("text"), F.col("zone")).where("instant_state = 'ok' AND row_id IS NOT NULL")
    return got.select("table_name", "row_id", "field_name", "instant_us").distinct()
