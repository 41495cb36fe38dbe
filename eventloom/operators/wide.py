"""Entity-attribute-value records into one typed row per entity.

Names are resolved to slots and values to typed cells by column expressions; cells fold into registers,
one cell per slot, and an RDD ``combineByKey`` merges the registers of an entity. Merging two cells keeps the later
one, which is associative and commutative, so duplicates collapse on the map side and a hot entity
never sends more than one register per map task.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.plan import computed_once
from eventloom.session import written

#: The columns of the wide market table and the kind of each.
FACTS = {
    "status": "lower", "result": "lower", "yes_sub_title": "text", "volume": "integer", "open_interest": "integer",
    "last_price": "integer", "yes_bid": "integer", "yes_ask": "integer", "can_close_early": "boolean", "expiration_date": "date",
}
FIRST_DAY, LAST_DAY = dt.date(2025, 6, 23), dt.date(2025, 7, 15)
FOLD_RECORDS = 500_000
#: Texts that say nothing.
BLANKS = ["", "-", "--", "null", "none", "nan", "nat", "n/a", "na", "#n/a"]

#: Outer blanks, zero-width ones included.
OUTER = r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$"

KINDS = {"lower": T.StringType(), "text": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "price": T.DoubleType()}


def price_columns(first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY) -> list[str]:
    days = [first + dt.timedelta(i) for i in range((last - first).days + 1)]
    return [f"yes_{d:%Y_%m_%d}_{tag}_PT" for d in days for tag in ("open_0500", "close_1700")]


def layout() -> dict[str, str]:
    """Column name -> kind, in the order of the wide table."""
    return FACTS | dict.fromkeys(price_columns(), "price")


def proper_ticker(c: Column) -> Column:
    """Tickers agree apart from letter case and outer blanks; the proper form is upper case."""
    return F.upper(F.regexp_replace(c, OUTER, ""))


def _between(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def resolve_slot(name: Column, first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY) -> Column:
    """Place in layout() of the column that a freely spelled name, in lower case, means, or null.

    Letter case, separators and missing zero padding make no difference.
    """
    facts = F.create_map(*[F.lit(x) for i, c in enumerate(FACTS) for x in (c.replace("_", ""), i)])
    sep = "[^a-z0-9]*"
    pat = rf"^{sep}yes{sep}(20\d\d)(?:[^a-z0-9]+(\d{{1,2}})[^a-z0-9]+(\d{{1,2}})|(\d\d)(\d\d)){sep}(open{sep}0500|close{sep}1700){sep}pt{sep}$"
    day = F.split_part(F.regexp_replace(name, pat, "$1-$2$4-$3$5|$6"), F.lit("|"), F.lit(1)).try_cast("date")
    slot = len(FACTS) + 2 * F.datediff(day, F.lit(first)) + F.when(F.contains(name, F.lit("close")), 1).otherwise(0)
    return F.when(name.rlike(pat), F.when(day.between(first, last), slot)).otherwise(facts[F.regexp_replace(name, "[^a-z0-9]", "")])


def _digits(text: Column) -> Column:
    """An integer spelled with grouping marks, a sign, leading zeros or an empty fraction."""
    t = F.regexp_replace(text, r"^\+", "")
    plain = F.regexp_replace(t, r"(?<=\d)[,\s\u00a0\u202f_'](?=\d{3}(?!\d))", "")
    return F.when(plain.rlike(r"^-?\d{1,18}(\.0*)?$"), F.regexp_replace(plain, r"\.0*$", "").cast("long"))


def _cents(text: Column) -> Column:
    """A price in whole cents, from a fraction, a percentage, cents or scientific notation; null outside 0..1."""
    t = F.lower(F.regexp_replace(text, r"\s+", ""))
    unit = t.rlike(r"(%|c|¢|cents?)$")
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(%|cents?|c|¢)$", ""), r"^\+?\$?\+?", ""), r"^(\d*),(\d+)$", "$1.$2")
    ok = number.rlike(r"^(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")
    value = number.try_cast("double")
    cents = F.when(unit, value).otherwise(value * 100)
    return F.when(ok & (cents >= 0) & (cents <= 100), F.round(cents, 0).cast("long"))


#: Month names begin with these.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month_number(c: Column) -> Column:
    """1..12 of an English month name or its beginning, else null."""
    low = F.lower(F.substring(c, 1, 3))
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), low), F.lit(0)).cast("int")


def _date(text: Column) -> Column:
    num = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:[T ]\d\d:\d\d.*)?$"
    dmy, mdy = r"^(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})$", r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    g = lambda p, i: F.regexp_extract(text, p, i)
    n = lambda p, i: g(p, i).try_cast("int")
    y = F.coalesce(n(num, 1), n(dmy, 3), n(mdy, 3), n(us, 3))
    m = F.coalesce(n(num, 2), month_number(g(dmy, 2)), month_number(g(mdy, 1)), n(us, 1))
    d = F.coalesce(n(num, 3), n(dmy, 1), n(mdy, 2), n(us, 2))
    iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), iso.try_cast("date"))


def typed_cell(kind: Column, value: Column) -> Column:
    """The cell's plain text when the trimmed value is of the column's kind, else null."""
    t = value
    low = F.lower(t)
    flag = F.when(low.isin("true", "t", "yes", "y", "1", "on"), "true").when(low.isin("false", "f", "no", "n", "0", "off"), "false")
    cell = (
        F.when(kind == "lower", low)
        .when(kind == "text", t)
        .when(kind == "integer", _digits(t).cast("string"))
        .when(kind == "boolean", flag)
        .when(kind == "date", _date(t).cast("string"))
        .when(kind == "price", _cents(t).cast("string"))
    )
    return F.when(t.isNotNull() & ~low.isin(*BLANKS), cell)


class Registers:
    """The associative cell mergers: a register maps slot -> (recorded_at, raw_id, cell)."""

    @staticmethod
    def put(reg: dict, slot: int, cell: tuple) -> None:
        old = reg.get(slot)
        if old is None or cell > old:
            reg[slot] = cell

    @staticmethod
    def merge(a: dict, b: dict) -> dict:
        if len(a) < len(b):
            a, b = b, a
        for slot, cell in b.items():
            Registers.put(a, slot, cell)
        return a


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ticker, register) of a stretch of cells, so that one object per ticker leaves a task instead of one per record."""
    regs: dict[str, dict] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(regs), pa.string()), pa.array([pickle.dumps(r, 5) for r in regs.values()], pa.binary())], names=["ticker", "reg"])

    for b in batches:
        for ticker, slot, us, raw, cell in zip(*(c.to_pylist() for c in b.columns)):
            reg = regs.get(ticker)
            if reg is None:
                reg = regs[ticker] = {}
            Registers.put(reg, slot, (us, raw, cell))
        held += b.num_rows
        if held >= FOLD_RECORDS:
            yield flush()
            regs.clear()
            held = 0
    if regs:
        yield flush()


def _encoder(names: list[str], kinds: list[str]):
    def number(kind: str, cell: str):
        if kind == "integer":
            return int(cell)
        if kind == "boolean":
            return cell == "true"
        if kind == "date":
            return dt.date.fromisoformat(cell)
        if kind == "price":
            return int(cell) / 100
        return cell

    def row(kv: tuple) -> tuple:
        ticker, reg = kv
        return (ticker, *[number(k, reg[i][2]) if i in reg else None for i, k in enumerate(kinds)])

    return row


def to_wide(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """One typed row per ticker from (raw_id, ticker, attr_name, attr_value, recorded_at) records.

    Per cell the latest recorded_at counts, then the highest raw_id, then the greater text. Records
    without a ticker, with a name that means no column, or whose value is blank or not of the column's
    type are passed over, as is a null recorded_at only when any dated record fills the cell (it sorts
    first). A ticker with no filled cell gives no row. Prices are doubles between 0 and 1.
    """
    spark = records.sparkSession
    cols = layout()
    kinds = list(cols.values())
    low = -(2**62)
    picked = records.select(
        proper_ticker(F.col("ticker")).alias("ticker"), F.lower("attr_name").alias("spelled"), F.col("attr_value").alias("value"),
        F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(low)).alias("us"), F.coalesce(F.col("raw_id").cast("long"), F.lit(low)).alias("raw"),
    )
    named = computed_once(picked.where("ticker <> '' AND value IS NOT NULL"), slot=resolve_slot(F.col("spelled"))).where("slot IS NOT NULL")
    kind_of = F.when(F.col("slot") >= len(FACTS), "price").otherwise(F.get(F.array(*[F.lit(k) for k in FACTS.values()]), F.col("slot")))
    tidy = computed_once(named, kind=kind_of, text=F.regexp_replace("value", OUTER, ""))
    cells = computed_once(tidy, cell=typed_cell(F.col("kind"), F.col("text"))).where("cell IS NOT NULL").select("ticker", "slot", "us", "raw", "cell")
    # nothing coalesces or splits an RDD's shuffle at run time: its width is what the cluster sets for all shuffles
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the registers are kept as a table: what the shuffle below loses with an executor is not read from the records again
    folded, _ = written(cells.mapInArrow(_fold, "ticker string, reg binary"), "registers")
    pairs = folded.rdd.map(lambda r: (r[0], pickle.loads(r[1])))
    rows = pairs.combineByKey(lambda reg: reg, Registers.merge, Registers.merge, n).map(_encoder(list(cols), kinds))
    schema = T.StructType([T.StructField("ticker", T.StringType())] + [T.StructField(c, KINDS[k]) for c, k in cols.items()])
    return spark.createDataFrame(rows, schema, verifySchema=False)


def melt(wide: DataFrame) -> DataFrame:
    """(ticker, column_name, cell_value): every filled cell of the wide table as plain text."""
    cells = []
    for c, k in layout().items():
        v = F.col(c)
        text = F.round(v * 100).cast("long").cast("string") if k == "price" else v.cast("string")
        cells.append(F.struct(F.lit(c).alias("column_name"), text.alias("cell_value")))
    return wide.select("ticker", F.explode(F.array(*cells)).alias("x")).select("ticker", "x.*").where("cell_value IS NOT NULL")
