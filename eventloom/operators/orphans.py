"""References to records that aren't there, were deleted, or came in later.

Keys are cut into ranges by a hash. Inside a range the distinct keys form a dictionary of small
integers, every side becomes compressed bitmaps over those integers per period, and orphans are what a
reference bitmap holds AND NOT its parents' bitmap. Surviving bits are decoded through the dictionary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
DAY_US = 86_400_000_000


class Bitmap:
    """A compressed set of integers: 2**16-wide containers, each a sorted uint16 array or a packed bitset."""

    def __init__(self, values: np.ndarray | None = None):
        self.boxes: dict[int, np.ndarray] = {}
        if values is not None and len(values):
            v = np.unique(np.asarray(values, np.int64))
            high = v >> 16
            cut = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
            for a, b in zip(cut, [*cut[1:], len(v)]):
                self._put(int(high[a]), (v[a:b] & 0xFFFF).astype(np.uint16))

    def _put(self, box: int, low: np.ndarray) -> None:
        if len(low) > 4096:
            bits = np.zeros(65536, bool)
            bits[low] = True
            self.boxes[box] = np.packbits(bits)
        elif len(low):
            self.boxes[box] = low

    @staticmethod
    def _bits(x: np.ndarray) -> np.ndarray:
        if x.dtype == np.uint8:
            return np.unpackbits(x).astype(bool)
        bits = np.zeros(65536, bool)
        bits[x] = True
        return bits

    def _each(self, other: Bitmap, op, sparse) -> Bitmap:
        """op on packed boxes, sparse(x, y) where both are short arrays."""
        out = Bitmap()
        none = np.zeros(0, np.uint16)
        for box, x in self.boxes.items():
            y = other.boxes.get(box, none)
            if x.dtype == y.dtype == np.uint16:
                out._put(box, sparse(x, y))
            else:
                out._put(box, np.flatnonzero(op(self._bits(x), self._bits(y))).astype(np.uint16))
        return out

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._each(other, lambda a, b: a & ~b, lambda x, y: np.setdiff1d(x, y, assume_unique=True))

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._each(other, lambda a, b: a & b, lambda x, y: np.intersect1d(x, y, assume_unique=True))

    def __or__(self, other: Bitmap) -> Bitmap:
        out = self._each(other, lambda a, b: a | b, np.union1d)
        for box, y in other.boxes.items():
            out.boxes.setdefault(box, y)
        return out

    def decode(self) -> np.ndarray:
        parts = [(box << 16) + (np.flatnonzero(self._bits(x)) if x.dtype == np.uint8 else x.astype(np.int64)) for box, x in sorted(self.boxes.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(int(np.bitwise_count(x).sum()) if x.dtype == np.uint8 else len(x) for x in self.boxes.values())


_FOUND = "space string, key string, period long, kind string, first_us long"


def _find(pdf: pd.DataFrame) -> pd.DataFrame:
    """Orphans of one key range, each (key, period of the reference, kind) with the instant the parent first came."""
    names, code = np.unique(pdf["key"].to_numpy(str), return_inverse=True)
    is_ref, period = (pdf["role"] == 0).to_numpy(), pdf["period"].to_numpy()
    came = np.zeros(len(names), np.int64)
    came[code[~is_ref]] = pdf["first_us"].to_numpy()[~is_ref]
    cut = lambda keep, p, kind: pd.DataFrame({"space": pdf["space"].iloc[0], "key": names[keep], "period": p, "kind": kind, "first_us": came[keep]})
    if not is_ref.any():
        return cut(np.zeros(0, np.int64), 0, "").astype({"space": str, "kind": str})
    parent = Bitmap(code[~is_ref])
    deleted = Bitmap(code[~is_ref & pdf["deleted"].to_numpy(bool)])
    out, arrived = [], Bitmap()
    p_periods, p_codes = period[~is_ref], code[~is_ref]
    order = np.argsort(p_periods, kind="stable")
    p_periods, p_codes, done = p_periods[order], p_codes[order], 0
    for p in np.unique(period[is_ref]):
        upto = int(np.searchsorted(p_periods, p, "left"))
        arrived, done = arrived | Bitmap(p_codes[done:upto]), upto
        refs = Bitmap(code[is_ref & (period == p)])
        missing = refs.and_not(parent)
        gone = refs & deleted
        open_ = refs.and_not(missing).and_not(gone).and_not(arrived)  # not known to have come before this period
        out += [cut(missing.decode(), p, "missing"), cut(gone.decode(), p, "deleted"), cut(open_.decode(), p, "late")]
    return pd.concat(out)


def orphan_references(
    refs: DataFrame, parents: DataFrame, *, ranges: int | None = None, period_us: int = DAY_US, salts: int = SALTS
) -> DataFrame:
    """Each orphan reference with its kind: missing, deleted or late, the first that holds.

    refs: (space, key, ref_id, us), parents: (space, key, us, deleted), with us the instant a row was
    fetched. A space names what is referenced, so several reference columns go through in one pass. A
    null key is no reference; a null us of a reference is never late, a null us of a parent counts as
    earliest for arrival and oldest for deletion; a null flag is false; among rows fetched at one
    instant a deletion wins. Repeated rows count once. Empty parents make every reference missing.
    Keys are cut into ``ranges`` by hash, by default as many as shuffle partitions, whose number a
    cluster sets by its data. Returns (space, ref_id, us, kind).
    """
    low = F.lit(-(2**62))
    refs = refs.where("key IS NOT NULL").select("space", "key", "ref_id", F.col("us").cast("long").alias("us"))
    state = (
        parents.where("key IS NOT NULL")
        .groupBy("space", "key")
        .agg(F.min(F.coalesce("us", low)).alias("first_us"), F.max(F.struct(F.coalesce("us", low).alias("u"), F.coalesce("deleted", F.lit(False)).alias("d")))["d"].alias("deleted"))
    )
    period = lambda c: F.floor(F.coalesce(c, F.lit(2**62)) / period_us).cast("long")
    seen = refs.select("space", "key", period(F.col("us")).alias("period")).distinct()
    ranges = ranges or int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seen.select("space", "key", "period", F.lit(0).alias("role"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("first_us")).unionByName(
        state.select("space", "key", F.floor(F.col("first_us") / period_us).cast("long").alias("period"), F.lit(1).alias("role"), "deleted", "first_us")
    )
    found = rows.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges))).groupBy("space", "range").applyInPandas(lambda pdf: _find(pdf), _FOUND)
    # Exact end: links of the surviving keys; inside one period the clock decides. A hot key's links are salted.
    salt = F.pmod(F.xxhash64("ref_id"), F.lit(salts))
    left = refs.withColumn("period", period(F.col("us"))).withColumn("salt", salt)
    keys = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    hit = left.join(keys, ["space", "key", "period", "salt"])
    return hit.where("kind <> 'late' OR first_us > us").select("space", "ref_id", "us", "kind").distinct()


def orphan_report(found: DataFrame, tables: Column, period: Column) -> DataFrame:
    """Number of orphan references per referenced table, period and kind."""
    return found.groupBy(tables.alias("referenced_table"), period.alias("period"), F.col("kind").alias("orphan_kind")).agg(F.count("*").alias("n_references"))
