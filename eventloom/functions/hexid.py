"""Hex identifiers and log words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hex(c: Column) -> Column:
    """A hex number without outer blanks, 0x and leading zeros, in lower case; null for null or blank text.

    Zero itself is "0". Text that isn't hex is only trimmed and lowered, so equal texts still agree.
    """
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(t, r"^0x", "")
    stripped = F.regexp_replace(bare, r"^0+(?=.)", "")
    return F.when(t != "", stripped)


def normalize_hex(c: Column, n_bytes: int) -> Column:
    """Lower case, 0x in front, padded with zeros on the left to n bytes; null and blank stay null."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^0x", "")
    return F.when(t != "", F.concat(F.lit("0x"), F.lpad(t, 2 * n_bytes, "0")))


def hex_to_long(c: Column) -> Column:
    """The value of a hex text of up to 15 digits after leading zeros; longer ones give null."""
    h = canonical_hex(c)
    return F.when(h.rlike("^[0-9a-f]{1,15}$"), F.conv(h, 16, 10).cast("long"))


def word(data: Column, i: int) -> Column:
    """The i-th 32-byte word of a log's data, as 64 hex digits; null beyond its end."""
    w = F.substring(F.regexp_replace(F.lower(data), r"^0x", ""), 1 + 64 * i, 64)
    return F.when(F.length(w) == 64, w)


#: Settlement words and what they mean.
PRICE_WORDS = {f"{10**18:064x}": "Yes", f"{0:064x}": "No", f"{5 * 10**17:064x}": "50/50", f"{2**255:064x}": "Ignore"}


def price_meaning(w: Column) -> Column:
    """Label of a settlement price word, null for any other value."""
    m = F.create_map(*[F.lit(x) for kv in PRICE_WORDS.items() for x in kv])
    return m[w]
