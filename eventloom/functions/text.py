"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Lower case without bold marks, plain quotes and hyphens, single blanks; null gives an empty text."""
    t = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("**"), F.lit(""))
    t = F.regexp_replace(F.replace(t, F.lit("’"), F.lit("'")), "[‐-―]", "-")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def slugify(c: Column, empty: str = "") -> Column:
    """Words joined by underscores; nothing left gives ``empty``."""
    t = F.regexp_replace(F.regexp_replace(clean_text(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", empty).otherwise(t) if empty else t


def join_fields(fields: list[Column], mark: str = "|") -> Column:
    """The non-empty fields joined by a mark."""
    return F.concat_ws(mark, *[F.nullif(f, F.lit("")) for f in fields])


def list_of(c: Column) -> Column:
    """A list written as text, with either quotes; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct words of at least so many letters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens, 0 where either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mismatch(names: list[str], left: str, right: str) -> Column:
    """``field_mismatch:a!=b`` of the fields that differ, joined by semicolons."""
    show = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "<blank>").otherwise(c)
    parts = [F.when(F.coalesce(F.col(left + n), F.lit("")) != F.coalesce(F.col(right + n), F.lit("")), F.concat(F.lit(f"{n}_mismatch:"), show(F.col(left + n)), F.lit("!="), show(F.col(right + n)))) for n in names]
    return F.concat_ws("; ", *parts)


def evidence(columns: list[str], pattern: str) -> Column:
    """``name=value`` of the columns whose value the pattern is found in, joined by semicolons."""
    return F.concat_ws("; ", *[F.when(F.col(c).rlike(pattern), F.concat(F.lit(f"{c}="), F.col(c))) for c in columns])


def normalize_id(c: Column) -> Column:
    """An id without the .0 that a passage through floats leaves."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def as_flag(c: Column) -> Column:
    """Null stays null, true in any spelling is true, all else false."""
    return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))) == "true")
