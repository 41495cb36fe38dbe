"""Texts scored against texts: sequence ratio, shared nouns, term weights."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Opening words that say nothing, and words that name nothing.
FILLERS = r"(?i)^\s*will\s+|\bwill the\b|\bis it true that\b"
STOPWORDS = "the and for will with that this from are was were has have had not but you your their his her its who what when where which than then into over under after before about".split()


def normalize_market_text(c: Column, aggressive: bool = False) -> Column:
    """Lower case without fillers; other marks than - ' , ; ( ) . become blanks, aggressively all marks."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), FILLERS, " ")
    t = F.regexp_replace(t, r"[^a-z0-9\s]" if aggressive else r"(?U)[^\w\s\-',;().]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def key_nouns(c: Column, least: int = 3) -> Column:
    """Distinct words of at least so many letters that aren't stopwords, split at blanks."""
    words = F.split(normalize_market_text(c), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; null where one is."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def confidence_bucket(score: Column, high: float, medium: float, also_medium: Column | None = None) -> Column:
    mid = score >= medium if also_medium is None else (score >= medium) | also_medium
    return F.when(score >= high, "HIGH_CONFIDENCE").when(mid, "MEDIUM_CONFIDENCE").otherwise("LOW_CONFIDENCE")


def tfidf(docs: DataFrame, group: str, ident: list[str], text: str, most: float = 0.95) -> DataFrame:
    """(group, ident.., term, weight): smoothed inverse frequencies, rows of length one; terms of more than ``most`` of a group's texts are left out.

    Everything is an aggregate on (group, term) or (group, ident); no vocabulary is gathered.
    """
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    tf = docs.select(group, *ident, F.explode(terms).alias("term")).groupBy(group, *ident, "term").agg(F.count("*").alias("tf"))
    n = docs.groupBy(group).agg(F.count("*").alias("n"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df")).join(n, group).where(F.col("df") <= most * F.col("n"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    raw = tf.join(df, [group, "term"]).select(group, *ident, "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, *ident)))
    return raw.select(group, *ident, "term", (F.col("w") / norm).alias("weight"))


def cosine_pairs(weights: DataFrame, group: str, ident: list[str], side: str, least: float) -> DataFrame:
    """(group, ident.. of side p with _p, of side k with _k): pairs of a group's texts whose cosine may reach ``least``, and all that do.

    weights: tfidf() rows of both sides. With terms in one order, rarest first, let two texts' first common term be t. What
    follows t adds at most the product of both rests' lengths, so the product of t's weights and this reach ``least``
    or the cosine doesn't; the same holds with length one for the other text, so only the terms before
    which a rest of that length is left can be t. Frequent terms, which most pairs share, are seldom among them.
    """
    slack = least - 1e-6
    n = weights.groupBy(group, "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group, *ident, side).orderBy("n", "term")
    from_here = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    after = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    first = weights.join(n, [group, "term"]).withColumns({"from_here": F.sqrt(from_here), "rest": F.sqrt(after)}).where(F.col("from_here") >= slack)
    of = lambda x: first.where(F.col(side) == x).select(group, "term", *[F.col(c).alias(f"{c}_{x}") for c in [*ident, "weight", "rest"]])
    met = of("p").join(of("k"), [group, "term"]).where(F.col("weight_p") * F.col("weight_k") + F.col("rest_p") * F.col("rest_k") >= slack)
    return met.select(group, *[f"{c}_{x}" for x in "pk" for c in ident]).distinct()
