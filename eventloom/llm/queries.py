"""Queries and SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.leaks import leaked_passages, removal_spans
from eventloom.llm.linkage import frames, link_markets, with_known_sub_titles
from eventloom.llm.mixing import mixture
from eventloom.llm.nearest import nearest_in_time
from eventloom.llm.subjects import document_subjects
from eventloom.operators.wide import proper_ticker
from eventloom.sources import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "k_cutoffs"), table(spark, sf_dir, "k_trades")
    got = nearest_in_time(
        c, t, left_entity=proper_ticker(F.col("ticker")), left_time=F.col("cutoff_utc"), left_id=F.col("target_id"),
        right_entity=proper_ticker(F.col("ticker")), right_time=F.col("created_time"), right_id=F.col("trade_id"),
    )
    return got.select(F.col("left_id").alias("target_id"), F.col("right_id").alias("trade_id"))


def _evidence(spark: SparkSession, sf_dir: str, exchange: str, ident, days: DataFrame) -> DataFrame:
    """(id, contract_key, entity_signature, day) of a venue's markets: an earlier parser's keys, and the day trading ends."""
    c = table(spark, sf_dir, "contract_canonical_markets").where(F.lower(F.trim("exchange")) == exchange).select(ident.alias("id"), "contract_key", "entity_signature")
    return c.unionByName(days.where("id IS NOT NULL AND day IS NOT NULL"), allowMissingColumns=True).distinct()


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of markets that settle on the same thing, each with its confidence."""
    p, k = table(spark, sf_dir, "pm_markets"), table(spark, sf_dir, "k_topics")
    ticker = proper_ticker(F.col("ticker"))
    left = frames(p, F.col("id"), F.col("question"), F.lit(None).cast("string"), F.col("_fetched_at"))
    parsed = table(spark, sf_dir, "contract_canonical_markets").where(F.lower(F.trim("exchange")) == "kalshi")
    others = parsed.select(proper_ticker(F.col("market_id")).alias("id"), "yes_sub_title", "no_sub_title")
    wordings = with_known_sub_titles(k.select(ticker.alias("id"), "title", "yes_sub_title", "no_sub_title", F.col("_fetched_at").alias("at")), others)
    right = frames(wordings, F.col("id"), F.col("title"), F.col("sub"), F.col("at"))
    said_l = _evidence(spark, sf_dir, "polymarket", F.col("market_id"), p.select("id", F.to_date("end_date").alias("day")))
    said_r = _evidence(spark, sf_dir, "kalshi", proper_ticker(F.col("market_id")), k.select(ticker.alias("id"), F.to_date("close_time").alias("day")))
    return link_markets(left, right, said_l, said_r).select(F.col("left_id").alias("pm_id"), F.col("right_id").alias("k_ticker"), "confidence", "residual")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).select("pm_id", "k_ticker").distinct()


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches to remove, in numbers of plain words; overlapping ones are merged."""
    return removal_spans(_passages(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    series = F.regexp_extract(F.upper(F.trim("event_ticker")), "^KX([A-Z]+)", 1)
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"), lang=F.col("lang"), topic=series)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source is used and the shares really reached."""
    return _mixture(spark, sf_dir)[1]


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, sf_dir)[0]


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all tokens aimed at and reached by source, language and topic."""
    return _mixture(spark, sf_dir)[2]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return document_subjects(d, table(spark, sf_dir, "subject_areas"), doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang"), source=F.col("source"), address=F.col("event_ticker"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_links": p3_links, "p6_found": p6_found, "p6_spans": p6_spans, "p7_mix": p7_mix, "p7_uses": p7_uses, "p7_margins": p7_margins, "p8_found": p8_found}

ORACLES = {
    "p1_found": """
        WITH w AS (SELECT DISTINCT target_id, upper(trim(ticker)) AS ticker, epoch_us(cutoff_utc) AS q FROM k_cutoffs WHERE cutoff_utc IS NOT NULL AND ticker IS NOT NULL),
        t AS (SELECT upper(trim(ticker)) AS ticker, epoch_us(created_time) AS u, min(trade_id) AS trade_id FROM k_trades WHERE created_time IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT w.target_id, t.trade_id, row_number() OVER (PARTITION BY w.target_id, w.ticker, w.q ORDER BY abs(t.u - w.q), t.u) AS rn
              FROM w JOIN t ON t.ticker = w.ticker AND t.u BETWEEN w.q - 1800000000 AND w.q + 1800000000)
        SELECT target_id, trade_id FROM p WHERE rn = 1""",
}
