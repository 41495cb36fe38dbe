"""Queries of the study's operators on the two venues' own tables, each with its SQL where another engine can say it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import logs as L
from eventloom.functions import text as X
from eventloom.functions.hexid import PRICE_WORDS, canonical_hex
from eventloom.operators import similarity as S
from eventloom.operators.asof import asof_join, weighted_mean
from eventloom.operators.closest import closest_texts
from eventloom.operators.guards import duplicates
from eventloom.operators.regress import within_regression
from eventloom.operators.templates import FIELDS, PLACES, canonical_alias, expand_outcomes, parse_contracts
from eventloom.operators.wide import melt, proper_ticker, to_wide
from eventloom.plans.core_sql import P2
from eventloom.plans.reference import query
from eventloom.session import written
from eventloom.sources import parquet_archive, table

HEX = "regexp_replace(regexp_replace(lower(trim({0})), '^0x', ''), '^0+(.)', '\\1')"


# ---- titles and contracts


def _pm_newest(spark: SparkSession, d: str) -> DataFrame:
    newest = Window.partitionBy("id").orderBy(F.desc_nulls_last("_fetched_at"), F.desc_nulls_last("question"))
    return table(spark, d, "pm_markets").withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def _k_newest(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_topics").withColumn("ticker", proper_ticker(F.col("ticker"))).where("ticker IS NOT NULL")
    newest = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("_fetched_at"), F.desc_nulls_last("row_id"))
    return k.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    pm = expand_outcomes(_pm_newest(spark, d), X.list_of(F.col("outcomes")), X.list_of(F.col("clob_token_ids")))
    pm = pm.select(
        F.lit("polymarket").alias("exchange"), F.col("id").alias("market_id"), F.col("condition_id").alias("event_group"), "outcome_index", "outcome_name", "token_id", "synthetic_binary", F.col("question").alias("title"),
        F.col("volume").cast("double").alias("volume"), "slug", F.col("end_date").cast("string").alias("ends"), F.col("created_at").cast("string").alias("made"),
    )
    k = _k_newest(spark, d).select(
        F.lit("kalshi").alias("exchange"), F.col("ticker").alias("market_id"), F.col("event_ticker").alias("event_group"), "title", "yes_sub_title", F.col("volume").cast("double").alias("volume"), "ticker",
        F.col("close_time").cast("string").alias("ends"), F.col("created_time").alias("made"),
    )
    both = pm.unionByName(k, allowMissingColumns=True)  # one pass of the templates for both venues
    parsed = parse_contracts(both, title=F.col("title"), outcome=F.col("outcome_name"), yes_sub_title=F.col("yes_sub_title"), slug=F.col("slug"), ticker=F.col("ticker"), dates=[F.col("ends"), F.col("made")])
    return parsed.drop("yes_sub_title", "slug", "ticker", "ends", "made")


@query(None)
def parsed_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Every market of both venues, non-binary ones as one row per outcome, with its contract fields."""
    return _parsed(spark, d)


@query(None)
def parsed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Markets and volume per venue, template reason and family."""
    return _parsed(spark, d).groupBy("exchange", "parse_reason", "market_family").agg(F.count("*").alias("markets"), F.sum("volume").alias("volume"))


_SIDE = "SELECT DISTINCT exchange, CASE WHEN exchange = 'kalshi' THEN upper(trim(market_id)) ELSE market_id END AS market_id, contract_key, entity_signature, market_family, parse_confidence, volume FROM contract_canonical_markets WHERE contract_key <> ''"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "contract_canonical_markets").where("contract_key <> ''")
    mid = F.when(F.col("exchange") == "kalshi", F.upper(F.trim("market_id"))).otherwise(F.col("market_id"))
    c = c.select("exchange", mid.alias("market_id"), "contract_key", "entity_signature", "market_family", "parse_confidence", "volume").distinct()
    renamed = lambda e, s: c.where(F.col("exchange") == e).drop("exchange").withColumnsRenamed({x: f"{x}_{s}" for x in c.columns if x != "contract_key"})
    return renamed("polymarket", "pm"), renamed("kalshi", "kalshi")


@query(f"""WITH c AS ({_SIDE}), p AS (SELECT * FROM c WHERE exchange = 'polymarket' QUALIFY row_number() OVER (PARTITION BY market_id, contract_key ORDER BY parse_confidence DESC, volume DESC NULLS LAST, entity_signature, market_family) = 1),
 k AS (SELECT * FROM c WHERE exchange = 'kalshi' QUALIFY row_number() OVER (PARTITION BY market_id, contract_key ORDER BY parse_confidence DESC, volume DESC NULLS LAST, entity_signature, market_family) = 1)
 SELECT p.market_id AS market_id_pm, k.market_id AS market_id_kalshi, contract_key, least(p.parse_confidence, k.parse_confidence) AS match_confidence, 'deterministic_contract_key' AS match_basis,
 contract_key || '|' || p.market_id || '|' || k.market_id AS contract_pair_id FROM p JOIN k USING (contract_key)""")
def contract_matches(spark: SparkSession, d: str) -> DataFrame:
    """Equal keys across venues: one row per market and key kept, the lesser confidence, a pair id."""
    def first(df: DataFrame, s: str) -> DataFrame:
        w = Window.partitionBy(f"market_id_{s}", "contract_key").orderBy(F.desc(f"parse_confidence_{s}"), F.desc_nulls_last(f"volume_{s}"), F.asc_nulls_last(f"entity_signature_{s}"), F.asc_nulls_last(f"market_family_{s}"))
        return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    pm, k = _sides(spark, d)
    j = first(pm, "pm").join(first(k, "kalshi"), "contract_key")
    return j.select("market_id_pm", "market_id_kalshi", "contract_key", F.least("parse_confidence_pm", "parse_confidence_kalshi").alias("match_confidence"), F.lit("deterministic_contract_key").alias("match_basis"), F.concat_ws("|", "contract_key", "market_id_pm", "market_id_kalshi").alias("contract_pair_id"))


#: Which resolver a family of markets is likely settled by.
PROXIES = {"uma_risk_exposed": ["election", "office_exit", "leader_contact", "policy_action"], "uma_likely_objective": ["sports", "fed_count", "fed_decision"], "chainlink_or_automated_likely": ["asset_threshold"]}
_PROXY = "CASE " + " ".join(f"WHEN trim(market_family) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in PROXIES.items()) + " ELSE 'unknown' END"


def _proxy(c):
    return F.coalesce(*[F.when(F.trim(c).isin(v), k) for k, v in PROXIES.items()], F.lit("unknown"))


@query(f"SELECT {_PROXY} AS resolver_proxy, count(*) AS markets, sum(coalesce(volume, 0)) AS volume FROM (SELECT DISTINCT exchange, market_id, market_family, volume FROM contract_canonical_markets) GROUP BY 1")
def resolver_proxies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contract_canonical_markets").select("exchange", "market_id", "market_family", "volume").distinct()
    return c.groupBy(_proxy(F.col("market_family")).alias("resolver_proxy")).agg(F.count("*").alias("markets"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"))


@query("""SELECT row_id, concat_ws('; ', CASE WHEN regexp_matches(lower(event), '(yes|no|price)') THEN 'event=' || event END, CASE WHEN regexp_matches(lower(proposed_price_meaning), '(yes|no|price)') THEN 'proposed_price_meaning=' || proposed_price_meaning END,
 CASE WHEN regexp_matches(lower(price_meaning), '(yes|no|price)') THEN 'price_meaning=' || price_meaning END) AS evidence FROM (SELECT DISTINCT row_id, event, proposed_price_meaning, price_meaning FROM uma_event_timeline)""")
def evidence_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns picked by a pattern on their names, hits of a pattern on their values joined as name=value."""
    u = table(spark, d, "uma_event_timeline")
    picked = [c for c, t in u.dtypes if t == "string" and re.search("^event$|meaning", c)]
    return u.select("row_id", *picked).distinct().select("row_id", X.evidence(picked, "(?i)(yes|no|price)").alias("evidence"))


# ---- filters

WINDOWS = [("2025-03-19", "2025-03-29"), ("2025-06-25", "2025-07-13")]
_IN_WINDOW = " OR ".join(f"(created_at <= TIMESTAMPTZ '{a} 00:00:00+00' AND coalesce(end_date, TIMESTAMPTZ '2100-01-01 00:00:00+00') >= TIMESTAMPTZ '{b} 00:00:00+00')" for a, b in WINDOWS)


@query(f"SELECT DISTINCT id FROM pm_markets WHERE {_IN_WINDOW}")
def any_window_filter(spark: SparkSession, d: str) -> DataFrame:
    """Markets active through any of several windows."""
    at = lambda day: F.lit(f"{day} 00:00:00+00:00").cast("timestamp")
    inside = [(F.col("created_at") <= at(a)) & (F.coalesce("end_date", at("2100-01-01")) >= at(b)) for a, b in WINDOWS]
    return table(spark, d, "pm_markets").where(reduce(lambda a, b: a | b, inside, F.lit(False))).select("id").distinct()


TOPICS = {"offices": r"\bmayor\b|\bsenator\b|\bpresident\b|\bgovernor\b", "deals": r"\bceasefire\b|\btreaty\b|\bmeet(ing)?\b", "prices": r"\bpercent\b|\bprice\b|\brate\b"}


@query(" UNION ALL ".join(f"SELECT DISTINCT '{s}' AS slug, id FROM pm_markets WHERE regexp_matches(lower(coalesce(question, '') || ' ' || coalesce(slug, '')), '{p}')" for s, p in TOPICS.items()))
def topic_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Markets of each topic by its pattern, in one pass over the table."""
    text = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("slug", F.lit(""))))
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(s)) for s, p in TOPICS.items()]), lambda x: x.isNotNull())
    return table(spark, d, "pm_markets").select(F.explode(hits).alias("slug"), "id").distinct()


@query("""WITH c AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, cutoff_utc FROM k_cutoffs WHERE cutoff_utc IS NOT NULL), z AS (SELECT max(cutoff_utc) AS z FROM c WHERE cutoff_utc < TIMESTAMPTZ '2025-03-01 00:00:00+00'),
 t AS (SELECT DISTINCT trade_id, upper(trim(ticker)) AS ticker, yes_price FROM k_trades, z WHERE created_time <= z) SELECT ticker, count(*) AS trades, avg(yes_price / 100.0) AS mean_price FROM t WHERE ticker IN (SELECT ticker FROM c) GROUP BY 1""")
def trades_before_last_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the wanted tickers up to the last cutoff; the bound, a single value, is known before the trades are read."""
    c = table(spark, d, "k_cutoffs").where("cutoff_utc IS NOT NULL")
    last = c.where(F.col("cutoff_utc") < F.lit("2025-03-01 00:00:00+00:00").cast("timestamp")).agg(F.max("cutoff_utc")).first()[0]
    t = table(spark, d, "k_trades").where(F.col("created_time") <= F.lit(last)).select("trade_id", proper_ticker(F.col("ticker")).alias("ticker"), "yes_price").distinct()
    keys = c.select(proper_ticker(F.col("ticker")).alias("ticker")).distinct()
    return t.join(keys, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("trades"), F.avg(F.col("yes_price") / 100.0).alias("mean_price"))


@query("SELECT DISTINCT row_id, block FROM uma_event_timeline WHERE block BETWEEN 62000000 AND 75000000 AND event IN ('DisputePrice', 'ProposePrice')")
def blocks_between(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "uma_event_timeline").where(F.col("block").between(62_000_000, 75_000_000) & F.col("event").isin("DisputePrice", "ProposePrice")).select("row_id", "block").distinct()


@query(f"""WITH k AS (SELECT {HEX.format('condition_id')} AS c, trim(market_id_pm) AS m FROM pm_neg_risk_uma_request_link), e AS (SELECT pm_id FROM market_matches_embeddings)
 SELECT DISTINCT id FROM pm_markets WHERE id IN (SELECT m FROM k WHERE m <> '') OR id IN (SELECT pm_id FROM e WHERE pm_id IS NOT NULL) OR {HEX.format('condition_id')} IN (SELECT c FROM k WHERE c <> '')""")
def member_by_any_key(spark: SparkSession, d: str) -> DataFrame:
    """Markets named by any of several id columns: keys are united first, then one semi join."""
    links, e = table(spark, d, "pm_neg_risk_uma_request_link"), table(spark, d, "market_matches_embeddings")
    keys = links.select(F.lit("id").alias("kind"), F.trim("market_id_pm").alias("key")).unionByName(e.select(F.lit("id").alias("kind"), F.col("pm_id").alias("key"))).unionByName(links.select(F.lit("condition").alias("kind"), canonical_hex(F.col("condition_id")).alias("key")))
    each = F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("condition").alias("kind"), canonical_hex(F.col("condition_id")).alias("key")))).alias("x")
    return table(spark, d, "pm_markets").select("id", each).select("id", "x.*").join(keys.where("key <> ''").distinct(), ["kind", "key"], "left_semi").select("id").distinct()


@query("SELECT DISTINCT pm_id, k_ticker FROM market_matches_embeddings WHERE contains(slug, 'pact') AND method = 'EMBEDDING' AND embedding_similarity >= 0.65")
def strict_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "market_matches_embeddings").where(F.contains("slug", F.lit("pact")) & (F.col("method") == "EMBEDDING") & (F.col("embedding_similarity") >= 0.65)).select("pm_id", "k_ticker").distinct()


@query("SELECT count(*) AS n, count(*) FILTER (volume > 0 AND active) AS passed, count(*) - count(*) FILTER (volume > 0 AND active) AS failed, round(avg(CAST(coalesce(volume > 0 AND active, false) AS INT)), 8) AS pass_share FROM pm_markets")
def filter_report(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce((F.col("volume") > 0) & F.col("active"), F.lit(False))
    return table(spark, d, "pm_markets").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("int")), 8).alias("pass_share"))


# ---- resolver lineage

_U = f"SELECT DISTINCT row_id, event_slug, {HEX.format('request_id')} AS request, event, block, lower(trim(tx)) AS tx, log_index, request_timestamp, price_meaning, proposed_price_meaning, payout FROM uma_event_timeline WHERE NOT coalesce(removed, false) AND trim(request_id) <> ''"


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "uma_event_timeline").where(~F.coalesce("removed", F.lit(False)))
    return u.select("row_id", "event_slug", canonical_hex(F.col("request_id")).alias("request"), "event", "block", F.lower(F.trim("tx")).alias("tx"), "log_index", "request_timestamp", "price_meaning", "proposed_price_meaning", "payout").where("request IS NOT NULL").distinct()


_L = f"SELECT DISTINCT link_id, {HEX.format('condition_id')} AS condition, {HEX.format('request_id')} AS request, prepared_block, init_block, lower(trim(init_tx)) AS init_tx, init_log_index FROM pm_neg_risk_uma_request_link WHERE trim(condition_id) <> ''"


def _links(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "pm_neg_risk_uma_request_link")
    return l.select("link_id", canonical_hex(F.col("condition_id")).alias("condition"), canonical_hex(F.col("request_id")).alias("request"), "prepared_block", "init_block", F.lower(F.trim("init_tx")).alias("init_tx"), "init_log_index").where("condition IS NOT NULL").distinct()


@query(f"""WITH l AS ({_L}), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY condition ORDER BY prepared_block NULLS LAST, init_log_index NULLS LAST, link_id) = 1), u AS ({_U}),
 r AS (SELECT request, min(block) AS log_block, max(CAST(event = 'Settle' AS INT)) AS settled FROM u WHERE event <> 'DisputePrice' GROUP BY 1)
 SELECT condition, nullif(f.request, '') AS request, coalesce(log_block, init_block) AS init_block, log_block IS NOT NULL AS initialized,
 CASE WHEN nullif(f.request, '') IS NULL THEN 'not_found' WHEN log_block IS NULL THEN 'neg_risk_configured_to_uma_unverified_question' WHEN settled = 1 THEN 'uma' ELSE 'uma_via_neg_risk_adapter' END AS ultimate_resolver_type
 FROM f LEFT JOIN r ON f.request = r.request""")
def resolver_map(spark: SparkSession, d: str) -> DataFrame:
    """Each condition's first preparation, what the oracle's log says of its request, and how it is resolved in the end."""
    w = Window.partitionBy("condition").orderBy(F.asc_nulls_last("prepared_block"), F.asc_nulls_last("init_log_index"), "link_id")
    first = _links(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    seen = _timeline(spark, d).where("event <> 'DisputePrice'").groupBy("request").agg(F.min("block").alias("log_block"), F.max((F.col("event") == "Settle").cast("int")).alias("settled"))
    kind = F.when(F.col("request").isNull(), "not_found").when(F.col("log_block").isNull(), "neg_risk_configured_to_uma_unverified_question").when(F.col("settled") == 1, "uma").otherwise("uma_via_neg_risk_adapter")
    return first.join(seen, "request", "left").select("condition", "request", F.coalesce("log_block", "init_block").alias("init_block"), F.col("log_block").isNotNull().alias("initialized"), kind.alias("ultimate_resolver_type"))


@query(f"""WITH l AS ({_L}), u AS ({_U}), h AS (SELECT l.link_id, u.row_id, u.request FROM l JOIN u ON l.init_tx = u.tx AND u.event = 'RequestPrice')
 SELECT link_id, min(row_id) AS row_id, min(request) AS request_of_receipt FROM h GROUP BY 1 HAVING count(*) = 1""")
def receipt_matches(spark: SparkSession, d: str) -> DataFrame:
    """The request in a link's transaction, accepted only where exactly one is there."""
    u = _timeline(spark, d).where("event = 'RequestPrice'").select("row_id", F.col("request").alias("of_receipt"), F.col("tx").alias("init_tx"))
    return _links(spark, d).join(u, "init_tx").groupBy("link_id").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"), F.min("of_receipt").alias("request_of_receipt")).where("n = 1").drop("n")


@query(f"WITH u AS ({_U}) SELECT row_id, block, request_timestamp FROM u WHERE event = 'DisputePrice' AND request_timestamp IN (SELECT request_timestamp FROM u WHERE event = 'ProposePrice')")
def disputes_of_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Disputes whose time is that of a proposal."""
    u = _timeline(spark, d)
    return u.where("event = 'DisputePrice'").join(u.where("event = 'ProposePrice'").select("request_timestamp"), "request_timestamp", "left_semi").select("row_id", "block", "request_timestamp")


@query(f"""WITH u AS ({_U}), b AS (SELECT block, min(request_timestamp) AS block_time FROM u GROUP BY 1) SELECT u.row_id, u.block, epoch_us(to_timestamp(block_time)) AS block_us FROM u LEFT JOIN b USING (block)""")
def log_block_times(spark: SparkSession, d: str) -> DataFrame:
    """Each log with the time of its block, from seconds."""
    u = _timeline(spark, d)
    b = u.groupBy("block").agg(F.min("request_timestamp").alias("block_time"))
    return u.join(b, "block", "left").select("row_id", "block", F.unix_micros(F.timestamp_seconds("block_time")).alias("block_us"))


@query("""WITH b AS (SELECT DISTINCT block, request_timestamp AS s FROM uma_event_timeline WHERE request_timestamp IS NOT NULL), q AS (SELECT DISTINCT event_slug, CAST(epoch(CAST(event_start AS TIMESTAMP)) AS BIGINT) AS a, CAST(epoch(CAST(event_end AS TIMESTAMP)) AS BIGINT) + 86400 AS z FROM resolution_risk_event_timeseries),
 x AS (SELECT min(block) AS lo, max(block) AS hi FROM b)
 SELECT event_slug, greatest(coalesce((SELECT max(block) FROM b WHERE s <= a - 2592000), (SELECT lo FROM x)) - 1000, 0) AS from_block, coalesce((SELECT min(block) FROM b WHERE s >= z + 2592000), (SELECT hi FROM x)) + 1000 AS to_block FROM q""")
def block_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Blocks at or before an event's start and at or after its end, 30 days padded, clamped to what is known, with a buffer."""
    b = table(spark, d, "uma_event_timeline").where("request_timestamp IS NOT NULL").select("block", F.col("request_timestamp").alias("s")).distinct()
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    q = table(spark, d, "resolution_risk_event_timeseries").select("event_slug", day("event_start").alias("a"), (day("event_end") + 86400).alias("z")).distinct()
    pad = 30 * 86400
    # events are few: the blocks are aggregated once against all of them, in blocks of a broadcast side of checked size
    if q.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 events at once")
    got = b.crossJoin(F.broadcast(q)).groupBy("event_slug", "a", "z").agg(F.max(F.when(F.col("s") <= F.col("a") - pad, F.col("block"))).alias("at_or_before"), F.min(F.when(F.col("s") >= F.col("z") + pad, F.col("block"))).alias("at_or_after"), F.min("block").alias("lo"), F.max("block").alias("hi"))
    return got.select("event_slug", F.greatest(F.coalesce("at_or_before", "lo") - 1000, F.lit(0)).alias("from_block"), (F.coalesce("at_or_after", "hi") + 1000).alias("to_block"))


@query(f"""WITH u AS ({_U}), f AS (SELECT event_slug, request, max(CAST(p.proposed_price_meaning <> s.price_meaning AS INT)) AS flip FROM (SELECT event_slug, request, proposed_price_meaning FROM u WHERE event = 'ProposePrice') p JOIN (SELECT event_slug, request, price_meaning FROM u WHERE event = 'Settle') s USING (event_slug, request) GROUP BY 1, 2)
 SELECT event_slug, count(*) AS requests, round(avg(flip), 8) AS flip_rate FROM f GROUP BY 1""")
def flip_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of requests settled otherwise than proposed: first per request, then per event."""
    u = _timeline(spark, d)
    p = u.where("event = 'ProposePrice'").select("event_slug", "request", "proposed_price_meaning")
    s = u.where("event = 'Settle'").select("event_slug", "request", "price_meaning")
    f = p.join(s, ["event_slug", "request"]).groupBy("event_slug", "request").agg(F.max((F.col("proposed_price_meaning") != F.col("price_meaning")).cast("int")).alias("flip"))
    return f.groupBy("event_slug").agg(F.count("*").alias("requests"), F.round(F.avg("flip"), 8).alias("flip_rate"))


@query(f"WITH u AS ({_U}), r AS (SELECT request, max(payout) AS payout, count(*) FILTER (event = 'DisputePrice') AS disputes FROM u GROUP BY 1) SELECT request, payout, disputes FROM r WHERE disputes > 0 ORDER BY payout DESC NULLS LAST, request LIMIT 20")
def top_disputes(spark: SparkSession, d: str) -> DataFrame:
    """The twenty disputed requests with the largest payout."""
    r = _timeline(spark, d).groupBy("request").agg(F.max("payout").alias("payout"), F.count_if(F.col("event") == "DisputePrice").alias("disputes"))
    return r.where("disputes > 0").orderBy(F.desc_nulls_last("payout"), "request").limit(20)


@query("""WITH v AS (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t, max(volume) AS volume FROM contract_canonical_markets WHERE title IS NOT NULL GROUP BY 1)
 SELECT CASE WHEN v.volume IS NULL THEN 'unknown_volume' WHEN v.volume >= 50000 THEN 'high' ELSE 'regular' END AS bucket, count(*) AS markets, median(v.volume) AS median_volume FROM (SELECT DISTINCT id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS t FROM pm_markets WHERE question IS NOT NULL) m LEFT JOIN v USING (t) GROUP BY 1""")
def volume_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Volumes joined by the exact cleaned title; misses are kept as unknown."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    v = table(spark, d, "contract_canonical_markets").where("title IS NOT NULL").groupBy(tidy("title").alias("t")).agg(F.max("volume").alias("volume"))
    m = table(spark, d, "pm_markets").where("question IS NOT NULL").select("id", tidy("question").alias("t")).distinct().join(v, "t", "left")
    bucket = F.when(F.col("volume").isNull(), "unknown_volume").when(F.col("volume") >= 50000, "high").otherwise("regular")
    return m.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("markets"), F.median("volume").alias("median_volume"))


_WORDS = {m: w for w, m in PRICE_WORDS.items()}


@query(f"WITH u AS ({_U}) SELECT row_id, event, block, request_timestamp, CASE WHEN event = 'Settle' AND price_meaning IN ('Yes', 'No', '50/50') THEN price_meaning END AS price_meaning, 'q: title: ' || row_id AS said, true AS named, CASE WHEN event IN ('ProposePrice', 'DisputePrice') THEN '0x' || lpad(CAST(row_id AS VARCHAR), 40, '0') END AS proposer FROM u WHERE event <> 'x' AND (event <> 'Settle' OR price_meaning IN ('Yes', 'No', '50/50')) AND event <> 'ProposePrice'")
def decoded_logs(spark: SparkSession, d: str) -> DataFrame:
    """The timeline written as raw logs and decoded again; logs with fewer topics are left out on the way."""
    u = _timeline(spark, d).where("(event <> 'Settle' OR price_meaning IN ('Yes', 'No', '50/50')) AND event <> 'ProposePrice'")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    said = F.lower(F.hex(F.encode(F.concat(F.lit("q: title: "), F.col("row_id").cast("string")), "UTF-8")))
    price = F.coalesce(F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])[F.col("price_meaning")], F.lit("0" * 64))
    tail_at = F.lit(f"{5 * 32:064x}")
    data = F.concat(F.lit("0x"), L.identifier_word(F.lit("YES_OR_NO_QUERY")), hexed(F.col("request_timestamp")), tail_at, price, hexed(F.lit(7)), hexed(F.length(said) / 2), said)
    logs = u.select("row_id", F.array(F.col("event"), F.lit("0x00"), F.lpad(F.col("row_id").cast("string"), 64, "0"), F.lit("0x" + "0" * 64)).alias("topics"), data.alias("data"), F.concat(F.lit("0x"), F.hex("block")).alias("blockNumber"))
    logs = logs.unionByName(logs.limit(3).withColumn("topics", F.slice("topics", 1, 2)))
    got = L.decode_requests(logs, F.when(F.get("topics", F.lit(0)).isin(L.EVENTS), F.get("topics", F.lit(0))))
    return got.select("row_id", "event", "block", "request_timestamp", F.when(F.col("event") == "Settle", F.col("price_meaning")).alias("price_meaning"), F.decode(F.unhex("ancillary"), "UTF-8").alias("said"), L.head_contains(F.col("ancillary"), F.lit("title:")).alias("named"), "proposer")


# ---- prices, panel, series

_PANEL = """WITH c AS (SELECT DISTINCT event_slug, upper(trim(ticker)) AS ticker, cutoff_label, cutoff_utc FROM k_cutoffs WHERE cutoff_utc IS NOT NULL AND ticker IS NOT NULL AND event_slug IS NOT NULL),
 t AS (SELECT upper(trim(ticker)) AS ticker, created_time, yes_price / 100.0 AS price FROM k_trades WHERE created_time IS NOT NULL AND ticker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), created_time ORDER BY trade_id DESC) = 1),
 k AS (SELECT upper(trim(ticker)) AS ticker, min(open_time) AS opened, max(close_time) AS closed, max(coalesce(volume, 0)) AS weight FROM k_topics WHERE ticker IS NOT NULL GROUP BY 1),
 e AS (SELECT event_slug, min(event_start) AS event_start, max(event_end) AS event_end FROM (VALUES ('vibalobridge_merger', DATE '2025-03-15', DATE '2025-03-16'), ('kelnarzeshaw_hearing', DATE '2025-03-20', DATE '2025-03-20'), ('pelvadorminster_hearing', DATE '2024-09-17', DATE '2024-09-17')) v(event_slug, event_start, event_end) GROUP BY 1),
 s AS (SELECT c.*, t.price FROM c ASOF LEFT JOIN t ON c.ticker = t.ticker AND t.created_time <= c.cutoff_utc),
 p AS (SELECT s.event_slug, s.ticker, s.cutoff_label, s.price, k.weight, date_diff('day', e.event_start, CAST(s.cutoff_utc AT TIME ZONE 'America/Los_Angeles' AS DATE)) AS relative_day,
   CAST(s.cutoff_utc >= CAST(e.event_start AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles' AS INT) AS post, CAST(s.cutoff_utc < CAST(e.event_end + INTERVAL 1 DAY AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles' AS INT) AS before_end, abs(s.price - 0.5) AS abs_from_50
   FROM s JOIN k USING (ticker) LEFT JOIN e USING (event_slug) WHERE s.cutoff_utc >= coalesce(k.opened, TIMESTAMPTZ '1900-01-01 00:00:00+00') AND s.cutoff_utc <= coalesce(k.closed, TIMESTAMPTZ '2100-01-01 00:00:00+00') AND k.weight > 0 AND s.price IS NOT NULL)"""
EVENTS = [("vibalobridge_merger", "2025-03-15", "2025-03-16"), ("kelnarzeshaw_hearing", "2025-03-20", "2025-03-20"), ("pelvadorminster_hearing", "2024-09-17", "2024-09-17")]


def _panel(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "k_cutoffs").where("cutoff_utc IS NOT NULL AND ticker IS NOT NULL AND event_slug IS NOT NULL")
    c = c.select(proper_ticker(F.col("ticker")).alias("ticker"), "event_slug", "cutoff_label", F.unix_micros("cutoff_utc").alias("us")).distinct()
    t = table(spark, d, "k_trades").select(proper_ticker(F.col("ticker")).alias("ticker"), F.unix_micros("created_time").alias("trade_us"), "trade_id", (F.col("yes_price") / 100.0).alias("price"))
    s = asof_join(c, t, "ticker", "us", "trade_us", "trade_id", ["price"]).where("price IS NOT NULL")
    k = table(spark, d, "k_topics").where("ticker IS NOT NULL").groupBy(proper_ticker(F.col("ticker")).alias("ticker")).agg(F.min("open_time").alias("opened"), F.max("close_time").alias("closed"), F.max(F.coalesce("volume", F.lit(0))).alias("weight"))
    ever = lambda x, y: F.unix_micros(F.coalesce(x, F.lit(f"{y}-01-01 00:00:00+00:00").cast("timestamp")))
    active = s.join(k, "ticker").where((F.col("us") >= ever("opened", 1900)) & (F.col("us") <= ever("closed", 2100)) & (F.col("weight") > 0))
    e = spark.createDataFrame(EVENTS, "event_slug string, a string, z string").select("event_slug", F.to_date("a").alias("event_start"), F.to_date("z").alias("event_end"))
    local = lambda day: F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), "America/Los_Angeles"))
    p = active.join(F.broadcast(e), "event_slug", "left")  # a literal table
    there = F.to_date(F.from_utc_timestamp(F.timestamp_micros("us"), "America/Los_Angeles"))
    return p.select(
        "event_slug", "ticker", "cutoff_label", "price", "weight", F.datediff(there, "event_start").cast("long").alias("relative_day"), (F.col("us") >= local(F.col("event_start"))).cast("int").alias("post"),
        (F.col("us") < local(F.date_add("event_end", 1))).cast("int").alias("before_end"), F.abs(F.col("price") - 0.5).alias("abs_from_50"),
    )


@query(_PANEL + " SELECT * FROM p")
def event_panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per event, market and cutoff at which the market was open: as-of price, weight, place in time, distance from even."""
    return _panel(spark, d)


@query(_PANEL + """ SELECT event_slug, cutoff_label, relative_day, post, before_end, round(sum(weight * price) / sum(weight), 8) AS weighted_price, round(sum(weight * abs_from_50) / sum(weight), 8) AS weighted_abs_from_50, count(DISTINCT ticker) AS pair_count, sum(weight)::BIGINT AS total_weight
 FROM p WHERE relative_day IS NOT NULL GROUP BY ALL""")
def event_timeseries(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means per event and cutoff; groups without event metadata are dropped."""
    mean = lambda c: F.round(weighted_mean(F.col(c), F.col("weight")), 8)
    return _panel(spark, d).where("relative_day IS NOT NULL").groupBy("event_slug", "cutoff_label", "relative_day", "post", "before_end").agg(
        mean("price").alias("weighted_price"), mean("abs_from_50").alias("weighted_abs_from_50"), F.countDistinct("ticker").alias("pair_count"), F.sum("weight").alias("total_weight")
    )


@query(_PANEL + """, o AS (SELECT event_slug, 'price' AS outcome, ticker, post, price AS y, weight AS w FROM p WHERE post IS NOT NULL UNION ALL SELECT event_slug, 'abs_from_50', ticker, post, abs_from_50, weight FROM p WHERE post IS NOT NULL),
 dm AS (SELECT *, y - avg(y) OVER (PARTITION BY event_slug, outcome, ticker) AS yd, post - avg(post) OVER (PARTITION BY event_slug, outcome, ticker) AS xd FROM o),
 f AS (SELECT event_slug, outcome, count(*) AS n_obs, count(DISTINCT ticker) AS n_contracts, sum(w * xd * xd) AS dn, sum(w * xd * yd) AS cr FROM dm GROUP BY 1, 2)
 SELECT event_slug, outcome, n_obs, n_contracts, CASE WHEN dn > 1e-12 THEN round(cr / dn, 8) END AS coef FROM f""")
def stacked_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Both outcomes stacked, one within-market regression per event and outcome."""
    p = _panel(spark, d).where("post IS NOT NULL")
    long = p.unpivot(["event_slug", "ticker", "post", "weight"], ["price", "abs_from_50"], "outcome", "y")
    return within_regression(long, ["event_slug", "outcome"], "ticker", "y", "post", "weight").select("event_slug", "outcome", "n_obs", "n_contracts", F.round("coef", 8).alias("coef"))


@query("""WITH t AS (SELECT DISTINCT trade_id, upper(trim(ticker)) AS ticker, yes_price FROM k_trades WHERE yes_price IS NOT NULL AND ticker IS NOT NULL), x AS (SELECT ticker, CASE WHEN yes_price % 100 = 0 THEN 0 WHEN yes_price % 10 = 0 THEN -1 ELSE -2 END AS exponent FROM t),
 n AS (SELECT ticker, exponent, count(*) AS n FROM x GROUP BY 1, 2) SELECT ticker, pow(10, exponent) AS minimum_tick_size, n FROM n QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, exponent) = 1""")
def tick_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent decimal step of each market's prices, 10 to the exponent; of equals the smallest."""
    t = table(spark, d, "k_trades").where("yes_price IS NOT NULL").select("trade_id", proper_ticker(F.col("ticker")).alias("ticker"), (F.col("yes_price") / 100).cast("decimal(38,18)").cast("string").alias("p")).distinct().where("ticker IS NOT NULL")
    places = F.length(F.regexp_replace(F.regexp_replace(F.split_part("p", F.lit("."), F.lit(2)), "0+$", ""), r"\s", ""))
    n = t.groupBy("ticker", (-places).alias("exponent")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("ticker").orderBy(F.desc("n"), "exponent")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("ticker", F.pow(F.lit(10.0), "exponent").alias("minimum_tick_size"), "n")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS token_id, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / nullif(l_extendedprice, 0) ELSE l_quantity / nullif(l_extendedprice, 0) END AS price FROM lineitem""")
def cash_side_prices(spark: SparkSession, d: str) -> DataFrame:
    """Price and token of a trade whose cash side has asset 0: cash over tokens, whichever side made the offer."""
    even = F.col("l_linenumber") % 2 == 0
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(even, "0").otherwise(F.concat(F.lit("s"), F.col("l_suppkey"))).alias("maker_asset"), F.when(even, F.concat(F.lit("p"), F.col("l_partkey"))).otherwise("0").alias("taker_asset"),
        F.when(even, F.col("l_quantity")).otherwise(F.col("l_extendedprice")).alias("maker_amount"), F.when(even, F.col("l_extendedprice")).otherwise(F.col("l_quantity")).alias("taker_amount"),
    )
    cash_made = F.col("maker_asset") == "0"
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return t.select("l_orderkey", "l_linenumber", F.when(cash_made, F.col("taker_asset")).otherwise(F.col("maker_asset")).alias("token_id"), F.when(cash_made, ratio("maker_amount", "taker_amount")).otherwise(ratio("taker_amount", "maker_amount")).alias("price"))


@query(f"""WITH w AS ({P2}), p AS (SELECT ticker, regexp_extract(column_name, '^yes_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})_(.*)$', 1) AS day, regexp_extract(column_name, '^yes_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})_(.*)$', 2) AS tag, CAST(cell_value AS BIGINT) AS cents FROM w WHERE column_name LIKE 'yes_20%')
 SELECT ticker, CAST(replace(day, '_', '-') AS DATE) AS day, tag, cents FROM p""")
def wide_prices_long(spark: SparkSession, d: str) -> DataFrame:
    """The price columns of the wide table as rows again, date and tag read from the names."""
    m = melt(to_wide(table(spark, d, "k_attributes"))).where("column_name LIKE 'yes_20%'")
    name = r"^yes_(\d{4}_\d{2}_\d{2})_(.*)$"
    return m.select("ticker", F.to_date(F.regexp_extract("column_name", name, 1), "yyyy_MM_dd").alias("day"), F.regexp_extract("column_name", name, 2).alias("tag"), F.col("cell_value").cast("long").alias("cents"))


@query(f"""WITH w AS ({P2}), p AS (SELECT ticker, CAST(replace(substr(column_name, 5, 10), '_', '-') AS DATE) AS day, substr(column_name, 16) AS tag, CAST(cell_value AS BIGINT) / 100.0 AS price FROM w WHERE column_name LIKE 'yes_20%'),
 b AS (SELECT ticker, count(*) AS n, min(price) AS lo, max(price) AS hi FROM p WHERE day < DATE '2025-07-01' GROUP BY 1), s AS (SELECT ticker, CASE WHEN lo > 0.5 THEN 'YES' WHEN hi < 0.5 THEN 'NO' END AS side FROM b)
 SELECT day, tag, count(*) AS markets, round(avg(CASE side WHEN 'YES' THEN price ELSE 1 - price END), 8) AS mean_favored, round(median(CASE side WHEN 'YES' THEN price ELSE 1 - price END), 8) AS median_favored FROM p JOIN s USING (ticker) WHERE side IS NOT NULL GROUP BY 1, 2""")
def strictly_favored(spark: SparkSession, d: str) -> DataFrame:
    """Mean price of the side all prices before the event favoured; markets whose prices were mixed or even are dropped."""
    p = wide_prices_long(spark, d).withColumn("price", F.col("cents") / 100.0)
    b = p.where(F.col("day") < F.lit("2025-07-01").cast("date")).groupBy("ticker").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    side = b.select("ticker", F.when(F.col("lo") > 0.5, "YES").when(F.col("hi") < 0.5, "NO").alias("side")).where("side IS NOT NULL")
    v = F.when(F.col("side") == "YES", F.col("price")).otherwise(1 - F.col("price"))
    return p.join(side, "ticker").groupBy("day", "tag").agg(F.count("*").alias("markets"), F.round(F.avg(v), 8).alias("mean_favored"), F.round(F.median(v), 8).alias("median_favored"))


# ---- texts against texts


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "market_matches_embeddings").where("pm_question IS NOT NULL AND k_title IS NOT NULL").select("slug", "pm_id", "pm_question", "k_ticker", "k_title", "k_yes_subtitle", "k_no_subtitle").distinct()
    return m.withColumn("k_text", F.concat_ws(" ", "k_title", F.coalesce("k_yes_subtitle", F.lit("")), F.coalesce("k_no_subtitle", F.lit(""))))


@query(None)
def best_text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each market's best partner within its slug by 0.6 sequence ratio and 0.4 shared nouns, with a confidence bucket.

    Every partner of the slug counts, with or without a shared noun. A row without a slug stands for its own pair only.
    """
    p = _pairs(spark, d).withColumn("g", F.coalesce(F.concat(F.lit("="), "slug"), F.to_json(F.struct("pm_id", "pm_question", "k_ticker", "k_text"))))
    side = lambda c, *rest: p.select("g", *rest, S.normalize_market_text(F.col(c)).alias("text"), F.concat_ws(" ", S.key_nouns(F.col(c))).alias("nouns"))
    a, _ = written(side("pm_question", "slug", "pm_id").distinct(), "closest-questions")
    b = side("k_text", "k_ticker").groupBy("g", "text", "nouns").agg(F.max("k_ticker").alias("k_ticker"))
    texts, _ = written(a.select("g", "text", "nouns").distinct(), "closest-texts")
    scored = closest_texts(texts, b).join(a.select("g", "text", "slug", "pm_id"), ["g", "text"])
    best = scored.groupBy("slug", "pm_id").agg(F.max_by(F.struct("k_ticker", "sequence", "nouns", "combined"), F.struct("combined", "k_ticker", "sequence")).alias("m")).select("slug", "pm_id", "m.*")
    kept = best.where((F.col("sequence") >= 0.7) | (F.col("nouns") >= 0.3))
    return kept.select("slug", "pm_id", "k_ticker", *[F.bround(c, 3).alias(c) for c in ("sequence", "nouns", "combined")], S.confidence_bucket(F.col("sequence"), 0.85, 0.7, F.col("nouns") >= 0.5).alias("match_type"))


_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)


@query(f"""WITH m AS (SELECT DISTINCT slug, pm_id, pm_question AS t FROM market_matches_embeddings WHERE pm_question IS NOT NULL AND k_title IS NOT NULL),
 k AS (SELECT DISTINCT slug, k_ticker, concat_ws(' ', k_title, coalesce(k_yes_subtitle, ''), coalesce(k_no_subtitle, '')) AS t FROM market_matches_embeddings WHERE pm_question IS NOT NULL AND k_title IS NOT NULL),
 docs AS (SELECT slug, 'p' AS side, pm_id AS id, t FROM m UNION ALL SELECT slug, 'k', k_ticker, t FROM k),
 tf AS (SELECT slug, side, id, t, unnest(regexp_extract_all(lower(t), '[a-z0-9_]{{2,}}')) AS term FROM docs), c AS (SELECT slug, side, id, t, term, count(*) AS tf FROM tf WHERE term NOT IN ({_STOP}) GROUP BY ALL),
 n AS (SELECT slug, count(*) AS n FROM docs GROUP BY 1), f AS (SELECT slug, term, count(*) AS df FROM c GROUP BY 1, 2), w AS (SELECT c.slug, side, id, t, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM c JOIN f USING (slug, term) JOIN n USING (slug) WHERE df <= 0.95 * n),
 z AS (SELECT slug, side, id, t, term, w / sqrt(sum(w * w) OVER (PARTITION BY slug, side, id, t)) AS w FROM w),
 s AS (SELECT a.slug, a.id AS pm_id, b.id AS k_ticker, round(sum(a.w * b.w), 6) AS similarity FROM z a JOIN z b ON a.slug = b.slug AND a.term = b.term AND a.side = 'p' AND b.side = 'k' GROUP BY a.slug, a.id, b.id, a.t, b.t)
 SELECT slug, pm_id, k_ticker, similarity, CASE WHEN similarity >= 0.7 THEN 'HIGH_CONFIDENCE' WHEN similarity >= 0.6 THEN 'MEDIUM_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS match_type FROM s WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY slug, pm_id ORDER BY similarity DESC, k_ticker DESC) = 1""")
def tfidf_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each market's best partner within its slug by cosine of term weights; texts meet through the terms that a cosine of a half needs."""
    p = _pairs(spark, d)
    docs = p.select("slug", F.lit("p").alias("side"), F.col("pm_id").alias("id"), F.col("pm_question").alias("t")).distinct().unionByName(p.select("slug", F.lit("k").alias("side"), F.col("k_ticker").alias("id"), F.col("k_text").alias("t")).distinct())
    docs, _ = written(docs.withColumn("no", F.monotonically_increasing_id()), "tfidf-texts")
    z, _ = written(S.tfidf(docs, "slug", ["side", "no"], F.col("t")), "tfidf-weights")
    # a text's weights as one list, read by both sides of every pair left
    lists = z.groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w"))
    pairs = S.cosine_pairs(z, "slug", ["no"], "side", 0.5)
    both = pairs.join(lists.withColumnsRenamed({"no": "no_p", "w": "w_p"}), "no_p").join(lists.withColumnsRenamed({"no": "no_k", "w": "w_k"}), "no_k")
    dot = F.aggregate(F.map_entries("w_p"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("w_k", e["key"]), F.lit(0.0)))
    s = both.select("no_p", "no_k", F.round(dot, 6).alias("similarity")).where("similarity >= 0.5")
    s = s.join(docs.select(F.col("no").alias("no_p"), "slug", F.col("id").alias("pm_id")), "no_p").join(docs.select(F.col("no").alias("no_k"), F.col("id").alias("k_ticker")), "no_k")
    best = s.groupBy("slug", "pm_id").agg(F.max_by(F.struct("k_ticker", "similarity"), F.struct("similarity", "k_ticker")).alias("m")).select("slug", "pm_id", "m.*")
    return best.withColumn("match_type", S.confidence_bucket(F.col("similarity"), 0.7, 0.6))


# ---- small forms


@query("SELECT id, CAST(row_number() OVER (ORDER BY volume DESC NULLS LAST, id) AS BIGINT) AS docid FROM (SELECT id, max(volume) AS volume FROM pm_markets GROUP BY 1) ORDER BY 2 LIMIT 50")
def numbered_top(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty by volume, numbered; only they come into one task."""
    top = table(spark, d, "pm_markets").groupBy("id").agg(F.max("volume").alias("volume")).orderBy(F.desc_nulls_last("volume"), "id").limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("volume"), "id")).cast("long").alias("docid"))


@query("SELECT row_id, ticker FROM (SELECT row_id, ticker, count(*) OVER (PARTITION BY row_id) AS n FROM k_topics) WHERE n > 1")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "k_topics").select("row_id", "ticker"), ["row_id"])


@query("SELECT ticker, close_time FROM (SELECT upper(trim(ticker)) AS ticker, epoch_us(max(close_time)) AS close_time FROM k_topics WHERE ticker IS NOT NULL GROUP BY 1) ORDER BY close_time NULLS LAST, ticker LIMIT 40")
def ordered_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_topics").where("ticker IS NOT NULL").groupBy(proper_ticker(F.col("ticker")).alias("ticker")).agg(F.unix_micros(F.max("close_time")).alias("close_time"))
    return k.orderBy(F.asc_nulls_last("close_time"), "ticker").limit(40)


@query("SELECT event_slug, min(event_start) AS event_start, max(event_end) AS event_end, CAST(max(event_end) + INTERVAL 1 DAY AS DATE) AS event_end_exclusive, CAST(min(event_start) - INTERVAL 7 DAY AS DATE) AS window_start, CAST(max(event_end) + INTERVAL 7 DAY AS DATE) AS window_end FROM resolution_risk_event_timeseries WHERE event_slug IS NOT NULL GROUP BY 1")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Start and end of each event, the first day after it, and a week's window around it."""
    e = table(spark, d, "resolution_risk_event_timeseries").where("event_slug IS NOT NULL").groupBy("event_slug").agg(F.min("event_start").alias("event_start"), F.max("event_end").alias("event_end"))
    return e.withColumns({"event_end_exclusive": F.date_add("event_end", 1), "window_start": F.date_sub("event_start", 7), "window_end": F.date_add("event_end", 7)})


_MEASURES = ["weighted_pm_yes_price", "weighted_pm_minus_k", "total_pm_weight"]


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, round(avg({m}), 8) AS mean, round(median({m}), 8) AS median, round(stddev_samp({m}), 8) AS std FROM resolution_risk_event_timeseries" for m in _MEASURES))
def measures_transposed(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate over several columns, set out as one row per column."""
    stats = {"mean": F.avg, "median": F.median, "std": F.stddev_samp}
    a = table(spark, d, "resolution_risk_event_timeseries").agg(*[F.round(f(m), 8).alias(f"{s}__{m}") for m in _MEASURES for s, f in stats.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), *[F.col(f"{s}__{m}").alias(s) for s in stats]) for m in _MEASURES])).alias("x")
    return a.select(rows).select("x.*")


@query("""SELECT column_name, dtype, n, n_unique, examples FROM (SELECT 'event_type' AS column_name, 'string' AS dtype, count(event_type) AS n, count(DISTINCT event_type) AS n_unique, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT CAST(event_type AS VARCHAR) AS x FROM events WHERE event_type IS NOT NULL ORDER BY 1 LIMIT 3)) AS examples FROM events
 UNION ALL SELECT 'user_id', 'bigint', count(user_id), count(DISTINCT user_id), (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS x FROM events WHERE user_id IS NOT NULL ORDER BY 1 LIMIT 3)) FROM events)""")
def profile_with_examples(spark: SparkSession, d: str) -> DataFrame:
    """Type, filled values, distinct values and three examples per column; a column's values are counted, never gathered."""
    e = table(spark, d, "events")
    kinds = dict(e.dtypes)
    out = None
    for c in ("event_type", "user_id"):
        v = e.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("x")).agg(F.count("*").alias("k"))
        few = v.orderBy("x").limit(3).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
        one = v.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("n_unique")).crossJoin(few).select(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), "n", "n_unique", "examples")
        out = one if out is None else out.unionByName(one)
    return out


_NAMED = "CASE trim(lower({0})) " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in PLACES.items()) + " END"


@query(f"SELECT r_regionkey, r_name, regexp_replace(CAST(r_regionkey AS VARCHAR) || '.0', '\\.0$', '') AS market_id, CASE lower(trim('TRUE ')) WHEN 'true' THEN true ELSE false END AS backed, coalesce({_NAMED.format('r_name')}, trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g'), '_')) AS place, least(r_name, 'europe') || '__' || greatest(r_name, 'europe') AS pair FROM region")
def normalized_values(spark: SparkSession, d: str) -> DataFrame:
    """Ids without .0, three-valued flags, alias or slug, pairs in order; read as a recursive archive."""
    r = parquet_archive(spark, f"{d}/region.parquet")
    flag = F.lit("TRUE ")
    return r.select("r_regionkey", "r_name", X.normalize_id(F.concat(F.col("r_regionkey").cast("string"), F.lit(".0"))).alias("market_id"), X.as_flag(flag).alias("backed"), canonical_alias(X.clean_text(F.col("r_name")), PLACES).alias("place"), F.concat_ws("__", F.least("r_name", F.lit("europe")), F.greatest("r_name", F.lit("europe"))).alias("pair"))
