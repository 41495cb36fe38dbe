"""Queries of the event-study operators, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions.hexid import canonical_hex, normalize_hex
from eventloom.operators.asof import asof_join, cutoff_grid, weighted_mean
from eventloom.operators.regress import within_regression
from eventloom.operators.vectors import nearest_vectors
from eventloom.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


GRID_SQL = """
 g AS (SELECT strftime(d, '%Y_%m_%d') || '_' || tag AS cutoff_label, CAST(d AS DATE) AS local_date, (CAST(d AS TIMESTAMP) + to_hours(CAST(h AS BIGINT))) AT TIME ZONE 'America/Los_Angeles' AS cutoff_utc
       FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) s(d), (VALUES ('open_0500_PT', 5), ('close_1700_PT', 17)) t(tag, h))"""


def _grid(spark: SparkSession) -> DataFrame:
    return cutoff_grid(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 30))


@query(f"WITH {GRID_SQL} SELECT cutoff_label, local_date, epoch_us(cutoff_utc) AS cutoff_us FROM g")
def cutoff_calendar(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark).select("cutoff_label", "local_date", F.unix_micros("cutoff_utc").alias("cutoff_us"))


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("trade_us"), "value")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    p = _purchases(spark, d)
    grid = _grid(spark).select("cutoff_label", F.unix_micros("cutoff_utc").alias("cutoff_us"))
    targets = p.select("user_id").distinct().crossJoin(F.broadcast(grid))  # the calendar is of fixed length
    return asof_join(targets, p, "user_id", "cutoff_us", "trade_us", "event_id", ["value"])


SNAP_SQL = f"""WITH {GRID_SQL},
 p AS (SELECT user_id, event_id, epoch_us(ts) AS trade_us, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
 t AS (SELECT user_id, cutoff_label, epoch_us(cutoff_utc) AS cutoff_us FROM (SELECT DISTINCT user_id FROM p), g),
 s AS (SELECT t.user_id, t.cutoff_us, t.cutoff_label, p.trade_us AS source_trade_us, p.value FROM t ASOF LEFT JOIN p ON t.user_id = p.user_id AND p.trade_us <= t.cutoff_us)"""


@query(SNAP_SQL + " SELECT user_id, cutoff_us, cutoff_label, source_trade_us, value FROM s")
def asof_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d)


@query(SNAP_SQL + " SELECT cutoff_label, round(sum(value * user_id) / sum(CASE WHEN value IS NOT NULL THEN user_id END), 6) AS weighted_value, count(value) AS n_prices FROM s WHERE user_id > 0 GROUP BY 1")
def weighted_asof_series(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d).where("user_id > 0").groupBy("cutoff_label").agg(F.round(weighted_mean(F.col("value"), F.col("user_id")), 6).alias("weighted_value"), F.count("value").alias("n_prices"))


_ALL = [f"2024_01_{x:02d}_{t}" for x in range(1, 31) for t in ("open_0500_PT", "close_1700_PT")]


@query(SNAP_SQL + " SELECT user_id, " + ", ".join(f"max(CASE WHEN cutoff_label = '{c}' THEN value END) AS \"yes_{c}\"" for c in _ALL) + " FROM s GROUP BY 1")
def snapshots_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every cutoff of the calendar as a column."""
    w = _snapshots(spark, d).groupBy("user_id").pivot("cutoff_label", _ALL).agg(F.first("value"))
    return w.select("user_id", *[F.col(c).alias(f"yes_{c}") for c in _ALL])


@query("SELECT user_id, epoch_us(v.ts) AS ts_us, event_id FROM events v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id")


@query("SELECT ticker, volume FROM (SELECT upper(trim(ticker)) AS ticker, max(coalesce(volume, 0)) AS volume FROM k_topics GROUP BY 1) ORDER BY volume DESC, ticker LIMIT 100")
def top_n_by_volume(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_topics").groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.max(F.coalesce("volume", F.lit(0))).alias("volume"))
    return k.orderBy(F.desc("volume"), "ticker").limit(100)


@query("SELECT DISTINCT id FROM pm_markets WHERE created_at <= TIMESTAMPTZ '2025-03-24 07:00:00+00' AND coalesce(end_date, TIMESTAMPTZ '2100-01-01 00:00:00+00') >= TIMESTAMPTZ '2025-03-24 07:00:00+00'")
def active_window_filter(spark: SparkSession, d: str) -> DataFrame:
    at, never = F.lit("2025-03-24 07:00:00+00:00").cast("timestamp"), F.lit("2100-01-01 00:00:00+00:00").cast("timestamp")
    return table(spark, d, "pm_markets").where((F.col("created_at") <= at) & (F.coalesce("end_date", never) >= at)).select("id").distinct()


@query("SELECT DISTINCT upper(trim(ticker)) AS ticker FROM k_topics WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(yes_sub_title, '') || ' ' || coalesce(no_sub_title, '')), '(mayor|senate|senator|president)')")
def topic_regex_filter(spark: SparkSession, d: str) -> DataFrame:
    search = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "yes_sub_title", "no_sub_title")]))
    return table(spark, d, "k_topics").where(search.rlike("(mayor|senate|senator|president)")).select(F.upper(F.trim("ticker")).alias("ticker")).distinct()


@query("""SELECT trade_id, upper(trim(ticker)) AS ticker, yes_price / 100.0 AS price, 1 - yes_price / 100.0 AS no_price FROM (SELECT DISTINCT trade_id, ticker, yes_price FROM k_trades) WHERE yes_price IS NOT NULL""")
def cents_to_probability(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "k_trades").select("trade_id", "ticker", "yes_price").distinct().where("yes_price IS NOT NULL")
    return t.select("trade_id", F.upper(F.trim("ticker")).alias("ticker"), (F.col("yes_price") / 100.0).alias("price"), (1 - F.col("yes_price") / 100.0).alias("no_price"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / nullif(l_quantity, 0) ELSE l_quantity / nullif(l_extendedprice, 0) END AS price FROM lineitem""")
def price_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    price = F.when(F.col("l_linenumber") % 2 == 0, ratio("l_extendedprice", "l_quantity")).otherwise(ratio("l_quantity", "l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_key_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT id FROM pm_markets WHERE id NOT IN (SELECT pm_id FROM market_matches_embeddings WHERE pm_id IS NOT NULL)")
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "market_matches_embeddings").select(F.col("pm_id").alias("id"))
    return table(spark, d, "pm_markets").select("id").distinct().join(m, "id", "left_anti")


@query("""SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, round(sum(l_quantity * l_discount), 4) / nullif(sum(l_quantity), 0) AS weighted_discount, count(DISTINCT o_orderkey) AS pair_count, round(sum(l_quantity), 4) AS total_weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 GROUP BY 1, 2""")
def weighted_timeseries(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        (F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4) / F.sum("l_quantity")).alias("weighted_discount"), F.countDistinct("o_orderkey").alias("pair_count"), F.round(F.sum("l_quantity"), 4).alias("total_weight")
    )


def _reg_sql(by: str) -> str:
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    part = f"PARTITION BY {g}l_suppkey"
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH d AS (SELECT {g}l_suppkey, l_quantity AS w, l_extendedprice AS y, CAST(l_shipdate >= TIMESTAMP '1997-06-01' AS INT) AS p FROM lineitem WHERE l_quantity > 0),
 e AS (SELECT *, y - avg(y) OVER ({part}) AS yd, p - avg(p) OVER ({part}) AS xd FROM d),
 f AS (SELECT {g}count(*) AS n_obs, count(DISTINCT l_suppkey) AS n_contracts, sum(w * xd * xd) AS denom, sum(w * xd * yd) AS cr, sum(CASE WHEN p = 0 THEN w * y END) / sum(CASE WHEN p = 0 THEN w END) AS pre_mean,
       sum(CASE WHEN p = 1 THEN w * y END) / sum(CASE WHEN p = 1 THEN w END) AS post_mean FROM e {group}),
 r AS (SELECT {g.replace(by, 'e.' + by) if by else ''}sum(w * (yd - cr / denom * xd) ** 2) AS rss FROM e JOIN f {on} {('GROUP BY e.' + by) if by else ''})
 SELECT {g}n_obs, n_contracts, round(cr / denom, 5) AS coef, round(sqrt(rss / (n_obs - n_contracts - 1) / denom), 5) AS se, round((cr / denom) / sqrt(rss / (n_obs - n_contracts - 1) / denom), 5) AS t_stat,
   round(pre_mean, 5) AS pre_mean, round(post_mean, 5) AS post_mean, round(post_mean - pre_mean, 5) AS difference FROM f JOIN r {on}"""


def _regress(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("post", (F.col("l_shipdate") >= F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")).cast("int"))
    out = within_regression(li, by, "l_suppkey", "l_extendedprice", "post", "l_quantity")
    return out.select(*by, "n_obs", "n_contracts", *[F.round(c, 5).alias(c) for c in ("coef", "se", "t_stat", "pre_mean", "post_mean", "difference")])


@query(_reg_sql(""))
def fe_regression(spark: SparkSession, d: str) -> DataFrame:
    return _regress(spark, d, [])


@query(_reg_sql("l_returnflag"))
def fe_regression_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _regress(spark, d, ["l_returnflag"])


@query("""WITH t AS (SELECT l_suppkey, CASE WHEN round(l_extendedprice * 100) % 100 = 0 THEN 1.0 WHEN round(l_extendedprice * 100) % 10 = 0 THEN 0.1 ELSE 0.01 END AS tick FROM lineitem)
 SELECT l_suppkey, tick, n FROM (SELECT l_suppkey, tick, count(*) AS n FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, tick) = 1""")
def tick_mode(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100)
    tick = F.when(cents % 100 == 0, 1.0).when(cents % 10 == 0, 0.1).otherwise(0.01)
    n = table(spark, d, "lineitem").groupBy("l_suppkey", tick.alias("tick")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "tick")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 0.5, 0) * 0.5 AS rounded FROM lineitem")
def round_to_tick(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.rint(F.col("l_extendedprice") / 0.5) * 0.5).alias("rounded"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def set_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"))


_C = "SELECT DISTINCT exchange, CASE WHEN exchange = 'kalshi' THEN upper(trim(market_id)) ELSE market_id END AS market_id, contract_key, entity_signature, deadline FROM contract_canonical_markets WHERE contract_key <> ''"


def _canonical(spark: SparkSession, d: str, exchange: str, prefix: str) -> DataFrame:
    c = table(spark, d, "contract_canonical_markets").where((F.col("exchange") == exchange) & (F.col("contract_key") != ""))
    mid = F.upper(F.trim("market_id")) if exchange == "kalshi" else F.col("market_id")
    return c.select(mid.alias(f"{prefix}market_id"), F.col("contract_key").alias(f"{prefix}key"), F.col("entity_signature").alias(f"{prefix}sig"), F.col("deadline").alias(f"{prefix}deadline")).distinct()


@query(f"WITH c AS ({_C}) SELECT DISTINCT p.market_id AS pm_market_id, k.market_id AS k_market_id, p.contract_key FROM c p JOIN c k USING (contract_key) WHERE p.exchange = 'polymarket' AND k.exchange = 'kalshi'")
def key_match(spark: SparkSession, d: str) -> DataFrame:
    p, k = _canonical(spark, d, "polymarket", "pm_"), _canonical(spark, d, "kalshi", "k_")
    return p.join(k, F.col("pm_key") == F.col("k_key")).select("pm_market_id", "k_market_id", F.col("pm_key").alias("contract_key")).distinct()


_FIELDS = ["market_family", "predicate", "subject", "obj", "scope", "deadline", "season", "direction", "threshold"]
_DIFFERS = ", ".join(f"CASE WHEN coalesce(CAST(p.{c} AS VARCHAR), '') <> coalesce(CAST(k.{c} AS VARCHAR), '') THEN '{c}_mismatch:' || coalesce(nullif(CAST(p.{c} AS VARCHAR), ''), '<blank>') || '!=' || coalesce(nullif(CAST(k.{c} AS VARCHAR), ''), '<blank>') END" for c in _FIELDS)


@query(f"""WITH c AS (SELECT DISTINCT exchange, CASE WHEN exchange = 'kalshi' THEN upper(trim(market_id)) ELSE market_id END AS market_id, contract_key, entity_signature, {', '.join(_FIELDS)} FROM contract_canonical_markets WHERE contract_key <> '' AND entity_signature <> '')
 SELECT DISTINCT p.market_id AS pm_market_id, k.market_id AS k_market_id, p.contract_key AS pm_key, k.contract_key AS k_key, coalesce(nullif(concat_ws('; ', {_DIFFERS}), ''), 'same_contract_key') AS reason
 FROM c p JOIN c k USING (entity_signature) WHERE p.exchange = 'polymarket' AND k.exchange = 'kalshi' AND p.contract_key <> k.contract_key""")
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every near miss, with all the fields that differ."""
    c = table(spark, d, "contract_canonical_markets").where("contract_key <> '' AND entity_signature <> ''")

    def side(exchange: str, prefix: str, mid) -> DataFrame:
        fields = [F.col(x).cast("string").alias(prefix + x) for x in _FIELDS]
        return c.where(F.col("exchange") == exchange).select(mid.alias(f"{prefix}market_id"), F.col("contract_key").alias(f"{prefix}key"), "entity_signature", *fields).distinct()

    j = side("polymarket", "pm_", F.col("market_id")).join(side("kalshi", "k_", F.upper(F.trim("market_id"))), "entity_signature").where("pm_key <> k_key")
    reason = X.mismatch(_FIELDS, "pm_", "k_")
    return j.select("pm_market_id", "k_market_id", "pm_key", "k_key", F.when(reason == "", "same_contract_key").otherwise(reason).alias("reason")).distinct()


_LIST = "CASE WHEN json_valid(replace({0}, chr(39), chr(34))) THEN CAST(replace({0}, chr(39), chr(34)) AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END"


@query(f"""WITH m AS (SELECT DISTINCT id, outcomes, clob_token_ids FROM pm_markets), l AS (SELECT id, {_LIST.format('outcomes')} AS o, {_LIST.format('clob_token_ids')} AS k FROM m),
 t AS (SELECT id, o, k, unnest(generate_series(1, len(k))) AS i FROM l) SELECT id, CAST(i - 1 AS INT) AS pos, k[i] AS token_id, coalesce(o[i], 'outcome_' || (i - 1)) AS outcome_name FROM t""")
def explode_outcomes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "pm_markets").select("id", "outcomes", "clob_token_ids").distinct()
    t = m.select("id", X.list_of(F.col("outcomes")).alias("o"), F.posexplode(X.list_of(F.col("clob_token_ids"))).alias("pos", "token_id"))
    return t.select("id", "pos", "token_id", F.coalesce(F.get("o", F.col("pos")), F.concat(F.lit("outcome_"), F.col("pos").cast("string"))).alias("outcome_name"))


@query("SELECT p_partkey, trim(regexp_replace(lower(coalesce(p_name, '')), '\\s+', ' ', 'g')) AS cleaned, trim(regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def clean_and_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.clean_text(F.col("p_name")).alias("cleaned"), X.slugify(F.col("p_name")).alias("slug"))


@query("SELECT DISTINCT link_id, CASE WHEN trim(condition_id) <> '' THEN '0x' || lpad(regexp_replace(lower(trim(condition_id)), '^0x', ''), 64, '0') END AS condition_id FROM pm_neg_risk_uma_request_link")
def hex_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pm_neg_risk_uma_request_link").select("link_id", normalize_hex(F.col("condition_id"), 32).alias("condition_id")).distinct()


@query("""WITH s AS (SELECT DISTINCT row_id, event, price_meaning, proposed_price_meaning FROM uma_event_timeline)
 SELECT row_id, CASE WHEN event = 'Settle' THEN 'settled:' || coalesce(price_meaning, 'unknown') WHEN event = 'DisputePrice' THEN 'disputed' WHEN event = 'ProposePrice' THEN 'proposed:' || coalesce(proposed_price_meaning, 'unknown') ELSE 'requested' END AS state FROM s""")
def resolver_classify(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "uma_event_timeline").select("row_id", "event", "price_meaning", "proposed_price_meaning").distinct()
    said = lambda p, c: F.concat(F.lit(p), F.coalesce(c, F.lit("unknown")))
    state = F.when(F.col("event") == "Settle", said("settled:", "price_meaning")).when(F.col("event") == "DisputePrice", "disputed").when(F.col("event") == "ProposePrice", said("proposed:", "proposed_price_meaning")).otherwise("requested")
    return u.select("row_id", state.alias("state"))


@query("""WITH r AS (SELECT regexp_replace(regexp_replace(lower(trim(request_id)), '^0x', ''), '^0+(.)', '\\1') AS k, count(DISTINCT CASE WHEN event = 'DisputePrice' THEN row_id END) AS disputes, max(CASE WHEN event = 'Settle' THEN payout END) AS payout
   FROM uma_event_timeline WHERE NOT coalesce(removed, false) AND trim(request_id) <> '' GROUP BY 1)
 SELECT CASE WHEN payout >= 1000 THEN 'high' WHEN payout IS NULL THEN 'open' ELSE 'regular' END AS bucket, count(*) AS requests, sum(CAST(disputes > 0 AS BIGINT))::BIGINT AS disputed, round(avg(disputes), 8) AS mean_rounds, median(payout) AS median_payout FROM r GROUP BY 1""")
def dispute_landscape(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "uma_event_timeline").where(~F.coalesce("removed", F.lit(False))).withColumn("k", canonical_hex(F.col("request_id"))).where("k IS NOT NULL")
    r = u.groupBy("k").agg(F.countDistinct(F.when(F.col("event") == "DisputePrice", F.col("row_id"))).alias("disputes"), F.max(F.when(F.col("event") == "Settle", F.nanvl("payout", F.lit(None)))).alias("payout"))
    bucket = F.when(F.col("payout") >= 1000, "high").when(F.col("payout").isNull(), "open").otherwise("regular")
    return r.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("requests"), F.sum((F.col("disputes") > 0).cast("long")).alias("disputed"), F.round(F.avg("disputes"), 8).alias("mean_rounds"), F.median("payout").alias("median_payout"))


_PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique FROM customer" for c in _PROFILED))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").agg(*[f(c).alias(f"{p}_{c}") for c in _PROFILED for p, f in (("n", F.count), ("u", F.countDistinct))], F.count("*").alias("all"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("non_null_count"), (F.col("all") - F.col(f"n_{c}")).alias("null_count"), F.col(f"u_{c}").alias("n_unique")) for c in _PROFILED]))
    return a.select(rows.alias("x")).select("x.*")


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH b AS (SELECT user_id, avg(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END) AS base FROM events WHERE event_type = 'purchase' GROUP BY 1),
 f AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN base > 250 THEN value ELSE 500 - value END AS v FROM events JOIN b USING (user_id) WHERE event_type = 'purchase' AND base IS NOT NULL)
 SELECT day, round(avg(v), 6) AS mean_v, round(median(v), 6) AS median_v, round(stddev_samp(v), 6) AS std_v FROM f GROUP BY 1""")
def favored_side(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    base = e.groupBy("user_id").agg(F.avg(F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.col("value"))).alias("base")).where("base IS NOT NULL")
    f = e.join(base, "user_id").select(F.to_date("ts").alias("day"), F.when(F.col("base") > 250, F.col("value")).otherwise(500 - F.col("value")).alias("v"))
    return f.groupBy("day").agg(F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.median("v"), 6).alias("median_v"), F.round(F.stddev_samp("v"), 6).alias("std_v"))


@query("SELECT exchange, count(*) AS n, round(avg(CAST(contract_key <> '' AS INT)), 8) AS parsed_share FROM (SELECT exchange, coalesce(contract_key, '') AS contract_key FROM contract_canonical_markets) GROUP BY 1")
def parsed_share(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contract_canonical_markets")
    return c.groupBy("exchange").agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("contract_key", F.lit("")) != "").cast("int")), 8).alias("parsed_share"))


@query("SELECT row_id, CAST(strftime(cutoff_date, '%Y%m%d') AS BIGINT) AS day_key, date_diff('day', event_start, cutoff_date) AS relative_day, CAST(cutoff_date >= event_start AS INT) AS post FROM (SELECT DISTINCT row_id, cutoff_date, event_start FROM resolution_risk_event_timeseries)")
def relative_days(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolution_risk_event_timeseries").select("row_id", "cutoff_date", "event_start").distinct()
    return r.select("row_id", F.date_format("cutoff_date", "yyyyMMdd").cast("long").alias("day_key"), F.datediff("cutoff_date", "event_start").cast("long").alias("relative_day"), (F.col("cutoff_date") >= F.col("event_start")).cast("int").alias("post"))


@query("SELECT a AS from_block, least(a + 9999, 1000000) AS to_block FROM generate_series(0, 1000000, 10000) t(a)")
def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1_000_000).cast("long"), F.lit(10_000).cast("long"))).alias("from_block"))
    return r.select("from_block", F.least(F.col("from_block") + 9999, F.lit(1_000_000)).cast("long").alias("to_block"))


@query("SELECT market_id, field, value FROM (SELECT DISTINCT market_id, coalesce(subject, '') AS subject, coalesce(scope, '') AS scope, coalesce(season, '') AS season FROM contract_canonical_markets WHERE exchange = 'polymarket') UNPIVOT (value FOR field IN (subject, scope, season)) WHERE value <> ''")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contract_canonical_markets").where("exchange = 'polymarket'").select("market_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("subject", "scope", "season")]).distinct()
    return c.unpivot("market_id", ["subject", "scope", "season"], "field", "value").where("value <> ''")


@query("""SELECT vec_id, best_id FROM (SELECT a.vec_id, b.vec_id AS best_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, best_id) = 1""")
def cosine_top1(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of all rows, whatever their label; of equals the least id."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(e.where("vec_id % 100 = 0"), e).select("vec_id", "best_id")


@query("""WITH m AS (SELECT DISTINCT pm_id, k_ticker, pm_question, k_title FROM market_matches_embeddings), t AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(pm_question), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)) AS a,
   list_distinct(list_filter(string_split(regexp_replace(lower(k_title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)) AS b FROM m WHERE pm_question IS NOT NULL AND k_title IS NOT NULL)
 SELECT pm_id, k_ticker, pm_question, k_title, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 8) AS jaccard FROM t""")
def jaccard_scores(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "market_matches_embeddings").select("pm_id", "k_ticker", "pm_question", "k_title").distinct().where("pm_question IS NOT NULL AND k_title IS NOT NULL")
    return m.withColumn("jaccard", F.round(X.jaccard(X.tokens(F.col("pm_question")), X.tokens(F.col("k_title"))), 8))
