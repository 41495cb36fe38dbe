"""The same results in plain SQL, for checks against another engine."""

from __future__ import annotations

from eventloom.plans.instants_sql import P4_FOUND, P4_STATES

_CELL_NAME = """
    regexp_replace(lower(attr_name), '[^a-z0-9]', '', 'g') AS bare,
    regexp_extract(lower(attr_name), '^[^a-z0-9]*yes[^a-z0-9]*2025(?:[^a-z0-9]+([0-9]{1,2})[^a-z0-9]+([0-9]{1,2})|([0-9]{2})([0-9]{2}))[^a-z0-9]*(open[^a-z0-9]*0500|close[^a-z0-9]*1700)[^a-z0-9]*pt[^a-z0-9]*$',
        ['m1', 'd1', 'm2', 'd2', 'tag']) AS g"""

P2 = f"""
WITH a AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, trim(attr_value) AS v, recorded_at, raw_id, {_CELL_NAME} FROM k_attributes WHERE ticker IS NOT NULL AND attr_value IS NOT NULL),
n AS (SELECT *, CASE WHEN g.tag <> '' THEN 'yes_2025_' || lpad(coalesce(nullif(g.m1, ''), g.m2), 2, '0') || '_' || lpad(coalesce(nullif(g.d1, ''), g.d2), 2, '0')
              || CASE WHEN g.tag LIKE 'open%' THEN '_open_0500_PT' ELSE '_close_1700_PT' END
            ELSE CASE bare WHEN 'status' THEN 'status' WHEN 'result' THEN 'result' WHEN 'yessubtitle' THEN 'yes_sub_title' WHEN 'volume' THEN 'volume' WHEN 'openinterest' THEN 'open_interest'
              WHEN 'lastprice' THEN 'last_price' WHEN 'yesbid' THEN 'yes_bid' WHEN 'yesask' THEN 'yes_ask' WHEN 'cancloseearly' THEN 'can_close_early' WHEN 'expirationdate' THEN 'expiration_date' END END AS column_name
      FROM a WHERE lower(v) NOT IN ('', '-', '--', 'null', 'none', 'nan', 'nat', 'n/a', 'na', '#n/a')),
k AS (SELECT * FROM n WHERE column_name IS NOT NULL AND (g.tag = '' OR substr(column_name, 5, 10) BETWEEN '2025_06_23' AND '2025_07_15')),
x AS (SELECT ticker, column_name, recorded_at, raw_id,
        CASE WHEN column_name IN ('status', 'result') THEN lower(v)
             WHEN column_name = 'yes_sub_title' THEN v
             WHEN column_name IN ('volume', 'open_interest', 'last_price', 'yes_bid', 'yes_ask') THEN
               CASE WHEN regexp_full_match(regexp_replace(v, '[, +]', '', 'g'), '-?[0-9]{{1,18}}([.]0*)?') THEN CAST(CAST(regexp_replace(regexp_replace(v, '[, +]', '', 'g'), '[.]0*$', '') AS BIGINT) AS VARCHAR) END
             WHEN column_name = 'can_close_early' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END
             WHEN column_name = 'expiration_date' THEN CAST(CAST(coalesce(
               try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%Y%m%d'), try_strptime(v, '%Y-%m-%dT%H:%M:%S'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%B %d, %Y')) AS DATE) AS VARCHAR)
             ELSE CAST(CASE WHEN regexp_matches(v, '(%|c|¢|cents)$') THEN TRY_CAST(round(TRY_CAST(regexp_replace(v, ' *(%|cents|c|¢)$', '') AS DOUBLE)) AS BIGINT)
                  ELSE TRY_CAST(round(100 * TRY_CAST(regexp_replace(regexp_replace(v, '^[$+]', ''), ',', '.') AS DOUBLE)) AS BIGINT) END AS VARCHAR) END AS cell_value
      FROM k)
SELECT ticker, column_name, cell_value FROM x WHERE cell_value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY ticker, column_name ORDER BY recorded_at DESC, raw_id DESC) = 1"""

_HEX = "regexp_replace(regexp_replace(lower(trim({0})), '^0x', ''), '^0+(.)', '\\1')"
P5_LINKS = f"""
WITH l AS (SELECT link_id, 'condition_id' AS ref_field, {_HEX.format('condition_id')} AS k, _fetched_at AS f FROM pm_neg_risk_uma_request_link WHERE trim(condition_id) <> ''
     UNION SELECT link_id, 'request_id', {_HEX.format('request_id')}, _fetched_at FROM pm_neg_risk_uma_request_link WHERE trim(request_id) <> ''),
r AS (SELECT 'condition_id' AS ref_field, {_HEX.format('condition_id')} AS k, _fetched_at AS f, coalesce(is_deleted, false) AS d FROM pm_markets WHERE trim(condition_id) <> ''
     UNION ALL SELECT 'request_id', {_HEX.format('request_id')}, _fetched_at, coalesce(removed, false) FROM uma_event_timeline WHERE lower(trim(event)) = 'requestprice' AND trim(request_id) <> ''),
p AS (SELECT ref_field, k, min(f) AS first_f, arg_max(d, CAST(epoch_us(f) AS HUGEINT) * 2 + CAST(d AS INT)) AS gone FROM r GROUP BY 1, 2),
o AS (SELECT link_id, ref_field, l.f, CASE WHEN p.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_f > l.f THEN 'late' END AS orphan_kind FROM l LEFT JOIN p USING (ref_field, k))"""
P5 = P5_LINKS + " SELECT DISTINCT link_id, ref_field, orphan_kind FROM o WHERE orphan_kind IS NOT NULL"
P5_REPORT = (
    P5_LINKS
    + """ SELECT CASE ref_field WHEN 'condition_id' THEN 'pm_markets' ELSE 'uma_event_timeline' END AS referenced_table, strftime(f, '%Y-%m') AS period, orphan_kind, count(*) AS n_references
     FROM (SELECT DISTINCT link_id, ref_field, f, orphan_kind FROM o WHERE orphan_kind IS NOT NULL) GROUP BY 1, 2, 3"""
)

#: The wide table's columns and how each is typed from a cell's plain text.
_TYPES = dict.fromkeys(("status", "result", "yes_sub_title"), "VARCHAR") | dict.fromkeys(("volume", "open_interest", "last_price", "yes_bid", "yes_ask"), "BIGINT") | {"can_close_early": "BOOLEAN", "expiration_date": "DATE"}
_DAYS = [f"2025_06_{d:02d}" for d in range(23, 31)] + [f"2025_07_{d:02d}" for d in range(1, 16)]
_COLUMNS = [f"CAST(max(CASE WHEN column_name = '{c}' THEN cell_value END) AS {t}) AS {c}" for c, t in _TYPES.items()] + [
    f"CAST(max(CASE WHEN column_name = 'yes_{d}_{x}_PT' THEN cell_value END) AS BIGINT) / 100 AS yes_{d}_{x}_PT" for d in _DAYS for x in ("open_0500", "close_1700")
]
P2_WIDE = f"WITH w AS ({P2}) SELECT ticker, {', '.join(_COLUMNS)} FROM w GROUP BY ticker"

ORACLES = {"p2_found": P2, "p2_wide": P2_WIDE, "p4_found": P4_FOUND, "p4_states": P4_STATES, "p5_found": P5, "p5_report": P5_REPORT}
