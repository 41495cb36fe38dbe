"""SQL of the instants: the notations' patterns are shared, parts, zones and clock changes are the other engine's own."""

from __future__ import annotations

from eventloom.operators.instants import CIVIL, FIXED, NOTATIONS, PACIFIC, UTC

_BLANK = r"[\s\x{FEFF}\x{200B}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"
_MAP = lambda m: "MAP {" + ", ".join(f"'{k.lower()}': {v!r}" for k, v in m.items()) + "}"
_FIELDS = [("resolution_risk_event_timeseries", "row_id", "cutoff_local", PACIFIC), ("resolution_risk_event_timeseries", "row_id", "cutoff_utc", UTC), ("k_topics", "row_id", "created_time", PACIFIC), ("uma_event_timeline", "row_id", "block_timestamp", UTC)]
_TEXTS = " UNION ".join(f"SELECT '{t}' AS table_name, {i} AS row_id, '{f}' AS field_name, {f} AS text, '{z}' AS zone FROM {t}" for t, i, f, z in _FIELDS)
_PARTS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN string_split(regexp_replace(s, '{p}', '{r.replace('$', chr(92))}'), '|')" for p, r in NOTATIONS) + " END"
_SIGN = r"^(?:z|utc|gmt|ut)?([+-])(\d{1,2})(?::?(\d{2}))?"

_STATES = f"""
WITH t AS ({_TEXTS}), s AS (SELECT *, regexp_replace(lower(regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g')), '\\s+', ' ', 'g') AS s FROM t),
 p AS (SELECT *, {_PARTS} AS p FROM s),
 n AS (SELECT *, CASE WHEN p IS NULL AND regexp_matches(s, '^0x0*[0-9a-f]{{1,15}}$') THEN CAST(CAST(regexp_replace(s, '^0x0*', '0x') AS BIGINT) AS DECIMAL(28, 9))
     WHEN p IS NULL AND regexp_matches(s, '^[+-]?\\d{{1,19}}(\\.\\d*)?(e[+]?\\d{{1,2}})?$') THEN TRY_CAST(s AS DECIMAL(28, 9)) END AS n,
   CASE WHEN length(p[1]) = 2 THEN 2000 + TRY_CAST(p[1] AS INT) ELSE TRY_CAST(p[1] AS INT) END AS y, coalesce(TRY_CAST(p[2] AS INT), nullif((strpos('janfebmaraprmayjunjulaugsepoctnovdec', left(p[2], 3)) + 2) // 3, 0)) AS m, TRY_CAST(p[3] AS INT) AS d,
   coalesce(TRY_CAST(nullif(p[4], '') AS INT), 0) AS h, coalesce(TRY_CAST(nullif(p[5], '') AS INT), 0) AS mi, coalesce(TRY_CAST(nullif(p[6], '') AS INT), 0) AS sec, CAST(rpad(left(p[7], 6), 6, '0') AS BIGINT) AS frac, p[8] AS half,
   trim(regexp_replace(coalesce(p[9], ''), '[\\[\\]()]', ' ', 'g')) AS z FROM p),
 c AS (SELECT *, CASE WHEN half = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS hour, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day FROM n),
 o AS (SELECT *, CASE WHEN day IS NOT NULL AND hour BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND sec BETWEEN 0 AND 59 THEN CAST(day AS TIMESTAMP) + to_seconds(hour * 3600 + mi * 60 + sec) END AS civil,
   coalesce(CASE WHEN regexp_matches(z, '{_SIGN}') THEN (CASE regexp_extract(z, '{_SIGN}', 1) WHEN '-' THEN -1 ELSE 1 END) * (CAST(regexp_extract(z, '{_SIGN}', 2) AS INT) * 60 + coalesce(TRY_CAST(nullif(regexp_extract(z, '{_SIGN}', 3), '') AS INT), 0)) END,
     {_MAP(FIXED)}[z], CASE WHEN z = '' AND zone = 'UTC' THEN 0 END) AS off, CASE WHEN z = '' THEN lower(zone) ELSE coalesce({_MAP({k: v.lower() for k, v in CIVIL.items()})}[z], z) END AS zn FROM c),
 g AS (SELECT o.*, tz.name AS zname FROM o LEFT JOIN (SELECT name, lower(name) AS low FROM pg_timezone_names() WHERE contains(name, '/')) tz ON off IS NULL AND civil IS NOT NULL AND tz.low = zn),
 a AS (SELECT *, CASE WHEN zname IS NOT NULL THEN list_distinct([civil - (timezone(zname, timezone('UTC', civil - INTERVAL 1 DAY)) - (civil - INTERVAL 1 DAY)), civil - (timezone(zname, timezone('UTC', civil + INTERVAL 1 DAY)) - (civil + INTERVAL 1 DAY))]) END AS tries FROM g),
 v AS (SELECT *, list_filter(tries, lambda u: timezone(zname, timezone('UTC', u)) = civil) AS hits FROM a),
 w AS (SELECT *, coalesce(CASE WHEN off IS NOT NULL THEN epoch_us(civil) - CAST(off AS BIGINT) * 60000000 + frac WHEN len(hits) = 1 THEN epoch_us(hits[1]) + frac END,
   CAST(CASE WHEN n IS NULL THEN NULL ELSE trunc(CASE WHEN abs(n) < 100000000000 THEN n * 1000000 WHEN abs(n) < 100000000000000 THEN n * 1000 WHEN abs(n) < 100000000000000000 THEN n ELSE n // 1000 END) END AS BIGINT)) AS instant_us FROM v)"""

P4_FOUND = _STATES + " SELECT DISTINCT table_name, row_id, field_name, instant_us FROM w WHERE instant_us IS NOT NULL AND row_id IS NOT NULL"
P4_STATES = _STATES + """ SELECT table_name, field_name, CASE WHEN coalesce(s, '') = '' THEN 'blank' WHEN instant_us IS NOT NULL THEN 'ok' WHEN len(hits) > 1 THEN 'ambiguous' WHEN len(hits) = 0 THEN 'nonexistent' ELSE 'unreadable' END AS instant_state, count(*) AS n_rows FROM w GROUP BY ALL"""
