"""SQL for the registered queries, runnable by DuckDB over the given tables."""

from __future__ import annotations

from checks.adapters import AS_OF

ORACLES: dict[str, str] = {}

NOW = f"TIMESTAMP '{AS_OF}'"

RUNS = """runs AS (
  SELECT event_id AS id, 'bundle_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS bundle_name,
    CASE WHEN event_type IN ('purchase','signup') THEN
           CASE WHEN user_id % 20 = 19 THEN 'ZERO_ROWS' ELSE 'SUCCESS' END
         WHEN event_type = 'view' THEN 'ZERO_ROWS'
         WHEN event_type = 'click' THEN 'DEGRADED' ELSE 'FAILED' END AS status,
    CASE WHEN event_type IN ('purchase','signup') AND user_id % 20 <> 19
         THEN CAST(floor(value) AS INTEGER) ELSE 0 END AS items_scraped,
    CAST(value AS DECIMAL(8,2)) AS duration_seconds,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS http_200_count,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN k ELSE 0 END AS http_403_count,
    CASE WHEN event_type = 'error' AND k % 2 = 1 THEN k ELSE 0 END AS http_429_count,
    0 AS http_500_count,
    CASE WHEN event_type = 'error' THEN 'KeyError: k=' || k END AS error_message,
    CASE WHEN user_id % 20 = 17 THEN ts - INTERVAL 2 DAY ELSE ts END AS created_at
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""

VIEW = f"""rollup_all AS (
  SELECT bundle_name,
    count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR) AS total_runs_24h,
    count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR AND status = 'SUCCESS') AS success_runs_24h,
    count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR AND status IN ('ZERO_ROWS','DEGRADED')) AS anomaly_runs_24h,
    count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR AND status = 'FAILED') AS failed_runs_24h,
    CAST(sum(items_scraped) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR) AS BIGINT) AS total_items_scraped_24h,
    max(created_at) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOUR) AS last_run_timestamp,
    max(created_at) FILTER (WHERE status = 'SUCCESS') AS last_success_timestamp
  FROM runs GROUP BY bundle_name
)"""

ERRORS = r"\[ERROR\]|\[CRITICAL\]|OperationalError|NameError|KeyError|AttributeError|Authentication failed|no password supplied|ConnectionRefusedError|Connection refused|Cloudflare challenge or 403"
PATTERN = "bundle[s]?/([a-zA-Z0-9_]+)"
LINES = f"""log_lines AS (
  SELECT event_id AS ord, CASE WHEN event_type = 'error'
      THEN '  [ERROR] KeyError in ' || path || ' k=' || regexp_extract(props, '[0-9]+')
      ELSE 'INFO finished ' || path END AS value
  FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'scheduler'
          ELSE 'bundles/bundle_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || '/scraper.py' END AS path
        FROM events)
), log_errors AS (
  SELECT bundle_name, message, min(ord) AS ord FROM (
    SELECT coalesce(nullif(regexp_extract(value, '{PATTERN}', 1), ''), 'unknown_bundle') AS bundle_name,
      left(trim(value), 140) AS message, ord
    FROM log_lines
    WHERE regexp_matches(value, '{ERRORS}', 'i')
  ) GROUP BY bundle_name, message
)"""


def _health(logs: bool) -> str:
    errors = (
        "SELECT bundle_name, arg_min(message, ord) AS first_error, count(*) AS stdout_error_count FROM log_errors GROUP BY bundle_name"
        if logs
        else "SELECT NULL::VARCHAR AS bundle_name, NULL::VARCHAR AS first_error, 0::BIGINT AS stdout_error_count WHERE false"
    )
    return f"""{RUNS}, {VIEW}, {LINES},
bundles AS (SELECT 'bundle_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS bundle_name,
    CASE WHEN n_nationkey % 2 = 0 THEN 6 END AS sla_hours, CASE WHEN n_nationkey % 3 = 0 THEN 0.6::DOUBLE END AS anomaly_ratio FROM nation),
errs AS ({errors}),
base AS (
  SELECT n.bundle_name,
    coalesce(v.total_runs_24h, 0) AS total, coalesce(v.success_runs_24h, 0) AS success,
    coalesce(v.anomaly_runs_24h, 0) AS anomaly, coalesce(v.failed_runs_24h, 0) AS failed,
    coalesce(v.total_items_scraped_24h, 0) AS items, v.last_success_timestamp AS last_ok,
    coalesce(b.sla_hours, 12) AS sla, coalesce(b.anomaly_ratio, 0.3::DOUBLE) AS ratio,
    e.first_error, coalesce(e.stdout_error_count, 0) AS errors_n,
    epoch_us({NOW}) - epoch_us(v.last_success_timestamp) AS us
  FROM (SELECT bundle_name FROM bundles UNION SELECT bundle_name FROM rollup_all WHERE total_runs_24h > 0) n
  LEFT JOIN (SELECT * FROM rollup_all WHERE total_runs_24h > 0) v USING (bundle_name)
  LEFT JOIN bundles b USING (bundle_name) LEFT JOIN errs e USING (bundle_name)
),
flags AS (
  SELECT *, us / 3.6e9 AS hours, total = 0 AND last_ok IS NULL AS no_data, errors_n > 0 AS logged,
    anomaly > 0 AND anomaly / greatest(1, total) >= ratio AS anomalous,
    failed > 0 AND failed / greatest(1, total) >= ratio AS failing,
    coalesce(us / 3.6e9 > sla, false) AS stale, last_ok IS NULL AND total > 0 AS never,
    CAST(trunc(ratio * 100) AS INTEGER) AS pct
  FROM base
),
health AS (
  SELECT *, CASE WHEN failing OR stale OR never THEN 'CRITICAL' WHEN anomalous OR logged THEN 'DEGRADED'
                 WHEN no_data THEN 'UNKNOWN' ELSE 'HEALTHY' END AS status,
    no_data::INT + logged::INT + anomalous::INT + failing::INT + stale::INT + never::INT AS issues_n
  FROM flags
),
acted AS (
  SELECT *, CASE WHEN status = 'CRITICAL' THEN 'REMEDIATE' WHEN status = 'HEALTHY' AND issues_n = 0 THEN 'OK' ELSE 'WATCH' END AS action
  FROM health
),
issues AS (
  SELECT bundle_name, status, CAST(row_number() OVER (PARTITION BY bundle_name ORDER BY r) AS INTEGER) AS issue_no, alert_type, message
  FROM (
    SELECT bundle_name, status, 1 AS r, NULL AS alert_type, 'No execution data recorded yet for this bundle.' AS message FROM health WHERE no_data
    UNION ALL SELECT bundle_name, status, 2, 'DAGSTER_STDOUT_ERROR', 'Dagster process STDOUT error detected: ''' || first_error || '''' FROM health WHERE logged
    UNION ALL SELECT bundle_name, status, 3, 'ZERO_ROWS_ANOMALY',
      'High anomaly rate (' || anomaly || '/' || total || ' runs returned 0 items, threshold: ' || pct || '%). Target HTML selector changed?' FROM health WHERE anomalous
    UNION ALL SELECT bundle_name, status, 4, 'EXECUTION_FAILURE_RATE',
      'High failure rate (' || failed || '/' || total || ' runs FAILED, threshold: ' || pct || '%). Check error_message / stdout logs.' FROM health WHERE failing
    UNION ALL SELECT bundle_name, status, 5, 'SLA_STALENESS_EXCEEDED',
      'Staleness SLA breached! Last successful run was ' || printf('%.1f', hours) || ' hours ago (SLA: ' || sla || 'h).' FROM health WHERE stale
    UNION ALL SELECT bundle_name, status, 6, 'NEVER_SUCCEEDED',
      'No successful run has ever been recorded for ''' || bundle_name || ''' (' || total || ' run(s) in the last 24h, none SUCCESS).' FROM health WHERE never
  )
)"""


def _latest(source: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY bundle_name ORDER BY created_at DESC, id DESC) AS rn FROM {source}) WHERE rn = 1)"""


BAD = "bad AS (SELECT * FROM runs WHERE status IN ('ZERO_ROWS','FAILED','DEGRADED'))"

ORACLES["health_rollup_24h"] = f"WITH {RUNS}, {VIEW} SELECT * FROM rollup_all WHERE total_runs_24h > 0"
ORACLES["health_rollup_idle"] = f"WITH {RUNS}, {VIEW} SELECT * FROM rollup_all"
ORACLES["health_status"] = f"""WITH {_health(False)}
SELECT bundle_name, status, total AS total_runs_24h, success AS success_runs_24h, items AS items_scraped_24h,
  last_ok IS NULL AS never, round(hours, 4) AS hours_since_success, sla AS sla_hours, round(ratio, 2) AS anomaly_ratio,
  errors_n AS stdout_error_count, issues_n FROM health"""
ORACLES["health_report"] = f"WITH {_health(False)} SELECT bundle_name, status, total AS total_runs_24h, row_number() OVER (ORDER BY bundle_name) AS place FROM health"
ORACLES["health_status_logs"] = f"WITH {_health(True)} SELECT bundle_name, status, first_error, errors_n AS stdout_error_count FROM health"
ORACLES["health_issues"] = f"WITH {_health(True)} SELECT * FROM issues"
ORACLES["health_fleet"] = f"""WITH {_health(False)}
SELECT bundle_name AS name, status, action, items AS items_24h, total AS runs_24h, issues_n FROM acted"""
ORACLES["health_fleet_action"] = f"""WITH {_health(False)}
SELECT CASE WHEN bool_or(action = 'REMEDIATE') THEN 'REMEDIATE' WHEN bool_or(action = 'WATCH') THEN 'WATCH' ELSE 'OK' END AS action,
  count(*) AS count FROM acted"""
ORACLES["health_digest"] = f"""WITH {_health(False)}, {_latest('runs', 'last_log')},
shown AS (SELECT bundle_name, string_agg(left(message, 140), ' / ' ORDER BY issue_no) AS issue_texts FROM issues WHERE issue_no <= 2 GROUP BY bundle_name)
SELECT a.bundle_name, a.status, action, total AS runs_24h, success AS success_24h, items AS items_24h,
  least(issues_n, 2) AS issues_shown, coalesce(issue_texts, '') AS issue_texts, l.status AS last_status, left(l.error_message, 140) AS last_error, l.created_at AS last_at,
  CASE WHEN action = 'REMEDIATE' THEN 'diagnose ' || a.bundle_name END AS next
FROM bundles b JOIN acted a USING (bundle_name) LEFT JOIN last_log l USING (bundle_name) LEFT JOIN shown s ON s.bundle_name = a.bundle_name"""
ORACLES["last_run"] = f"""WITH {RUNS}, {_latest('runs', 'r')}
SELECT bundle_name, id, status, items_scraped, http_403_count, http_429_count, left(error_message, 140) AS error_message, created_at FROM r"""
ORACLES["last_failure"] = f"""WITH {RUNS}, {BAD}, {_latest('bad', 'r')}
SELECT bundle_name, id, status, error_message, created_at FROM r"""
ORACLES["diagnostics"] = f"""WITH {RUNS}, {BAD}, {_latest('runs', 'l')}, {_latest('bad', 'f')},
names AS (SELECT 'bundle_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS bundle_name FROM nation UNION SELECT bundle_name FROM runs)
SELECT n.bundle_name, coalesce(nullif(l.status, ''), f.status, 'UNKNOWN') AS status,
  coalesce(nullif(f.error_message, ''), l.error_message) AS error_message, l.items_scraped,
  l.http_200_count, l.http_403_count, l.http_429_count, l.http_500_count, l.created_at
FROM names n LEFT JOIN l USING (bundle_name) LEFT JOIN f USING (bundle_name)"""
ORACLES["failure_mode"] = f"""WITH {RUNS}
SELECT id, bundle_name, CASE WHEN status = 'ZERO_ROWS' THEN 'A' WHEN http_403_count + http_429_count > 0 THEN 'B'
  WHEN error_message <> '' THEN 'C' END AS mode FROM runs"""
PROBES = "probes AS (SELECT user_id, event_type, value, CASE WHEN event_type <> 'error' THEN 200 WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 2 = 0 THEN 403 ELSE 429 END AS status_code FROM events)"
ORACLES["probe_ratio"] = f"""WITH {PROBES}
SELECT user_id, CASE WHEN count(*) FILTER (WHERE status_code = 200) = count(*) THEN 'HEALTHY' ELSE 'DEGRADED' END AS status,
  count(*) FILTER (WHERE status_code = 200) || '/' || count(*) AS successful_requests FROM probes GROUP BY user_id"""
ORACLES["stuck_runs"] = """SELECT event_id AS run_id,
  CASE event_type WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'QUEUED' ELSE 'STARTING' END AS status, ts AS updated_at
FROM events WHERE event_type IN ('view','click','signup') AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) > 1800"""
FETCH = "fetches AS (SELECT user_id AS run_id, status_code, event_type <> 'view' AS has_content, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) ELSE 0 END AS items FROM probes)"
ORACLES["run_outcomes"] = f"""WITH {PROBES}, {FETCH},
g AS (SELECT run_id, CAST(coalesce(sum(items) FILTER (WHERE status_code = 200 AND has_content), 0) AS BIGINT) AS items_scraped,
  count(*) FILTER (WHERE status_code = 200 AND has_content) AS http_200_count,
  count(*) FILTER (WHERE status_code = 403) AS http_403_count, count(*) FILTER (WHERE status_code = 429) AS http_429_count
  FROM fetches GROUP BY run_id)
SELECT run_id, CASE WHEN items_scraped > 0 THEN 'SUCCESS' WHEN http_200_count > 0 THEN 'ZERO_ROWS' ELSE 'FAILED' END AS status,
  items_scraped, http_200_count, http_403_count, http_429_count FROM g"""
ORACLES["fetch_outcomes"] = f"""WITH {PROBES}, {FETCH}
SELECT CASE WHEN items > 0 THEN 'SUCCESS' WHEN status_code = 200 THEN 'ZERO_ROWS' ELSE 'FAILED' END AS status, count(*) AS n FROM fetches GROUP BY 1"""
ORACLES["log_errors"] = f"WITH {LINES} SELECT * FROM log_errors"

SENT = f"strftime({NOW}, '%Y-%m-%d %H:%M:%S')"
ALERTS = f"""alert_rows AS (
  SELECT bundle_name, alert_type, 'SCRAPER_ALERT' AS event, message,
    '<b>' || bundle_name || '</b>: <code>' || alert_type || '</code> at ' || {SENT} || chr(10) || message || chr(10)
    || 'Blocked requests: 0 with 403, 0 with 429' || chr(10) || 'Run <code>sitemill health --auto-fix ' || bundle_name || '</code>' AS text_html,
    '{{"bundle_name":"' || bundle_name || '","alert_type":"' || alert_type || '","details":"' || message || '","http_403_count":0,"http_429_count":0}}' AS payload
  FROM issues WHERE alert_type IS NOT NULL
)"""
ORACLES["alert_rows"] = f"WITH {_health(True)}, {ALERTS} SELECT bundle_name, alert_type, event, text_html, payload FROM alert_rows"
ORACLES["alerts_fanout"] = f"""WITH {_health(True)}, {ALERTS}
SELECT bundle_name, alert_type, 'chat' AS channel, 'room-1' AS target, text_html AS body FROM alert_rows
UNION ALL SELECT bundle_name, alert_type, 'chat_webhook', 'https://hooks.example/a',
  replace(replace(replace(regexp_replace(text_html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') FROM alert_rows
UNION ALL SELECT bundle_name, alert_type, 'webhook', 'https://hooks.example/b', '{{"event":"' || event || '","payload":' || payload || ',"timestamp":"' || strftime({NOW}, '%Y-%m-%dT%H:%M:%S.000000+00:00') || '"}}' FROM alert_rows"""
ORACLES["attention_alerts"] = f"""WITH {RUNS}, {BAD}, {_latest('bad', 'r')},
f AS (SELECT bundle_name, coalesce(error_message, status) AS e FROM r)
SELECT bundle_name, 'HUMAN_ATTENTION' AS event,
  '<b>' || bundle_name || '</b>: given up after 3 repairs at ' || {SENT} || chr(10) || 'Last error: <code>' || e || '</code>' || chr(10)
  || 'Run <code>sitemill health --fix ' || bundle_name || '</code>' AS text_html,
  '{{"bundle_name":"' || bundle_name || '","retries_count":3,"last_error":"' || e || '"}}' AS payload FROM f"""
ORACLES["repair_alerts"] = f"""WITH {RUNS}, f AS (SELECT bundle_name, count(*) AS n FROM runs GROUP BY bundle_name)
SELECT bundle_name, 'AUTO_REPAIR_SUCCESS' AS event,
  '<b>' || bundle_name || '</b>: repaired by <code>model</code> in attempt 1 at ' || {SENT} || chr(10) || 'Changed lines: ' || n AS text_html,
  '{{"bundle_name":"' || bundle_name || '","model_used":"model","attempt":1,"modified_lines_count":' || n || '}}' AS payload FROM f"""
ORACLES["run_log_append"] = f"""WITH {RUNS}
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS dt, status, count(*) AS runs, CAST(sum(items_scraped) AS BIGINT) AS items,
  CAST(sum(duration_seconds) AS DOUBLE) AS seconds, count(*) AS logged FROM runs GROUP BY 1, 2"""

# Catalog

CHECK = "(10 - (" + " + ".join(
    f"CAST(substr(base, {i}, 1) AS INTEGER) * {3 if i % 2 == 0 else 1}" for i in range(1, 13)
) + ") % 10) % 10"
FEED = f"""feed AS (
  SELECT p AS row_id, CASE WHEN p % 97 = 96 THEN '' ELSE chr(9) || chr(160) || 'SKU-' || p || ' ' END AS sku,
    CASE WHEN p % 11 <> 10 THEN base || CASE WHEN p % 5 = 4 THEN ({CHECK} + 1) % 10 ELSE {CHECK} END END AS gtin,
    CASE WHEN p % 4 = 3 THEN NULL WHEN p % 23 = 22 THEN lower(p_brand) ELSE p_brand END AS brand,
    ' ' || p_name AS title, CASE WHEN p % 7 <> 6 THEN p_type END AS category,
    CASE WHEN p % 29 = 28 THEN 'n/a' WHEN p % 13 = 12 THEN '0' WHEN p % 17 = 16 THEN CAST(p_retailprice * 1000 AS VARCHAR)
         WHEN p % 19 <> 18 THEN CAST(p_retailprice AS VARCHAR) END AS price,
    CASE WHEN p % 31 = 30 THEN 'many' ELSE CAST(p_size - 3 AS VARCHAR) END AS stock
  FROM (SELECT *, p_partkey AS p, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS base FROM part)
)"""
NORM = f"""{FEED}, norm AS (
  SELECT row_id, trim(sku, ' ' || chr(9) || chr(160)) AS sku, trim(gtin) AS gtin, trim(brand) AS brand, trim(title) AS title,
    trim(category) AS category, try_cast(price AS DOUBLE) AS price, coalesce(try_cast(stock AS BIGINT), 0) AS stock FROM feed
)"""
PADDED = " + ".join(
    f"CAST(substr(lpad(digits, 14, '0'), {i}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(1, 15)
)
ALIAS = "CASE lower(brand) " + " ".join(f"WHEN 'brand#{k}' THEN 'Brand#{k}'" for k in (1, 2, 3, 4, 5)) + " WHEN 'widget' THEN 'Widgetco' END"
IN_TITLE = "CASE " + " ".join(
    f"WHEN contains(lower(title), 'brand#{k}') THEN 'Brand#{k}'" for k in (1, 2, 3, 4, 5)
) + " WHEN contains(lower(title), 'widget') THEN 'Widgetco' END"
PREDS = f"""{NORM}, facts AS (
  SELECT *, regexp_replace(coalesce(gtin, ''), '[^0-9]', '', 'g') AS digits, {ALIAS} AS alias, {IN_TITLE} AS in_title,
    CASE WHEN regexp_matches(title, '\\b(black)\\b', 'i') THEN 'Black' WHEN regexp_matches(title, '\\b(white)\\b', 'i') THEN 'White'
         WHEN regexp_matches(title, '\\b(red)\\b', 'i') THEN 'Red' WHEN regexp_matches(title, '\\b(blue)\\b', 'i') THEN 'Blue' END AS hue,
    CASE WHEN contains(lower(title), 'bolt') THEN 'Hardware > Bolts' WHEN contains(lower(title), 'ring') THEN 'Hardware > Rings' END AS word
  FROM norm
), checked AS (SELECT *, length(digits) IN (8, 12, 13, 14) AND ({PADDED}) % 10 = 0 AS valid FROM facts),
preds AS (
  SELECT row_id, 1 AS n, 'gtin' AS rule_id, nullif(digits, '') AS value, NULL::DOUBLE AS number,
    CASE WHEN digits = '' THEN 0.0 WHEN valid THEN 1.0 ELSE 0.2 END AS confidence,
    CASE WHEN digits = '' THEN 'missing gtin' WHEN valid THEN 'valid ean/gtin' ELSE 'invalid checksum' END AS message FROM checked
  UNION ALL SELECT row_id, 2, 'brand', CASE WHEN coalesce(brand, '') <> '' THEN coalesce(alias, brand) ELSE in_title END, NULL,
    CASE WHEN coalesce(brand, '') <> '' AND alias IS NOT NULL THEN 0.95 WHEN coalesce(brand, '') <> '' THEN 0.85 WHEN in_title IS NOT NULL THEN 0.75 ELSE 0 END,
    CASE WHEN coalesce(brand, '') <> '' AND alias IS NOT NULL THEN 'alias map' WHEN coalesce(brand, '') <> '' THEN 'supplier brand kept'
         WHEN in_title IS NOT NULL THEN 'found in title' ELSE 'brand unknown' END FROM checked
  UNION ALL SELECT row_id, 3, 'color', hue, NULL, CASE WHEN hue IS NULL THEN 0 ELSE 0.8 END,
    CASE WHEN hue IS NULL THEN 'color not found' ELSE 'regex match' END FROM checked
  UNION ALL SELECT row_id, 4, 'category', coalesce(nullif(category, ''), word), NULL,
    CASE WHEN coalesce(category, '') <> '' THEN 0.9 WHEN word IS NOT NULL THEN 0.7 ELSE 0 END,
    CASE WHEN coalesce(category, '') <> '' THEN 'supplier category' WHEN word IS NOT NULL THEN 'keyword map' ELSE 'category unknown' END FROM checked
  UNION ALL SELECT row_id, 5, 'price', NULL, price,
    CASE WHEN price IS NULL THEN 0 WHEN price <= 0 THEN 0.1 WHEN price > 100000 THEN 0.4 ELSE 0.95 END,
    CASE WHEN price IS NULL THEN 'missing price' WHEN price <= 0 THEN 'price must be > 0' WHEN price > 100000 THEN 'suspiciously high' ELSE 'price ok' END FROM checked
)"""
ENRICHED = f"""{PREDS}, judged AS (
  SELECT p.*, value IS NOT NULL OR number IS NOT NULL AS has,
    CASE rule_id WHEN 'gtin' THEN c.gtin WHEN 'brand' THEN c.brand WHEN 'category' THEN c.category END AS own, c.price AS own_price
  FROM preds p JOIN checked c USING (row_id)
), marked AS (
  SELECT *, has AND confidence > 0 AS ok,
    has AND confidence > 0 AND confidence < 0.65 AS unsure,
    has AND confidence >= 0.65 AND rule_id IN ('gtin','brand','category') AND coalesce(own, '') <> '' AND own <> value AS clash
  FROM judged
), held AS (
  SELECT row_id, bool_or(unsure OR coalesce(clash, false)) AS hold,
    coalesce(string_agg(rule_id, ',' ORDER BY n) FILTER (WHERE unsure OR coalesce(clash, false) OR (NOT ok AND confidence = 0)), '') AS low_conf,
    max(CASE WHEN rule_id = 'gtin' AND ok AND confidence >= 0.65 THEN value END) AS g,
    max(CASE WHEN rule_id = 'brand' AND ok AND confidence >= 0.65 THEN value END) AS b,
    max(CASE WHEN rule_id = 'color' AND ok AND confidence >= 0.65 THEN value END) AS h,
    max(CASE WHEN rule_id = 'category' AND ok AND confidence >= 0.65 THEN value END) AS c
  FROM marked GROUP BY row_id
), enriched AS (
  SELECT row_id, sku, coalesce(nullif(gtin, ''), g, gtin) AS gtin, coalesce(nullif(brand, ''), b, brand) AS brand, title, h AS color,
    coalesce(nullif(category, ''), c, category) AS category, price, stock, low_conf,
    hold OR coalesce(coalesce(nullif(category, ''), c), '') = '' AS quarantine
  FROM norm JOIN held USING (row_id)
)"""
QA = f"""{ENRICHED}, qa_checked AS (
  SELECT *, regexp_replace(coalesce(gtin, ''), '[^0-9]', '', 'g') AS digits FROM enriched
), qa AS (
  SELECT row_id, sku, quarantine, 'gtin' AS field, 'error' AS severity, 'Invalid GTIN/EAN checksum' AS message FROM qa_checked
    WHERE coalesce(gtin, '') <> '' AND NOT (length(digits) IN (8, 12, 13, 14) AND ({PADDED}) % 10 = 0)
  UNION ALL SELECT row_id, sku, quarantine, 'price', 'warning', 'Missing price' FROM enriched WHERE price IS NULL
  UNION ALL SELECT row_id, sku, quarantine, 'price', 'error', 'Price must be > 0' FROM enriched WHERE price <= 0
  UNION ALL SELECT row_id, sku, quarantine, 'stock', 'error', 'Stock cannot be negative' FROM enriched WHERE stock < 0
  UNION ALL SELECT row_id, sku, quarantine, 'sku', 'error', 'SKU is required' FROM enriched WHERE coalesce(sku, '') = ''
), totals AS (
  SELECT count(*) AS row_count, count(*) FILTER (WHERE NOT quarantine) AS clean_count, count(*) FILTER (WHERE quarantine) AS quarantine_count,
    (SELECT count(*) FROM qa WHERE NOT quarantine AND severity = 'error') AS qa_errors,
    (SELECT count(*) FROM qa WHERE NOT quarantine AND severity = 'warning') AS qa_warnings
  FROM enriched
)"""
FEED_COLUMNS = ["row_id", "sku", "gtin", "brand", "title", "category", "price", "stock"]
PROFILE = " UNION ALL ".join(
    f"SELECT count(*) AS row_count, {i} AS position, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM feed"
    for i, c in enumerate(FEED_COLUMNS, 1)
)
ORACLES["feed_profile"] = f"WITH {FEED} {PROFILE}"
ORACLES["feed_json_scan"] = ORACLES["feed_profile"]
ORACLES["feed_normalized"] = f"WITH {NORM} SELECT * FROM norm"
ORACLES["feed_array_scan"] = ORACLES["feed_normalized"]
# A CSV file cannot tell an empty text from none.
TAIL = """CASE p % 5 WHEN 0 THEN ' 5" screw, "best"' WHEN 1 THEN chr(10) || 'second, line' WHEN 2 THEN ' ' || chr(92) || ' "' WHEN 3 THEN '  ,  ' ELSE '' END"""


def _awkward(sql: str) -> str:
    return sql.replace("' ' || p_name AS title", f"' ' || p_name || {TAIL} AS title")


ORACLES["feed_csv_scan"] = f"WITH {_awkward(NORM)} SELECT row_id, nullif(sku, '') AS sku, gtin, brand, title, category, price, stock FROM norm"
ORACLES["gtin_check"] = f"""WITH {PREDS}
SELECT row_id, CASE WHEN gtin IS NULL THEN NULL ELSE digits END AS digits, CASE WHEN gtin IS NULL THEN NULL ELSE valid END AS valid FROM checked"""
ORACLES["rule_predictions"] = f"WITH {PREDS} SELECT row_id, rule_id, value, round(number, 4) AS number, CAST(confidence AS DOUBLE) AS confidence, message FROM preds"
ORACLES["catalog_enriched"] = f"WITH {ENRICHED} SELECT row_id, sku, gtin, brand, title, color, category, round(price, 4) AS price, stock, low_conf, quarantine FROM enriched"
ORACLES["quarantine_split"] = f"WITH {ENRICHED} SELECT row_id, CASE WHEN quarantine THEN 'quarantine' ELSE 'clean' END AS part FROM enriched"
ORACLES["rule_hits"] = f"WITH {ENRICHED} SELECT rule_id, count(*) AS hits FROM marked WHERE ok GROUP BY rule_id"
ORACLES["qa_issues"] = f"WITH {QA} SELECT sku, field, severity, message FROM qa"
ORACLES["qa_rollup"] = f"WITH {QA} SELECT * FROM totals"
ORACLES["qa_gate"] = f"""WITH {QA} SELECT qa_errors = 0 AS passed, qa_errors, qa_warnings, quarantine_count,
  CASE WHEN qa_errors = 0 THEN 'No GTIN/price/SKU errors' ELSE qa_errors || ' QA errors — fix before export' END AS description FROM totals"""
JSON_ROW = "'{' || concat_ws(',', '\"row_id\":' || row_id, " + ", ".join(
    f"'\"{c}\":\"' || {c} || '\"'" if c not in ("price", "stock") else f"'\"{c}\":' || {c}"
    for c in ("sku", "gtin", "brand", "title", "category", "price", "stock", "color")
) + ") || '}'"
ORACLES["staging_rows"] = f"""WITH {QA} SELECT 7 AS import_run_id, e.row_id,
  CASE WHEN quarantine THEN 'quarantine' WHEN e.row_id IN (SELECT row_id FROM qa WHERE severity = 'error') THEN 'failed' ELSE 'passed' END AS qa_status,
  sha256({JSON_ROW}) AS row_hash FROM enriched e"""
# The export feed has no zero price, so a zero-priced row is no longer held back for it.
ORACLES["catalog_export"] = f"""WITH {_awkward(ENRICHED).replace("WHEN p % 13 = 12 THEN '0'", "WHEN p % 13 = 12 THEN NULL")}
SELECT CASE WHEN quarantine THEN 'quarantine' ELSE 'catalog' END AS part, 'SKU-' || row_id AS sku, title FROM enriched
UNION ALL SELECT 'passed', CAST(count(*) AS VARCHAR), NULL FROM part"""
ORACLES["brand_map_apply"] = """SELECT p_partkey, CASE WHEN length(p_brand) = 7 THEN 'House ' || substr(p_brand, 7, 1) ELSE p_brand END AS brand FROM part"""
ORACLES["keyword_category"] = """WITH needles AS (SELECT DISTINCT lower(substr(split_part(p_name, ' ', -1), 1, 3)) AS needle FROM part),
titles AS (SELECT DISTINCT p_name FROM part),
best AS (SELECT p_name, min(needle) AS needle FROM titles JOIN needles ON contains(lower(p_name), needle) GROUP BY p_name)
SELECT p_partkey, p_name AS title, 'Parts > ' || needle AS category FROM part LEFT JOIN best USING (p_name)"""

# Crawl

INDEX = """idx AS (
  SELECT url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS url_host_name, CAST(CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS SMALLINT) AS fetch_status,
    CASE WHEN page_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_mime_type,
    'crawl-data/part-' || (page_id % 10) || '.warc.gz' AS warc_filename, page_id * 1000 AS warc_record_offset, length(html) AS warc_record_length,
    CASE WHEN page_id % 2 = 0 THEN 'CC-MAIN-2024-46' ELSE 'CC-MAIN-2024-51' END AS crawl,
    CASE WHEN page_id % 3 = 0 THEN 'crawldiagnostics' ELSE 'warc' END AS subset FROM pages
)"""
ORACLES["index_scan"] = f"WITH {INDEX} SELECT *, true AS has_file FROM idx"
ORACLES["index_query"] = f"""WITH {INDEX} SELECT url_host_name, count(*) AS captures, CAST(sum(warc_record_length) AS BIGINT) AS bytes FROM idx
WHERE crawl = 'CC-MAIN-2024-46' AND subset = 'warc' AND fetch_status = 200 AND content_mime_type LIKE 'text/html%' GROUP BY url_host_name"""
ORACLES["shard_list"] = """SELECT 'cc-index/table/cc-main/warc/crawl=CC-MAIN-2024-46/subset=warc/part-' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.parquet' AS path
FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 9 <> 8"""
CDX = """lines AS (
  SELECT page_id AS ord, url, 'crawl-data/part-' || (page_id % 10) || '.warc.gz' AS filename, page_id * 1000 AS warc_record_offset,
    CASE WHEN page_id % 11 <> 10 THEN length(html) END AS warc_record_length,
    CASE WHEN page_id % 7 = 0 THEN '404' WHEN page_id % 7 = 1 THEN '-' ELSE '200' END AS st,
    CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' WHEN page_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime,
    '20240101' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS timestamp, page_id % 50 = 49 AS broken
  FROM pages
), captures AS (
  SELECT ord, url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS url_host_name, filename AS warc_filename, warc_record_offset, warc_record_length,
    timestamp, try_cast(st AS INTEGER) AS status, mime, 'cdx' AS source, st
  FROM lines WHERE NOT broken AND warc_record_length IS NOT NULL
)"""
ORACLES["cdx_captures"] = f"WITH {CDX} SELECT * EXCLUDE (st) FROM captures WHERE st = '200' AND contains(mime, 'text/html')"
ORACLES["cdx_unfiltered"] = f"WITH {CDX} SELECT * EXCLUDE (st) FROM captures"
ORACLES["cdx_limited"] = f"""WITH {CDX} SELECT * EXCLUDE (st) FROM captures WHERE st = '200' AND contains(mime, 'text/html')
  AND ord IN (SELECT ord FROM lines ORDER BY ord LIMIT 100) ORDER BY ord LIMIT 20"""
ORACLES["cdx_first"] = f"""WITH {CDX} SELECT * EXCLUDE (st) FROM captures WHERE st = '200' AND contains(mime, 'text/html') ORDER BY ord LIMIT 150"""
ORACLES["cdx_dropped"] = "SELECT count(*) AS lines, 0::BIGINT AS blank, count(*) FILTER (page_id % 50 = 49) AS malformed FROM pages"
ORACLES["shard_limit"] = """SELECT 'https://shards.example/cc-index/table/cc-main/warc/crawl=CC-MAIN-2024-46/subset=warc/part-' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.parquet' AS path
FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 9 <> 8 ORDER BY page_id LIMIT 15"""
ORACLES["record_locations"] = f"WITH {INDEX} SELECT url, 'https://data.commoncrawl.org/' || warc_filename AS record_url FROM idx"
ORACLES["archive_records"] = """SELECT page_id, url, url AS target_uri, 200 AS status, md5(html) AS text_md5, length(html) AS chars, false AS charset_fallback
FROM pages WHERE page_id % 40 <> 39 AND page_id % 25 <> 24"""
ORACLES["archive_rejects"] = """SELECT page_id, 'ValueError: ' || CASE WHEN page_id % 25 = 24 THEN 'warc_record_length must be positive' ELSE 'no response record in slice' END AS error
FROM pages WHERE page_id % 40 = 39 OR page_id % 25 = 24"""

# Functions, routing, extraction

RAW = """raw AS (
  SELECT page_id, url, CASE WHEN page_id % 45 = 44 THEN '' WHEN page_id % 6 = 0 THEN 'https://r.example/redirect?x=1&u=' || url_encode(url) || '&utm=feed#frag'
    WHEN page_id % 10 = 1 THEN regexp_replace(url, '^https?://', '') WHEN page_id % 15 = 2 THEN chr(8203) || ' ' || url || ' ' ELSE url END AS raw FROM pages
)"""
ORACLES["clean_website"] = f"""WITH {RAW} SELECT page_id, CASE WHEN raw <> '' THEN 'https://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '')
  || rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') END AS website FROM raw"""
ORACLES["route_host"] = f"""WITH {RAW} SELECT page_id, split_part(split_part(
  regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https://', ''), '^http://', ''), '^www\\.', ''), '/', 1), ':', 1) AS host FROM raw"""
ORACLES["lead_score"] = """WITH l AS (SELECT s_suppkey AS s, CASE s_suppkey % 10 WHEN 0 THEN '4.8.1' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '4.9 stars' WHEN 4 THEN '4.5/' WHEN 5 THEN 'n/a'
    ELSE '4.' || (s_suppkey % 10) END AS rating, CASE WHEN s_suppkey % 13 <> 12 THEN s_suppkey % 47 END AS reviews,
    CASE s_suppkey % 5 WHEN 0 THEN '$250,000+' WHEN 1 THEN '$10,000+' WHEN 2 THEN '$100,000' WHEN 3 THEN '$5,000' END AS size FROM supplier),
n AS (SELECT *, try_cast(regexp_replace(rating, '[^0-9.]', '', 'g') AS DOUBLE) AS num FROM l),
p AS (SELECT *, CASE WHEN coalesce(rating, '') = '' THEN 0 WHEN num >= 4.8 THEN 20 WHEN num >= 4.5 THEN 10 ELSE 0 END AS a,
  CASE WHEN reviews > 30 THEN 15 WHEN reviews > 10 THEN 10 ELSE 0 END AS b,
  CASE WHEN size LIKE '%50,000%' OR size LIKE '%100,000%' THEN 15 WHEN size LIKE '%10,000%' OR size LIKE '%25,000%' THEN 10 ELSE 0 END AS c FROM n)
SELECT s AS s_suppkey, CAST(CASE WHEN coalesce(rating, '') <> '' AND num IS NULL THEN 50 WHEN reviews IS NULL THEN 50 + a ELSE least(50 + a + b + c, 100) END AS INTEGER) AS score FROM p"""
ORACLES["page_urls"] = """SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN i = 0 THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || i END AS page_url
FROM (SELECT page_id, url, unnest(range(CASE WHEN page_id % 5 - 1 <= 0 THEN 10 ELSE page_id % 5 - 1 END)) AS i FROM pages)"""
ROUTED = """routed AS (
  SELECT *, CASE WHEN host = 'blog.tionsh.example.net' OR suffix(host, '.blog.tionsh.example.net') OR host = 'example.org' OR suffix(host, '.example.org') THEN 'blog_tionsh'
    WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'com_site' WHEN host = 'example.net' OR suffix(host, '.example.net') THEN 'net_site' END AS extractor_id
  FROM (SELECT *, split_part(split_part(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https://', ''), '^http://', ''), '^www\\.', ''), '/', 1), ':', 1) AS host FROM pages)
)"""
ORACLES["extractor_pages"] = f"""WITH {ROUTED}, n AS (SELECT page_id, url, coalesce(extractor_id, '') = 'com_site' AS own, coalesce(extractor_id, '') = 'net_site' AS coded, unnest(range(page_id % 4 + 1)) AS i FROM routed)
SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN coded AND i > 0 THEN url || '#' || CASE i WHEN 1 THEN md5(url) WHEN 2 THEN md5(md5(url)) ELSE md5(md5(md5(url))) END
  WHEN own THEN rtrim(url, '/') || '/p/' || (i + 1) WHEN i = 0 THEN url
  ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || i END AS page_url FROM n"""
ORACLES["route_pages"] = f"WITH {ROUTED} SELECT page_id, url, extractor_id FROM routed"
ORACLES["extract_listing"] = """WITH found AS (
  SELECT page_id, url, 0 AS ord, 'Shop ' || page_id AS company_name, 'First note ' || page_id AS summary FROM pages
  UNION ALL SELECT page_id, url, 1, 'Card ' || page_id, 'Second & note' FROM pages
  UNION ALL SELECT page_id, url, 2, 'Item ' || page_id, 'Item ' || page_id FROM pages
  UNION ALL SELECT page_id, url, 2 + i, 'Extra ' || i, 'About ' || page_id FROM (SELECT *, unnest(range(1, page_id % 3 + 2)) AS i FROM pages))
SELECT page_id, CAST(ord AS INTEGER) AS ord, company_name, summary, 'com_site' AS source_directory, url AS source_url FROM found"""
# HTML ends "&amp" without its semicolon too, as a title cut inside the entity has it.
ORACLES["extract_titles"] = f"""WITH {ROUTED} SELECT page_id, extractor_id,
  trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&amp;?', '&', 'g')) AS company_name,
  extractor_id AS source_directory, url AS source_url FROM routed WHERE extractor_id IS NOT NULL"""
ORACLES["valid_records"] = """SELECT conv_id, CASE WHEN n > 0 THEN 'SUCCESS' ELSE 'ZERO_ROWS' END AS status, n AS items_scraped, total - n AS discarded
FROM (SELECT conv_id, count(*) FILTER (WHERE role <> 'system' AND length(text) > 0) AS n, count(*) AS total FROM conversations GROUP BY conv_id)"""
ORACLES["source_urls"] = "SELECT page_id, url AS source_url FROM pages"
ORACLES["strip_html"] = """SELECT page_id, md5(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text_md5 FROM pages"""
ORACLES["escape_html"] = """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html_md5 FROM pages"""

# Merges

ITEMS = """cur AS (SELECT s_suppkey AS id, s_name AS company_name, 'nation ' || s_nationkey AS summary, 'https://example.com/s/' || s_suppkey AS source_url,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey) AS created_at FROM supplier),
batch AS (SELECT c_custkey AS pos, 'Supplier#' || lpad(CAST(c_custkey // 10 AS VARCHAR), 9, '0') AS company_name, 'segment ' || c_mktsegment AS summary,
  'https://example.com/c/' || c_custkey AS source_url FROM customer),
lasts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY pos DESC) = 1),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY pos) = 1)"""
ORACLES["upsert_items"] = f"""WITH {ITEMS}
SELECT c.id, c.company_name, coalesce(l.summary, c.summary) AS summary, coalesce(l.source_url, c.source_url) AS source_url, c.created_at FROM cur c LEFT JOIN lasts l USING (company_name)
UNION ALL SELECT (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY company_name), company_name, summary, source_url, {NOW}
  FROM lasts WHERE company_name NOT IN (SELECT company_name FROM cur)"""
ORACLES["insert_ignore"] = f"""WITH {ITEMS} SELECT * FROM cur UNION ALL
SELECT pos + 1000000, company_name, summary, source_url, {NOW} FROM firsts WHERE company_name NOT IN (SELECT company_name FROM cur)"""
ORACLES["dedupe_last"] = f"WITH {ITEMS} SELECT * FROM lasts"
ORACLES["dedupe_first"] = f"WITH {ITEMS} SELECT * FROM firsts"
ORACLES["items_recent"] = f"WITH {ITEMS} SELECT company_name, summary, source_url, created_at FROM cur ORDER BY created_at DESC, company_name"
ORACLES["load_counts"] = "SELECT count(DISTINCT c_custkey // 10) AS scraped, count(DISTINCT c_custkey // 10) AS stored FROM customer"
ORACLES["run_registry"] = """SELECT 'run-' || user_id AS run_id, event_type AS model_name, value AS metric, 's3://runs/' || event_id AS artifact_uri
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

# Vectors, media

CENTROIDS = """points AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
means AS (SELECT label, i, avg(v[i]) AS x FROM points, range(1, 65) t(i) GROUP BY label, i),
centroids AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY label)"""


def _knn(score: str, order: str, keep: str = "true") -> str:
    return f"""WITH {CENTROIDS}, scored AS (SELECT query_id, id, CAST(label AS VARCHAR) AS label, {score} AS score FROM centroids, points)
SELECT query_id, id, label, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS INTEGER) AS rank
FROM scored WHERE {keep} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) <= 10"""


ORACLES["knn_cosine"] = _knn("list_cosine_similarity(q, v)", "DESC")
ORACLES["knn_euclid"] = _knn("list_distance(q, v)", "ASC")
ORACLES["knn_dot_threshold"] = _knn("list_inner_product(q, v)", "DESC", "score >= 0.04")
# A centroid replaces the point of its id; vectors are 32-bit.
MERGED = """merged AS (
  SELECT id, CASE WHEN q IS NULL THEN CAST(label AS VARCHAR) ELSE '' END AS label, coalesce(q, v)::FLOAT[] AS v FROM points LEFT JOIN (SELECT query_id * 100 AS id, q FROM centroids) c USING (id)
  UNION ALL SELECT query_id * 100, '', q::FLOAT[] FROM centroids WHERE query_id * 100 NOT IN (SELECT id FROM points))"""
ORACLES["point_upsert"] = f"""WITH {CENTROIDS}, {MERGED}
SELECT id, label, CAST(i - 1 AS INTEGER) AS dim, round(CAST(v[i] AS DOUBLE), 5) AS x FROM merged, range(1, 65) t(i)"""
ORACLES["collection_versions"] = f"""WITH {CENTROIDS}, {MERGED}
SELECT label, count(*) AS points, 64 AS dims, 64 AS dim, 'Dot' AS metric FROM merged GROUP BY label"""
# Vectors are 32-bit.
ORACLES["embed_hash"] = """WITH terms AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM documents),
dims AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS n FROM terms WHERE term <> '' GROUP BY 1, 2)
SELECT doc_id, dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) AS weight FROM dims"""
MEDIA = """media AS (SELECT conv_id AS cluster_id, turn AS ord, CASE role WHEN 'assistant' THEN 'image' WHEN 'user' THEN 'video' END AS type,
  CASE WHEN turn % 3 = 1 THEN text ELSE '' END AS title, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN text END AS speech_transcript,
  CASE WHEN role = 'user' THEN text ELSE '  ' END AS ocr_text, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS brand FROM conversations)"""
ORACLES["cluster_summary"] = f"""WITH {MEDIA}, kinds AS (SELECT cluster_id, coalesce(type, 'video') AS k, count(*) AS n FROM media GROUP BY 1, 2),
lead AS (SELECT cluster_id, k AS primary_media_type FROM kinds QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, k) = 1),
facts AS (SELECT cluster_id, arg_min(speech_transcript, ord) FILTER (WHERE speech_transcript <> '') AS s, arg_min(title, ord) FILTER (WHERE title <> '') AS t,
  arg_min(ocr_text, ord) FILTER (WHERE ocr_text <> '') AS o, count(*) AS n, count(DISTINCT nullif(brand, '')) AS b, arg_min(brand, ord) FILTER (WHERE brand <> '') AS lead_brand FROM media GROUP BY cluster_id),
hooked AS (SELECT *, coalesce(s, t, 'Discover the ultimate solution today.') AS hook, coalesce(o, 'SPECIAL OFFER 50% OFF') AS overlay FROM facts)
SELECT cluster_id, 'success' AS status, NULL::VARCHAR AS message, primary_media_type, n AS analyzed_items_count, b AS brand_count, lead_brand, hook, overlay,
  'Script for cluster #' || cluster_id || chr(10) || 'Voiceover: "' || hook || '"' || chr(10) || 'On-Screen Text: "' || overlay || '"' AS generated_script,
  'Product shot of ' || coalesce(lead_brand, 'modern product') || ' with the text "' || overlay || '"' AS visual_prompt
FROM hooked JOIN lead USING (cluster_id)"""
ORACLES["cluster_brands"] = f"WITH {MEDIA} SELECT DISTINCT cluster_id, brand FROM media WHERE brand <> ''"
ORACLES["media_context"] = f"""WITH {MEDIA}, seen AS (SELECT cluster_id, trim(ocr_text, ' ' || chr(9) || chr(10) || chr(13)) AS t, min(ord) AS ord FROM media GROUP BY 1, 2),
joined AS (SELECT cluster_id, coalesce(string_agg(t, ' | ' ORDER BY ord) FILTER (WHERE t <> ''), '') AS visual_ocr_text FROM seen GROUP BY cluster_id)
SELECT cluster_id, visual_ocr_text, 'Brand ' || cluster_id AS brand_name, 'hello' AS speech_transcript,
  'Brand: Brand ' || cluster_id || ' | Speech: hello | OnScreen Text: ' || visual_ocr_text AS full_semantic_payload FROM joined"""
ORACLES["frame_sample"] = """SELECT doc_id, frames, i * greatest(1, frames // 5) AS frame
FROM (SELECT doc_id, n_chars - 20 AS frames FROM documents), range(5) t(i) WHERE frames > 0 AND i * greatest(1, frames // 5) < frames"""

# Snapshots, payloads, reports

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS component, count(*) AS row_count FROM {t}" for t in TABLES)
ORACLES["snapshot_manifest"] = f"SELECT component, row_count, CASE WHEN row_count > 0 THEN 'ok' ELSE 'empty' END AS status FROM ({COUNTS})"
ORACLES["restore_status"] = f"SELECT 'complete' AS status, count(*) + 1 AS components, CAST(sum(row_count) AS BIGINT) AS row_count FROM ({COUNTS})"
ORACLES["snapshot_rollup"] = f"SELECT 'partial' AS status, count(*) + 1 AS components, CAST(sum(row_count) AS BIGINT) AS row_count FROM ({COUNTS})"
ORACLES["json_payloads"] = "SELECT page_id, url, md5(html) AS html_md5 FROM pages"
CARD = """'<div class="card">' || chr(10) || '<h2>' || company_name || '</h2>' || chr(10) || '<p>' || summary || '</p>' || chr(10) || '<a href="' || source_url || '">' || source_url || '</a>' || chr(10) || '</div>'"""
ORACLES["report_cards"] = f"WITH {ITEMS} SELECT company_name, {CARD} AS card FROM cur"
ORACLES["report_page"] = f"""WITH {ITEMS}, n AS (SELECT count(*) AS n FROM cur)
SELECT 0::BIGINT AS position, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head><meta charset="utf-8"><title>Scraped items</title></head>' || chr(10)
  || '<body>' || chr(10) || '<h1>Scraped items</h1>' || chr(10) || '<p class="subtitle">' || n || ' row(s)</p>' AS html FROM n
UNION ALL SELECT row_number() OVER (ORDER BY created_at DESC, company_name), {CARD} FROM cur
UNION ALL SELECT n + 1, '</body>' || chr(10) || '</html>' FROM n"""

# Streams: the batch equivalent

ORACLES["stream_log_errors"] = f"WITH {LINES} SELECT bundle_name, message FROM log_errors"
ORACLES["stream_log_tail"] = f"""WITH {LINES}, f AS (SELECT floor(ord / 500)::BIGINT AS file, ord % 500 + 1 AS line, value FROM log_lines),
sizes AS (SELECT file, max(line) AS n FROM f GROUP BY file),
scans AS (
  SELECT 0 AS scan, value FROM f JOIN sizes USING (file) WHERE line <= 360 AND line > least(n, 360) - 300
  UNION ALL SELECT 1, value FROM f WHERE line > 360
  UNION ALL SELECT 2, value FROM f JOIN sizes USING (file) WHERE file % 3 = 1 AND n > 330 AND line <= 330 AND line > 30)
SELECT DISTINCT scan, coalesce(nullif(regexp_extract(value, '{PATTERN}', 1), ''), 'unknown_bundle') AS bundle_name, left(trim(value), 140) AS message
FROM scans WHERE regexp_matches(value, '{ERRORS}', 'i')"""
ORACLES["stream_health"] = f"""WITH {_health(False)}
SELECT bundle_name, status, total AS total_runs_24h, success AS success_runs_24h, failed AS failed_runs_24h FROM health"""
ORACLES["stream_telemetry"] = f"""WITH {RUNS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS dt, bundle_name, count(*) AS runs, CAST(sum(items_scraped) AS BIGINT) AS items FROM runs GROUP BY 1, 2"""
ORACLES["stream_trailing"] = f"""WITH {RUNS}, buckets AS (
  SELECT bundle_name, (CAST(floor(epoch(created_at) / 300) AS BIGINT) + 1) * 300 AS as_of, count(*) AS t, count(*) FILTER (status = 'SUCCESS') AS s,
    count(*) FILTER (status IN ('ZERO_ROWS', 'DEGRADED')) AS a, count(*) FILTER (status = 'FAILED') AS f FROM runs GROUP BY ALL)
SELECT bundle_name, as_of, CAST(sum(t) OVER w AS BIGINT) AS total_runs_24h, CAST(sum(s) OVER w AS BIGINT) AS success_runs_24h,
  CAST(sum(a) OVER w AS BIGINT) AS anomaly_runs_24h, CAST(sum(f) OVER w AS BIGINT) AS failed_runs_24h
FROM buckets WINDOW w AS (PARTITION BY bundle_name ORDER BY as_of RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)"""

# Single linkage by recursion: a step joins the two components with the least distance. Every point carries the account of its
# component's cluster (c: rank of the step that made it; mass; below: stability of the clusters inside it).
ORACLES["density_clusters"] = """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
e AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY w, a, b) AS k FROM (
    SELECT p.id AS a, q.id AS b, sqrt(list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS w FROM v p JOIN v q ON p.id < q.id)),
r AS (
  SELECT id, id AS comp, 1 AS n, NULL::BIGINT AS c, 0.0::DOUBLE AS mass, 0.0::DOUBLE AS below, 0::BIGINT AS step, NULL::BIGINT AS was, NULL::DOUBLE AS own, NULL::DOUBLE AS inner_own FROM v
  UNION ALL
  SELECT r.id, CASE WHEN r.comp IN (u.comp, t.comp) THEN least(u.comp, t.comp) ELSE r.comp END, CASE WHEN r.comp IN (u.comp, t.comp) THEN u.n + t.n ELSE r.n END,
    CASE WHEN r.comp NOT IN (u.comp, t.comp) THEN r.c WHEN (u.c IS NULL) = (t.c IS NULL) THEN m.k ELSE coalesce(u.c, t.c) END,
    CASE WHEN r.comp NOT IN (u.comp, t.comp) THEN r.mass WHEN (u.c IS NULL) = (t.c IS NULL) THEN (u.n + t.n) / m.l
         WHEN u.c IS NULL THEN t.mass + u.n / m.l ELSE u.mass + t.n / m.l END,
    CASE WHEN r.comp NOT IN (u.comp, t.comp) THEN r.below WHEN u.c IS NOT NULL AND t.c IS NOT NULL THEN greatest(u.mass - u.n / m.l, u.below) + greatest(t.mass - t.n / m.l, t.below)
         ELSE u.below + t.below END,
    m.k, r.c, CASE WHEN r.comp IN (u.comp, t.comp) AND u.c IS NOT NULL AND t.c IS NOT NULL THEN r.mass - r.n / m.l END, r.below
  FROM r, (SELECT min(e.k) AS k, arg_min(e.a, e.k) AS a, arg_min(e.b, e.k) AS b, greatest(arg_min(e.w, e.k), 2.2250738585072014e-308) AS l
           FROM e JOIN r p ON p.id = e.a JOIN r q ON q.id = e.b WHERE p.comp <> q.comp) m
    JOIN r u ON u.id = m.a JOIN r t ON t.id = m.b),
ended AS (SELECT DISTINCT was AS cluster, c AS parent, own >= inner_own AS wins FROM r WHERE own IS NOT NULL),
top AS (
  SELECT cluster, parent, CASE WHEN wins THEN cluster END AS top FROM ended
  UNION ALL SELECT t.cluster, e.parent, CASE WHEN e.wins THEN e.cluster END FROM top t JOIN ended e ON e.cluster = t.parent),
tops AS (SELECT cluster, max(top) AS top FROM top GROUP BY cluster),
entered AS (SELECT id, min_by(c, step) AS cluster FROM r WHERE c IS NOT NULL GROUP BY id),
placed AS (SELECT id, top FROM entered JOIN tops USING (cluster) WHERE top IS NOT NULL),
named AS (SELECT top, row_number() OVER (ORDER BY min(id)) - 1 AS label FROM placed GROUP BY top)
SELECT v.id, coalesce(label, -1)::INTEGER AS label FROM v LEFT JOIN placed USING (id) LEFT JOIN named USING (top)"""

ORACLES["knn_pruned"] = ORACLES["knn_cosine"]
