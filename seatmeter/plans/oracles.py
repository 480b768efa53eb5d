"""The registered queries as plain SQL over the same test tables, written independently of the operators."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 12:00:00'"

# Derived tables by name; each may use the ones before it.
_TABLES = {
    "raw_polls": """
        SELECT event_id AS poll_id, user_id, event_type, value, ts, n_nationkey AS nk, n_name,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events JOIN nation ON user_id % 25 = n_nationkey""",
    "polls": """
        SELECT poll_id, user_id, k, nk, '27000@' || lower(replace(n_name, '_', '-')) || '.example.com' AS server_hostname,
               lower(replace(n_name, '_', '-')) || '.example.com' AS machine, lower(replace(n_name, '_', '-')) AS short,
               CASE WHEN nk % 3 = 0 THEN 'rlm' ELSE 'flexlm' END AS server_type,
               event_type AS feature_name, 'v' || (k % 3) AS version, 'vd' || (nk % 2) AS vendor_daemon,
               CASE WHEN nk = 14 THEN 0 ELSE 60 + 60 * (nk % 5) END AS total_licenses,
               CAST(floor(value) AS INTEGER) AS used_licenses,
               CASE WHEN k % 10 <> 0 THEN CAST(DATE '2024-01-31' + (k - 20) AS TIMESTAMP) END AS expiration_date,
               date_trunc('day', ts) AS polled_at, ts AS sampled_at
        FROM raw_polls""",
    "features": """
        SELECT poll_id AS id, p.server_hostname, feature_name AS name, version, vendor_daemon, total_licenses,
               used_licenses, expiration_date, polled_at AS last_updated, polled_at = latest AS is_active
        FROM (SELECT *, row_number() OVER (PARTITION BY server_hostname, feature_name, version, expiration_date
                                           ORDER BY poll_id DESC) AS rn FROM polls) p
        JOIN (SELECT server_hostname, max(polled_at) AS latest FROM polls GROUP BY 1) l
          ON l.server_hostname = p.server_hostname
        WHERE rn = 1""",
    "feature_usage": """
        SELECT poll_id AS id, server_hostname, feature_name, date, time, users_count
        FROM (SELECT poll_id, server_hostname, feature_name, CAST(sampled_at AS DATE) AS date,
                     strftime(sampled_at, '%H:%M:00') AS time, used_licenses AS users_count,
                     row_number() OVER (PARTITION BY server_hostname, feature_name, CAST(sampled_at AS DATE),
                                        strftime(sampled_at, '%H:%M:00') ORDER BY poll_id) AS rn
              FROM polls)
        WHERE rn = 1""",
    "servers": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               '27000@' || lower(replace(n_name, '_', '-')) || '.example.com' AS hostname, n_name AS description,
               CASE WHEN n_nationkey % 3 = 0 THEN 'rlm' ELSE 'flexlm' END AS type, 'c' || n_nationkey AS cacti_id,
               'https://web-' || n_nationkey AS webui, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
               {as_of} AS updated_at
        FROM nation""",
    "license_events": """
        SELECT poll_id AS id, CAST(sampled_at AS DATE) AS event_date, strftime(sampled_at, '%H:%M:%S') AS event_time,
               CASE WHEN feature_name = 'error' THEN 'DENIED' WHEN feature_name IN ('view', 'signup') THEN 'OUT'
                    ELSE 'IN' END AS event_type,
               'tool' || (k % 10) AS feature_name, 'user' || user_id AS username,
               CASE WHEN feature_name = 'error' THEN 'reason ' || (k % 3) ELSE '' END AS reason
        FROM polls""",
    "checkouts": """
        SELECT server_hostname, feature_name, 'user' || user_id AS username, 'host' || (user_id % 40) AS host,
               sampled_at AS checked_out_at, '2024.' || (k % 4) AS version, version AS license_version
        FROM polls""",
    "alerts": """
        SELECT id, server_hostname, name AS feature_name, 'expiration' AS alert_type,
               'License ''' || name || ''' on ' || server_hostname || ' expires in ' || days || ' days ('
               || strftime(expiration_date, '%Y-%m-%d') || ')' AS message,
               CASE WHEN days <= 3 THEN 'critical' WHEN days <= 7 THEN 'warning' ELSE 'info' END AS severity,
               id % 2 = 0 AS sent,
               CASE WHEN id % 2 = 0 THEN last_updated + INTERVAL 5 MINUTE END AS sent_at, last_updated AS created_at
        FROM (SELECT *, CAST(trunc(epoch(expiration_date - last_updated) / 86400) AS INTEGER) AS days FROM features)
        WHERE expiration_date > last_updated AND expiration_date <= last_updated + INTERVAL 10 DAY""",
    "alert_events": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               {as_of} - CASE WHEN n_nationkey % 2 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 90 MINUTE END AS datetime,
               'expiration' AS type,
               '27000@' || lower(replace(n_name, '_', '-')) || '.example.com' AS hostname
        FROM nation""",
    "current_util": """
        SELECT f.server_hostname, f.name AS feature_name, f.version, f.total_licenses, f.used_licenses,
               f.total_licenses - f.used_licenses AS available_licenses,
               CASE WHEN f.total_licenses > 0 THEN f.used_licenses * 100.0 / f.total_licenses ELSE 0 END
                 AS utilization_pct, f.vendor_daemon
        FROM features f
        JOIN (SELECT server_hostname, name, max(last_updated) AS latest FROM features WHERE total_licenses > 0
              GROUP BY 1, 2) l
          ON f.server_hostname = l.server_hostname AND f.name = l.name AND f.last_updated = l.latest
        WHERE f.total_licenses > 0""",
    "capacity": """
        SELECT server_hostname, name AS feature_name, arg_min(total_licenses, id) AS total_licenses
        FROM features GROUP BY 1, 2""",
    "stats": """
        SELECT u.server_hostname, u.feature_name, avg_usage, peak_usage, min_usage, total_licenses,
               CASE WHEN total_licenses > 0 THEN avg_usage / total_licenses * 100 ELSE 0 END AS avg_utilization_pct
        FROM (SELECT server_hostname, feature_name, avg(users_count) AS avg_usage, max(users_count) AS peak_usage,
                     min(users_count) AS min_usage
              FROM feature_usage WHERE date >= DATE '2024-01-01' GROUP BY 1, 2) u
        LEFT JOIN capacity c USING (server_hostname, feature_name)""",
    "hourly": """
        SELECT server_hostname, feature_name, CAST(substr(time, 1, 2) AS INTEGER) AS hour, avg(users_count) AS avg_usage,
               max(users_count) AS peak_usage
        FROM feature_usage WHERE date >= DATE '2024-01-01' GROUP BY 1, 2, 3""",
    "strict_usage": """
        SELECT *, CAST(users_count AS DOUBLE) AS y,
               date_diff('day', min(date) OVER (PARTITION BY server_hostname, feature_name), date) AS x,
               row_number() OVER (PARTITION BY server_hostname, feature_name ORDER BY date DESC, time DESC) AS age
        FROM feature_usage WHERE date >= DATE '2024-01-02'""",
    "line": """
        SELECT server_hostname, feature_name, n, mean, stddev, least, most, last_day, last_value, median, avg7, avg30,
               CASE WHEN den = 0 THEN 0 ELSE (n * sxy - sx * sy) / den END AS slope,
               CASE WHEN den = 0 THEN mean ELSE (sy - (n * sxy - sx * sy) / den * sx) / n END AS intercept
        FROM (SELECT server_hostname, feature_name, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS stddev,
                     min(users_count) AS least, max(users_count) AS most, max(x) AS last_day,
                     max(CASE WHEN age = 1 THEN y END) AS last_value, median(y) AS median,
                     avg(CASE WHEN age <= 7 THEN y END) AS avg7, avg(CASE WHEN age <= 30 THEN y END) AS avg30,
                     sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy,
                     CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS den
              FROM strict_usage GROUP BY 1, 2)""",
    "fit": """
        SELECT l.*, CASE WHEN tot = 0 THEN 0 ELSE greatest(least(1 - res / tot, 1), 0) END AS r_squared
        FROM line l
        JOIN (SELECT u.server_hostname, u.feature_name, sum((y - mean) * (y - mean)) AS tot,
                     sum((y - slope * x - intercept) * (y - slope * x - intercept)) AS res
              FROM strict_usage u JOIN line USING (server_hostname, feature_name) GROUP BY 1, 2) s
          USING (server_hostname, feature_name)""",
    "fit7": """
        SELECT f.*, total_licenses, slope * last_day + intercept AS expected
        FROM fit f JOIN capacity USING (server_hostname, feature_name) WHERE n >= 7""",
    "enhanced": """
        SELECT f.server_hostname, f.feature_name, total_licenses, mean AS avg_usage, median AS median_usage,
               greatest(most, 0) AS peak_usage, least AS min_usage, stddev AS std_dev,
               CASE WHEN total_licenses > 0 THEN mean / total_licenses * 100 ELSE 0 END AS avg_pct,
               CASE WHEN total_licenses > 0 THEN CAST(greatest(most, 0) AS DOUBLE) / total_licenses * 100 ELSE 0 END AS peak_pct,
               slope, avg7, avg30, coalesce(peak_hour, 0) AS peak_hour
        FROM fit f JOIN capacity USING (server_hostname, feature_name)
        LEFT JOIN (SELECT server_hostname, feature_name, CASE WHEN avg_usage > 0 THEN hour ELSE 0 END AS peak_hour
                   FROM (SELECT *, row_number() OVER (PARTITION BY server_hostname, feature_name
                                                      ORDER BY avg_usage DESC, hour) AS rn FROM hourly)
                   WHERE rn = 1) USING (server_hostname, feature_name)
        WHERE n >= 2""",
    "scored": """
        SELECT *, CASE WHEN total_licenses = 0 THEN 0 ELSE greatest(0, least(100,
                   CASE WHEN avg_pct < 30 THEN avg_pct / 30 * 100
                        WHEN avg_pct > 80 THEN 100 - (avg_pct - 80) / 20 * 30 ELSE 100 END
                   - CASE WHEN avg_pct > 0 AND peak_pct / avg_pct > 2 THEN (peak_pct / avg_pct - 2) * 10 ELSE 0 END
                   - CASE WHEN std_dev > total_licenses * 0.3 THEN 10 ELSE 0 END)) END AS score
        FROM enhanced""",
    "trended": """
        SELECT s.server_hostname, s.feature_name, s.total_licenses, avg_usage, peak_usage,
               avg_utilization_pct AS utilization_pct, coalesce(slope, 0) AS trend_slope,
               CASE WHEN slope > 0 AND total_licenses > 0 AND total_licenses - (slope * last_day + last_value) > 0
                    THEN CAST(trunc((total_licenses - (slope * last_day + last_value)) / slope) AS INTEGER)
                    ELSE -1 END AS days_to_capacity
        FROM stats s LEFT JOIN (SELECT * FROM line WHERE n >= 7) USING (server_hostname, feature_name)""",
    "expiring": """
        SELECT *, CAST(trunc(epoch(expiration_date - {as_of}) / 86400) AS INTEGER) AS days_to_expire
        FROM features
        WHERE is_active AND expiration_date > {as_of} AND expiration_date <= {as_of} + INTERVAL 10 DAY""",
    "expiring_labeled": """
        SELECT *, CASE WHEN days_to_expire <= 3 THEN 'critical' WHEN days_to_expire <= 7 THEN 'warning'
                       ELSE 'info' END AS severity,
               'License ''' || name || ''' on ' || server_hostname || ' expires in ' || days_to_expire || ' days ('
               || strftime(expiration_date, '%Y-%m-%d') || ')' AS message
        FROM expiring""",
    "new_alerts": """
        SELECT id, server_hostname, name AS feature_name, 'expiration' AS alert_type, message, severity, FALSE AS sent,
               CAST(NULL AS TIMESTAMP) AS sent_at, {as_of} AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY server_hostname ORDER BY expiration_date, name, version, id)
                AS rn FROM expiring_labeled)
        WHERE rn = 1 AND NOT EXISTS (
            SELECT 1 FROM alert_events e WHERE e.hostname = server_hostname AND e.type = 'expiration'
            AND e.datetime > {as_of} - INTERVAL 60 MINUTE)""",
    "due": """
        SELECT server_hostname AS hostname, sampled_at AS datetime, feature_name FROM polls
        WHERE expiration_date >= sampled_at AND expiration_date <= sampled_at + INTERVAL 10 DAY""",
    "due_next": """
        SELECT a.hostname, a.datetime, a.feature_name, b.datetime AS next_at
        FROM (SELECT *, datetime + INTERVAL 60 MINUTE AS free_at FROM due) a
        ASOF LEFT JOIN due b ON a.hostname = b.hostname AND a.free_at <= b.datetime""",
    "passing": """
        SELECT hostname, datetime, feature_name, next_at FROM due_next
        WHERE (hostname, datetime) IN (SELECT (hostname, min(datetime)) FROM due GROUP BY hostname)
        UNION ALL
        SELECT n.hostname, n.datetime, n.feature_name, n.next_at
        FROM passing p JOIN due_next n ON n.hostname = p.hostname AND n.datetime = p.next_at""",
    "table_rows": """
        SELECT 'servers' AS table_name, count(*) AS row_count, CAST(NULL AS DATE) AS oldest_record,
               CAST(NULL AS DATE) AS newest_record FROM servers
        UNION ALL SELECT 'features', count(*), NULL, NULL FROM features
        UNION ALL SELECT 'feature_usage', count(*), min(date), max(date) FROM feature_usage
        UNION ALL SELECT 'license_events', count(*), NULL, NULL FROM license_events
        UNION ALL SELECT 'alerts', count(*), NULL, NULL FROM alerts
        UNION ALL SELECT 'alert_events', count(*), NULL, NULL FROM alert_events""",
    "holders": """
        SELECT p.*, i FROM polls p, (VALUES (1), (2), (3)) v(i) WHERE i <= k % 4 AND k % 20 <> 0""",
    "flex_pools": """
        SELECT poll_id, server_hostname, feature_name AS name, (k % 3) || '.0' AS version, vendor_daemon,
               total_licenses,
               CASE WHEN k % 4 > 0 THEN k % 4 WHEN total_licenses > 0 THEN least(used_licenses, total_licenses)
                    ELSE 0 END AS used_licenses,
               TIMESTAMP '2099-01-01 00:00:00' AS expiration_date, sampled_at
        FROM polls WHERE server_type = 'flexlm' AND k % 20 > 1
        UNION ALL
        SELECT poll_id, server_hostname, feature_name, '9.0', 'old', 30,
               CASE WHEN total_licenses > 0 THEN least(used_licenses * 30 // total_licenses, 30) ELSE 0 END,
               CAST(make_date(2025, month(sampled_at), 1) AS TIMESTAMP), sampled_at
        FROM polls WHERE server_type = 'flexlm' AND k % 20 > 1
        UNION ALL
        SELECT poll_id, server_hostname, 'plain_' || (k % 4), '', '', 10, k % 10, NULL, sampled_at
        FROM polls WHERE server_type = 'flexlm' AND k % 20 > 1
        UNION ALL
        SELECT poll_id, server_hostname, 'free_' || (k % 2), '', '', 9999, 0, NULL, sampled_at
        FROM polls WHERE server_type = 'flexlm' AND k % 20 > 1""",
    "event_steps": """
        SELECT *, lag(tm) OVER w AS at_before, lag(event_type) OVER w AS type_before,
               lead(id) OVER w IS NULL AS is_last
        FROM (SELECT *, CAST(event_date AS TIMESTAMP) + CAST(event_time AS INTERVAL) AS tm FROM license_events
              WHERE event_type IN ('IN', 'OUT'))
        WINDOW w AS (PARTITION BY feature_name, username ORDER BY tm, id)""",
    "sessions": """
        SELECT feature_name, username, CASE WHEN type_before = 'OUT' THEN at_before END AS started_at, tm AS ended_at,
               CASE WHEN event_type = 'OUT' THEN 'replaced' WHEN type_before = 'OUT' THEN 'returned' ELSE 'unmatched' END
                 AS state
        FROM event_steps WHERE event_type = 'IN' OR type_before = 'OUT'
        UNION ALL SELECT feature_name, username, tm, NULL, 'held' FROM event_steps WHERE is_last AND event_type = 'OUT'""",
    "levels": """
        SELECT feature_name, tm, started, sum(step) OVER (PARTITION BY feature_name ORDER BY tm) AS users
        FROM (SELECT feature_name, tm, sum(step) AS step, sum(started) AS started
              FROM (SELECT feature_name, started_at AS tm, 1 AS step, 1 AS started FROM sessions
                    UNION ALL SELECT feature_name, ended_at, -1, 0 FROM sessions WHERE started_at IS NOT NULL)
              WHERE tm IS NOT NULL GROUP BY 1, 2)""",
    "tool_states": """
        SELECT server_hostname, 'tool' || (k % 10) AS feature_name, sampled_at AS tm,
               arg_max(total_licenses // 4, poll_id) AS total,
               arg_max(least(total_licenses // 4, used_licenses), poll_id) AS used
        FROM polls GROUP BY 1, 2, 3""",
    "denied": """
        SELECT id, feature_name, username, reason, CAST(event_date AS TIMESTAMP) + CAST(event_time AS INTERVAL) AS tm
        FROM license_events WHERE event_type = 'DENIED'""",
    "rounds": """
        SELECT server_hostname, polled_at, row_number() OVER w AS round, lead(polled_at) OVER w AS next_at
        FROM (SELECT DISTINCT server_hostname, polled_at FROM polls)
        WINDOW w AS (PARTITION BY server_hostname ORDER BY polled_at)""",
    "round_states": """
        SELECT *, lag(round) OVER w AS round_before, lag(next_at) OVER w AS next_before,
               lag(total) OVER w AS total_before, lag(used) OVER w AS used_before, lead(round) OVER w IS NULL AS is_last
        FROM (SELECT server_hostname, feature_name AS name, version, expiration_date, polled_at,
                     arg_max(total_licenses, poll_id) AS total, arg_max(used_licenses, poll_id) AS used
              FROM polls GROUP BY ALL) JOIN rounds USING (server_hostname, polled_at)
        WINDOW w AS (PARTITION BY server_hostname, name, version, expiration_date ORDER BY round)""",
    "pool_points": """
        SELECT server_hostname, name, version, expiration_date, polled_at AS tm, TRUE AS listed, total, used
        FROM round_states
        WHERE round_before IS NULL OR round_before + 1 < round OR total <> total_before OR used <> used_before
        UNION ALL SELECT server_hostname, name, version, expiration_date, next_before, FALSE, NULL, NULL
        FROM round_states WHERE round_before + 1 < round
        UNION ALL SELECT server_hostname, name, version, expiration_date, next_at, FALSE, NULL, NULL
        FROM round_states WHERE is_last AND next_at IS NOT NULL""",
    "answers": """
        SELECT poll_id, server_hostname, sampled_at AS tm, CAST(poll_id AS VARCHAR) AS dump_id,
               row_number() OVER (PARTITION BY server_hostname ORDER BY sampled_at, CAST(poll_id AS VARCHAR)) AS n
        FROM polls WHERE k % 20 <> 0""",
    "seen_holders": """
        SELECT DISTINCT a.server_hostname, n, tm, dump_id, feature_name, 'user' || i AS username, 'host' || (k % 7) AS host
        FROM holders h JOIN answers a USING (poll_id)""",
    "hours": """
        SELECT server_hostname, feature_name, CAST(date AS DATE) AS day, CAST(substr(time, 1, 2) AS INTEGER) AS hour,
               date_diff('day', DATE '1970-01-01', date) * 24 + CAST(substr(time, 1, 2) AS INTEGER) AS slot,
               avg(users_count) AS level
        FROM feature_usage GROUP BY ALL""",
    "hour_moments": """
        SELECT server_hostname, feature_name, count(*) AS hours, avg(level) AS mean, var_pop(level) AS variance
        FROM hours GROUP BY 1, 2""",
    "lagged": """
        SELECT a.server_hostname, a.feature_name, b.slot - a.slot AS lag, count(*) AS pairs,
               avg((a.level - mean) * (b.level - mean)) / any_value(variance) AS r
        FROM hours a JOIN hours b ON a.server_hostname = b.server_hostname AND a.feature_name = b.feature_name
             AND b.slot - a.slot IN (24, 168)
        JOIN hour_moments m ON m.server_hostname = a.server_hostname AND m.feature_name = a.feature_name
        WHERE variance > 1e-9 GROUP BY 1, 2, 3""",
    "by_hour": """
        SELECT server_hostname, feature_name, string_agg(coalesce(CAST(level AS VARCHAR), '-'), ',' ORDER BY i) AS pattern
        FROM (SELECT DISTINCT server_hostname, feature_name FROM feature_usage) CROSS JOIN range(24) r(i)
        LEFT JOIN (SELECT server_hostname, feature_name, CAST(substr(time, 1, 2) AS INTEGER) AS i,
                          CAST(round(avg(users_count) * 1000) AS BIGINT) AS level FROM feature_usage GROUP BY 1, 2, 3)
          USING (server_hostname, feature_name, i) GROUP BY 1, 2""",
    "by_weekday": """
        SELECT server_hostname, feature_name, string_agg(coalesce(CAST(level AS VARCHAR), '-'), ',' ORDER BY i) AS pattern
        FROM (SELECT DISTINCT server_hostname, feature_name FROM feature_usage) CROSS JOIN range(7) r(i)
        LEFT JOIN (SELECT server_hostname, feature_name, dayofweek(date) AS i,
                          CAST(round(avg(users_count) * 1000) AS BIGINT) AS level FROM feature_usage GROUP BY 1, 2, 3)
          USING (server_hostname, feature_name, i) GROUP BY 1, 2""",
    "week_cells": """
        SELECT server_hostname, feature_name, dayofweek(date) * 24 + CAST(substr(time, 1, 2) AS INTEGER) AS slot,
               avg(users_count) AS level
        FROM feature_usage GROUP BY 1, 2, 3""",
    "busy_cells": """
        SELECT server_hostname, feature_name, slot + turn * 168 AS slot, level,
               slot + turn * 168 - row_number() OVER (PARTITION BY server_hostname, feature_name ORDER BY slot + turn * 168)
                 AS island
        FROM (SELECT *, avg(level) OVER (PARTITION BY server_hostname, feature_name) AS mean FROM week_cells),
             (VALUES (0), (1)) t(turn)
        WHERE mean > 0 AND level >= 1.25 * mean - 1e-9""",
    "stretches": """
        SELECT server_hostname, feature_name, min(slot) % 168 AS start, count(*) AS hours, sum(level) AS total
        FROM busy_cells GROUP BY server_hostname, feature_name, island HAVING min(slot) BETWEEN 1 AND 168""",
    "rlm_pools": """
        SELECT poll_id, server_hostname, feature_name AS name, 'v' || (k % 3) || '.1' AS version, vendor_daemon,
               total_licenses, used_licenses,
               CASE WHEN k % 2 = 0 THEN TIMESTAMP '2099-01-01 00:00:00' ELSE TIMESTAMP '2025-12-31 00:00:00' END
                 AS expiration_date, sampled_at
        FROM polls WHERE server_type = 'rlm'
        UNION ALL
        SELECT poll_id, server_hostname, 'tool_' || (k % 5), 'v2.0', vendor_daemon, 999, k % 9,
               TIMESTAMP '2099-01-01 00:00:00', sampled_at
        FROM polls WHERE server_type = 'rlm'""",
    "form_pools": """
        SELECT poll_id, server_hostname, feature_name AS name, '3.1' AS version, '' AS vendor_daemon, total_licenses,
               1 AS used_licenses, CAST(NULL AS TIMESTAMP) AS expiration_date, sampled_at FROM polls WHERE k % 8 = 2
        UNION ALL SELECT poll_id, server_hostname, feature_name, '4.2', '', total_licenses,
               CASE WHEN total_licenses > 0 THEN least(used_licenses, total_licenses) ELSE used_licenses END, NULL, sampled_at
        FROM polls WHERE k % 8 = 3
        UNION ALL SELECT poll_id, server_hostname, upper(feature_name), '', '', total_licenses, 1, NULL, sampled_at
        FROM polls WHERE k % 8 = 3
        UNION ALL SELECT poll_id, server_hostname, feature_name, '7.0', vendor_daemon, total_licenses, 1,
               TIMESTAMP '2026-06-20 00:00:00', sampled_at FROM polls WHERE k % 8 = 4
        UNION ALL SELECT poll_id, server_hostname, upper(feature_name), '7.0', vendor_daemon, 5, 0,
               TIMESTAMP '2026-07-01 00:00:00', sampled_at FROM polls WHERE k % 8 = 4
        UNION ALL SELECT poll_id, server_hostname, feature_name, v, vendor_daemon, n,
               CASE WHEN total_licenses > 0 THEN least(used_licenses * n // total_licenses, n) ELSE 0 END, e, sampled_at
        FROM polls, (VALUES ('1.0', 2, TIMESTAMP '2099-01-01'), ('2.0', 3, TIMESTAMP '2036-01-01')) x(v, n, e)
        WHERE k % 8 = 5
        UNION ALL SELECT poll_id, server_hostname, feature_name, v, CASE WHEN v = '3.0' THEN '' ELSE vendor_daemon END, 4, 0, e,
               sampled_at
        FROM polls, (VALUES ('1.0', TIMESTAMP '2026-03-15'), ('2.0', TIMESTAMP '2099-01-01'), ('3.0', TIMESTAMP '2036-01-01'),
                            ('4.0', TIMESTAMP '2027-11-09')) x(v, e)
        WHERE k % 8 = 6
        UNION ALL SELECT poll_id, server_hostname, feature_name, '', '', total_licenses, 3, NULL, sampled_at
        FROM polls WHERE k % 8 = 7""",
    "text_pools": "SELECT * FROM flex_pools UNION ALL SELECT * FROM rlm_pools",
}

_WITH = "WITH RECURSIVE " + ",\n".join(
    f"{name} AS ({text.replace('{as_of}', AS_OF)})" for name, text in _TABLES.items()
) + "\n"

_FEATURE_ROW = ("id, server_hostname, name, version, vendor_daemon, total_licenses, used_licenses, expiration_date, "
                "last_updated, is_active")
_ALERT_ROW = ("id, server_hostname, feature_name, alert_type, message, severity, sent, sent_at, created_at")
_DUMP_POOL = ("CAST(poll_id AS VARCHAR) AS dump_id, server_hostname, name, version, vendor_daemon, total_licenses, "
              "used_licenses, expiration_date, sampled_at AS last_updated")
_AGE = f"CAST(floor(epoch({AS_OF} - checked_out_at)) AS BIGINT)"
_REACH = ("CASE WHEN slope > 0 AND total_licenses > 0 AND total_licenses - expected > 0 "
          "THEN CAST(trunc((total_licenses - expected) / slope) AS INTEGER) ELSE -1 END")


def _direction(slope: str) -> str:
    return f"CASE WHEN {slope} > 0.1 THEN 'increasing' WHEN {slope} < -0.1 THEN 'decreasing' ELSE 'stable' END"


_BODIES = {
    "collected_inventory": """
        SELECT p.server_hostname, name, version, vendor_daemon, total_licenses, used_licenses, expiration_date,
               p.sampled_at AS last_updated, p.sampled_at = latest AS is_active
        FROM (SELECT *, row_number() OVER (PARTITION BY server_hostname, name, version, expiration_date
                                           ORDER BY sampled_at DESC, CAST(poll_id AS VARCHAR) DESC) AS rn FROM text_pools) p
        JOIN (SELECT server_hostname, max(sampled_at) AS latest FROM text_pools GROUP BY 1) USING (server_hostname)
        WHERE rn = 1""",
    "collected_usage": """
        SELECT server_hostname, feature_name, date, time, users_count
        FROM (SELECT server_hostname, name AS feature_name, CAST(sampled_at AS DATE) AS date,
                     strftime(sampled_at, '%H:%M:00') AS time, used_licenses AS users_count,
                     row_number() OVER (PARTITION BY server_hostname, name, date_trunc('minute', sampled_at)
                                        ORDER BY sampled_at, CAST(poll_id AS VARCHAR), version, expiration_date NULLS FIRST) AS rn
              FROM text_pools)
        WHERE rn = 1""",
    "stream_status_texts": """
        SELECT 'server_status' AS type, 'server:' || server_hostname AS channel, sampled_at AS timestamp,
               CASE WHEN server_type = 'flexlm' THEN CASE k % 20 WHEN 0 THEN 'down' WHEN 1 THEN 'warning' ELSE 'up' END
                    WHEN k % 10 = 1 THEN 'warning' WHEN k % 20 = 0 THEN 'down' ELSE 'up' END AS service,
               coalesce(n, 0) AS features, coalesce(used, 0) AS used,
               (SELECT count(*) FROM holders h WHERE h.poll_id = polls.poll_id) AS users
        FROM polls LEFT JOIN (SELECT poll_id, count(*) AS n, sum(used_licenses) AS used FROM text_pools GROUP BY 1)
          USING (poll_id)""",
    "forms_status": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname AS hostname,
               CASE WHEN k % 8 IN (0, 1, 7) THEN 'down' ELSE 'up' END AS service,
               CASE WHEN k % 8 = 7 THEN '' ELSE 'lic' || (k % 3) END AS master,
               CASE WHEN k % 8 = 7 THEN '' ELSE '11.19.' || (k % 4) END AS version,
               CASE k % 8 WHEN 0 THEN 'Cannot read data from ' || server_hostname
                    WHEN 1 THEN 'Error getting status from ' || server_hostname ELSE '' END AS message,
               sampled_at AS last_checked
        FROM polls""",
    "forms_features": f"SELECT {_DUMP_POOL} FROM form_pools",
    "forms_checkouts": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname,
               CASE WHEN k % 8 = 3 THEN upper(feature_name) ELSE feature_name END AS feature_name, u AS username, 'pc' AS host,
               CASE u WHEN 'fay' THEN TIMESTAMP '1998-02-03 07:05:00' WHEN 'gus' THEN TIMESTAMP '2024-04-05 17:30:00'
                    ELSE date_trunc('minute', sampled_at) END AS checked_out_at,
               '9' AS version, CASE k % 8 WHEN 2 THEN '3.1' WHEN 3 THEN '4.2' WHEN 4 THEN '7.0' ELSE '' END AS license_version
        FROM polls, (VALUES (2, 'ann'), (3, 'bob'), (4, 'cy'), (5, 'dan'), (7, 'eve'), (7, 'fay'), (7, 'gus')) x(form, u)
        WHERE k % 8 = form""",
    "unsupported_dumps": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname AS host,
               'unsupported server type: ' || CASE WHEN poll_id % 15 = 0 THEN '' ELSE 'spm' END AS reason
        FROM polls WHERE poll_id % 5 = 0""",
    "pool_checkouts": f"""
        SELECT f.id, c.server_hostname, c.feature_name, c.license_version, f.expiration_date, c.username, c.host,
               c.version AS client_version, c.checked_out_at,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' ELSE (s // 60) || 'm' END AS age,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS duration
        FROM (SELECT *, {_AGE} AS s FROM checkouts) c JOIN features f ON f.server_hostname = c.server_hostname AND f.name = c.feature_name
             AND f.version = c.license_version
        WHERE c.username LIKE '%7'""",
    "servers_from_files": """
        SELECT id, hostname, description, type, cacti_id, webui, created_at, updated_at, file
        FROM servers, (VALUES ('json'), ('csv')) x(file)""",
    "heatmap_documents": """
        SELECT server_hostname, feature_name, string_agg(hour || ':' || CAST(round(coalesce(avg_usage, 0) * 1000) AS BIGINT) || ':'
               || coalesce(peak_usage, 0), ' ' ORDER BY hour) AS hourly_data
        FROM (SELECT DISTINCT server_hostname, feature_name FROM hourly)
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(24))
        LEFT JOIN hourly USING (server_hostname, feature_name, hour) GROUP BY 1, 2""",
    "series_comparison_table": """
        SELECT CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS timestamp,
               max(users_count) FILTER (WHERE feature_name = 'view') AS first,
               max(users_count) FILTER (WHERE feature_name = 'click') AS second
        FROM feature_usage
        WHERE date >= DATE '2024-01-01' AND (server_hostname, feature_name) IN (
            ('27000@nation-3.example.com', 'view'), ('27000@nation-8.example.com', 'click'))
        GROUP BY 1""",
    "export_report_json": """
        SELECT 'summary' AS section, 'license_utilization' AS a, '' AS b, (SELECT count(*) FROM servers) AS x,
               (SELECT count(*) FROM current_util) AS y
        UNION ALL SELECT 'servers', hostname, type, id, length(webui) FROM servers
        UNION ALL SELECT 'utilization', server_hostname, feature_name, total_licenses, used_licenses FROM current_util
        UNION ALL SELECT 'statistics', server_hostname, feature_name, peak_usage, min_usage FROM stats
        UNION ALL SELECT 'heatmap', server_hostname, feature_name, 24, sum(peak_usage) FROM hourly GROUP BY 2, 3""",
    "deep_page": """
        SELECT server_hostname, feature_name, date, time, users_count FROM feature_usage
        ORDER BY users_count DESC, date, time, server_hostname, feature_name
        LIMIT 25 OFFSET (SELECT count(*) * 3 // 4 FROM feature_usage)""",
    "stored_table_stats": "SELECT * FROM table_rows",
    "checkout_sessions": """
        SELECT *, CAST(epoch(ended_at) - epoch(started_at) AS BIGINT) AS seconds FROM sessions""",
    "peak_concurrency": """
        SELECT feature_name, CAST(tm AS DATE) AS day, sum(started) AS started, max(users) AS peak_users,
               arg_min(tm, (-users, tm)) AS peak_at
        FROM levels GROUP BY 1, 2""",
    "denials_at_capacity": """
        SELECT d.id, d.feature_name, username, reason, d.tm AS denied_at, sum(total) AS total_licenses,
               sum(used) AS used_licenses, sum(used) >= sum(total) AS at_capacity
        FROM (SELECT * FROM denied CROSS JOIN (SELECT DISTINCT server_hostname FROM polls)) d
        ASOF LEFT JOIN tool_states s
          ON s.server_hostname = d.server_hostname AND s.feature_name = d.feature_name AND s.tm <= d.tm
        GROUP BY 1, 2, 3, 4, 5""",
    "pool_history": """
        SELECT server_hostname, name, version, expiration_date, tm AS valid_from,
               lead(tm) OVER (PARTITION BY server_hostname, name, version, expiration_date ORDER BY tm) AS valid_to,
               listed, total AS total_licenses, used AS used_licenses
        FROM pool_points""",
    "checkout_changes": """
        SELECT server_hostname, feature_name, username, host,
               CASE WHEN n = 1 THEN 'present' ELSE 'appeared' END AS change, tm AS seen_at, dump_id
        FROM seen_holders h WHERE NOT EXISTS (FROM seen_holders p WHERE p.server_hostname = h.server_hostname
            AND p.feature_name = h.feature_name AND p.username = h.username AND p.host = h.host AND p.n = h.n - 1)
        UNION ALL
        SELECT h.server_hostname, feature_name, username, host, 'left', c.tm, c.dump_id
        FROM seen_holders h JOIN answers c ON c.server_hostname = h.server_hostname AND c.n = h.n + 1
        WHERE NOT EXISTS (FROM seen_holders p WHERE p.server_hostname = h.server_hostname
            AND p.feature_name = h.feature_name AND p.username = h.username AND p.host = h.host AND p.n = h.n + 1)""",
    "seasonal_patterns": """
        SELECT server_hostname, feature_name, hours, coalesce(d.pairs, 0) AS daily_pairs,
               coalesce(w.pairs, 0) AS weekly_pairs, round(d.r, 6) AS daily_correlation, round(w.r, 6) AS weekly_correlation,
               coalesce(d.pairs >= 10 AND d.r >= 0.3, FALSE) AS has_daily_cycle,
               coalesce(w.pairs >= 10 AND w.r >= 0.3, FALSE) AS has_weekly_cycle,
               h.pattern AS hourly_pattern, y.pattern AS daily_pattern
        FROM hour_moments
        LEFT JOIN (FROM lagged WHERE lag = 24) d USING (server_hostname, feature_name)
        LEFT JOIN (FROM lagged WHERE lag = 168) w USING (server_hostname, feature_name)
        JOIN by_hour h USING (server_hostname, feature_name) JOIN by_weekday y USING (server_hostname, feature_name)""",
    "peak_periods": """
        SELECT server_hostname, feature_name, start_hour, hours, (start_hour + hours - 1) % 24 AS end_hour,
               string_agg(DISTINCT CAST(start // 24 AS VARCHAR), ',' ORDER BY CAST(start // 24 AS VARCHAR)) AS days_of_week,
               round(sum(total) / sum(hours), 6) AS avg_usage,
               CASE WHEN hours BETWEEN 6 AND 14 AND start_hour BETWEEN 6 AND 10 THEN 'Business Hours'
                    WHEN (start_hour + hours // 2) % 24 BETWEEN 5 AND 11 THEN 'Morning Peak'
                    WHEN (start_hour + hours // 2) % 24 BETWEEN 12 AND 16 THEN 'Afternoon Peak'
                    WHEN (start_hour + hours // 2) % 24 BETWEEN 17 AND 21 THEN 'Evening Peak'
                    ELSE 'Night Peak' END AS label
        FROM (SELECT *, start % 24 AS start_hour FROM stretches)
        GROUP BY server_hostname, feature_name, start_hour, hours""",
    "current_utilization": """
        SELECT server_hostname, feature_name, version, total_licenses, used_licenses, available_licenses,
               round(utilization_pct, 6) AS utilization_pct, vendor_daemon FROM current_util""",
    "features_snapshot": f"SELECT {_FEATURE_ROW} FROM features",
    "usage_dedup": "SELECT id, server_hostname, feature_name, date, time, users_count FROM feature_usage",
    "usage_appended": """
        SELECT id, server_hostname, feature_name, date, time, users_count FROM feature_usage u
        WHERE NOT EXISTS (FROM feature_usage s WHERE s.server_hostname = u.server_hostname
            AND s.feature_name = u.feature_name AND s.date - CAST(s.id % 2 AS INTEGER) = u.date AND s.time = u.time)""",
    "stored_history_of_series": """
        SELECT server_hostname, feature_name, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS timestamp,
               users_count FROM feature_usage
        WHERE date >= DATE '2024-01-01' AND server_hostname = '27000@nation-8.example.com' AND feature_name = 'view'""",
    "usage_stats_of_server": """
        SELECT server_hostname, feature_name, round(avg_usage, 6) AS avg_usage, peak_usage, min_usage, total_licenses,
               round(avg_utilization_pct, 6) AS avg_utilization_pct FROM stats
        WHERE server_hostname = '27000@nation-3.example.com'""",
    "feature_dedup_cleanup": f"""
        SELECT {_FEATURE_ROW} FROM features
        WHERE id IN (SELECT max(id) FROM features WHERE expiration_date IS NOT NULL
                     GROUP BY server_hostname, name, version)
           OR expiration_date IS NULL""",
    "features_evolved": f"SELECT {_FEATURE_ROW.replace('is_active', 'TRUE AS is_active')} FROM features",
    "usage_history": """
        SELECT server_hostname, feature_name, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS timestamp,
               users_count FROM feature_usage WHERE date >= DATE '2024-01-24'""",
    "usage_rows_strict": """
        SELECT id, server_hostname, feature_name, date, time, users_count FROM feature_usage
        WHERE CAST(date AS TIMESTAMP) >= TIMESTAMP '2024-01-01 12:00:00'""",
    "usage_stats": """
        SELECT server_hostname, feature_name, round(avg_usage, 6) AS avg_usage, peak_usage, min_usage, total_licenses,
               round(avg_utilization_pct, 6) AS avg_utilization_pct FROM stats""",
    "hourly_heatmap": """
        SELECT s.server_hostname, s.feature_name, h.hour, round(coalesce(avg_usage, 0), 6) AS avg_usage,
               coalesce(peak_usage, 0) AS peak_usage
        FROM (SELECT DISTINCT server_hostname, feature_name FROM hourly) s
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
        LEFT JOIN hourly USING (server_hostname, feature_name, hour)""",
    "overview_tiles": """
        SELECT count(*) AS total_features, round(avg(utilization_pct), 6) AS avg_utilization_pct,
               count(*) FILTER (WHERE utilization_pct >= 90) AS high_utilization,
               sum(total_licenses) AS total_licenses FROM current_util""",
    "utilization_bands": """
        SELECT server_hostname, feature_name, version, round(utilization_pct, 6) AS utilization_pct,
               CASE WHEN utilization_pct >= 90 THEN 'high' WHEN utilization_pct >= 70 THEN 'medium' ELSE 'low' END
                 AS band FROM current_util""",
    "series_comparison": """
        SELECT u.server_hostname, u.feature_name, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS timestamp,
               users_count
        FROM feature_usage u
        JOIN (SELECT server_hostname, feature_name FROM current_util GROUP BY 1, 2
              ORDER BY max(utilization_pct) DESC, feature_name, server_hostname LIMIT 3)
          USING (server_hostname, feature_name)
        WHERE date >= DATE '2024-01-24'""",
    "search_sort_page": """
        SELECT server_hostname, feature_name, round(avg_usage, 6) AS avg_usage, peak_usage, min_usage, total_licenses,
               round(avg_utilization_pct, 6) AS avg_utilization_pct
        FROM stats WHERE lower(server_hostname) LIKE '%nation-1%' OR lower(feature_name) LIKE '%nation-1%'
        ORDER BY peak_usage DESC, server_hostname, feature_name LIMIT 10 OFFSET 10""",
    "page_info": """
        SELECT total, 10 AS "limit", 10 AS "offset", 2 AS page, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages,
               least(11, total) AS first_row, least(20, total) AS last_row,
               20 < total AS has_next, TRUE AS has_prev
        FROM (SELECT count(*) AS total FROM stats
              WHERE lower(server_hostname) LIKE '%nation-1%' OR lower(feature_name) LIKE '%nation-1%')""",
    "linear_fit": """
        SELECT server_hostname, feature_name, n AS samples, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
               round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, last_day,
               CAST(last_value AS INTEGER) AS last_value, least, most FROM fit""",
    "predictive_summary": f"""
        SELECT server_hostname, feature_name, total_licenses, round(mean, 6) AS current_usage,
               round(slope, 6) AS trend_slope, {_REACH} AS days_to_capacity,
               round(r_squared, 6) AS confidence_level FROM fit7""",
    "forecast_30d": """
        SELECT server_hostname, feature_name, i AS days_ahead, DATE '2024-01-31' + i AS date,
               round(greatest(slope * (last_day + i) + intercept, 0), 6) AS predicted_usage, total_licenses
        FROM fit7, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 31))""",
    "anomalies": """
        SELECT server_hostname, feature_name, date, time, users_count AS usage, round(mean, 6) AS expected,
               round(z, 6) AS deviation,
               CASE WHEN abs(z) > 3 THEN 'high' WHEN abs(z) > 2.5 THEN 'medium' ELSE 'low' END AS severity
        FROM (SELECT u.*, mean, (y - mean) / stddev AS z
              FROM strict_usage u JOIN fit7 USING (server_hostname, feature_name) WHERE stddev > 0)
        WHERE abs(z) > 2""",
    "trend_analysis": f"""
        SELECT server_hostname, feature_name, 30 AS period, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
               round(r_squared, 6) AS r_squared, {_direction('slope')} AS direction, round(slope, 6) AS change_per_day,
               round(slope * 7, 6) AS change_per_week, round(slope * 30, 6) AS change_per_month,
               round(greatest(slope * (last_day + 7) + intercept, 0), 6) AS projected_usage_7_days,
               round(greatest(slope * (last_day + 30) + intercept, 0), 6) AS projected_usage_30_days,
               round(greatest(slope * (last_day + 90) + intercept, 0), 6) AS projected_usage_90_days,
               reach AS days_to_capacity,
               slope > 0 AND total_licenses > 0 AND (total_licenses - expected <= 0 OR reach < 30) AS capacity_at_risk,
               CASE WHEN slope > 0 AND total_licenses > 0 THEN
                        CASE WHEN total_licenses - expected <= 0 THEN 'Immediately increase license count - at capacity'
                             WHEN reach < 30 THEN 'Consider increasing license count within 30 days'
                             WHEN reach < 90 THEN 'Monitor usage and plan for potential license increase'
                             ELSE 'No action required' END
                    WHEN slope < -0.5 AND total_licenses > 0 THEN 'Consider reducing license count to optimize costs'
                    ELSE 'No action required' END AS recommended_action,
               reach > 0 AND reach < 90 AS capacity_warning
        FROM (SELECT *, {_REACH} AS reach FROM fit7)""",
    "enhanced_statistics": f"""
        SELECT server_hostname, feature_name, total_licenses, round(avg_usage, 6) AS avg_usage,
               round(median_usage, 6) AS median_usage, peak_usage, min_usage, round(std_dev, 6) AS std_dev,
               round(avg_pct, 6) AS avg_utilization_pct, round(peak_pct, 6) AS peak_utilization_pct,
               {_direction('slope')} AS trend_direction, round(slope, 6) AS trend_slope,
               CASE WHEN abs(slope) > 1 THEN 'strong' WHEN abs(slope) > 0.3 THEN 'moderate' ELSE 'weak' END
                 AS trend_strength,
               round(avg7, 6) AS moving_avg_7day, round(avg30, 6) AS moving_avg_30day, peak_hour,
               0 AS peak_day_of_week, round(avg_usage, 6) AS weekday_avg, round(avg_usage, 6) AS weekend_avg,
               round(score, 6) AS efficiency_score, CAST(trunc((100 - avg_pct) / 10) AS INTEGER) AS underutilized_hours
        FROM scored""",
    "efficiency_score": "SELECT server_hostname, feature_name, round(score, 6) AS efficiency_score FROM scored",
    "recommendations": """
        SELECT server_hostname, feature_name, 'increase' AS type, 'high' AS priority, 'High Utilization Alert' AS title,
               round(avg_pct, 6) AS value,
               printf('Average utilization is %.1f%%, which is above the recommended 80%% threshold.', avg_pct)
                 AS description,
               'Users may experience license denials during peak times' AS impact
        FROM enhanced WHERE avg_pct > 80
        UNION ALL
        SELECT server_hostname, feature_name, 'alert', 'high', 'Peak Capacity Reached', round(peak_pct, 6),
               printf('Peak utilization reached %.1f%%, indicating license shortage during peak times.', peak_pct),
               'Immediate risk of license denials' FROM enhanced WHERE peak_pct > 95
        UNION ALL
        SELECT server_hostname, feature_name, 'reduce', 'medium', 'License Optimization Opportunity', round(avg_pct, 6),
               printf('Average utilization is only %.1f%%. Consider reducing license count to optimize costs.', avg_pct),
               'Potential to reduce licenses by ' || CAST(trunc(total_licenses * 0.5) AS INTEGER)
               || ' without impacting users' FROM enhanced WHERE avg_pct < 20 AND total_licenses > 5
        UNION ALL
        SELECT server_hostname, feature_name, 'increase', 'medium', 'Growing Demand Detected', round(slope, 6),
               printf('Usage is increasing by approximately %.1f licenses per day.', slope),
               'Plan for additional licenses within the next quarter' FROM enhanced WHERE slope > 0.5
        UNION ALL
        SELECT server_hostname, feature_name, 'reduce', 'low', 'Declining Usage Trend', round(-slope, 6),
               printf('Usage is decreasing by approximately %.1f licenses per day.', -slope),
               'Opportunity to reduce licenses during next renewal' FROM enhanced WHERE slope < -0.5""",
    "utilization_with_trend": """
        SELECT server_hostname, feature_name, total_licenses, round(avg_usage, 6) AS avg_usage, peak_usage,
               round(utilization_pct, 6) AS utilization_pct, round(trend_slope, 6) AS trend_slope, days_to_capacity
        FROM trended""",
    "capacity_classes": """
        SELECT capacity_class, recommendation, server_hostname, feature_name, total_licenses,
               round(avg_usage, 6) AS avg_usage, peak_usage, round(utilization_pct, 6) AS utilization_pct,
               round(trend_slope, 6) AS trend_slope, days_to_capacity
        FROM (SELECT 'high_utilization' AS capacity_class,
                     'High utilization - consider increasing licenses' AS recommendation, * FROM trended
              WHERE utilization_pct >= 80
              UNION ALL SELECT 'low_utilization', 'Low utilization - consider reducing licenses', * FROM trended
              WHERE utilization_pct <= 20
              UNION ALL SELECT 'trending_up', 'Usage increasing - monitor capacity', * FROM trended
              WHERE trend_slope > 0.5
              UNION ALL SELECT 'trending_down', 'Usage decreasing - opportunity to optimize', * FROM trended
              WHERE trend_slope < -0.5)""",
    "capacity_summary": """
        SELECT 30 AS period_analyzed, count(DISTINCT server_hostname) AS total_servers, count(*) AS total_features,
               count(*) FILTER (WHERE utilization_pct >= 80) AS features_at_capacity,
               count(*) FILTER (WHERE utilization_pct <= 20) AS features_underutilized,
               count(*) FILTER (WHERE trend_slope > 0.5) AS features_trending_up,
               count(*) FILTER (WHERE trend_slope < -0.5) AS features_trending_down
        FROM trended""",
    "capacity_recommendations": """
        SELECT 30 AS period_analyzed, * FROM (
            SELECT 'increase' AS type, 'high' AS priority, 'Features at High Utilization' AS title,
                   CAST(count(*) AS DOUBLE) AS value,
                   count(*) || ' features have utilization above 80% and may need additional licenses.' AS description,
                   'Prevent license denials and ensure user productivity' AS impact
            FROM trended WHERE utilization_pct >= 80
            UNION ALL
            SELECT 'reduce', 'medium', 'Underutilized Features Detected', CAST(count(*) AS DOUBLE),
                   count(*) || ' features have utilization below 20% and may have excess licenses.',
                   'Potential cost savings by reducing unused licenses' FROM trended WHERE utilization_pct <= 20
            UNION ALL
            SELECT 'alert', 'medium', 'Growing Usage Trends', CAST(count(*) AS DOUBLE),
                   count(*) || ' features show increasing usage trends.',
                   'Plan for capacity increases in the next quarter' FROM trended WHERE trend_slope > 0.5)
        WHERE value > 0""",
    "features_active": f"""
        SELECT {_FEATURE_ROW}, greatest(total_licenses - used_licenses, 0) AS available_licenses
        FROM features WHERE is_active""",
    "features_all": f"""
        SELECT {_FEATURE_ROW}, greatest(total_licenses - used_licenses, 0) AS available_licenses FROM features""",
    "expiring_soon": f"SELECT {_FEATURE_ROW}, days_to_expire, severity, message FROM expiring_labeled",
    "expiration_report": f"""
        SELECT {_FEATURE_ROW}, days_to_expiration,
               CASE WHEN NOT is_active THEN 'Inactive' WHEN days_to_expiration < 0 THEN 'Expired'
                    WHEN days_to_expiration < 30 THEN 'Expiring Soon' ELSE 'Valid' END AS status
        FROM (SELECT *, CAST(trunc(epoch(expiration_date - {AS_OF}) / 86400) AS INTEGER) AS days_to_expiration
              FROM features WHERE expiration_date IS NOT NULL AND is_active)""",
    "expiration_report_all": f"""
        SELECT {_FEATURE_ROW}, days_to_expiration,
               CASE WHEN NOT is_active THEN 'Inactive' WHEN days_to_expiration < 0 THEN 'Expired'
                    WHEN days_to_expiration < 30 THEN 'Expiring Soon' ELSE 'Valid' END AS status
        FROM (SELECT *, CAST(trunc(epoch(expiration_date - {AS_OF}) / 86400) AS INTEGER) AS days_to_expiration
              FROM features WHERE id IN (SELECT max(id) FROM features WHERE expiration_date IS NOT NULL
                                         GROUP BY server_hostname, name, version, expiration_date))""",
    "expiry_alerts_throttled": f"SELECT {_ALERT_ROW} FROM new_alerts",
    "alerts_appended": f"""
        SELECT {_ALERT_ROW.replace('id, ', '', 1)} FROM alerts
        UNION ALL SELECT {_ALERT_ROW.replace('id, ', '', 1)} FROM new_alerts""",
    "alerts_unsent": f"SELECT {_ALERT_ROW} FROM alerts WHERE NOT sent",
    "alerts_top_open": f"SELECT {_ALERT_ROW} FROM alerts WHERE NOT sent ORDER BY created_at, id LIMIT 5",
    "alerts_recent": f"""
        SELECT {_ALERT_ROW}, CASE WHEN sent THEN 'Sent' ELSE 'Pending' END AS delivery_status
        FROM alerts WHERE created_at > {AS_OF} - INTERVAL 30 DAY""",
    "alerts_mark_sent": f"""
        SELECT id, server_hostname, feature_name, alert_type, message, severity,
               TRUE AS sent, CASE WHEN NOT sent THEN {AS_OF} ELSE sent_at END AS sent_at, created_at
        FROM alerts""",
    "alerts_dispatched": f"""
        SELECT id, server_hostname, feature_name, alert_type, message, severity,
               TRUE AS sent, CASE WHEN NOT sent THEN {AS_OF} ELSE sent_at END AS sent_at, created_at
        FROM alerts""",
    "alert_messages": """
        SELECT id, CASE WHEN severity = 'critical' THEN 'ops@example.com,oncall@example.com' ELSE 'ops@example.com' END
                 AS recipients,
               '[' || severity || '] License Alert: ' || alert_type AS subject,
               'License Alert' || chr(10) || chr(10) || 'Server: ' || server_hostname || chr(10) || 'Feature: '
               || feature_name || chr(10) || 'Type: ' || alert_type || chr(10) || 'Severity: ' || severity || chr(10)
               || 'Time: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) || 'Message:' || chr(10)
               || message AS body
        FROM alerts WHERE NOT sent""",
    "checkout_counts": f"""
        SELECT {', '.join('f.' + c.strip() for c in _FEATURE_ROW.split(','))},
               (SELECT count(*) FROM checkouts c WHERE c.server_hostname = f.server_hostname
                  AND c.feature_name = f.name AND c.license_version = f.version) AS checkout_count,
               greatest(total_licenses - used_licenses, 0) AS available_licenses
        FROM features f""",
    "checkout_detail": f"""
        SELECT server_hostname, feature_name, license_version, username, host, version, checked_out_at,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
                    ELSE (s // 60) || 'm' END AS age,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS duration
        FROM (SELECT *, {_AGE} AS s FROM checkouts)""",
    "checkout_detail_of_feature": f"""
        SELECT server_hostname, feature_name, license_version, username, host, version, checked_out_at,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
                    ELSE (s // 60) || 'm' END AS age,
               CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h'
                    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
                    WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS duration
        FROM (SELECT *, {_AGE} AS s FROM checkouts)
        WHERE server_hostname = '27000@nation-8.example.com' AND feature_name = 'view'""",
    "checked_out_only": f"""
        SELECT {', '.join('f.' + c.strip() for c in _FEATURE_ROW.split(','))}, c.n AS checkout_count,
               greatest(total_licenses - used_licenses, 0) AS available_licenses
        FROM features f JOIN (SELECT server_hostname, feature_name, license_version, count(*) AS n FROM checkouts
                              WHERE username LIKE '%7' GROUP BY 1, 2, 3) c
          ON c.server_hostname = f.server_hostname AND c.feature_name = f.name AND c.license_version = f.version""",
    "checkouts_by_name": "SELECT server_hostname, feature_name, count(*) AS checkout_count FROM checkouts GROUP BY 1, 2",
    "server_type_distribution": """
        SELECT type AS server_type, count(*) AS servers,
               round(count(*) * 100.0 / (SELECT count(*) FROM servers), 6) AS percentage FROM servers GROUP BY 1""",
    "dashboard_totals": """
        SELECT (SELECT count(*) FROM servers) AS total_servers,
               (SELECT count(*) FROM features WHERE is_active) AS total_features,
               (SELECT coalesce(sum(total_licenses), 0) FROM features WHERE is_active) AS total_licenses,
               (SELECT count(*) FROM alerts WHERE NOT sent) AS active_alerts""",
    "checkouts_with_type": """
        SELECT c.server_hostname, feature_name, username, coalesce(s.type, 'flexlm') AS server_type
        FROM checkouts c LEFT JOIN servers s ON CASE WHEN s.id % 2 = 1 THEN 'moved-' ELSE '' END || s.hostname = c.server_hostname""",
    "live_or_stored": """
        SELECT CASE WHEN server_type = 'flexlm' THEN 'standby-' ELSE '' END || server_hostname AS server_hostname,
               feature_name AS name, version, vendor_daemon, total_licenses, used_licenses,
               expiration_date, 'live' AS origin, CAST(NULL AS TIMESTAMP) AS last_updated FROM polls
        UNION ALL
        SELECT f.server_hostname, name, version, vendor_daemon, total_licenses, used_licenses, expiration_date,
               'stored', max(last_updated) OVER (PARTITION BY f.server_hostname)
        FROM features f WHERE is_active AND f.server_hostname NOT IN (
            SELECT server_hostname FROM polls WHERE server_type = 'rlm')""",
    "host_quality": """
        SELECT id, hostname, type,
               CASE WHEN form = 2 THEN 'port must be between 1 and 65535'
                    WHEN form = 3 AND 200 + id * 10 > 255 THEN 'invalid hostname: ' || hostname
                    WHEN form = 4 THEN 'invalid hostname: ' || hostname END AS host_reason,
               CASE WHEN id % 6 = 5 THEN 'unsupported server type: spm' END AS type_reason,
               NOT (form = 2 OR form = 4 OR form = 3 AND 200 + id * 10 > 255) AND id % 6 <> 5 AS is_valid
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 AS form,
                     CASE n_nationkey % 5 WHEN 0 THEN '27000@' || host WHEN 1 THEN host || ':5053'
                          WHEN 2 THEN host || ':70000' WHEN 3 THEN '192.168.1.' || (200 + n_nationkey * 10)
                          ELSE n_name END AS hostname,
                     CASE WHEN n_nationkey % 6 = 5 THEN 'spm' WHEN n_nationkey % 3 = 0 THEN ' RLM ' ELSE 'flexlm' END
                       AS type
              FROM (SELECT *, lower(replace(n_name, '_', '-')) || '.example.com' AS host FROM nation))""",
    "table_stats": """
        SELECT table_name, row_count, oldest_record, newest_record,
               round(row_count * 100.0 / (SELECT max(row_count) FROM table_rows), 6) AS row_share_pct
        FROM table_rows""",
    "retention_stats": """
        SELECT u.total AS usage_records_total, d30 AS usage_records_30_days, u.total AS usage_records_90_days,
               u.total AS usage_records_365_days, e.total AS events_total, e.recent AS events_30_days,
               a.total AS alerts_total, a.sent AS alerts_sent, CAST(0 AS BIGINT) AS potential_savings_rows,
               CAST(0 AS BIGINT) AS potential_savings_bytes, '' AS potential_savings_human
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE date >= DATE '2024-01-01') AS d30 FROM feature_usage) u,
             (SELECT count(*) AS total, count(*) FILTER (WHERE event_date >= DATE '2024-01-01') AS recent
              FROM license_events) e,
             (SELECT count(*) AS total, count(*) FILTER (WHERE sent) AS sent FROM alerts) a""",
    "retention_stats_later": """
        SELECT total AS usage_records_total, d30 AS usage_records_30_days, d90 AS usage_records_90_days,
               total AS usage_records_365_days, e.n AS events_total, e.recent AS events_30_days, a.n AS alerts_total,
               a.sent AS alerts_sent, total - d90 AS potential_savings_rows,
               (total - d90) * 100 AS potential_savings_bytes,
               CASE WHEN (total - d90) * 100 < 1024 THEN ((total - d90) * 100) || ' B'
                    WHEN (total - d90) * 100 < 1048576 THEN printf('%.1f KB', (total - d90) * 100 / 1024.0::DOUBLE)
                    ELSE printf('%.1f MB', (total - d90) * 100 / 1048576.0::DOUBLE) END AS potential_savings_human
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE date >= DATE '2024-03-15') AS d30,
                     count(*) FILTER (WHERE date >= DATE '2024-01-15') AS d90 FROM feature_usage),
             (SELECT count(*) AS n, count(*) FILTER (WHERE event_date >= DATE '2024-03-15') AS recent
              FROM license_events) e,
             (SELECT count(*) AS n, count(*) FILTER (WHERE sent) AS sent FROM alerts) a""",
    "retention_cleanup": f"""
        SELECT 'feature_usage' AS table_name, count(*) FILTER (WHERE date < cutoff) AS rows_deleted,
               count(*) FILTER (WHERE date >= cutoff) AS rows_kept
        FROM feature_usage, (SELECT {AS_OF} - INTERVAL 14 DAY AS cutoff)
        UNION ALL
        SELECT 'license_events', count(*) FILTER (WHERE event_date < cutoff),
               count(*) FILTER (WHERE event_date >= cutoff)
        FROM license_events, (SELECT {AS_OF} - INTERVAL 14 DAY AS cutoff)
        UNION ALL
        SELECT 'alerts', count(*) FILTER (WHERE created_at < cutoff AND sent),
               count(*) FILTER (WHERE NOT (created_at < cutoff AND sent))
        FROM alerts, (SELECT {AS_OF} - INTERVAL 14 DAY AS cutoff)
        UNION ALL
        SELECT 'alert_events', count(*) FILTER (WHERE datetime < cutoff), count(*) FILTER (WHERE datetime >= cutoff)
        FROM alert_events, (SELECT {AS_OF} - INTERVAL 14 DAY AS cutoff)""",
    "usage_kept": """
        SELECT id, server_hostname, feature_name, date, time, users_count FROM feature_usage
        WHERE date >= DATE '2024-01-18'""",
    "storage_advice": """
        SELECT 'feature_usage' AS table_name, 'retention' AS type, 'medium' AS priority,
               'Large Usage History' AS title, CAST(n AS DOUBLE) AS value,
               'feature_usage table has ' || n || ' rows. Consider implementing data retention.' AS description,
               'Reducing old data can significantly reduce database size' AS impact,
               'Configure data retention policy to delete data older than 90-365 days' AS action
        FROM (SELECT count(*) AS n FROM feature_usage) WHERE n > 1000
        UNION ALL
        SELECT 'features', 'cleanup', 'low', 'Inactive Features', CAST(n AS DOUBLE),
               'There are ' || n || ' inactive feature records that could be archived.',
               'Minor space savings, cleaner data', 'Archive or delete old inactive feature records'
        FROM (SELECT count(*) AS n FROM features WHERE NOT is_active) WHERE n > 100""",
    "dump_status": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname AS hostname,
               CASE WHEN server_type = 'flexlm' THEN
                        CASE k % 20 WHEN 0 THEN 'down' WHEN 1 THEN 'warning' ELSE 'up' END
                    WHEN k % 10 = 1 THEN 'warning' WHEN k % 20 = 0 THEN 'down' ELSE 'up' END AS service,
               CASE WHEN k % 20 = 0 THEN '' WHEN server_type = 'flexlm' THEN short ELSE machine END AS master,
               CASE WHEN server_type = 'rlm' THEN '15.' || (k % 4) WHEN k % 20 = 0 THEN ''
                    ELSE '11.18.' || (k % 4) END AS version,
               CASE WHEN server_type = 'flexlm' AND k % 20 = 0 THEN 'Cannot connect to ' || server_hostname
                    WHEN server_type = 'flexlm' AND k % 20 = 1 THEN 'Vendor daemon is down on ' || server_hostname
                    WHEN server_type = 'rlm' AND k % 10 = 1 THEN
                        'ISV ' || vendor_daemon || ' appears to be down on ' || server_hostname
                    ELSE '' END AS message,
               sampled_at AS last_checked
        FROM polls""",
    "flexlm_features": f"SELECT {_DUMP_POOL} FROM flex_pools",
    "rlm_features": f"SELECT {_DUMP_POOL} FROM rlm_pools",
    "all_features": f"SELECT {_DUMP_POOL} FROM flex_pools UNION ALL SELECT {_DUMP_POOL} FROM rlm_pools",
    "flexlm_checkouts": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname, feature_name, 'user' || i AS username,
               'host' || (k % 7) AS host, date_trunc('minute', sampled_at) AS checked_out_at,
               '2024.' || (k % 5) AS version, (k % 3) || '.0' AS license_version
        FROM holders WHERE server_type = 'flexlm'""",
    "rlm_checkouts": """
        SELECT CAST(poll_id AS VARCHAR) AS dump_id, server_hostname, feature_name, 'user' || i AS username,
               'host' || (k % 7) AS host, date_trunc('minute', sampled_at) AS checked_out_at,
               'v' || (k % 3) || '.1' AS version, 'v' || (k % 3) || '.1' AS license_version
        FROM holders WHERE server_type = 'rlm'""",
    "status_board": """
        SELECT s.hostname, s.description, s.type AS server_type, coalesce(l.service, 'down') AS service, l.master,
               coalesce(l.version, '') AS server_version,
               CASE WHEN l.service IS NULL THEN 'No status received' ELSE l.message END AS message, l.sampled_at AS last_checked
        FROM servers s LEFT JOIN (
            SELECT *, CASE WHEN server_type = 'flexlm' THEN
                             CASE k % 20 WHEN 0 THEN 'down' WHEN 1 THEN 'warning' ELSE 'up' END
                           WHEN k % 10 = 1 THEN 'warning' WHEN k % 20 = 0 THEN 'down' ELSE 'up' END AS service,
                   CASE WHEN k % 20 = 0 THEN '' WHEN server_type = 'flexlm' THEN short ELSE machine END AS master,
                   CASE WHEN server_type = 'rlm' THEN '15.' || (k % 4) WHEN k % 20 = 0 THEN ''
                        ELSE '11.18.' || (k % 4) END AS version,
                   CASE WHEN server_type = 'flexlm' AND k % 20 = 0 THEN 'Cannot connect to ' || server_hostname
                        WHEN server_type = 'flexlm' AND k % 20 = 1 THEN 'Vendor daemon is down on ' || server_hostname
                        WHEN server_type = 'rlm' AND k % 10 = 1 THEN
                            'ISV ' || vendor_daemon || ' appears to be down on ' || server_hostname
                        ELSE '' END AS message
            FROM (SELECT p.* EXCLUDE (version), row_number() OVER (PARTITION BY server_hostname ORDER BY poll_id DESC) AS rn FROM polls p
                  WHERE nk % 7 <> 0)
            WHERE rn = 1) l ON l.server_hostname = s.hostname""",
    "stream_usage_ingest": """
        SELECT id, server_hostname, feature_name, date, time, users_count FROM feature_usage""",
    "stream_alert_throttle": """
        SELECT hostname, 'expiration' AS type, datetime, feature_name, 'license expires' AS message FROM passing""",
    "stream_status_feed": """
        SELECT 'server_status' AS type, 'server:' || server_hostname AS channel, sampled_at AS timestamp,
               '{"server_hostname":"' || server_hostname || '","server_type":"' || server_type || '","feature_name":"'
               || feature_name || '","total_licenses":' || total_licenses || ',"used_licenses":' || used_licenses
               || '}' AS data
        FROM polls WHERE nk IN (3, 8)""",
    "alert_feed": """
        SELECT 'alert' AS type, 'alerts' AS channel, created_at AS timestamp,
               '{"server_hostname":"' || server_hostname || '","feature_name":"' || feature_name || '","severity":"'
               || severity || '","message":"' || message || '"}' AS data
        FROM alerts""",
    "export_servers": f"""
        SELECT CAST(id AS VARCHAR) AS "ID", hostname AS "Hostname", description AS "Description", type AS "Type",
               webui AS "WebUI", '2024-01-01T00:00:00Z' AS "Created At", '2024-01-31T12:00:00Z' AS "Updated At"
        FROM servers""",
    "export_features": """
        SELECT server_hostname AS "Server", name AS "Feature", version AS "Version", vendor_daemon AS "Vendor Daemon",
               CAST(total_licenses AS VARCHAR) AS "Total Licenses", CAST(used_licenses AS VARCHAR) AS "Used Licenses",
               CAST(greatest(total_licenses - used_licenses, 0) AS VARCHAR) AS "Available",
               strftime(expiration_date, '%Y-%m-%d') AS "Expiration Date",
               strftime(last_updated, '%Y-%m-%dT%H:%M:%SZ') AS "Last Updated"
        FROM features WHERE is_active""",
    "export_utilization": """
        SELECT server_hostname AS "Server", feature_name AS "Feature", version AS "Version",
               vendor_daemon AS "Vendor Daemon", CAST(total_licenses AS VARCHAR) AS "Total Licenses",
               CAST(used_licenses AS VARCHAR) AS "Used Licenses", CAST(available_licenses AS VARCHAR) AS "Available",
               printf('%.2f', CAST(utilization_pct AS DOUBLE)) AS "Utilization %"
        FROM current_util""",
    "export_history": """
        SELECT CAST(date AS VARCHAR) || ' ' || time AS "Timestamp", CAST(users_count AS VARCHAR) AS "Users Count"
        FROM feature_usage WHERE date >= DATE '2024-01-01'""",
    "export_stats": """
        SELECT server_hostname AS "Server", feature_name AS "Feature", printf('%.2f', avg_usage) AS "Avg Usage",
               CAST(peak_usage AS VARCHAR) AS "Peak Usage", CAST(min_usage AS VARCHAR) AS "Min Usage",
               CAST(total_licenses AS VARCHAR) AS "Total Licenses",
               printf('%.2f', avg_utilization_pct) AS "Avg Utilization %"
        FROM stats""",
    "export_json": """
        SELECT server_hostname, feature_name, version, total_licenses, used_licenses, available_licenses,
               round(CAST(utilization_pct AS DOUBLE), 6) AS utilization_pct, vendor_daemon,
               count(*) OVER () AS "count", '2024-01-31T12:00:00Z' AS exported_at, '' AS server FROM current_util""",
    "export_report": """
        SELECT 'utilization' AS section, server_hostname AS "Server", feature_name AS "Feature", version AS "Version",
               CAST(total_licenses AS VARCHAR) AS "Total", CAST(used_licenses AS VARCHAR) AS "Used",
               CAST(available_licenses AS VARCHAR) AS "Available",
               printf('%.2f', CAST(utilization_pct AS DOUBLE)) AS "Utilization %", NULL AS "Avg Usage",
               NULL AS "Peak Usage", NULL AS "Min Usage", NULL AS "Total Licenses" FROM current_util
        UNION ALL
        SELECT 'statistics', server_hostname, feature_name, NULL, NULL, NULL, NULL, NULL, printf('%.2f', avg_usage),
               CAST(peak_usage AS VARCHAR), CAST(min_usage AS VARCHAR), CAST(total_licenses AS VARCHAR) FROM stats""",
    "export_names": """
        SELECT DISTINCT server_hostname, name,
               replace(replace(server_hostname, '@', '_'), '.', '') AS file_part, name || '___x' AS odd_part
        FROM features""",
    "weekly_profile": """
        SELECT server_hostname, feature_name, CAST(dayofweek(date) AS INTEGER) AS day_of_week,
               CAST(substr(time, 1, 2) AS INTEGER) AS hour, round(avg(users_count), 6) AS avg_usage,
               max(users_count) AS peak_usage
        FROM feature_usage GROUP BY 1, 2, 3, 4""",
    "weekday_weekend": """
        SELECT server_hostname, feature_name,
               round(avg(users_count) FILTER (WHERE dayofweek(date) BETWEEN 1 AND 5), 6) AS weekday_avg,
               round(avg(users_count) FILTER (WHERE dayofweek(date) IN (0, 6)), 6) AS weekend_avg
        FROM feature_usage GROUP BY 1, 2""",
    "denials": """
        SELECT feature_name, reason, event_date, count(*) AS denials FROM license_events
        WHERE event_type = 'DENIED' GROUP BY 1, 2, 3""",
    "feature_changes": """
        SELECT * FROM (
            SELECT coalesce(b.server_hostname, a.server_hostname) AS server_hostname, coalesce(b.name, a.name) AS name,
                   coalesce(b.version, a.version) AS version,
                   coalesce(strftime(coalesce(b.expiration_date, a.expiration_date), '%Y-%m-%d %H:%M:%S'), '')
                     AS expiration_date,
                   b.total_licenses AS total_before, b.used_licenses AS used_before, a.total_licenses AS total_after,
                   a.used_licenses AS used_after,
                   CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed'
                        WHEN a.total_licenses <> b.total_licenses OR a.used_licenses <> b.used_licenses THEN 'changed'
                   END AS change
            FROM (SELECT *, poll_id AS id FROM (
                      SELECT *, feature_name AS name, max(polled_at) OVER (PARTITION BY server_hostname) AS latest,
                             row_number() OVER (PARTITION BY server_hostname, feature_name, version, expiration_date
                                                ORDER BY poll_id DESC) AS rn
                      FROM polls WHERE polled_at < TIMESTAMP '2024-01-30 00:00:00')
                  WHERE rn = 1 AND polled_at = latest) b
            FULL JOIN (SELECT * FROM features WHERE is_active) a
              ON a.server_hostname = b.server_hostname AND a.name = b.name AND a.version = b.version
                 AND a.expiration_date IS NOT DISTINCT FROM b.expiration_date)
        WHERE change IS NOT NULL""",
    "inventory_refreshed": f"SELECT {_FEATURE_ROW} FROM features",
}


# Stored tables answer as the tables they were written from.
_BODIES["stored_cleanup"] = _BODIES["retention_cleanup"]
_BODIES["stored_usage_kept"] = _BODIES["usage_kept"]


def oracle_sql() -> dict[str, str]:
    return {name: _WITH + body for name, body in _BODIES.items()}
