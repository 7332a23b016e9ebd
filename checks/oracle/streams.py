"""Oracle SQL of the streaming queries, over the same rows as a batch."""

SQL: dict[str, str] = {}

SQL["STR-01"] = """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(duration_ms) * 1e0 / count(duration_ms), 1) AS avg_duration_ms,
  count(DISTINCT CASE WHEN event_type = 'app_open' THEN user_id END) AS opens,
  count(DISTINCT CASE WHEN event_type IN ('search_submit', 'channel_view') THEN user_id END) AS browse,
  count(DISTINCT CASE WHEN event_type = 'channel_detail' THEN user_id END) AS detail
FROM usage_v GROUP BY 1"""
SQL["STR-02"] = "SELECT username, status, score, verdict, members, CAST(epoch(scanned_at) AS BIGINT) AS scanned_at FROM results_v"
SQL["STR-03"] = "SELECT DISTINCT username FROM requests_v WHERE username NOT IN (SELECT username FROM results_v WHERE status IN ('GOOD', 'BAD'))"
SQL["STR-04"] = "SELECT channel_id, raw_score, score, verdict, trust_factor, status FROM scored_v"
