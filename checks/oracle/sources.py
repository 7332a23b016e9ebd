"""Oracle SQL of scans, sources and sinks."""

SQL: dict[str, str] = {}

SQL["SRC-01"] = """
SELECT user_id AS channel_id, event_id AS post_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, 'message ' || event_id AS text,
  CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS views, event_id % 13 AS forwards,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 7 ELSE 0 END AS replies, event_id % 11 = 0 AS reactions_off,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN '' ELSE '👍=' || (event_id % 50) || ',custom_' || event_id || '=' || (event_id % 3) END AS reactions,
  CASE event_id % 6 WHEN 0 THEN event_id % 40 WHEN 1 THEN event_id % 90 END AS source_id,
  CASE event_id % 6 WHEN 0 THEN 'channel' WHEN 1 THEN 'user' END AS source_type FROM events"""
SQL["SRC-02"] = """
SELECT e.event_id AS post_id, CASE event_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'document' WHEN 2 THEN 'video' END AS media_type, kind, url
FROM events e LEFT JOIN (
  SELECT event_id AS id, 'texturl' AS kind, 'https://example.com/' || event_id AS url FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'button', 'https://e.example/1' FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, 'button', 'https://e.example/2' FROM events WHERE event_id % 5 = 0) l ON l.id = e.event_id"""
SQL["SRC-03"] = "SELECT channel_id, user_id, is_premium, is_scam, is_fake, is_restricted, is_deleted, is_bot, dc_id FROM audience_v"
SQL["SRC-04"] = """SELECT channel_id, CASE WHEN channel_id % 3 <> 0 THEN online_count ELSE 0 END AS online_count, participants_count, 0 AS admins_count,
  0 AS banned_count, 0 AS kicked_count, CASE WHEN channel_id % 2 = 0 THEN 'complete' ELSE 'unknown' END AS status FROM channels_v"""
SQL["SRC-05"] = """
SELECT channel_id, '[' || string_agg('[' || post_id || ',' || CAST(floor(epoch(ts)) AS BIGINT) || ',' || views || ',' || forwards || ',' || reacted || ']', ',' ORDER BY rn) || ']' AS posts_raw
FROM newest_v WHERE rn <= 50 GROUP BY 1"""
SQL["SRC-05b"] = """SELECT channel_id, CAST(rn - 1 AS INT) AS place, post_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, views, forwards, reacted AS reactions FROM newest_v WHERE rn <= 50"""
SQL["SRC-06"] = "SELECT channel_id, user_id, is_premium FROM audience_v WHERE user_id <> 0"
SQL["SRC-07"] = """
SELECT username, short AS short_format, cv, 12 AS cv_max, 2 AS reach_points, cp AS comment_points, es AS er_status, tc AS stability_top, pr AS premium_ratio,
  pl AS private_ratio, ch % 4 = 2 AS verified, sd AS diversity, rg AS posts_per_day FROM stored_v WHERE has_json"""
SQL["SRC-09"] = """
SELECT channel_id, 'post' AS kind, post_id AS id, md5(text) AS text_md5, NULL AS is_premium, NULL AS user_id FROM newest_text_v WHERE length(text) > 0
UNION ALL SELECT c.channel_id, 'comment', comment_id, md5(text), coalesce(a.is_premium, false), c.user_id FROM comments_v c
LEFT JOIN audience_v a ON a.channel_id = c.channel_id AND a.user_id = c.user_id WHERE length(text) > 0"""
SQL["SRC-10"] = """
SELECT channel_id, 'post' AS kind, post_id AS id, md5(text) AS text_md5 FROM newest_text_v WHERE length(text) > 0
UNION ALL SELECT channel_id, 'comment', comment_id, md5(text) FROM comments_v WHERE length(text) > 0"""
SQL["SRC-11"] = """
SELECT '@' || username AS username, CAST(score AS VARCHAR) AS score, verdict, CAST(members AS VARCHAR) AS members, coalesce(category, '') AS category,
  coalesce(category_secondary, '') AS category_secondary, found_via, CAST(CAST(epoch(scanned_at) AS BIGINT) AS VARCHAR) AS scanned_at
FROM results_v WHERE status = 'GOOD' AND (category = 'NEWS' OR category_secondary = 'NEWS')"""
SQL["SRC-12"] = """SELECT username, score, verdict, trust_factor, 5 AS links, severity FROM results_v JOIN (SELECT username, severity FROM channels_v) USING (username)"""
SQL["SRC-13"] = """SELECT username, score, CASE WHEN score >= 50 THEN ad_status ELSE 0 END AS ad_status, CASE WHEN score >= 50 THEN found_via ELSE 'unknown' END AS found_via FROM results_v"""
SQL["SRC-14"] = """
SELECT username, CASE WHEN p THEN score + 1 ELSE score END AS score, CASE WHEN p AND channel_id % 2 = 0 THEN 'TECH' ELSE category END AS category,
  CASE WHEN p THEN '{"a": ' || channel_id || '}' END AS forensics_json, p AS patched,
  CAST(epoch(CASE WHEN p THEN TIMESTAMP '2024-01-31 00:00:00' ELSE scanned_at END) AS BIGINT) AS scanned_at FROM (SELECT *, channel_id % 3 = 0 AS p FROM results_v)"""
SQL["SRC-14b"] = SQL["SRC-14"]
SQL["SRC-15"] = """SELECT username, count(*) AS requests, CAST(epoch(min(requested_at)) AS BIGINT) AS first_requested FROM requests_v
  WHERE request_id % 50 <> 0 AND request_id % 30 <> 0 GROUP BY 1"""
SQL["SRC-16"] = "SELECT event_type, count(*) AS events, round(avg(duration_ms), 1) AS avg_duration_ms FROM usage_v GROUP BY 1"
_names = [
    "impossible_reach", "flat_cv", "dead_engagement", "no_decay", "simple_reactions", "disabled_comments", "bot_regularity", "flat_reactions",
    "extreme_reach_decay", "high_reactions_low_comments", "suspicious_velocity", "effective_members", "young_fast_inactive",
]
_reasons = ", ".join(
    f"CASE WHEN {'NOT alibi AND reach > reach_limit' if i == 1 else f'f{i} > 0'} THEN '{n}' END" for i, n in enumerate(_names, start=1)
)
SQL["SRC-17"] = f"""
SELECT username, status, score, verdict, trust_factor, members, raw_score, scam_flag AS is_scam, effective_conviction AS conviction_score,
  concat_ws(',', {_reasons}) AS conviction_factors, age_days AS channel_age_days, round_even(CAST(total_views AS DOUBLE) / posts, 1) AS avg_views,
  round_even(reach, 2) AS reach_percent, cv_points, engagement, tier, er_status FROM scored_v"""
