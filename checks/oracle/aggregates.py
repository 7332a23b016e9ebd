"""Oracle SQL of the aggregations and window functions."""

SQL: dict[str, str] = {}

SQL["AGG-01"] = """
SELECT channel_id, count(*) AS values,
  round(CASE WHEN count(*) < 2 OR sum(replies) = 0 THEN 0 ELSE stddev_samp(replies) / avg(replies) * 100 END, 4) AS cv_sample_percent,
  round(CASE WHEN count(*) < 2 OR sum(replies) = 0 THEN 0 ELSE stddev_pop(replies) / avg(replies) END, 4) AS cv_population
FROM newest_v GROUP BY 1"""
SQL["AGG-02"] = "SELECT channel_id, round(coalesce(stddev_samp(views) / avg(views) * 100, 0), 4) AS cv_views FROM viewed_v GROUP BY 1"
SQL["AGG-03"] = "SELECT channel_id, members, round(reach, 4) AS reach FROM metrics_v"
SQL["AGG-04"] = "SELECT channel_id, round(forward_rate, 4) AS forward_rate FROM metrics_v"
SQL["AGG-05"] = "SELECT channel_id, round(reaction_rate, 4) AS reaction_rate FROM metrics_v"
SQL["AGG-06"] = "SELECT channel_id, decay_known, round(decay, 4) AS decay FROM metrics_v"
SQL["AGG-07"] = """
SELECT channel_id, p.posts_per_day, round_even(greatest(CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) / 1000000 / 86400, 0.1), 1) AS span_days,
  posting_status, CAST(CASE posting_status WHEN 'active' THEN 0.9 WHEN 'heavy' THEN 0.75 WHEN 'spam' THEN 0.55 ELSE 1 END AS DOUBLE) AS posting_multiplier
FROM posting_v p JOIN (SELECT channel_id, min(ts) AS lo, max(ts) AS hi FROM newest_v GROUP BY 1) USING (channel_id)"""
SQL["AGG-08"] = "SELECT channel_id, reactions_on FROM metrics_v"
SQL["AGG-09"] = "SELECT channel_id, coalesce(reacted_posts, 0) AS reacted_posts, stability_cv, stability_top FROM metrics_v LEFT JOIN stability_v USING (channel_id)"
SQL["AGG-10"] = "SELECT channel_id, round(er_new, 3) AS er_new, round(er_old, 3) AS er_old, round(er_trend, 3) AS er_trend, er_status FROM metrics_v"
SQL["AGG-11"] = "SELECT channel_id, coalesce(source_posts, 0) AS source_posts, round(m.source_share, 4) AS source_share FROM metrics_v m LEFT JOIN source_v USING (channel_id)"
SQL["AGG-12"] = "SELECT channel_id, reposts, round(repost_ratio, 4) AS repost_ratio FROM metrics_v"
SQL["AGG-13"] = """SELECT channel_id, posts, total_views, total_forwards, total_reactions,
  round_even(CAST(total_views AS DOUBLE) / posts, 1) AS avg_views_all FROM metrics_v"""
SQL["AGG-14"] = "SELECT channel_id, total_replies, round(avg_comments, 4) AS avg_comments FROM metrics_v"
SQL["AGG-15"] = """
SELECT channel_id, emoji, reactions, CAST(count(*) OVER (PARTITION BY channel_id) AS INT) AS emoji_types,
  round(coalesce(CAST(sum(CASE WHEN emoji IN ('👍', '❤') THEN reactions ELSE 0 END) OVER (PARTITION BY channel_id) AS DOUBLE)
        / nullif(CAST(sum(reactions) OVER (PARTITION BY channel_id) AS DOUBLE), 0), 0), 4) AS simple_share
FROM (SELECT channel_id, emoji, CAST(sum(c) AS BIGINT) AS reactions FROM (
   SELECT channel_id, '👍' AS emoji, r1 AS c FROM newest_v WHERE known UNION ALL
   SELECT channel_id, '❤', r2 FROM newest_v WHERE known UNION ALL SELECT channel_id, '🎉', r3 FROM newest_v WHERE known) GROUP BY 1, 2)"""
SQL["AGG-16"] = """SELECT channel_id, rankable AS rankable_posts, flat AS flat_posts,
  round(coalesce(CAST(flat AS DOUBLE) / nullif(rankable, 0), 0), 4) AS flat_share FROM metrics_v"""
SQL["AGG-17"] = """SELECT channel_id, early AS early_posts, CAST(early_sum AS BIGINT) AS early_sum,
  round(early_cv, 4) AS flatness_cv, flatness_on FROM metrics_v"""
SQL["AGG-18"] = r"""
SELECT channel_id, private_posts, ad_posts, round_even(ratio, 2) AS private_ratio, private_multiplier, coalesce(codes, 0) AS unique_private
FROM private_v LEFT JOIN (
  SELECT channel_id, count(DISTINCT code) AS codes FROM (
    SELECT channel_id, unnest(regexp_extract_all(text, 't\.me/(?:\+|joinchat/)([a-zA-Z0-9_-]+)', 1, 'i')) AS code FROM newest_text_v)
  GROUP BY 1) USING (channel_id)"""
SQL["AGG-19"] = "SELECT channel_id, with_dc, foreign_dc, native_dc, foreign_ratio, geo_mismatch, geo_penalty FROM forensics_v"
SQL["AGG-20"] = "SELECT channel_id, accounts, premium, premium_ratio, premium_penalty FROM forensics_v"
SQL["AGG-21"] = """SELECT channel_id, n_scam, n_fake, n_restricted, n_deleted, n_bot, n_flagged,
  complete AND (n_scam > 0 OR n_fake > 0) AS flagged, flag_penalty FROM forensics_v"""
SQL["AGG-22"] = """SELECT channel_id, accounts, forensic_status AS status, cluster_penalty, geo_penalty, premium_penalty, flag_penalty,
  cluster_penalty + geo_penalty + premium_penalty + flag_penalty AS total_penalty FROM forensics_v"""
SQL["AGG-23"] = "SELECT status, count(*) AS channels FROM results_v GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM results_v"
SQL["AGG-24"] = "SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS channels FROM results_v WHERE status = 'GOOD' GROUP BY 1"
SQL["AGG-25"] = """
SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS channels,
  round(count(*) * 100e0 / (SELECT count(*) FROM results_v WHERE status = 'GOOD'), 4) AS share
FROM results_v WHERE status = 'GOOD' GROUP BY 1"""
SQL["AGG-26"] = """
SELECT h.category, channels, coalesce(r.low, o.low) AS cpm_low, coalesce(r.high, o.high) AS cpm_high, h.category <> 'UNCATEGORIZED' AS categorised,
  CAST(sum(channels) OVER (PARTITION BY h.category <> 'UNCATEGORIZED') AS BIGINT) AS group_total
FROM (SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS channels FROM results_v WHERE status = 'GOOD' GROUP BY 1) h
LEFT JOIN rates_v r ON r.category = h.category CROSS JOIN (SELECT low, high FROM rates_v WHERE category = 'OTHER') o"""
SQL["AGG-27"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM usage_v
  WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND user_id IS NOT NULL GROUP BY 1"""
SQL["AGG-28"] = """SELECT event_type, count(*) AS events, round(avg(duration_ms), 1) AS avg_duration_ms FROM usage_v
  WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1"""
SQL["AGG-29"] = """
SELECT count(DISTINCT CASE WHEN event_type = 'app_open' THEN user_id END) AS opens,
  count(DISTINCT CASE WHEN event_type IN ('search_submit', 'channel_view') THEN user_id END) AS browse,
  count(DISTINCT CASE WHEN event_type = 'channel_detail' THEN user_id END) AS detail
FROM usage_v WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'"""
_rolling = """
SELECT strftime(d.day, '%Y-%m-%d') AS day, {stage} count(DISTINCT e.user_id) AS users, true AS close
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM usage_v WHERE user_id IS NOT NULL) d
JOIN (SELECT CAST(ts AS DATE) AS day, user_id, event_type FROM usage_v WHERE user_id IS NOT NULL) e ON e.day BETWEEN d.day - 6 AND d.day {where} GROUP BY ALL"""
SQL["AGG-27b"] = _rolling.format(stage="", where="")
SQL["AGG-29b"] = _rolling.format(stage="s.stage,", where="JOIN (VALUES ('opens', 'app_open'), ('browse', 'search_submit'), ('browse', 'channel_view'), ('detail', 'channel_detail')) AS s(stage, kind) ON s.kind = e.event_type")
SQL["AGG-30"] = "SELECT DISTINCT channel_id, user_id, username FROM audience_v WHERE user_id IS NOT NULL AND user_id <> 0"
SQL["AGG-31"] = """
SELECT channel_id, footer, footer_posts FROM footers_v"""
SQL["AGG-32"] = """
SELECT key, turn, CASE WHEN total > 0 THEN least(100, greatest(0, CAST(trunc(ads * 1e0 / total * 100) AS INT))) ELSE 0 END AS ad_percentage
FROM (SELECT key, turn, CAST(json_extract(body, '$.ad_post_count') AS INT) AS ads, CAST(json_extract(body, '$.total_posts') AS INT) AS total
      FROM llm_v WHERE body IS NOT NULL)"""
SQL["AGG-33"] = """
SELECT key, turn, CASE WHEN total > 0 THEN CAST(trunc(bots * 1e0 / total * 100) AS INT) ELSE 0 END AS bot_percentage,
  CASE tier WHEN 'HIGH' THEN 95 WHEN 'MEDIUM' THEN 70 WHEN 'LOW' THEN 30 ELSE 50 END AS trust_score
FROM (SELECT key, turn, CAST(json_extract(body, '$.suspicious_bot_count') AS INT) AS bots, CAST(json_extract(body, '$.total_comments') AS INT) AS total,
        json_extract_string(body, '$.authenticity_tier') AS tier FROM llm_v WHERE body IS NOT NULL)"""
SQL["AGG-34"] = """
SELECT key, turn, toxic AS is_toxic, CASE WHEN toxic THEN category END AS toxic_category,
  CASE severity WHEN 'CRITICAL' THEN 95 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 60 WHEN 'LOW' THEN 40 ELSE 0 END AS confidence,
  round_even(ratio, 3) AS toxic_ratio
FROM (SELECT *, category <> 'null' AND (severity IN ('CRITICAL', 'HIGH') OR (severity = 'MEDIUM' AND ratio > 0.1)) AS toxic FROM (
  SELECT key, turn, json_extract_string(body, '$.toxic_category') AS category, json_extract_string(body, '$.severity_label') AS severity,
    CAST(json_extract(body, '$.toxic_post_count') AS DOUBLE) / CAST(json_extract(body, '$.total_posts') AS DOUBLE) AS ratio
  FROM llm_v WHERE body IS NOT NULL))"""
SQL["WIN-01"] = "SELECT channel_id, post_id, rn FROM newest_v WHERE rn <= 50"
SQL["WIN-02"] = """SELECT channel_id, post_id, pos AS viewed_rank, cnt AS viewed_count, pos <= cnt // 4 AS is_new, pos > cnt - cnt // 4 AS is_old FROM viewed_v"""
SQL["WIN-03"] = """SELECT channel_id, ids, pairs AS neighbour_pairs,
  round(coalesce(CAST(pairs AS DOUBLE) / nullif(ids - 1, 0), 0), 4) AS neighbour_ratio FROM neighbours_v"""
SQL["WIN-04"] = "SELECT channel_id, gaps, round(interval_cv, 3) AS interval_cv FROM metrics_v"
SQL["WIN-05"] = """
SELECT channel_id, post_id, reacted FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY reacted DESC, post_id) AS place, count(*) OVER (PARTITION BY channel_id) AS big
  FROM newest_v WHERE reacted > 0) WHERE place > 1 OR big <= 3"""
SQL["WIN-06"] = """
SELECT channel_id, count(*) FILTER (WHERE rn <= 5) AS early_posts, arg_min(post_id, rn) FILTER (WHERE known AND rn <= 20) AS target_post
FROM newest_v GROUP BY 1"""
SQL["WIN-07"] = """
SELECT user_id, username, strftime(added_at, '%Y-%m-%d') AS added_on, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, username ORDER BY added_at DESC, seq DESC) AS k FROM favorites_v) WHERE k = 1"""
SQL["WIN-08"] = """
SELECT user_id, username, position FROM (
  SELECT user_id, username, row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC, seq DESC) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, username ORDER BY added_at DESC, seq DESC) AS k FROM favorites_v) WHERE k = 1)
WHERE position <= 100"""
SQL["WIN-09"] = "SELECT request_id, username, row_number() OVER (ORDER BY requested_at, request_id) AS position FROM requests_v"
