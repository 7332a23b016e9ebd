"""Oracle SQL of re-scoring, prices and presentation."""

SQL: dict[str, str] = {}

_inputs = """SELECT username, i_fatal AS clustered, i_pc AS premium_count, i_users AS users_analyzed, es AS er_status, i_scam AS scam_count, i_bad AS bad_count,
  i_ad AS ad_percentage, i_bot AS bot_percentage, round(i_nr, 4) AS neighbour_ratio, round(i_fo, 4) AS foreign_ratio, round(re, 4) AS reach,
  round(fr, 4) AS forward_rate, round(rr, 4) AS reaction_rate, round(ac, 4) AS avg_comments, CAST(i_conv AS DOUBLE) AS conviction_score,
  round(vd, 4) AS views_decay, round(i_share, 4) AS source_max_share, round(rg, 4) AS posts_per_day, round(i_private, 4) AS private_ratio FROM {source}"""
SQL["RSC-01"] = _inputs.format(source="trust_row_v")
SQL["RSC-01b"] = _inputs.format(source="trust_in_v")
SQL["RSC-02"] = "SELECT username, stored_trust FROM stored_trust_v"
SQL["RSC-03"] = "SELECT username, quality_points, engagement_points, reputation_points, stored_raw FROM raw_v"
SQL["RSC-04"] = "SELECT username, round(new_trust, 4) AS new_trust, penalties FROM unified_v"
SQL["RSC-05"] = """
SELECT username, new_raw, new_score, round(new_trust, 4) AS new_trust, new_verdict,
  has_json AND (score <> new_score OR abs(trust_factor - new_trust) > 0.01 OR verdict <> new_verdict) AS changed
FROM (SELECT *, CASE WHEN NOT has_json THEN verdict WHEN new_score >= 75 THEN 'EXCELLENT' WHEN new_score >= 55 THEN 'GOOD' WHEN new_score >= 40 THEN 'MEDIUM'
    WHEN new_score >= 25 THEN 'HIGH_RISK' ELSE 'SCAM' END AS new_verdict
  FROM (SELECT s.username, s.has_json, s.score, s.trust_factor, s.verdict, CASE WHEN s.has_json THEN stored_raw ELSE 0 END AS new_raw,
      CASE WHEN s.has_json THEN CAST(round_even(stored_raw * u.new_trust, 0) AS INT) ELSE s.score END AS new_score,
      CASE WHEN s.has_json THEN u.new_trust ELSE s.trust_factor END AS new_trust
    FROM stored_v s JOIN raw_v USING (username) LEFT JOIN unified_row_v u USING (username)))"""
_bulk = """SELECT s.username, s.score, CAST(trunc(stored_raw * stored_trust) AS INT) AS new_score, stored_trust
  FROM stored_v s JOIN raw_patched_v USING (username) JOIN stored_trust_v USING (username) WHERE s.status IN ('GOOD', 'BAD')"""
SQL["RSC-06"] = f"""
SELECT username, new_score, CASE WHEN new_score >= 75 THEN 'EXCELLENT' WHEN new_score >= 55 THEN 'GOOD' WHEN new_score >= 40 THEN 'MEDIUM'
  WHEN new_score >= 25 THEN 'HIGH_RISK' ELSE 'SCAM' END AS new_verdict, CASE WHEN new_score >= 70 THEN 'GOOD' ELSE 'BAD' END AS new_status, stored_trust FROM ({_bulk})"""
SQL["RSC-07"] = """
SELECT username, new_score, CASE WHEN new_score >= 70 THEN 'GOOD' ELSE 'BAD' END AS new_status, tier AS new_tier FROM (
  SELECT s.username, f.tier, least(CAST(trunc((stored_raw + 5e0) * s.trust_factor * f.llm_trust) AS INT), f.tier_cap) AS new_score
  FROM stored_v s JOIN raw_v USING (username) JOIN safety_v f USING (channel_id) WHERE s.status IN ('GOOD', 'BAD'))"""
SQL["RSC-08"] = """SELECT username, users_analyzed, round(i_nr, 4) AS neighbour_ratio, round(new_trust, 4) AS new_trust FROM backfilled_v"""
SQL["RSC-09"] = """
SELECT username, CASE WHEN has_json THEN cv ELSE 0e0 END AS in_cv_views, CASE WHEN has_json THEN re ELSE 0e0 END AS in_reach, CASE WHEN has_json THEN rg ELSE 0e0 END AS in_posts_per_day,
  CASE WHEN has_json THEN fr ELSE 0e0 END AS in_forward_rate, CASE WHEN has_json THEN vd ELSE 1e0 END AS in_views_decay, CASE WHEN has_json THEN rr ELSE 0e0 END AS in_reaction_rate,
  CASE WHEN has_json THEN ac ELSE 0e0 END AS in_avg_comments, CASE WHEN has_json THEN rs ELSE 100e0 END AS in_stability_cv,
  CASE WHEN has_json AND pr IS NOT NULL THEN pr ELSE 0e0 END AS in_premium_ratio, CASE WHEN has_json THEN round(1 - sd, 4) ELSE 1e0 END AS in_source_share,
  CASE WHEN has_json AND rp IS NOT NULL THEN rp ELSE 1e0 END AS in_repost_ratio, CASE WHEN has_json THEN es ELSE 'critical_decline' END AS in_er_status,
  CASE WHEN has_json THEN 3 ELSE 0 END AS in_stability_points, CASE WHEN has_json THEN ag ELSE 0 END AS in_age,
  CASE WHEN has_json AND pc IS NOT NULL THEN pc ELSE 0 END AS in_premium_count, NOT has_json OR con AS in_comments_enabled, NOT has_json OR ron AS in_reactions_enabled
FROM stored_v"""
SQL["AGG-36"] = f"""SELECT count(*) AS total, count(*) AS updated, 0 AS skipped, 0 AS errors, count(*) FILTER (WHERE score <> new_score) AS changed FROM ({_bulk})"""
SQL["JSN-03"] = "SELECT username, CASE WHEN has_json THEN ac ELSE 0e0 END AS avg_comments FROM stored_v"
SQL["JSN-04"] = """SELECT username, CASE WHEN has_json THEN re ELSE 0e0 END AS quick_reach, CASE WHEN has_json THEN rr ELSE 0e0 END AS quick_err,
  CASE WHEN has_json THEN ac ELSE 0e0 END AS quick_comments FROM stored_v"""
SQL["PRC-01"] = "SELECT username, cpm FROM cpm_v"
SQL["PRC-02"] = "SELECT username, guessed AS views_for_price FROM views_v"
SQL["PRC-03"] = """SELECT username, price_min, price_max, cpm, low AS cpm_low, high AS cpm_high, v AS views_for_price, r.trust_factor AS price_trust
  FROM price_v JOIN results_v r USING (username)"""
SQL["PRC-04"] = "SELECT channel_id, low AS cpm_low, high AS cpm_high FROM results_v JOIN cpm_v USING (username)"
SQL["PRS-01"] = """SELECT username, CAST(row_number() OVER (PARTITION BY username ORDER BY m, name) - 1 AS INT) AS place, name, round(m, 2) AS multiplier FROM penalties_v"""
SQL["PRS-02"] = "SELECT username, i - 1 AS place, codes[i] AS code FROM (SELECT username, codes, unnest(range(1, len(codes) + 1)) AS i FROM recommend_v)"
SQL["PRS-03"] = """
SELECT s.username, score, verdict, status, members, category, price_min, price_max, CASE WHEN has_json THEN re ELSE 0e0 END AS quick_reach,
  CASE WHEN has_json THEN rr ELSE 0e0 END AS quick_err, flag_verified AS verified, ad_status, coalesce(np, 0) AS n_penalties, len(codes) AS n_recommendations
FROM stored_v s JOIN price_v USING (username) JOIN recommend_v USING (username)
LEFT JOIN (SELECT username, count(*) AS np FROM penalties_v GROUP BY 1) USING (username)"""
SQL["PRS-04"] = """SELECT username, title, score, verdict, list_min AS price_min, list_max AS price_max, flag_verified AS verified, ad_status
  FROM stored_v JOIN price_v USING (username) WHERE status IN ('GOOD', 'BAD') AND score >= 30"""
SQL["PRS-05"] = """
SELECT username, 'STANDARD' AS tier, 85 AS tier_cap, lt AS llm_trust_factor, lad AS ad_percentage, CASE WHEN lad <= 20 THEN 'good' WHEN lad <= 40 THEN 'warning' ELSE 'bad' END AS ad_status,
  lbot AS bot_percentage, CASE WHEN lbot <= 20 THEN 'good' WHEN lbot <= 50 THEN 'warning' ELSE 'bad' END AS bot_status, ltrust AS trust_score,
  CASE WHEN ltrust >= 60 THEN 'good' WHEN ltrust >= 30 THEN 'warning' ELSE 'bad' END AS trust_status FROM stored_v WHERE has_llm"""
SQL["UIF-01"] = """
SELECT *, CASE activity_status WHEN 'good' THEN 100 WHEN 'warning' THEN 60 ELSE 20 END AS activity_bar FROM (
  SELECT r.username, CASE WHEN ad_pct <= 20 THEN 'good' WHEN ad_pct <= 40 THEN 'warning' ELSE 'bad' END AS ad_status,
    CASE WHEN ad_pct < 10 THEN 'good' WHEN ad_pct < 30 THEN 'warning' WHEN ad_pct < 100 THEN 'bad' ELSE 'warning' END AS ad_load,
    CASE WHEN t >= 60 THEN 'good' WHEN t >= 30 THEN 'warning' ELSE 'bad' END AS trust_status,
    CASE WHEN t >= 80 THEN 'good' WHEN t >= 60 THEN 'warning' ELSE 'bad' END AS brand_status,
    CASE WHEN score / 5e0 < 0.14 THEN 'bad' WHEN score / 5e0 < 0.5 THEN 'warning' WHEN score / 5e0 < 8 THEN 'good' WHEN score / 5e0 < 15 THEN 'warning' ELSE 'bad' END AS activity_status,
    CASE WHEN score < 20 THEN 'good' WHEN score < 50 THEN 'warning' WHEN score < 100 THEN 'bad' ELSE 'warning' END AS private_status
  FROM results_v r JOIN (SELECT username, comment_trust AS t FROM channels_v) USING (username))"""
SQL["UIF-03"] = """
SELECT username, category, metric, score, max, round(value, 2) AS value, false AS disabled FROM (
  SELECT username, 'quality' AS category, 'forward_rate' AS metric, 4 AS score, 15 AS max, fr AS value FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'quality', 'cv_views', 1, 12, cv FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'quality', 'reach', 2, 8, re FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'quality', 'regularity', 3, 7, rg FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'engagement', 'comments', cp, 15, NULL FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'engagement', 'er_trend', 5, 10, NULL FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'engagement', 'reaction_rate', 6, 8, rr FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'engagement', 'reaction_stability', 3, 5, rs FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'reputation', 'age', 2, 7, ag FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'reputation', 'premium', CASE WHEN has_premium THEN 4 ELSE 0 END, CASE WHEN has_premium THEN 7 ELSE 0 END,
      CASE WHEN has_premium THEN (ch % 8) / 100e0 END FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'reputation', 'source_diversity', 6, 6, sd FROM stored_v WHERE has_json)"""
SQL["UIF-03b"] = """
SELECT *, CASE status WHEN 'good' THEN 100 WHEN 'warning' THEN 60 ELSE 20 END AS bar_percent FROM (
  SELECT username, 'quality' AS category, 'ad_load' AS metric, CAST(lad AS DOUBLE) AS value,
    CASE WHEN lad < 10 THEN 'good' WHEN lad < 30 THEN 'warning' WHEN lad < 100 THEN 'bad' ELSE 'warning' END AS status FROM stored_v WHERE has_llm
  UNION ALL SELECT username, 'quality', 'activity', rg, CASE WHEN rg < 0.14 THEN 'bad' WHEN rg < 0.5 THEN 'warning' WHEN rg < 8 THEN 'good' WHEN rg < 15 THEN 'warning' ELSE 'bad' END
    FROM stored_v WHERE has_json
  UNION ALL SELECT username, 'reputation', 'private_links', pl, CASE WHEN pl < 0.2 THEN 'good' WHEN pl < 0.5 THEN 'warning' WHEN pl < 1 THEN 'bad' ELSE 'warning' END
    FROM stored_v WHERE has_json)"""
SQL["UIF-04"] = "SELECT username, category, metric, score, max, category_score FROM estimate_v"
