"""Oracle SQL of fraud factors, gates, trust and scores."""

SQL: dict[str, str] = {}

for _number in range(1, 14):
    _hit = "NOT alibi AND reach > reach_limit" if _number == 1 else f"f{_number} > 0"
    SQL[f"FRD-{_number:02d}"] = f"SELECT channel_id, f{_number} AS weight, {_hit} AS triggered FROM factors_v"
SQL["FRD-05"] = """
SELECT channel_id, CASE WHEN hit THEN 10 ELSE 0 END AS weight, hit AS triggered FROM (
  SELECT channel_id, coalesce(known, false) AND total_reactions > 0 AND CAST(simple_reactions AS DOUBLE) / nullif(total_reactions, 0) > 0.95 AND 3 <= 2 AS hit
  FROM metrics_v)"""
SQL["FRD-14"] = "SELECT channel_id, mitigation FROM factors_v"
_names = [
    "impossible_reach", "flat_cv", "dead_engagement", "no_decay", "simple_reactions", "disabled_comments", "bot_regularity", "flat_reactions",
    "extreme_reach_decay", "high_reactions_low_comments", "suspicious_velocity", "effective_members", "young_fast_inactive",
]
_reasons = ", ".join(
    f"CASE WHEN {'NOT alibi AND reach > reach_limit' if i == 1 else f'f{i} > 0'} THEN '{n}' END" for i, n in enumerate(_names, start=1)
)
SQL["FRD-15"] = f"""SELECT channel_id, conviction, hits AS factors_triggered, mitigation, eff AS effective_conviction, conviction_scam,
  concat_ws(',', {_reasons}) AS reasons FROM conviction_v"""
SQL["GAT-01"] = "SELECT channel_id, posts < 10 OR participants_count < 100 AS new_channel FROM metrics_v"
SQL["GAT-02"] = """SELECT channel_id, CASE WHEN is_scam THEN 'flagged_scam' ELSE 'flagged_fake' END AS gate FROM metrics_v
  WHERE (is_scam OR is_fake) AND posts >= 10 AND participants_count >= 100"""
SQL["GAT-03"] = """SELECT channel_id, viewed AS viewed_posts,
  viewed = 0 AND posts >= 10 AND participants_count >= 100 AND NOT is_scam AND NOT is_fake AS no_views FROM metrics_v"""
SQL["GAT-04"] = """SELECT channel_id, 'impossible_counts' AS gate FROM metrics_v
  WHERE impossible AND viewed > 0 AND posts >= 10 AND participants_count >= 100 AND NOT is_scam AND NOT is_fake"""
for _number, _column in {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 14: 13, 15: 14}.items():
    SQL[f"TRU-{_number:02d}"] = f"SELECT channel_id, m{_column} AS multiplier FROM trust_v"
SQL["TRU-13"] = """
SELECT channel_id, CASE WHEN scam + bad = 0 THEN 1e0 ELSE round_even(power(0.9e0, scam) * power(0.95e0, bad), 2) END AS multiplier FROM network_v"""
SQL["TRU-16"] = """
SELECT t.channel_id, CASE WHEN coalesce(f.accounts, 0) >= 10 THEN 'normal' ELSE 'hardcore' END AS scoring_mode, flatness_on,
  round(CASE WHEN coalesce(f.accounts, 0) < 10 AND flatness_on THEN least(0.8e0, p) ELSE p END, 6) AS trust
FROM (SELECT *, greatest(0.1e0, n1 * n2 * n3 * m4*m5*m6*m7*m8*m9*m10*m11*m12*m13*m14) AS p FROM (
   SELECT t.*, CASE WHEN NOT coalesce(f.accounts >= 10, false) THEN 1e0 WHEN f.pairs / (f.ids - 1e0) > 0.3 THEN 0e0 WHEN f.pairs / (f.ids - 1e0) > 0.15 THEN 0.5e0 ELSE 1e0 END AS n1,
     CASE WHEN f.accounts >= 10 AND f.with_dc >= 5 AND f.foreign_dc * 1e0 / f.with_dc > 0.75 THEN 0.2e0 ELSE 1e0 END AS n2,
     CASE WHEN f.accounts >= 10 AND f.premium = 0 THEN 0.8e0 ELSE 1e0 END AS n3
   FROM trust_v t LEFT JOIN few_v f USING (channel_id))) t LEFT JOIN few_v f USING (channel_id)"""
SQL["TRU-16b"] = """
SELECT t.channel_id, CASE WHEN coalesce(a.accounts, 0) >= 10 THEN 'normal' ELSE 'hardcore' END AS scoring_mode, flatness_on,
  round(CASE WHEN coalesce(a.accounts, 0) < 10 AND flatness_on THEN least(0.8e0, trust_product) ELSE trust_product END, 6) AS trust
FROM trust_v t LEFT JOIN (SELECT channel_id, count(*) AS accounts FROM audience_v GROUP BY 1) a USING (channel_id)"""
SQL["TRU-17"] = "SELECT channel_id, round(bot_m, 4) AS multiplier FROM safety_v"
SQL["TRU-18"] = """SELECT channel_id, ad_m AS scan_multiplier,
  CAST(CASE WHEN ad_pct <= 20 THEN 1 WHEN ad_pct <= 40 THEN 0.95 WHEN ad_pct <= 60 THEN 0.85 WHEN ad_pct <= 80 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS rescore_multiplier FROM safety_v"""
SQL["TRU-19"] = "SELECT channel_id, safe_m AS safety_multiplier, tier, tier_cap, exclusion_reason, round(llm_trust, 4) AS llm_trust FROM safety_v"
SQL["AGG-35"] = """SELECT channel_id, round(trust_product, 6) AS trust_product, concat_ws(',',
  CASE WHEN m1 < 1 THEN 'id_clustering' END, CASE WHEN m2 < 1 THEN 'geo_dc' END, CASE WHEN m3 < 1 THEN 'premium' END,
  CASE WHEN m4 < 1 THEN 'hidden_comments' END, CASE WHEN m5 < 1 THEN 'conviction' END, CASE WHEN m6 < 1 THEN 'hollow_views' END,
  CASE WHEN m7 < 1 THEN 'zombie_engagement' END, CASE WHEN m8 < 1 THEN 'satellite' END, CASE WHEN m9 < 0.6 THEN 'ghost_channel' WHEN m9 < 1 THEN 'zombie_audience' END,
  CASE WHEN m10 < 1 THEN 'member_discrepancy' END, CASE WHEN m11 < 1 THEN 'budget_cliff' END, CASE WHEN m12 < 1 THEN 'spam_posting' END,
  CASE WHEN m13 < 1 THEN 'private_links' END, CASE WHEN m14 < 1 THEN 'dying_engagement' END,
  CASE WHEN scoring_mode = 'hardcore' AND flatness_on THEN 'reaction_flatness' END) AS penalties FROM trust_v"""
SQL["SCO-01"] = "SELECT channel_id, quality, quality_max, engagement, engagement_max, reputation, 20 AS reputation_max FROM points_v"
SQL["SCO-02"] = "SELECT channel_id, raw_score FROM trust_v"
SQL["SCO-03"] = "SELECT channel_id, score FROM scored_v"
SQL["SCO-04"] = "SELECT channel_id, scam_flag, verdict FROM scored_v"
SQL["SCO-05"] = "SELECT channel_id, trust_factor, round_even(llm_trust, 2) AS llm_trust_factor FROM scored_v"
SQL["SCO-06"] = """
SELECT channel_id, status,
  CASE WHEN severity = 'CRITICAL' AND is_toxic THEN 'BAD' WHEN verdict = 'SCAM' THEN 'BAD' ELSE 'GOOD' END AS outcome_status,
  CASE WHEN severity = 'CRITICAL' AND is_toxic THEN 'TOXIC_' || toxic_category ELSE verdict END AS outcome_verdict,
  CASE WHEN severity = 'CRITICAL' AND is_toxic THEN 0 ELSE score END AS outcome_score,
  NOT (severity = 'CRITICAL' AND is_toxic) AND score >= 70 AND coalesce(category, '') = '' AS retry
FROM scored_v"""
