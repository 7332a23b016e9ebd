"""Views over the driver tables, in DuckDB SQL, written independently of the Spark code.

Names end in ``_v`` so that they cannot be confused with columns or driver tables.
"""

from trustlens.functions.text import STOP_NAMES

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["size_v"] = "SELECT (SELECT max(user_id) + 1 FROM events) AS n, (SELECT count(*) FROM documents) AS docs"

VIEWS["post_base_v"] = f"""
SELECT user_id AS channel_id, event_id AS post_id, ts, value, n, event_id % docs AS doc_id,
  date_diff('day', CAST(ts AS DATE), CAST({AS_OF} AS DATE)) AS age_days,
  CAST(CASE WHEN event_id % 45 = 0 THEN 0
       WHEN user_id % 5 = 0 THEN 1000 + (event_id % 3) * 10
       WHEN user_id % 5 = 1 THEN 700 + event_id % 600
       WHEN user_id % 5 = 2 THEN 200 + floor(value * 20)
       WHEN user_id % 5 = 3 THEN 400 + 40 * date_diff('day', CAST(ts AS DATE), CAST({AS_OF} AS DATE)) + event_id % 50
       ELSE floor(value * 100) END AS BIGINT) AS views
FROM events CROSS JOIN size_v"""

VIEWS["posts_v"] = """
SELECT channel_id, post_id, ts, views, n, doc_id,
  CASE WHEN channel_id % 50 = 47 AND post_id % 25 = 0 THEN views + 1
       ELSE views * (CASE channel_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 12 WHEN 4 THEN 35 ELSE 60 END) // 1000
  END AS forwards,
  post_id % (1 + channel_id % 12) AS replies,
  CASE WHEN channel_id % 11 = 0 THEN NULL ELSE r1 END AS r1,
  CASE WHEN channel_id % 11 = 0 THEN NULL ELSE r1 // 2 END AS r2,
  CASE WHEN channel_id % 11 = 0 THEN NULL WHEN views >= 100 THEN post_id % 5 ELSE 0 END AS r3,
  channel_id % 11 <> 0 AS known,
  CASE WHEN post_id % 4 = 0 AND channel_id % 3 = 0 THEN
    CASE WHEN channel_id % 9 = 0 THEN 1000 ELSE 1000 + post_id % 6 END END AS source_id,
  CASE WHEN channel_id % 7 = 0 THEN
     CASE WHEN post_id % 10 IN (0, 1, 2) THEN ' t.me/+inv' || (post_id % 97)
          WHEN post_id % 10 = 3 THEN ' t.me/channel' || (post_id % n) ELSE '' END
   ELSE CASE post_id % 40 WHEN 0 THEN ' t.me/+inv' || (post_id % 97) WHEN 1 THEN ' t.me/channel' || (post_id % n)
     WHEN 2 THEN ' @channel' || ((post_id * 7) % n) WHEN 3 THEN ' telegram.me/channel' || ((post_id * 11) % n)
     WHEN 4 THEN ' https://example.com/x' WHEN 5 THEN ' t.me/joinchat/j' || (post_id % 31)
     WHEN 6 THEN ' @helperbot' ELSE '' END END AS suffix
FROM (SELECT *, views * (CASE channel_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 0 WHEN 2 THEN 5 + post_id % 20
                         ELSE 5 + age_days END) // 1000 AS r1 FROM post_base_v)"""

VIEWS["newest_v"] = """
SELECT *, coalesce(r1 + r2 + r3, 0) AS reacted FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, post_id DESC) AS rn FROM posts_v
)"""

VIEWS["newest_text_v"] = "SELECT p.*, d.text || p.suffix AS text FROM newest_v p JOIN documents d ON d.doc_id = p.doc_id"

VIEWS["viewed_v"] = """
SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, post_id DESC) AS pos,
  count(*) OVER (PARTITION BY channel_id) AS cnt,
  CAST(reacted AS DOUBLE) / views * 100 AS er
FROM newest_v WHERE views > 0"""

VIEWS["quartile_v"] = """
SELECT channel_id, max(cnt) AS cnt,
  avg(views) FILTER (WHERE pos <= cnt // 4) AS new_views, avg(views) FILTER (WHERE pos > cnt - cnt // 4) AS old_views,
  avg(er) FILTER (WHERE pos <= greatest(cnt // 4, 3)) AS er_new,
  avg(er) FILTER (WHERE pos > cnt - greatest(cnt // 4, 3)) AS er_old,
  sqrt(greatest(CAST(count(*) * sum(views * views) - sum(views) * sum(views) AS DOUBLE), 0) * count(*) / nullif(count(*) - 1, 0))
    / sum(views) * 100 AS cv_views,
  CAST(sum(views) AS DOUBLE) / count(*) AS avg_views
FROM viewed_v GROUP BY channel_id"""

VIEWS["gaps_v"] = """
SELECT channel_id, count(*) AS gaps, sqrt(greatest(count(*) * sum(g * g) - sum(g) * sum(g), 0)) / sum(g) AS interval_cv FROM (
  SELECT channel_id, CAST(epoch_us(lag(ts) OVER (PARTITION BY channel_id ORDER BY ts DESC, post_id DESC)) - epoch_us(ts) AS DOUBLE) / 1000000 AS g
  FROM newest_v) WHERE g > 0 GROUP BY channel_id"""

VIEWS["stability_v"] = """
SELECT channel_id, count(*) AS reacted_posts, max(reacted) AS reacted_max, sum(reacted) AS reacted_sum,
  count(*) FILTER (WHERE keep) AS kn,
  CASE WHEN count(*) FILTER (WHERE keep) < 2 THEN 0 ELSE
    sqrt(greatest(CAST(count(*) FILTER (WHERE keep) * sum(reacted * reacted) FILTER (WHERE keep)
         - sum(reacted) FILTER (WHERE keep) * sum(reacted) FILTER (WHERE keep) AS DOUBLE), 0)
       * (count(*) FILTER (WHERE keep)) / (count(*) FILTER (WHERE keep) - 1))
    / (sum(reacted) FILTER (WHERE keep)) * 100 END AS cv
FROM (SELECT *, NOT (big > 3 AND place = 1) AS keep FROM (
  SELECT channel_id, reacted, count(*) OVER (PARTITION BY channel_id) AS big,
    row_number() OVER (PARTITION BY channel_id ORDER BY reacted DESC, post_id) AS place
  FROM newest_v WHERE reacted > 0)) GROUP BY channel_id"""

VIEWS["source_v"] = """
SELECT channel_id, CAST(max(c) AS DOUBLE) / sum(c) AS source_share, CAST(sum(c) AS BIGINT) AS source_posts FROM (
  SELECT channel_id, source_id, count(*) AS c FROM newest_v WHERE source_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""

VIEWS["flat_v"] = """
SELECT channel_id, count(*) AS rankable, count(*) FILTER (WHERE cv < 15) AS flat FROM (
  SELECT channel_id, sqrt(greatest(CAST(3 * (r1*r1 + r2*r2 + r3*r3) - (r1+r2+r3) * (r1+r2+r3) AS DOUBLE), 0)) / (r1+r2+r3) * 100 AS cv
  FROM newest_v WHERE r1 > 10 AND r2 > 10 AND r3 > 10) GROUP BY 1"""

VIEWS["early_v"] = """
SELECT channel_id, count(*) AS early, sum(reacted) AS early_sum,
  coalesce(sqrt(greatest(CAST(count(*) * sum(reacted * reacted) - sum(reacted) * sum(reacted) AS DOUBLE), 0)) / nullif(sum(reacted), 0) * 100, 0) AS early_cv
FROM newest_v WHERE rn <= 5 AND known GROUP BY 1"""

VIEWS["links_v"] = r"""
SELECT channel_id,
  count(*) FILTER (WHERE regexp_matches(text, 't\.me/(\+|joinchat/)[a-zA-Z0-9_-]+', 'i')) AS private_posts,
  count(*) FILTER (WHERE regexp_matches(text, 't\.me/[a-zA-Z][a-zA-Z0-9_]{3,}', 'i')) AS public_posts
FROM newest_text_v GROUP BY 1"""

VIEWS["totals_v"] = """
SELECT channel_id, count(*) AS posts, CAST(sum(views) AS BIGINT) AS total_views, CAST(sum(forwards) AS BIGINT) AS total_forwards,
  CAST(sum(reacted) AS BIGINT) AS total_reactions, CAST(sum(replies) AS BIGINT) AS total_replies,
  bool_or(known) OR sum(reacted) > 0 AS reactions_on, count(source_id) AS reposts,
  CAST(sum(coalesce(r1 + r2, 0)) AS BIGINT) AS simple_reactions, bool_or(known) AS known,
  bool_or(views > 0 AND (forwards > views OR reacted > views)) AS impossible,
  CASE WHEN count(*) >= 2 THEN count(*) / greatest(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 / 86400, 0.1) ELSE 0 END AS ppd
FROM newest_v GROUP BY 1"""

VIEWS["channels_v"] = f"""
SELECT ch AS channel_id, 'channel' || ch AS username, 'Channel ' || ch AS title,
  CASE ch % 6 WHEN 0 THEN '' WHEN 1 THEN 'Ads: @manager' || ch WHEN 2 THEN 'no ads' WHEN 3 THEN 'contact t.me/owner' || ch
    WHEN 4 THEN 'promo @adbot' || ch || 'bot, write to @channel' || ch ELSE 'news of the day' END AS description,
  members, members + CASE WHEN ch % 13 = 0 THEN members // 5 ELSE 0 END AS participants_count,
  CASE ch % 8 WHEN 0 THEN 1 WHEN 1 THEN members * 2 // 1000 ELSE members * 30 // 1000 END AS online_count,
  5 + (ch * 53) % 1200 AS age_days,
  ch % 50 = 49 AS is_scam, ch % 50 = 48 AS is_fake, ch % 10 = 9 AS is_verified, ch % 4 <> 0 AS comments_enabled,
  CASE ch % 18 WHEN 0 THEN 'CRYPTO' WHEN 1 THEN 'FINANCE' WHEN 2 THEN 'REAL_ESTATE' WHEN 3 THEN 'BUSINESS' WHEN 4 THEN 'TECH'
    WHEN 5 THEN 'AI_ML' WHEN 6 THEN 'EDUCATION' WHEN 7 THEN 'BEAUTY' WHEN 8 THEN 'HEALTH' WHEN 9 THEN 'TRAVEL' WHEN 10 THEN 'RETAIL'
    WHEN 11 THEN 'ENTERTAINMENT' WHEN 12 THEN 'NEWS' WHEN 13 THEN 'LIFESTYLE' WHEN 14 THEN 'GAMBLING' WHEN 15 THEN 'ADULT'
    WHEN 17 THEN '' END AS category,
  CASE WHEN ch % 5 = 0 THEN 'NEWS' END AS category_secondary,
  (ch * 7) % 101 AS ad_pct, (ch * 13) % 101 AS bot_pct, (ch * 17) % 101 AS comment_trust, ch % 20 < 3 AS is_toxic,
  CASE WHEN ch % 2 = 0 THEN 'GAMBLING' ELSE 'SCAM' END AS toxic_category,
  CASE ch % 20 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'SAFE' END AS severity
FROM (SELECT DISTINCT user_id AS ch, CASE user_id % 6 WHEN 0 THEN 100 + user_id % 100 WHEN 1 THEN 200 + (user_id * 37) % 800
        WHEN 2 THEN 1000 + (user_id * 41) % 4000 ELSE 5000 + (user_id * 7919) % 60000 END AS members FROM events)"""

VIEWS["audience_v"] = """
SELECT channel_id, k * CASE channel_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE 1000 END AS user_id, 'user' || k AS username,
  channel_id % 5 <> 0 AND k % (CASE WHEN channel_id % 5 = 1 THEN 10 ELSE 20 END) = 0 AS is_premium,
  k % 401 = 0 AS is_scam, k % 503 = 0 AS is_fake, k % 211 = 0 AS is_restricted, k % 97 = 0 AS is_deleted, k % 61 = 0 AS is_bot,
  CASE WHEN k % 6 = 0 THEN NULL WHEN channel_id % 4 = 1 THEN [1, 3, 5][k % 3 + 1] ELSE [2, 4][k % 2 + 1] END AS dc_id
FROM (SELECT o_custkey % n AS channel_id, o_orderkey AS k FROM orders CROSS JOIN size_v)"""

VIEWS["neighbours_v"] = """
SELECT channel_id, count(*) AS ids, count(*) FILTER (WHERE gap <= 500) AS pairs FROM (
  SELECT channel_id, user_id - lag(user_id) OVER (PARTITION BY channel_id ORDER BY user_id) AS gap
  FROM audience_v WHERE user_id IS NOT NULL AND user_id <> 0) GROUP BY 1"""

VIEWS["forensics_v"] = """
SELECT *, complete AND neighbour_raw > 0.30 AS clustered, neighbour_raw > 0.15 AND neighbour_raw <= 0.30 AS suspicious,
  round_even(neighbour_raw, 3) AS neighbour_ratio, round_even(foreign_raw, 3) AS foreign_ratio, foreign_raw > 0.75 AS geo_mismatch,
  round_even(premium_raw, 3) AS premium_ratio, CASE WHEN complete THEN premium ELSE 0 END AS premium_count,
  CASE WHEN neighbour_raw > 0.30 THEN -100 ELSE 0 END AS cluster_penalty, CASE WHEN foreign_raw > 0.75 THEN -50 ELSE 0 END AS geo_penalty,
  CASE WHEN NOT complete THEN 0 WHEN premium = 0 THEN -20 WHEN premium_raw > 0.05 THEN 10 ELSE 0 END AS premium_penalty,
  CASE WHEN complete AND (n_scam > 0 OR n_fake > 0) THEN -10 ELSE 0 END AS flag_penalty,
  CASE WHEN complete THEN 'complete' ELSE 'insufficient_data' END AS forensic_status
FROM (
  SELECT a.*, coalesce(ids, 0) AS ids, coalesce(pairs, 0) AS pairs, accounts >= 10 AS complete,
    CASE WHEN accounts >= 10 AND ids >= 10 THEN CAST(pairs AS DOUBLE) / (ids - 1) ELSE 0e0 END AS neighbour_raw,
    CASE WHEN accounts >= 10 AND with_dc >= 5 THEN CAST(foreign_dc AS DOUBLE) / with_dc ELSE 0e0 END AS foreign_raw,
    CASE WHEN accounts >= 10 THEN CAST(premium AS DOUBLE) / accounts ELSE 0e0 END AS premium_raw
  FROM (
    SELECT channel_id, count(*) AS accounts, count(dc_id) AS with_dc, count(*) FILTER (WHERE dc_id IN (1, 3, 5)) AS foreign_dc,
      count(*) FILTER (WHERE dc_id IN (2, 4)) AS native_dc, count(*) FILTER (WHERE is_premium) AS premium,
      count(*) FILTER (WHERE is_scam) AS n_scam, count(*) FILTER (WHERE is_fake) AS n_fake,
      count(*) FILTER (WHERE is_restricted) AS n_restricted, count(*) FILTER (WHERE is_deleted) AS n_deleted,
      count(*) FILTER (WHERE is_bot) AS n_bot,
      count(*) FILTER (WHERE is_scam OR is_fake OR is_restricted OR is_deleted OR is_bot) AS n_flagged
    FROM audience_v GROUP BY 1) a LEFT JOIN neighbours_v USING (channel_id))"""

VIEWS["metrics_v"] = """
SELECT c.*, coalesce(t.posts, 0) AS posts, t.total_views, t.total_forwards, t.total_reactions, t.total_replies, t.reactions_on, t.reposts,
  t.simple_reactions, t.impossible, t.ppd, round_even(t.ppd, 1) AS posts_per_day, t.known,
  coalesce(q.cnt, 0) AS viewed, coalesce(q.avg_views, 0e0) AS avg_views, coalesce(q.cv_views, 0e0) AS cv_views,
  coalesce(q.avg_views, 0e0) / c.members * 100 AS reach,
  coalesce(CAST(t.total_forwards AS DOUBLE) / nullif(t.total_views, 0) * 100, 0) AS forward_rate,
  coalesce(CAST(t.total_reactions AS DOUBLE) / nullif(t.total_views, 0) * 100, 0) AS reaction_rate,
  CAST(t.total_replies AS DOUBLE) / t.posts AS avg_comments,
  t.posts >= 12 AND q.cnt // 4 >= 3 AS decay_known,
  CASE WHEN t.posts >= 12 AND q.cnt // 4 >= 3 THEN q.old_views / q.new_views ELSE 1e0 END AS decay,
  CASE WHEN q.cnt >= 12 THEN q.er_new ELSE 0e0 END AS er_new, CASE WHEN q.cnt >= 12 THEN q.er_old ELSE 0e0 END AS er_old,
  CASE WHEN q.cnt >= 12 AND q.er_old >= 0.1 THEN q.er_new / q.er_old END AS er_trend,
  CASE WHEN coalesce(q.cnt, 0) < 12 THEN 'insufficient_data' WHEN q.er_old < 0.1 THEN 'always_dead'
       WHEN q.er_new / q.er_old >= 1.1 THEN 'growing' WHEN q.er_new / q.er_old >= 0.9 THEN 'stable'
       WHEN q.er_new / q.er_old >= 0.7 THEN 'declining' ELSE 'dying' END AS er_status,
  CASE WHEN s.reacted_posts >= 3 THEN round_even(s.cv, 1) ELSE 50e0 END AS stability_cv,
  CASE WHEN s.reacted_posts >= 3 THEN round_even(CAST(s.reacted_max AS DOUBLE) / s.reacted_sum, 3) ELSE 0.2e0 END AS stability_top,
  coalesce(f.source_share, 0e0) AS source_share, CAST(t.reposts AS DOUBLE) / t.posts AS repost_ratio,
  coalesce(g.gaps, 0) AS gaps, coalesce(g.interval_cv, 0e0) AS interval_cv,
  coalesce(fl.rankable, 0) AS rankable, coalesce(fl.flat, 0) AS flat,
  coalesce(e.early >= 3 AND e.early_sum > 0 AND e.early_cv < 10, false) AS flatness_on, coalesce(e.early_cv, 0e0) AS early_cv,
  coalesce(e.early, 0) AS early, coalesce(e.early_sum, 0) AS early_sum,
  CAST(t.total_reactions AS DOUBLE) / t.posts AS reactions_per_post
FROM channels_v c LEFT JOIN totals_v t USING (channel_id) LEFT JOIN quartile_v q USING (channel_id)
LEFT JOIN stability_v s USING (channel_id) LEFT JOIN source_v f USING (channel_id) LEFT JOIN gaps_v g USING (channel_id)
LEFT JOIN flat_v fl USING (channel_id) LEFT JOIN early_v e USING (channel_id)"""

VIEWS["tiers_v"] = """
SELECT * FROM (VALUES ('NEWS', 20, 40, 60), ('ADULT', 20, 40, 60), ('ENTERTAINMENT', 10, 18, 30), ('AI_ML', 10, 18, 30),
  ('FINANCE', 10, 18, 30), ('EDUCATION', 10, 18, 30), ('RETAIL', 4, 8, 15), ('TRAVEL', 4, 8, 15), ('REAL_ESTATE', 4, 8, 15),
  ('BEAUTY', 4, 8, 15), ('GAMBLING', 4, 8, 15)) AS t(category, active_at, heavy_at, spam_at)"""

VIEWS["posting_v"] = """
SELECT m.channel_id, m.ppd, m.posts_per_day,
  CASE WHEN m.posts < 2 THEN 'insufficient_data' WHEN m.ppd < coalesce(active_at, 6) THEN 'normal'
       WHEN m.ppd < coalesce(heavy_at, 12) THEN 'active' WHEN m.ppd < coalesce(spam_at, 20) THEN 'heavy' ELSE 'spam' END AS posting_status
FROM metrics_v m LEFT JOIN tiers_v USING (category)"""

VIEWS["private_v"] = """
SELECT channel_id, private_posts, private_posts + public_posts AS ad_posts, ratio,
  CAST(least(CASE WHEN ratio >= 1 THEN 0.25 WHEN ratio > 0.8 THEN 0.35 WHEN ratio > 0.6 THEN 0.5 ELSE 1 END,
        CASE WHEN category = 'CRYPTO' AND ratio > 0.4 THEN 0.45 ELSE 1 END,
        CASE WHEN NOT comments_enabled AND ratio > 0.5 THEN 0.4 ELSE 1 END) AS DOUBLE) AS private_multiplier
FROM (SELECT l.*, c.category, c.comments_enabled,
        coalesce(CAST(private_posts AS DOUBLE) / nullif(private_posts + public_posts, 0), 0) AS ratio
      FROM channels_v c JOIN links_v l USING (channel_id))"""

VIEWS["factors_v"] = """
SELECT *, CASE WHEN posts < 10 OR participants_count < 100 THEN 'insufficient_data' WHEN is_scam THEN 'flagged_scam'
    WHEN is_fake THEN 'flagged_fake' WHEN viewed = 0 THEN 'no_views' WHEN impossible THEN 'impossible_counts' END AS gate,
  CASE WHEN alibi THEN 0 WHEN reach > 300 THEN 35 WHEN reach > reach_limit THEN 30 ELSE 0 END AS f1,
  CASE WHEN viewed < 5 THEN 0 WHEN cv_views < 10 THEN 25 WHEN cv_views < 15 THEN 20 ELSE 0 END AS f2,
  CASE WHEN comments_enabled AND ((reactions_per_post > 50 AND avg_comments / reactions_per_post < 0.02)
       OR (reactions_per_post > 100 AND avg_comments < 1)) THEN 20 ELSE 0 END AS f3,
  CASE WHEN NOT decay_known THEN 0 WHEN decay < 0.7 THEN 15 WHEN decay < 0.85 THEN 10 ELSE 0 END AS f4,
  0 AS f5,
  CASE WHEN comments_enabled THEN 0 ELSE 15 END AS f6,
  CASE WHEN posts >= 10 AND gaps >= 5 AND interval_cv < 0.15 THEN 10 ELSE 0 END AS f7,
  CASE WHEN rankable >= 3 AND CAST(flat AS DOUBLE) / rankable > 0.5 THEN 20 ELSE 0 END AS f8,
  CASE WHEN decay_known AND reach > 200 AND decay < 0.7 THEN 25 ELSE 0 END AS f9,
  CASE WHEN comments_enabled AND reactions_per_post > 500 AND avg_comments < 5 THEN 15 ELSE 0 END AS f10,
  CASE WHEN speed > speed_fake THEN CASE WHEN age_days < 90 THEN 25 ELSE 20 END
       WHEN speed > speed_warn THEN CASE WHEN age_days < 90 THEN 10 ELSE 5 END ELSE 0 END AS f11,
  CASE WHEN effective < 0.3 THEN 25 WHEN effective < 0.5 THEN 10 ELSE 0 END AS f12,
  CASE WHEN age_days < 60 AND speed > 100 AND (reaction_rate < 1 OR avg_comments < 0.5) THEN 30 ELSE 0 END AS f13,
  CASE WHEN forward_rate / 100 > 0.05 THEN 15 ELSE 0 END + CASE WHEN is_verified THEN 20 ELSE 0 END AS mitigation
FROM (SELECT *, CAST(members AS DOUBLE) / age_days AS speed,
    CASE WHEN avg_views > 0 THEN avg_views / CAST(CASE WHEN members < 200 THEN 0.8 WHEN members < 1000 THEN 0.5 WHEN members < 5000 THEN 0.3 ELSE 0.15 END AS DOUBLE) / members ELSE 1 END AS effective,
    CASE WHEN members < 200 THEN 250 WHEN members < 1000 THEN 180 WHEN members < 5000 THEN 150 ELSE 130 END AS reach_limit,
    CASE WHEN members < 200 THEN 30 WHEN members < 1000 THEN 50 WHEN members < 5000 THEN 150 ELSE 300 END AS speed_warn,
    CASE WHEN members < 200 THEN 100 WHEN members < 1000 THEN 200 WHEN members < 5000 THEN 500 ELSE 1000 END AS speed_fake,
    forward_rate > 3 OR (avg_comments > CASE WHEN members < 200 THEN 0.5 WHEN members < 1000 THEN 1 WHEN members < 5000 THEN 2 ELSE 5 END
      AND comment_trust >= 70) AS alibi
  FROM metrics_v)"""

VIEWS["conviction_v"] = """
SELECT *, (eff >= 50 AND hits >= 2) OR (eff >= 70 AND hits >= 1) OR conviction >= 80 AS conviction_scam,
  CASE WHEN gate IS NULL THEN eff ELSE 0 END AS effective_conviction
FROM (SELECT *, greatest(0, conviction - mitigation) AS eff FROM (
  SELECT *, f1+f2+f3+f4+f5+f6+f7+f8+f9+f10+f11+f12+f13 AS conviction,
    CAST(NOT alibi AND reach > reach_limit AS INT) + CAST(f2 > 0 AS INT) + CAST(f3 > 0 AS INT) + CAST(f4 > 0 AS INT) + CAST(f6 > 0 AS INT)
    + CAST(f7 > 0 AS INT) + CAST(f8 > 0 AS INT) + CAST(f9 > 0 AS INT) + CAST(f10 > 0 AS INT) + CAST(f11 > 0 AS INT) + CAST(f12 > 0 AS INT)
    + CAST(f13 > 0 AS INT) AS hits
  FROM factors_v))"""

VIEWS["points_v"] = """
SELECT *, cv_points + reach_points + regularity_points + forward_points AS quality,
  comment_points + er_points + reaction_points + stability_points AS engagement,
  age_points + premium_points + source_points AS reputation,
  42 + forwards_max - 15 AS quality_max, 38 + comments_max - 15 + reactions_max - 8 AS engagement_max
FROM (SELECT *,
  CASE WHEN cv_views < 10 THEN 0 WHEN cv_views < 30 THEN 8 WHEN cv_views < 60 THEN 12 WHEN cv_views < 100 THEN 6 WHEN forward_rate > 3 THEN 6 ELSE 0 END AS cv_points,
  CASE WHEN reach > (CASE WHEN members < 200 THEN 200 WHEN members < 1000 THEN 150 WHEN members < 5000 THEN 130 ELSE 120 END) THEN 0
    WHEN reach > (CASE WHEN members < 200 THEN 150 WHEN members < 1000 THEN 100 WHEN members < 5000 THEN 80 ELSE 60 END) THEN 4
    WHEN reach < 5 THEN 0 WHEN reach < 10 THEN 3 WHEN reach < 20 THEN 5 WHEN reach < 50 THEN 6 ELSE 8 END AS reach_points,
  CASE WHEN posts_per_day < 0.14 THEN 0 WHEN posts_per_day < 0.5 THEN 3 WHEN posts_per_day < 1 THEN 5 WHEN posts_per_day <= 5 THEN 7
    WHEN posts_per_day <= 10 THEN 5 WHEN posts_per_day <= 20 THEN 3 ELSE 1 END AS regularity_points,
  CASE WHEN forward_level = 0 THEN 0 ELSE
   (CASE forwards_max WHEN 15 THEN [2, 4, 9, 12, 15] WHEN 18 THEN [3, 5, 11, 14, 18] WHEN 25 THEN [4, 8, 15, 20, 25] ELSE [6, 11, 23, 30, 38] END)[forward_level] END AS forward_points,
  CASE WHEN NOT comments_enabled THEN 0 ELSE (CASE comments_max WHEN 15 THEN
     CASE WHEN members < 200 THEN CASE WHEN avg_comments < 0.01 THEN 0 WHEN avg_comments < 0.05 THEN 4 WHEN avg_comments < 0.2 THEN 9 WHEN avg_comments < 0.5 THEN 12 ELSE 15 END
          WHEN members < 1000 THEN CASE WHEN avg_comments < 0.1 THEN 0 WHEN avg_comments < 0.3 THEN 3 WHEN avg_comments < 1 THEN 8 WHEN avg_comments < 3 THEN 12 ELSE 15 END
          ELSE CASE WHEN avg_comments < 0.3 THEN 0 WHEN avg_comments < 0.5 THEN 3 WHEN avg_comments < 2 THEN 8 WHEN avg_comments < 5 THEN 12 ELSE 15 END END
     ELSE
     CASE WHEN members < 200 THEN CASE WHEN avg_comments < 0.01 THEN 0 WHEN avg_comments < 0.05 THEN 6 WHEN avg_comments < 0.2 THEN 12 WHEN avg_comments < 0.5 THEN 16 ELSE 20 END
          WHEN members < 1000 THEN CASE WHEN avg_comments < 0.1 THEN 0 WHEN avg_comments < 0.3 THEN 4 WHEN avg_comments < 1 THEN 10 WHEN avg_comments < 3 THEN 16 ELSE 20 END
          ELSE CASE WHEN avg_comments < 0.3 THEN 0 WHEN avg_comments < 0.5 THEN 4 WHEN avg_comments < 2 THEN 10 WHEN avg_comments < 5 THEN 16 ELSE 20 END END
     END) END AS comment_points,
  CASE er_status WHEN 'insufficient_data' THEN 5 WHEN 'growing' THEN 10 WHEN 'stable' THEN 7 WHEN 'declining' THEN 3 ELSE 0 END AS er_points,
  CASE WHEN reactions_max = 0 THEN 0 ELSE (CASE reactions_max WHEN 8 THEN [0, 2, 2, 4, 6, 8] ELSE [0, 4, 3, 6, 10, 13] END)[
     CASE WHEN reaction_rate > (CASE WHEN members < 200 THEN 20 WHEN members < 1000 THEN 12 ELSE 10 END) THEN 1
          WHEN reaction_rate > (CASE WHEN members < 200 THEN 15 WHEN members < 1000 THEN 8 ELSE 5 END) THEN 2
          WHEN reaction_rate < 0.3 THEN 3 WHEN reaction_rate < 1 THEN 4 WHEN reaction_rate < 3 THEN 5 ELSE 6 END] END AS reaction_points,
  CASE WHEN stability_top > 0.6 THEN 1 WHEN coalesce(nullif(stability_cv, 0), 50) < 15 THEN 1 WHEN coalesce(nullif(stability_cv, 0), 50) > 80 THEN 2
    WHEN stability_top < 0.4 THEN 5 ELSE 3 END AS stability_points,
  CASE WHEN age_days < 90 THEN 0 WHEN age_days < 180 THEN 1 WHEN age_days < 365 THEN 2 WHEN age_days < 730 THEN 4 ELSE 7 END AS age_points,
  CASE WHEN NOT coalesce(complete, false) OR premium_count = 0 THEN 0 WHEN premium_ratio > 0.05 THEN 7 WHEN premium_ratio > 0.02 THEN 4
    WHEN premium_ratio > 0.01 THEN 3 ELSE 1 END AS premium_points,
  CASE WHEN repost_ratio < 0.1 THEN 6 WHEN source_share > 0.7 THEN 0 WHEN source_share > 0.5 THEN 2 ELSE 6 END AS source_points
FROM (SELECT m.*, fo.complete, fo.accounts, fo.clustered, fo.neighbour_raw, fo.geo_mismatch, fo.premium_ratio, fo.premium_count,
    CASE WHEN m.comments_enabled AND reactions_on THEN 15 WHEN m.comments_enabled THEN 20 ELSE 0 END AS comments_max,
    CASE WHEN NOT reactions_on THEN 0 WHEN m.comments_enabled THEN 8 ELSE 13 END AS reactions_max,
    CASE WHEN m.comments_enabled AND reactions_on THEN 15 WHEN m.comments_enabled THEN 18 WHEN reactions_on THEN 25 ELSE 38 END AS forwards_max,
    CASE WHEN forward_rate > 15 THEN 0
      WHEN forward_rate >= (CASE WHEN members > 50000 THEN 1.5 WHEN members > 5000 THEN 2.0 ELSE 3.0 END) THEN 5
      WHEN forward_rate >= (CASE WHEN members > 50000 THEN 0.7 WHEN members > 5000 THEN 1.0 ELSE 1.5 END) THEN 4
      WHEN forward_rate >= (CASE WHEN members > 50000 THEN 0.3 WHEN members > 5000 THEN 0.5 ELSE 0.5 END) THEN 3
      WHEN forward_rate >= (CASE WHEN members > 50000 THEN 0.1 WHEN members > 5000 THEN 0.2 ELSE 0.1 END) THEN 2
      WHEN forward_rate >= 0.05 THEN 1 ELSE 0 END AS forward_level
  FROM conviction_v m LEFT JOIN forensics_v fo USING (channel_id)))"""

VIEWS["trust_v"] = """
SELECT *, CASE WHEN coalesce(accounts, 0) >= 10 THEN 'normal' ELSE 'hardcore' END AS scoring_mode,
  CASE WHEN coalesce(accounts, 0) < 10 AND flatness_on THEN least(0.8e0, trust_product) ELSE trust_product END AS trust,
  least(100, greatest(0, quality + engagement + reputation)) AS raw_score
FROM (SELECT *, greatest(0.1e0, m1*m2*m3*m4*m5*m6*m7*m8*m9*m10*m11*m12*m13*m14) AS trust_product FROM (
  SELECT p.*, posting_status, ratio AS private_ratio, private_posts, ad_posts,
    CAST(CASE WHEN NOT coalesce(complete, false) THEN 1 WHEN clustered THEN 0 WHEN neighbour_raw > 0.15 THEN 0.5 ELSE 1 END AS DOUBLE) AS m1,
    CAST(CASE WHEN complete AND geo_mismatch THEN 0.2 ELSE 1 END AS DOUBLE) AS m2,
    CAST(CASE WHEN complete AND premium_ratio = 0 THEN 0.8 ELSE 1 END AS DOUBLE) AS m3,
    CAST(CASE WHEN NOT comments_enabled THEN 0.85 ELSE 1 END AS DOUBLE) AS m4,
    CAST(CASE WHEN effective_conviction >= 70 THEN 0.3 WHEN effective_conviction >= 50 THEN 0.6 ELSE 1 END AS DOUBLE) AS m5,
    CAST(CASE WHEN reach > 300 AND NOT alibi THEN 0.6 ELSE 1 END AS DOUBLE) AS m6,
    CAST(CASE WHEN reach > 50 AND reaction_rate < 0.1 THEN 0.7 ELSE 1 END AS DOUBLE) AS m7,
    CAST(CASE WHEN source_share > 0.5 AND avg_comments < 1 THEN 0.8 ELSE 1 END AS DOUBLE) AS m8,
    CAST(CASE WHEN members > 20000 AND online_count > 0 AND online_count * 100e0 / members < 0.1 THEN 0.5
         WHEN members > 5000 AND online_count > 0 AND online_count * 100e0 / members < 0.3 THEN 0.7 ELSE 1 END AS DOUBLE) AS m9,
    CAST(CASE WHEN participants_count > 0 AND abs(participants_count - members) * 100e0 / members > 10 THEN 0.8 ELSE 1 END AS DOUBLE) AS m10,
    CAST(CASE WHEN decay < 0.2 AND decay > 0 THEN 0.7 ELSE 1 END AS DOUBLE) AS m11,
    CAST(CASE posting_status WHEN 'active' THEN 0.9 WHEN 'heavy' THEN 0.75 WHEN 'spam' THEN 0.55 ELSE 1 END AS DOUBLE) AS m12,
    private_multiplier AS m13,
    CAST(CASE WHEN er_status <> 'dying' THEN 1 WHEN decay BETWEEN 0.7 AND 1.3 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS m14
  FROM points_v p LEFT JOIN posting_v USING (channel_id) LEFT JOIN private_v USING (channel_id)))"""

VIEWS["safety_v"] = """
SELECT channel_id, category, ad_pct, bot_pct, ad_m, bot_m, CAST(safe_m AS DOUBLE) AS safe_m, tier, tier_cap, exclusion_reason,
  CASE WHEN safe_m = 0 THEN 0e0 ELSE greatest(0.15e0, ad_m * bot_m * CAST(safe_m AS DOUBLE)) END AS llm_trust
FROM (SELECT channel_id, category, ad_pct, bot_pct,
  CAST(CASE WHEN ad_pct <= 30 THEN 1 WHEN ad_pct <= 40 THEN 0.9 WHEN ad_pct <= 50 THEN 0.75 WHEN ad_pct <= 60 THEN 0.55 WHEN ad_pct <= 70 THEN 0.4 ELSE 0.35 END AS DOUBLE) AS ad_m,
  CASE WHEN bot_pct <= 40 THEN 1e0 ELSE greatest(0.3e0, 1e0 - (bot_pct - 40) / 100e0) END AS bot_m,
  CASE WHEN NOT counts THEN 1 WHEN severity = 'CRITICAL' THEN 0 WHEN severity = 'HIGH' THEN 0.3 WHEN severity = 'MEDIUM' THEN 0.7 ELSE 1 END AS safe_m,
  CASE WHEN counts AND severity = 'CRITICAL' THEN 'EXCLUDED' WHEN counts AND severity = 'HIGH' THEN 'RESTRICTED' ELSE 'STANDARD' END AS tier,
  CASE WHEN counts AND severity = 'CRITICAL' THEN 0 WHEN counts AND severity = 'HIGH' THEN 30 ELSE 85 END AS tier_cap,
  CASE WHEN counts AND severity = 'CRITICAL' THEN 'TOXIC_' || toxic_category END AS exclusion_reason
  FROM (SELECT *, is_toxic AND NOT (toxic_category = 'GAMBLING' AND coalesce(category, '') IN ('CRYPTO', 'FINANCE')) AS counts FROM channels_v))"""

VIEWS["scored_v"] = """
SELECT *, CASE WHEN gate = 'insufficient_data' THEN 'NEW_CHANNEL' WHEN tier = 'EXCLUDED' THEN 'EXCLUDED' WHEN scam_flag THEN 'SCAM'
   WHEN score >= 75 THEN 'EXCELLENT' WHEN score >= 55 THEN 'GOOD' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 25 THEN 'HIGH_RISK' ELSE 'SCAM' END AS verdict,
  CASE WHEN tier = 'EXCLUDED' THEN round_even(trust, 2) ELSE round_even(greatest(0.1e0, trust * llm_trust), 2) END AS trust_factor,
  CASE WHEN score >= 70 THEN 'GOOD' ELSE 'BAD' END AS status
FROM (SELECT t.*, s.ad_m, s.bot_m, s.safe_m, s.tier, s.tier_cap, s.llm_trust, s.exclusion_reason,
   coalesce(gate <> 'insufficient_data', true) AND (gate IS NOT NULL OR conviction_scam OR coalesce(clustered, false)) AS scam_flag,
   CASE WHEN gate = 'insufficient_data' OR tier = 'EXCLUDED' THEN 0
     ELSE least(100, greatest(0, CAST(trunc(least(raw_score * trust * llm_trust, CAST(tier_cap AS DOUBLE))) AS INT))) END AS score
  FROM trust_v t JOIN safety_v s USING (channel_id))"""

VIEWS["answers_v"] = f"""
SELECT conv_id AS key, turn,
  '{{"classification": {{"category": "' || ['TECH', 'NEWS', 'CRYPTO', 'MUSIC'][conv_id % 4 + 1]
  || '"}}, "safety": {{"status": "' || ['SAFE', 'HIGH', 'MEDIUM', 'CRITICAL', 'SAFE'][conv_id % 5 + 1]
  || '", "is_scam": ' || CASE WHEN conv_id % 7 = 0 THEN 'true' ELSE 'false' END
  || ', "flags": [' || ['', '"online casino"', '"fake shop", "adult"', '"18+ content"'][conv_id % 4 + 1]
  || ']}}, "ad_analysis": {{"ad_post_ids": [' || substring('1, 2, 3, 4, 5', 1, greatest(0, 3 * (conv_id % 6) - 2))
  || ']}}, "audience": {{"trust_score": ' || ((conv_id * 17) % 101)
  || ', "verdict": "' || ['HIGH_QUALITY', 'MIXED', 'BOT_FARM', 'OTHER'][conv_id % 4 + 1]
  || '"}}, "ad_percentage": ' || ((conv_id * 7) % 101) || ', "ad_post_count": ' || ((conv_id * 3 + turn) % 60)
  || ', "total_comments": ' || (conv_id % 41) || ', "suspicious_bot_count": ' || ((conv_id + turn) % 20)
  || ', "authenticity_tier": "' || ['HIGH', 'MEDIUM', 'LOW', 'ODD'][(conv_id + turn) % 4 + 1]
  || '", "toxic_post_count": ' || (conv_id % 9) || ', "total_posts": ' || (20 + conv_id % 30)
  || ', "toxic_category": "' || ['GAMBLING', 'null', 'SCAM'][conv_id % 3 + 1]
  || '", "severity_label": "' || ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'SAFE'][conv_id % 5 + 1] || '"}}' AS clean,
  'Toxicity: ' || (conv_id % 10) || chr(10) || 'ad_percentage: ' || ((conv_id * 7) % 101)
  || chr(10) || '"violence": ' || (conv_id % 4) || chr(10) || 'red_flags: ["spam", "bots"]' AS lines
  FROM conversations"""

VIEWS["llm_v"] = f"""
SELECT key, turn, {AS_OF} - to_days(CAST(turn * 2 AS INT)) AS cached_at,
  CASE turn % 4 WHEN 0 THEN clean WHEN 1 THEN 'Here is the answer: ' || clean || ' Hope it helps.' WHEN 2 THEN lines ELSE '' END AS response,
  CASE WHEN turn % 4 IN (0, 1) THEN clean END AS body
FROM answers_v"""

VIEWS["results_v"] = f"""
SELECT c.channel_id, c.username, c.title, c.description, c.members, c.participants_count, c.online_count, c.is_verified, c.comments_enabled,
  c.category, c.category_secondary, c.ad_pct, c.bot_pct, s.score, least(100, s.score + 5) AS raw_score,
  round((10 + (c.channel_id * 29) % 91) / 100e0, 2) AS trust_factor,
  CASE WHEN s.score >= 75 THEN 'EXCELLENT' WHEN s.score >= 55 THEN 'GOOD' WHEN s.score >= 40 THEN 'MEDIUM' WHEN s.score >= 25 THEN 'HIGH_RISK' ELSE 'SCAM' END AS verdict,
  CASE c.channel_id % 10 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'ERROR' ELSE CASE WHEN s.score >= 70 THEN 'GOOD' ELSE 'BAD' END END AS status,
  CASE WHEN c.channel_id % 4 <> 3 THEN c.channel_id % 4 END AS ad_status,
  CASE WHEN c.channel_id % 6 = 0 THEN 'user_request' ELSE 'channel' || (c.channel_id // 2) END AS found_via,
  {AS_OF} - to_hours(c.channel_id) AS created_at, {AS_OF} - to_hours(c.channel_id) AS scanned_at, z.n
FROM channels_v c JOIN (SELECT channel_id, CAST((channel_id * 37) % 101 AS INT) AS score FROM channels_v) s USING (channel_id) CROSS JOIN size_v z"""

VIEWS["ad_links_v"] = """
SELECT channel_id, username, score, status, 'channel' || ((channel_id * k + k) % n) AS link FROM results_v CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS x(k)"""

VIEWS["usage_v"] = """
SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'app_open' WHEN 'view' THEN 'channel_view' WHEN 'click' THEN 'search_submit'
    WHEN 'purchase' THEN 'channel_detail' WHEN 'error' THEN 'scan_request' END AS event_type,
  CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, 'channel' || ((event_id * 31) % n) AS username,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms
FROM events CROSS JOIN size_v"""

VIEWS["skip_v"] = f"""
SELECT username, {AS_OF} + to_days(CAST(channel_id % 5 - 2 AS INT)) AS expires_at FROM channels_v WHERE channel_id % 17 = 0"""

VIEWS["requests_v"] = """
SELECT o_orderkey AS request_id, 'channel' || (o_orderkey % (2 * n)) AS username, o_orderdate AS requested_at FROM orders CROSS JOIN size_v"""

VIEWS["favorites_v"] = """
SELECT o_custkey AS user_id, 'channel' || (o_orderkey % n) AS username, o_orderdate AS added_at, o_orderkey AS seq FROM orders CROSS JOIN size_v"""

VIEWS["comments_v"] = f"""
SELECT conv_id % n AS channel_id, conv_id * 100 + turn AS comment_id, conv_id * 20 AS user_id,
  {AS_OF} - to_hours(CAST(conv_id % 1000 AS INT)) - to_minutes(CAST(turn AS INT)) AS ts, text
FROM conversations CROSS JOIN size_v WHERE role = 'user'"""

VIEWS["rates_v"] = """
SELECT * FROM (VALUES ('CRYPTO', 800, 1500, 3000), ('FINANCE', 650, 1000, 1700), ('REAL_ESTATE', 500, 850, 1500), ('BUSINESS', 400, 650, 1200),
  ('TECH', 350, 600, 1000), ('AI_ML', 300, 500, 850), ('EDUCATION', 200, 350, 600), ('BEAUTY', 130, 230, 400), ('HEALTH', 130, 230, 400),
  ('TRAVEL', 170, 300, 500), ('RETAIL', 85, 150, 300), ('NEWS', 65, 170, 400), ('ENTERTAINMENT', 35, 85, 170), ('LIFESTYLE', 100, 200, 400),
  ('GAMBLING', 650, 1150, 1700), ('ADULT', 65, 130, 200), ('OTHER', 65, 130, 270)) AS t(category, low, mid, high)"""

VIEWS["cleaned_v"] = r"""
SELECT channel_id, post_id, row_number() OVER (PARTITION BY channel_id ORDER BY rn) AS slot,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), 't\.me/\S+', '', 'g'),
    '[\x{1F600}-\x{1F64F}]{3,}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean
FROM (SELECT * REPLACE (CASE WHEN channel_id % 4 = 1 AND post_id % 5 < 3 THEN text || chr(10) || chr(10) || 'Follow this channel for more: number ' || channel_id ELSE text END AS text) FROM newest_text_v) WHERE length(text) > 30"""

VIEWS["footers_v"] = r"""
SELECT channel_id, arg_min(line, first_at) AS footer, arg_min(posts, first_at) AS footer_posts FROM (
  SELECT channel_id, line, count(*) AS posts, min(slot * 1000 + i) AS first_at, max(texts) AS texts FROM (
    SELECT channel_id, slot, texts, i, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') AS line FROM (
      SELECT channel_id, slot, texts, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
        SELECT channel_id, slot, texts, string_split(CASE WHEN length(clean) > 200 THEN right(clean, 200) ELSE clean END, chr(10)) AS lines FROM (
          SELECT *, count(*) OVER (PARTITION BY channel_id) AS texts,
            count(*) FILTER (WHERE length(clean) > 50) OVER (PARTITION BY channel_id) AS endings FROM cleaned_v)
        WHERE length(clean) > 50 AND texts >= 5 AND endings >= 5)))
  WHERE length(line) > 10 GROUP BY 1, 2) WHERE posts >= texts * 0.4 GROUP BY 1"""

VIEWS["network_v"] = """
SELECT s.channel_id, count(*) FILTER (WHERE t.verdict = 'SCAM') AS scam,
  count(*) FILTER (WHERE t.status = 'BAD' AND t.verdict <> 'SCAM') AS bad
FROM (SELECT DISTINCT channel_id, username, link FROM ad_links_v) s
LEFT JOIN results_v t ON t.username = s.link AND t.username <> s.username AND t.status IN ('GOOD', 'BAD') GROUP BY 1"""

VIEWS["few_v"] = """
SELECT a.*, coalesce(ids, 0) AS ids, coalesce(pairs, 0) AS pairs FROM (
  SELECT channel_id, count(*) AS accounts, count(dc_id) AS with_dc, count(*) FILTER (WHERE dc_id IN (1, 3, 5)) AS foreign_dc,
    count(*) FILTER (WHERE is_premium) AS premium FROM audience_v WHERE user_id % 37 = 0 GROUP BY 1) a
LEFT JOIN (SELECT channel_id, count(*) AS ids, count(*) FILTER (WHERE gap <= 500) AS pairs FROM (
  SELECT channel_id, user_id - lag(user_id) OVER (PARTITION BY channel_id ORDER BY user_id) AS gap FROM audience_v WHERE user_id <> 0 AND user_id % 37 = 0)
  GROUP BY 1) USING (channel_id)"""

VIEWS["stored_v"] = """
SELECT r.*, ch % 23 <> 22 AS has_json, ch % 2 = 1 AS short, ch % 9 <> 0 AS has_forensics, ch % 6 <> 5 AND ch % 23 <> 22 AS has_llm,
  ((ch * 17) % 1300) / 10e0 AS cv, ((ch * 23) % 3400) / 10e0 AS re, ((ch * 11) % 250) / 10e0 AS rg, ((ch * 13) % 200) / 100e0 AS vd,
  ((ch * 31) % 170) / 10e0 AS fr, ((ch * 7) % 80) / 10e0 AS ac, ch % 16 AS cp, ((ch * 19) % 130) / 10e0 AS rr, ((ch * 9) % 1000) / 10e0 AS rs,
  CASE WHEN ch % 2 = 0 THEN ((ch * 3) % 100) / 100e0 END AS tc, (ch * 53) % 1200 AS ag,
  ['growing', 'stable', 'declining', 'dying', 'always_dead', 'insufficient_data'][ch % 6 + 1] AS es,
  CASE WHEN ch % 2 = 0 THEN (ch % 8) / 100e0 END AS pr, CASE WHEN ch % 2 = 0 THEN ch % 5 END AS pc, ch % 14 <> 7 AS has_premium,
  ((ch * 21) % 101) / 100e0 AS sd, CASE WHEN ch % 2 = 0 THEN ((ch * 2) % 10) / 10e0 END AS rp, ((ch * 41) % 101) / 100e0 AS pl,
  ((ch * 3) % 100 + 1) / 100e0 AS lt, ch % 4 <> 0 AS con, ch % 11 <> 0 AS ron,
  ((ch * 5) % 50) / 100e0 AS nr, (ch * 5) % 50 > 30 AS fatal, ((ch * 37) % 101) / 100e0 AS fo, (ch % 12) / 100e0 AS fp, ch % 6 AS fpc, 20 + ch % 80 AS fu,
  (ch * 7) % 101 AS lad, (ch * 13) % 101 AS lbot, (ch * 17) % 101 AS ltrust,
  CASE WHEN ch % 5 = 0 AND ch % 23 <> 22 THEN ch % 3 = 0 WHEN ch % 2 = 0 AND ch % 23 <> 22 THEN ch % 4 = 2 ELSE false END AS flag_verified,
  CASE WHEN ch % 3 <> 0 THEN (ch * 101) % 9000 END AS avg_views
FROM (SELECT *, channel_id AS ch FROM results_v) r"""

VIEWS["patched_v"] = """
SELECT username, CASE WHEN NOT has_json OR NOT has_premium THEN NULL WHEN has_forensics THEN fp ELSE pr END AS premium_ratio,
  CASE WHEN NOT has_json OR NOT has_premium THEN NULL WHEN has_forensics THEN fpc ELSE pc END AS premium_n FROM stored_v"""

VIEWS["trust_in_v"] = """
SELECT s.*, CASE WHEN has_forensics THEN nr ELSE 0e0 END AS i_nr, has_forensics AND fatal AS i_fatal, CASE WHEN has_forensics THEN fo ELSE 0e0 END AS i_fo,
  CASE WHEN has_forensics THEN fpc ELSE 0 END AS i_pc, CASE WHEN has_forensics THEN fu ELSE 0 END AS i_users,
  CASE WHEN has_json AND ch % 3 = 0 THEN 55 ELSE 0 END AS i_conv, CASE WHEN sd <> 0 THEN 1 - sd ELSE 0e0 END AS i_share,
  CASE WHEN has_json AND ch % 7 = 0 THEN pl ELSE 0e0 END AS i_private, CASE WHEN has_json AND ch % 11 = 0 THEN 2 ELSE 0 END AS i_scam, CASE WHEN has_json AND ch % 11 = 0 THEN 1 ELSE 0 END AS i_bad,
  CASE WHEN has_llm THEN lad ELSE 0 END AS i_ad, CASE WHEN has_llm THEN lbot ELSE 0 END AS i_bot
FROM stored_v s WHERE has_json"""

VIEWS["trust_row_v"] = """
SELECT * REPLACE (0 AS i_conv, CASE WHEN vd = 0 THEN 1e0 ELSE vd END AS vd, CASE WHEN sd = 0 THEN 0e0 ELSE 1 - sd END AS i_share, pl AS i_private,
  0 AS i_scam, 0 AS i_bad, ad_pct AS i_ad, bot_pct AS i_bot, comments_enabled AS con) FROM trust_in_v"""

_UNIFIED = """
SELECT username, CASE WHEN u1 = 0 THEN 0e0 WHEN penalties = '' THEN 1e0
    ELSE greatest(0.1e0, round_even(u1*u2*u3*u4*u5*u6*u7*u8*u9*u10*u11*u12*u13*u14*u15*u16*u17*u18*u19, 2)) END AS new_trust, penalties
FROM (SELECT *, concat_ws(',', CASE WHEN u1 < 1 THEN 'id_clustering' END, CASE WHEN u2 < 1 THEN 'geo_dc_mismatch' END, CASE WHEN u3 < 1 THEN 'premium_zero' END,
    CASE WHEN u4 < 1 THEN 'bot_penalty' END, CASE WHEN u5 < 1 THEN 'ad_penalty' END, CASE WHEN u6 < 1 THEN 'conviction' END, CASE WHEN u7 < 1 THEN 'hollow_views' END,
    CASE WHEN u8 < 1 THEN 'zombie_engagement' END, CASE WHEN u9 < 1 THEN 'satellite' END, CASE WHEN u10 < 0.6 THEN 'ghost_channel' WHEN u10 < 1 THEN 'zombie_audience' END,
    CASE WHEN u11 < 1 THEN 'member_discrepancy' END, CASE WHEN u12 < 1 THEN 'budget_cliff' END, CASE WHEN u13 < 1 THEN 'spam_posting' END,
    CASE WHEN u14 < 1 THEN 'private_links' END, CASE WHEN u15 < 1 THEN 'private_crypto_combo' END, CASE WHEN u16 < 1 THEN 'private_hidden_combo' END,
    CASE WHEN u17 < 1 THEN 'hidden_comments' END, CASE WHEN u18 < 1 THEN 'dying_engagement' END, CASE WHEN u19 < 1 THEN 'scam_network' END) AS penalties
FROM (SELECT username,
  CAST(CASE WHEN i_fatal OR i_nr > 0.3 THEN 0 WHEN i_nr > 0.15 THEN 0.5 ELSE 1 END AS DOUBLE) AS u1,
  CAST(CASE WHEN i_fo > 0.75 THEN 0.2 ELSE 1 END AS DOUBLE) AS u2, CAST(CASE WHEN i_users >= 10 AND i_pc = 0 THEN 0.8 ELSE 1 END AS DOUBLE) AS u3,
  CASE WHEN i_bot > 40 THEN greatest(0.3e0, 1e0 - (i_bot - 40) / 100e0) ELSE 1e0 END AS u4,
  CAST(CASE WHEN i_ad <= 20 THEN 1 WHEN i_ad <= 40 THEN 0.95 WHEN i_ad <= 60 THEN 0.85 WHEN i_ad <= 80 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS u5,
  CAST(CASE WHEN i_conv >= 70 THEN 0.3 WHEN i_conv >= 50 THEN 0.6 ELSE 1 END AS DOUBLE) AS u6,
  CAST(CASE WHEN re > 300 AND fr < 3 AND ac < 1 THEN 0.6 ELSE 1 END AS DOUBLE) AS u7, CAST(CASE WHEN re > 50 AND rr < 0.1 THEN 0.7 ELSE 1 END AS DOUBLE) AS u8,
  CAST(CASE WHEN i_share > 0.5 AND ac < 1 THEN 0.8 ELSE 1 END AS DOUBLE) AS u9,
  CAST(CASE WHEN online_count > 0 AND members > 20000 AND online_count * 100e0 / members < 0.1 THEN 0.5
       WHEN online_count > 0 AND members > 5000 AND online_count * 100e0 / members < 0.3 THEN 0.7 ELSE 1 END AS DOUBLE) AS u10,
  CAST(CASE WHEN abs(participants_count - members) * 1e0 / members > 0.1 THEN 0.8 ELSE 1 END AS DOUBLE) AS u11,
  CAST(CASE WHEN vd < 0.2 THEN 0.7 ELSE 1 END AS DOUBLE) AS u12,
  CAST(CASE WHEN rg > coalesce(spam_at, 20) THEN 0.55 WHEN rg > coalesce(heavy_at, 12) THEN 0.75 WHEN rg > coalesce(active_at, 6) THEN 0.9 ELSE 1 END AS DOUBLE) AS u13,
  CAST(CASE WHEN i_private >= 1 THEN 0.25 WHEN i_private > 0.8 THEN 0.35 WHEN i_private > 0.6 THEN 0.5 ELSE 1 END AS DOUBLE) AS u14,
  CAST(CASE WHEN category = 'CRYPTO' AND i_private > 0.4 THEN 0.45 ELSE 1 END AS DOUBLE) AS u15, CAST(CASE WHEN NOT con AND i_private > 0.5 THEN 0.4 ELSE 1 END AS DOUBLE) AS u16,
  CAST(CASE WHEN NOT con THEN 0.85 ELSE 1 END AS DOUBLE) AS u17, CAST(CASE WHEN es <> 'dying' THEN 1 WHEN vd BETWEEN 0.7 AND 1.3 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS u18,
  CASE WHEN i_scam + i_bad = 0 THEN 1e0 ELSE round_even(power(0.9e0, i_scam) * power(0.95e0, i_bad), 2) END AS u19
FROM {source} LEFT JOIN tiers_v USING (category)))"""
VIEWS["unified_v"] = _UNIFIED.format(source="trust_in_v")
VIEWS["unified_row_v"] = _UNIFIED.format(source="trust_row_v")

_RAW = """
SELECT username, has_json, q AS quality_points, e AS engagement_points, p AS reputation_points, least(100, q + e + p) AS stored_raw FROM (
  SELECT username, has_json, CASE WHEN has_json THEN q1 + q2 + q3 + q4 ELSE 0 END AS q, CASE WHEN has_json THEN e1 + e2 + e3 + e4 ELSE 0 END AS e,
    CASE WHEN has_json THEN p1 + p2 + p3 ELSE 0 END AS p FROM (
  SELECT *,
    CASE WHEN cv < 10 THEN 0 WHEN cv < 30 THEN 8 WHEN cv < 60 THEN 12 WHEN cv < 100 THEN 6 WHEN fr > 3 THEN 6 ELSE 0 END AS q1,
    CASE WHEN re > (CASE WHEN members < 200 THEN 200 WHEN members < 1000 THEN 150 WHEN members < 5000 THEN 130 ELSE 120 END) THEN 0
      WHEN re > (CASE WHEN members < 200 THEN 150 WHEN members < 1000 THEN 100 WHEN members < 5000 THEN 80 ELSE 60 END) THEN 4
      WHEN re < 5 THEN 0 WHEN re < 10 THEN 3 WHEN re < 20 THEN 5 WHEN re < 50 THEN 6 ELSE 8 END AS q2,
    CASE WHEN lvl = 0 THEN 0 ELSE (CASE WHEN con AND ron THEN [2, 4, 9, 12, 15] WHEN con THEN [3, 5, 11, 14, 18] WHEN ron THEN [4, 8, 15, 20, 25] ELSE [6, 11, 23, 30, 38] END)[lvl] END AS q3,
    CASE WHEN rg < 0.14 THEN 0 WHEN rg < 0.5 THEN 3 WHEN rg < 1 THEN 5 WHEN rg <= 5 THEN 7 WHEN rg <= 10 THEN 5 WHEN rg <= 20 THEN 3 ELSE 1 END AS q4,
    cp AS e1,
    CASE WHEN NOT ron THEN 0 ELSE (CASE WHEN con THEN [0, 2, 2, 4, 6, 8] ELSE [0, 4, 3, 6, 10, 13] END)[
      CASE WHEN rr > (CASE WHEN members < 200 THEN 20 WHEN members < 1000 THEN 12 ELSE 10 END) THEN 1
           WHEN rr > (CASE WHEN members < 200 THEN 15 WHEN members < 1000 THEN 8 ELSE 5 END) THEN 2
           WHEN rr < 0.3 THEN 3 WHEN rr < 1 THEN 4 WHEN rr < 3 THEN 5 ELSE 6 END] END AS e2,
    CASE WHEN coalesce(tc, 0.2) > 0.6 THEN 1 WHEN rs < 15 THEN 1 WHEN rs > 80 THEN 2 WHEN coalesce(tc, 0.2) < 0.4 THEN 5 ELSE 3 END AS e3,
    CASE es WHEN 'insufficient_data' THEN 5 WHEN 'growing' THEN 10 WHEN 'stable' THEN 7 WHEN 'declining' THEN 3 ELSE 0 END AS e4,
    CASE WHEN ag < 90 THEN 0 WHEN ag < 180 THEN 1 WHEN ag < 365 THEN 2 WHEN ag < 730 THEN 4 ELSE 7 END AS p1,
    CASE WHEN coalesce(pn, 0) = 0 THEN 0 WHEN px > 0.05 THEN 7 WHEN px > 0.02 THEN 4 WHEN px > 0.01 THEN 3 ELSE 1 END AS p2,
    CASE WHEN coalesce(rp, 0) < 0.1 THEN 6 WHEN 1 - sd > 0.7 THEN 0 WHEN 1 - sd > 0.5 THEN 2 ELSE 6 END AS p3
  FROM (SELECT s.*, {premium},
      CASE WHEN fr > 15 THEN 0 WHEN fr >= (CASE WHEN members > 50000 THEN 1.5 WHEN members > 5000 THEN 2.0 ELSE 3.0 END) THEN 5
        WHEN fr >= (CASE WHEN members > 50000 THEN 0.7 WHEN members > 5000 THEN 1.0 ELSE 1.5 END) THEN 4
        WHEN fr >= (CASE WHEN members > 50000 THEN 0.3 ELSE 0.5 END) THEN 3
        WHEN fr >= (CASE WHEN members > 50000 THEN 0.1 WHEN members > 5000 THEN 0.2 ELSE 0.1 END) THEN 2
        WHEN fr >= 0.05 THEN 1 ELSE 0 END AS lvl FROM stored_v s {join})))"""
VIEWS["raw_v"] = _RAW.format(premium="CASE WHEN has_premium THEN pc END AS pn, pr AS px", join="")
VIEWS["raw_patched_v"] = _RAW.format(premium="premium_n AS pn, premium_ratio AS px", join="JOIN patched_v USING (username)")

VIEWS["stored_trust_v"] = """
SELECT username, greatest(0.1e0, round_even(CASE WHEN ch % 4 = 0 THEN 0.85e0 ELSE 1e0 END * CASE WHEN ch % 3 = 0 THEN 0.6e0 ELSE 1e0 END
  * CASE WHEN ch % 7 = 0 THEN 0.5e0 ELSE 1e0 END * CASE WHEN ch % 11 = 0 THEN 0.81e0 ELSE 1e0 END * CASE WHEN has_llm THEN lt ELSE 1e0 END, 2)) AS stored_trust
FROM stored_v WHERE has_json"""

VIEWS["penalties_v"] = """
SELECT username, name, m FROM (
  SELECT username, 'hidden_comments' AS name, 0.85e0 AS m FROM stored_v WHERE has_json AND ch % 4 = 0
  UNION ALL SELECT username, 'conviction', 0.6e0 FROM stored_v WHERE has_json AND ch % 3 = 0
  UNION ALL SELECT username, 'private_links', 0.5e0 FROM stored_v WHERE has_json AND ch % 7 = 0
  UNION ALL SELECT username, 'scam_network', 0.81e0 FROM stored_v WHERE has_json AND ch % 11 = 0
  UNION ALL SELECT username, 'bots_in_comments', 0.8e0 FROM stored_v WHERE has_llm AND lbot > 40
  UNION ALL SELECT username, 'ad_load', 0.9e0 FROM stored_v WHERE has_llm AND lad > 30
  UNION ALL SELECT username, CASE WHEN trust_factor <= 0.3 THEN 'critical_risk' WHEN trust_factor <= 0.5 THEN 'high_risk' WHEN trust_factor <= 0.7 THEN 'medium_risk'
      WHEN trust_factor < 0.9 THEN 'slight_risk' ELSE 'minimal_risk' END, trust_factor FROM stored_v
    WHERE trust_factor < 1 AND NOT (has_json AND (ch % 4 = 0 OR ch % 3 = 0 OR ch % 7 = 0 OR ch % 11 = 0)) AND NOT (has_llm AND (lbot > 40 OR lad > 30)))"""

VIEWS["estimate_v"] = """
SELECT username, category, metric, CASE WHEN last THEN least(total - spent, top) ELSE least(pts, top) END AS score, top AS max, total AS category_score
FROM (SELECT *, CAST(trunc(top * share) AS INT) AS pts, CAST(trunc(cat_max * share) AS INT) AS total, metric IN ('regularity', 'reaction_stability', 'source_diversity') AS last,
    CAST(sum(CASE WHEN metric IN ('regularity', 'reaction_stability', 'source_diversity') THEN 0 ELSE CAST(trunc(top * share) AS INT) END)
         OVER (PARTITION BY username, x.category) AS INT) AS spent
  FROM (SELECT username, least(100e0, CASE WHEN trust_factor > 0 THEN score / trust_factor ELSE score END) / 100 AS share FROM results_v)
  CROSS JOIN (VALUES ('quality', 'forward_rate', 15, 42), ('quality', 'cv_views', 12, 42), ('quality', 'reach', 8, 42), ('quality', 'regularity', 7, 42),
    ('engagement', 'comments', 15, 38), ('engagement', 'er_trend', 10, 38), ('engagement', 'reaction_rate', 8, 38), ('engagement', 'reaction_stability', 5, 38),
    ('reputation', 'age', 7, 20), ('reputation', 'premium', 7, 20), ('reputation', 'source_diversity', 6, 20)) AS x(category, metric, top, cat_max))"""

VIEWS["totals_shown_v"] = """
SELECT s.username, CASE WHEN has_json THEN ch % 43 ELSE q END AS quality_total, CASE WHEN has_json THEN ch % 39 ELSE e END AS engagement_total,
  CASE WHEN has_json THEN ch % 21 ELSE r END AS reputation_total
FROM stored_v s JOIN (SELECT username, max(category_score) FILTER (WHERE category = 'quality') AS q, max(category_score) FILTER (WHERE category = 'engagement') AS e,
  max(category_score) FILTER (WHERE category = 'reputation') AS r FROM estimate_v GROUP BY 1) USING (username)"""

VIEWS["recommend_v"] = """
SELECT username, list_filter([
    CASE WHEN strong <> '' THEN 'strong:' || strong END, CASE WHEN verdict NOT IN ('EXCELLENT', 'GOOD') AND weak <> '' THEN 'weak:' || weak END,
    CASE WHEN category IN ('CRYPTO', 'FINANCE', 'REAL_ESTATE', 'BUSINESS') THEN 'premium_segment' WHEN category IN ('TECH', 'AI_ML') THEN 'tech_segment' END,
    CASE WHEN verdict = 'EXCELLENT' AND trust_factor >= 0.9 THEN 'ready' WHEN verdict = 'GOOD' AND trust_factor >= 0.8 THEN 'good_choice'
         WHEN verdict IN ('HIGH_RISK', 'SCAM') THEN 'high_risk' END,
    CASE WHEN members > 100000 AND verdict IN ('EXCELLENT', 'GOOD') THEN 'large_channel' WHEN members < 5000 AND score >= 70 THEN 'small_and_good' END],
  lambda x: x IS NOT NULL)[1:4] AS codes
FROM (SELECT s.*, concat_ws('+', CASE WHEN quality_total * 100e0 / 42 >= 70 THEN 'quality' END, CASE WHEN engagement_total * 100e0 / 38 >= 70 THEN 'engagement' END,
    CASE WHEN reputation_total * 100e0 / 20 >= 80 THEN 'reputation' END, CASE WHEN trust_factor >= 0.9 THEN 'trust' END) AS strong,
  concat_ws('+', CASE WHEN quality_total * 100e0 / 42 < 50 THEN 'quality' END, CASE WHEN engagement_total * 100e0 / 38 < 50 THEN 'engagement' END,
    CASE WHEN reputation_total * 100e0 / 20 < 50 THEN 'reputation' END, CASE WHEN trust_factor < 0.7 THEN 'trust' END) AS weak
  FROM stored_v s JOIN totals_shown_v USING (username))"""

VIEWS["cpm_v"] = """
SELECT username, low, mid, high, CAST(trunc(CASE WHEN e >= 80 THEN high WHEN e >= 70 THEN mid + (high - mid) * (0.5e0 + (e - 70) / 10 * 0.5e0)
   WHEN e >= 55 THEN mid * (0.8e0 + (e - 55) / 15 * 0.2e0) WHEN e >= 40 THEN low + (mid - low) * ((e - 40) / 15) * 0.5e0
   ELSE low * greatest(0.3e0, e / 40) END) AS INT) AS cpm
FROM (SELECT username, score * trust_factor AS e, coalesce(x.low, 65) AS low, coalesce(x.mid, 130) AS mid, coalesce(x.high, 270) AS high
      FROM results_v r LEFT JOIN rates_v x ON x.category = r.category)"""

VIEWS["views_v"] = """
SELECT s.username, CAST(greatest(100, trunc(members * (CASE WHEN has_json THEN least(50e0, greatest(1e0, re)) WHEN pts > 0 THEN pts * 1e0 / 8 * 20 ELSE 10e0 END / 100)
   * (0.7e0 + score / 100e0 * 0.6e0))) AS BIGINT) AS guessed,
  CAST(greatest(100, trunc(members * (CASE WHEN pts > 0 THEN pts * 1e0 / 8 * 20 ELSE 10e0 END / 100) * (0.7e0 + score / 100e0 * 0.6e0))) AS BIGINT) AS listed,
  avg_views
FROM stored_v s JOIN (SELECT username, score AS pts FROM estimate_v WHERE metric = 'reach') USING (username)"""

VIEWS["price_v"] = """
SELECT username, cpm, low, high, v, vl, CAST(greatest(100, trunc(c * 0.9e0)) AS BIGINT) AS price_min, CAST(greatest(200, trunc(c * 1.1e0)) AS BIGINT) AS price_max,
  CAST(greatest(100, trunc(cl * 0.9e0)) AS BIGINT) AS list_min, CAST(greatest(200, trunc(cl * 1.1e0)) AS BIGINT) AS list_max
FROM (SELECT *, trunc(v / 1000e0 * cpm) AS c, trunc(vl / 1000e0 * cpm) AS cl FROM (
  SELECT username, cpm, low, high, CASE WHEN avg_views > 0 THEN avg_views ELSE guessed END AS v, listed AS vl FROM views_v JOIN cpm_v USING (username)))"""

VIEWS["backfill_in_v"] = """
SELECT t.* REPLACE (f.neighbour_ratio AS i_nr, f.clustered AS i_fatal, f.foreign_ratio AS i_fo, f.premium_count AS i_pc, f.accounts AS i_users, 0 AS i_ad, 0 AS i_bot)
FROM trust_all_v t JOIN forensics_v f USING (channel_id) WHERE f.complete AND t.status <> 'WAITING' AND t.ch % 9 = 0"""
VIEWS["trust_all_v"] = VIEWS["trust_in_v"].replace("FROM stored_v s WHERE has_json", "FROM stored_full_v s")
VIEWS["stored_full_v"] = """
SELECT * REPLACE (CASE WHEN has_json THEN re ELSE 0e0 END AS re, CASE WHEN has_json THEN fr ELSE 0e0 END AS fr, CASE WHEN has_json THEN rr ELSE 0e0 END AS rr,
  CASE WHEN has_json THEN vd ELSE 1e0 END AS vd, CASE WHEN has_json THEN ac ELSE 0e0 END AS ac, CASE WHEN has_json THEN sd ELSE 0e0 END AS sd, CASE WHEN has_json THEN rg ELSE 0e0 END AS rg,
  CASE WHEN has_json THEN es ELSE 'insufficient_data' END AS es, NOT has_json OR con AS con) FROM stored_v"""
VIEWS["unified_fill_v"] = _UNIFIED.format(source="backfill_in_v")
VIEWS["backfilled_v"] = "SELECT username, i_users AS users_analyzed, i_nr, new_trust FROM backfill_in_v JOIN unified_fill_v USING (username)"
VIEWS["links_out_v"] = r"""
SELECT DISTINCT channel_id, username, link FROM (
  SELECT channel_id, 'channel' || channel_id AS username, 'channel' || (source_id % n) AS link FROM newest_v WHERE source_id IS NOT NULL
  UNION ALL
  SELECT channel_id, 'channel' || channel_id, link FROM (
    SELECT channel_id, unnest(regexp_extract_all(lower(text), 't\.me/([a-zA-Z0-9_]{5,32})', 1)) AS link, false AS mention FROM newest_text_v
    UNION ALL SELECT channel_id, unnest(regexp_extract_all(lower(text), 'telegram\.me/([a-zA-Z0-9_]{5,32})', 1)), false FROM newest_text_v
    UNION ALL SELECT channel_id, unnest(regexp_extract_all(lower(text), '@([a-zA-Z0-9_]{5,32})', 1)), true FROM newest_text_v)
  WHERE NOT (mention AND link LIKE '%bot') AND link NOT IN (STOP_NAMES))
WHERE link <> username"""

VIEWS["links_out_v"] = VIEWS["links_out_v"].replace("STOP_NAMES", ", ".join(f"'{w}'" for w in STOP_NAMES))

VIEWS["texts_v"] = "SELECT p.post_id, p.channel_id, d.text || p.suffix AS text FROM posts_v p JOIN documents d ON d.doc_id = p.doc_id"
