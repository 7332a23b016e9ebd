"""Oracle SQL of predicates, joins, top-k and set operations."""

SQL: dict[str, str] = {}

SQL["FLT-01"] = "SELECT channel_id, 'channel' || channel_id AS username FROM channels_v"
SQL["FLT-02"] = """SELECT name, regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_]{4,31}') AS valid FROM (
  SELECT c_name AS name FROM customer UNION ALL SELECT replace(c_name, '#', '_') FROM customer UNION ALL SELECT c_mktsegment FROM customer)"""
_shown = "status IN ('GOOD', 'BAD')"
SQL["FLT-03"] = f"""SELECT username, score, members, trust_factor FROM results_v WHERE {_shown} AND score BETWEEN 20 AND 90
  AND members BETWEEN 500 AND 50000 AND trust_factor >= 0.3"""
SQL["FLT-04"] = f"SELECT username, verdict FROM results_v WHERE {_shown} AND verdict IN ('EXCELLENT', 'GOOD')"
SQL["FLT-05"] = f"""SELECT username, category, category_secondary FROM results_v WHERE {_shown}
  AND (category IN ('NEWS', 'TECH') OR category_secondary IN ('NEWS', 'TECH'))"""
SQL["FLT-06"] = f"SELECT username, ad_status FROM results_v WHERE {_shown} AND ad_status IN (0, 2)"
SQL["FLT-07"] = f"""SELECT count(*) AS channels FROM results_v WHERE {_shown} AND score BETWEEN 40 AND 100 AND members >= 200
  AND verdict IN ('EXCELLENT', 'GOOD') AND (category IN ('NEWS', 'CRYPTO') OR category_secondary IN ('NEWS', 'CRYPTO')) AND ad_status IN (1, 2)"""
SQL["FLT-08"] = """SELECT username, score FROM results_v WHERE status = 'GOOD' AND (category IS NULL OR category = '')
  ORDER BY score DESC, username LIMIT 20"""
SQL["FLT-09"] = """SELECT username FROM results_v WHERE status IN ('GOOD', 'BAD') AND NOT EXISTS (
  SELECT 1 FROM newest_text_v p WHERE p.channel_id = results_v.channel_id AND length(p.text) > 0 AND p.channel_id % 7 <> 3)"""
SQL["FLT-09b"] = """SELECT username FROM results_v WHERE status IN ('GOOD', 'BAD') AND NOT EXISTS (
  SELECT 1 FROM newest_text_v p WHERE p.channel_id = results_v.channel_id AND length(p.text) > 0)"""
SQL["FLT-10"] = """SELECT username, status FROM results_v WHERE status <> 'WAITING'
  AND channel_id IN (SELECT channel_id FROM newest_text_v WHERE length(text) > 0)"""
SQL["FLT-11"] = "SELECT username FROM results_v WHERE status <> 'WAITING' AND channel_id % 9 = 0"
SQL["FLT-12"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) FILTER (WHERE length(CAST({c} AS VARCHAR)) > 0) AS filled FROM results_v"
    for c in ("category", "category_secondary", "description", "ad_status", "title")
)
SQL["FLT-13"] = """SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INT) AS number, -1 AS fallback,
  CAST(left(o_orderpriority, 1) AS DOUBLE) + 0.5 AS decimal, 1e0 AS neutral FROM orders"""
SQL["FLT-14"] = "SELECT channel_id, CASE WHEN coalesce(category, '') = '' THEN 'OTHER' ELSE category END AS category FROM channels_v"
SQL["FLT-15"] = "SELECT username, flag_verified AS is_verified FROM stored_v"
SQL["FLT-16"] = "SELECT channel_id, members FROM channels_v WHERE members >= 200"
SQL["FLT-17"] = """SELECT channel_id, post_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts, post_id) AS age_rank
  FROM newest_v WHERE views > 0"""
SQL["FLT-18"] = """
SELECT channel_id, 'post' AS kind, slot, md5(body) AS body_md5 FROM (
  SELECT channel_id, slot, CASE WHEN footer IS NOT NULL AND instr(clean, footer) > 1
      THEN regexp_replace(substring(clean, 1, instr(clean, footer) - 1), '^\\s+|\\s+$', '', 'g') ELSE clean END AS body
  FROM cleaned_v LEFT JOIN footers_v USING (channel_id)) WHERE length(body) > 30
UNION ALL
SELECT channel_id, 'comment', slot, md5(body) FROM (
  SELECT channel_id, slot, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'),
    't\\.me/\\S+', '', 'g'), '[\\x{1F600}-\\x{1F64F}]{3,}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY comment_id) AS slot FROM comments_v))
WHERE length(body) > 5"""
SQL["JOIN-01"] = "SELECT post_id, source_id, CASE WHEN source_id - 1000 < n THEN 'channel' || (source_id - 1000) END AS source_username FROM posts_v"
SQL["JOIN-02"] = """
SELECT c.channel_id, comment_id, coalesce(a.is_premium, false) AS is_premium FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY comment_id) AS slot FROM comments_v) c
LEFT JOIN audience_v a ON a.channel_id = c.channel_id AND a.user_id = c.user_id WHERE length(text) > 0"""
SQL["JOIN-03"] = """
SELECT channel_id, count(*) AS accounts, count(*) FILTER (WHERE extra) AS supplements FROM (
  SELECT channel_id, user_id, false AS extra FROM audience_v WHERE user_id % 37 = 0
  UNION ALL
  SELECT a.channel_id, a.user_id, true FROM audience_v a
  WHERE (SELECT count(*) FROM audience_v s WHERE s.channel_id = a.channel_id AND s.user_id % 37 = 0) < 10
    AND a.user_id % 37 <> 0 AND EXISTS (SELECT 1 FROM comments_v c WHERE c.channel_id = a.channel_id AND c.user_id = a.user_id)) GROUP BY 1"""
SQL["JOIN-03b"] = """SELECT channel_id, count(*) AS accounts, 0 AS supplements FROM audience_v GROUP BY 1"""
SQL["JOIN-04"] = """SELECT DISTINCT username, 'user_request' AS found_via FROM requests_v WHERE username NOT IN (SELECT username FROM results_v)"""
SQL["JOIN-05"] = """SELECT username, status, CASE WHEN status = 'WAITING' AND username IN (SELECT username FROM requests_v) THEN 'user_request' ELSE found_via END AS found_via FROM results_v"""
SQL["JOIN-06"] = "SELECT username FROM channels_v WHERE username NOT IN (SELECT username FROM skip_v WHERE expires_at > TIMESTAMP '2024-01-31 00:00:00')"
SQL["JOIN-07"] = """
SELECT username, epoch(expires_at)::BIGINT AS expires_at FROM (
  SELECT username, TIMESTAMP '2024-02-07 00:00:00' AS expires_at FROM channels_v WHERE channel_id % 34 = 0
  UNION ALL SELECT username, expires_at FROM skip_v WHERE username NOT IN (SELECT username FROM channels_v WHERE channel_id % 34 = 0))
WHERE expires_at > TIMESTAMP '2024-01-31 00:00:00'"""
SQL["JOIN-08"] = """
SELECT username, CASE WHEN w THEN 'GOOD' ELSE status END AS status, CASE WHEN w THEN least(100, score + 7) ELSE score END AS score,
  CASE WHEN w AND channel_id % 2 = 0 THEN 'TECH' ELSE category END AS category, w AS written
FROM (SELECT *, status = 'WAITING' AND channel_id % 3 <> 0 AS w FROM results_v)"""
SQL["JOIN-08b"] = SQL["JOIN-08"]
SQL["JOIN-09"] = "SELECT channel_id, scam AS scam_count, bad AS bad_count FROM network_v"
SQL["JOIN-10"] = """
SELECT link AS username, min(username) AS found_via FROM links_out_v JOIN results_v USING (channel_id, username)
WHERE status = 'GOOD' AND score >= 72 AND channel_id % 3 <> 1
  AND link NOT IN (SELECT username FROM results_v WHERE channel_id % 3 <> 1) GROUP BY 1"""
SQL["JOIN-10b"] = """
SELECT username, min(hop) AS hop FROM (
  SELECT 'channel1' AS username, 0 AS hop WHERE EXISTS (SELECT 1 FROM results_v WHERE channel_id = 1)
  UNION ALL SELECT link, 1 FROM ad_links_v WHERE username = 'channel1'
  UNION ALL SELECT b.link, 2 FROM ad_links_v a JOIN ad_links_v b ON b.username = a.link WHERE a.username = 'channel1'
  UNION ALL SELECT c.link, 3 FROM ad_links_v a JOIN ad_links_v b ON b.username = a.link JOIN ad_links_v c ON c.username = b.link WHERE a.username = 'channel1')
GROUP BY 1"""
SQL["JOIN-10c"] = """
SELECT link AS username, min(username) AS found_via FROM links_out_v JOIN results_v USING (channel_id, username)
WHERE status = 'GOOD' AND score >= 72 AND link NOT IN (SELECT username FROM results_v) GROUP BY 1"""
SQL["JOIN-10d"] = """
SELECT username, hop FROM (
  WITH RECURSIVE reached(username, hop) USING KEY (username) AS (
    SELECT DISTINCT username, 0 FROM results_v WHERE status = 'GOOD'
    UNION
    SELECT l.link, min(r.hop) + 1 FROM reached r JOIN ad_links_v l ON l.username = r.username
    WHERE l.link NOT IN (SELECT username FROM recurring.reached) GROUP BY 1)
  SELECT username, hop FROM reached)"""
SQL["JOIN-11"] = """
SELECT channel_id, coalesce(r.category, 'OTHER') AS price_category, coalesce(r.low, 65) AS cpm_low, coalesce(r.mid, 130) AS cpm_avg, coalesce(r.high, 270) AS cpm_high,
  coalesce(active_at, 6) AS active_at, coalesce(heavy_at, 12) AS heavy_at, coalesce(spam_at, 20) AS spam_at
FROM channels_v c LEFT JOIN rates_v r ON r.category = c.category LEFT JOIN tiers_v t ON t.category = c.category"""
SQL["JOIN-12"] = """SELECT channel_id, CASE WHEN members < 200 THEN 250 WHEN members < 1000 THEN 180 WHEN members < 5000 THEN 150 ELSE 130 END AS reach_limit,
  CAST(CASE WHEN members < 200 THEN 0.8 WHEN members < 1000 THEN 0.5 WHEN members < 5000 THEN 0.3 ELSE 0.15 END AS DOUBLE) AS expected_reach FROM channels_v"""
SQL["JOIN-13"] = """
SELECT key, turn IS NOT NULL AS hit, turn FROM (SELECT DISTINCT conv_id AS key FROM conversations)
LEFT JOIN (SELECT key, min(turn) AS turn FROM llm_v WHERE cached_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1) USING (key)"""
SQL["JOIN-14"] = """
SELECT username, CASE WHEN NOT regexp_full_match(username, '[a-zA-Z][a-zA-Z0-9_]{4,31}') THEN 'invalid' WHEN status IN ('GOOD', 'BAD') AND score > 0 THEN 'scored'
    WHEN pos IS NOT NULL THEN 'queued' ELSE 'new' END AS answer,
  pos AS queue_position
FROM (SELECT DISTINCT username FROM requests_v) LEFT JOIN results_v USING (username)
LEFT JOIN (SELECT username, row_number() OVER (ORDER BY created_at, username) AS pos FROM results_v WHERE status = 'WAITING') USING (username)"""
SQL["JOIN-15"] = "SELECT username, premium_ratio AS ratio, premium_n AS count FROM patched_v"
SQL["TOP-01"] = f"""
SELECT username, members, (SELECT count(*) FROM results_v WHERE {_shown}) AS total, (SELECT count(*) FROM results_v WHERE {_shown}) > 30 AS has_more
FROM results_v WHERE {_shown} ORDER BY members DESC, username LIMIT 15 OFFSET 15"""
SQL["TOP-01b"] = f"""SELECT username, score FROM results_v WHERE {_shown} AND (score < 60 OR (score = 60 AND username > 'channel9'))
  ORDER BY score DESC, username LIMIT 15"""
SQL["TOP-01c"] = f"""
SELECT username, members, (SELECT count(*) FROM results_v WHERE {_shown}) AS total, (SELECT count(*) FROM results_v WHERE {_shown}) > 45 AS has_more
FROM results_v WHERE {_shown} ORDER BY members DESC, username LIMIT 15 OFFSET 30"""
SQL["TOP-01d"] = """
SELECT c_name AS username, CAST(floor(c_acctbal) AS BIGINT) AS score, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer) > 100 AS has_more
FROM customer ORDER BY floor(c_acctbal) NULLS FIRST, c_name LIMIT 20 OFFSET 80"""
SQL["TOP-02"] = """SELECT username, found_via FROM results_v WHERE status = 'WAITING'
  ORDER BY CASE WHEN found_via = 'user_request' THEN 0 ELSE 1 END, created_at, username LIMIT 10"""
SQL["TOP-03"] = "SELECT username FROM results_v WHERE status = 'WAITING' ORDER BY created_at, username LIMIT 5"
SQL["TOP-04"] = """SELECT username, count(*) AS events FROM usage_v WHERE event_type IN ('scan_request', 'channel_view')
  AND ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
SQL["TOP-05"] = """
SELECT username, string_agg(name || ':' || printf('%.2f', m), ',' ORDER BY m, name) AS penalties FROM penalties_v GROUP BY 1
UNION ALL SELECT username, '' FROM results_v WHERE username NOT IN (SELECT username FROM penalties_v)"""
SQL["TOP-06"] = """
SELECT channel_id, position, user_id, concat_ws(',', CASE WHEN is_scam THEN 'scam' END, CASE WHEN is_fake THEN 'fake' END,
  CASE WHEN is_restricted THEN 'restricted' END, CASE WHEN is_deleted THEN 'deleted' END, CASE WHEN is_bot THEN 'bot' END) AS flags
FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY user_id) AS position FROM audience_v
      WHERE is_scam OR is_fake OR is_restricted OR is_deleted OR is_bot) WHERE position <= 10"""
SQL["TOP-07"] = "SELECT username, CAST(len(codes) AS INT) AS n, array_to_string(codes, ',') AS codes FROM recommend_v"
SQL["TOP-08"] = "SELECT request_id, username FROM requests_v ORDER BY requested_at DESC, request_id DESC LIMIT 25"
SQL["TOP-09"] = """SELECT coalesce(category, 'UNCATEGORIZED') AS category, count(*) AS channels FROM results_v WHERE status = 'GOOD'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
SQL["SET-01"] = "SELECT channel_id, link FROM links_out_v"
SQL["SET-02"] = r"""SELECT DISTINCT channel_id, unnest(regexp_extract_all(text, 't\.me/(?:\+|joinchat/)([a-zA-Z0-9_-]+)', 1, 'i')) AS code FROM newest_text_v"""
SQL["SET-03"] = """
SELECT DISTINCT username, '[seed]' AS found_via FROM (SELECT username FROM channels_v UNION ALL SELECT username FROM requests_v)
WHERE username NOT IN (SELECT username FROM results_v WHERE channel_id % 2 = 0)"""
SQL["SET-03b"] = """
SELECT DISTINCT username, '[seed]' AS found_via FROM (SELECT username FROM channels_v UNION ALL SELECT username FROM requests_v)
WHERE username NOT IN (SELECT username FROM results_v)"""
SQL["SET-04"] = """
SELECT 'results' AS side, username, count(*) AS rows FROM results_v WHERE NOT (status = 'WAITING' AND username IN (SELECT username FROM skip_v)) GROUP BY 2
UNION ALL SELECT 'favorites', username, count(DISTINCT user_id) FROM favorites_v WHERE username NOT IN (SELECT username FROM skip_v) GROUP BY 2"""
