"""Oracle SQL of text functions and model answers."""

from trustlens.functions.text import STOP_NAMES, TYPE_KEYWORDS

SQL: dict[str, str] = {}

_clean = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\S+', '', 'g'), 't\.me/\S+', '', 'g'), "
    r"'[\x{{1F600}}-\x{{1F64F}}]{{3,}}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
)
SQL["TXT-01"] = f"SELECT post_id, md5({_clean.format('d.text || p.suffix')}) AS clean_md5 FROM posts_v p JOIN documents d ON d.doc_id = p.doc_id"
_stop = ", ".join(f"'{w}'" for w in STOP_NAMES)
SQL["TXT-02"] = rf"""
SELECT post_id, coalesce(links, '') AS links FROM posts_v LEFT JOIN (
  SELECT post_id, string_agg(name, ',' ORDER BY name) AS links FROM (
    SELECT DISTINCT post_id, name FROM (
      SELECT post_id, channel_id, unnest(regexp_extract_all(lower(text), 't\.me/([a-zA-Z0-9_]{{5,32}})', 1)) AS name, false AS mention FROM texts_v
      UNION ALL SELECT post_id, channel_id, unnest(regexp_extract_all(lower(text), 'telegram\.me/([a-zA-Z0-9_]{{5,32}})', 1)), false FROM texts_v
      UNION ALL SELECT post_id, channel_id, unnest(regexp_extract_all(lower(text), '@([a-zA-Z0-9_]{{5,32}})', 1)), true FROM texts_v)
    WHERE name <> 'channel' || channel_id AND name NOT IN ({_stop}) AND NOT (mention AND name LIKE '%bot')) GROUP BY 1) USING (post_id)"""
SQL["TXT-03"] = """
SELECT username AS name, CASE channel_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS ad_status FROM channels_v
UNION ALL SELECT c_name, [2, 0, 1, 2, 1, 0, 0, 0, 0, 2][c_custkey % 10 + 1] FROM customer"""
SQL["TXT-04"] = """SELECT username, CASE ad_status WHEN 2 THEN 'sells' WHEN 1 THEN 'possible' WHEN 0 THEN 'closed' ELSE 'unknown' END AS label FROM results_v"""
SQL["TXT-05"] = """
SELECT username, 0 AS place, '@manager' || channel_id AS contact, 'telegram' AS type, 30 AS confidence FROM channels_v WHERE channel_id % 6 = 1
UNION ALL SELECT username, 0, 't.me/owner' || channel_id, 'telegram_link', 25 FROM channels_v WHERE channel_id % 6 = 3
UNION ALL SELECT username, 0, '@adbot' || channel_id || 'bot', 'bot', 80 FROM channels_v WHERE channel_id % 6 = 4"""
SQL["TXT-06"] = r"""
SELECT channel_id, post_id, md5(CASE WHEN instr(clean, footer) > 1 THEN regexp_replace(substring(clean, 1, instr(clean, footer) - 1), '^\s+|\s+$', '', 'g') ELSE clean END) AS body_md5
FROM cleaned_v JOIN footers_v USING (channel_id)"""
SQL["TXT-07"] = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ['TECH', 'NEWS', NULL][conv_id % 3 + 1] WHEN 1 THEN ['CRYPTO', 'FINANCE', 'TRAVEL'][conv_id % 3 + 1]
  WHEN 2 THEN 'TECH' ELSE 'ADULT' END AS category FROM conversations"""
SQL["TXT-08"] = "SELECT channel_id, coalesce(category, 'OTHER') AS category, category_secondary FROM channels_v"
_mask = []
for _name, _words in TYPE_KEYWORDS.items():
    _hits = " + ".join(f"CAST(contains(blob, '{w}') AS INT)" for w in _words)
    _mask.append(f"{_hits} AS {_name.lower()}_hits")
SQL["TXT-09"] = f"""
SELECT channel_id, CASE WHEN category IN ('TECH', 'AI_ML', 'EDUCATION') THEN 'TECH' WHEN category = 'CRYPTO' THEN 'CRYPTO' WHEN category = 'NEWS' THEN 'NEWS'
    WHEN category IN ('ENTERTAINMENT', 'LIFESTYLE') THEN 'ENTERTAINMENT' WHEN category IN ('BUSINESS', 'FINANCE', 'REAL_ESTATE') THEN 'BUSINESS'
    WHEN top < 3 THEN 'GENERAL' WHEN tech_hits = top THEN 'TECH' WHEN crypto_hits = top THEN 'CRYPTO' WHEN news_hits = top THEN 'NEWS'
    WHEN entertainment_hits = top THEN 'ENTERTAINMENT' ELSE 'BUSINESS' END AS channel_type, top AS keyword_hits
FROM (SELECT *, greatest(tech_hits, crypto_hits, news_hits, entertainment_hits, business_hits) AS top FROM (
  SELECT channel_id, category, {', '.join(_mask)} FROM (
    SELECT channel_id, max(CASE WHEN channel_id % 2 = 0 THEN category END) AS category, string_agg(lower(text), ' ' ORDER BY rn) AS blob
    FROM newest_text_v JOIN channels_v USING (channel_id) WHERE length(text) > 0 GROUP BY 1)))"""
SQL["TXT-10"] = r"""
SELECT conv_id, turn, md5(CASE WHEN length(s) < 50 THEN NULL WHEN length(s) <= 400 THEN s
    WHEN contains(left(s, 400), '.') AND 400 - instr(reverse(left(s, 400)), '.') > 200 THEN left(s, 400 - instr(reverse(left(s, 400)), '.') + 1)
    ELSE left(s, 400) END) AS summary_md5
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(replace('** ' || text, '*', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM conversations)"""
SQL["TXT-11"] = """SELECT c_custkey, ['GAMBLING', 'ADULT', 'SCAM', NULL, 'GAMBLING', 'ADULT', 'SCAM'][c_custkey % 7 + 1] AS toxic_category FROM customer"""
SQL["JSN-01"] = """
SELECT key, turn, CASE WHEN body IS NOT NULL THEN 'json' WHEN turn % 4 = 2 THEN 'fields' ELSE 'empty' END AS level,
  CASE WHEN turn % 4 = 2 THEN key % 10 ELSE 0 END AS toxicity, CASE WHEN turn % 4 = 2 THEN key % 4 ELSE 0 END AS violence,
  CASE WHEN turn % 4 <> 3 THEN (key * 7) % 101 ELSE 0 END AS ad_percentage, CASE WHEN turn % 4 = 2 THEN 'spam,bots' ELSE '' END AS red_flags FROM llm_v"""
SQL["JSN-02"] = """
SELECT key, turn, coalesce(CASE WHEN cat IN ('TECH', 'NEWS', 'CRYPTO') THEN cat END, 'LIFESTYLE') AS category,
  coalesce(status IN ('CRITICAL', 'HIGH') OR scam, false) AS is_toxic, coalesce(status, 'SAFE') AS toxic_severity,
  CASE WHEN flag LIKE '%CASINO%' THEN 'GAMBLING' WHEN flag LIKE '%18+%' THEN 'ADULT' WHEN flag LIKE '%FAKE%' THEN 'SCAM' END AS toxic_category,
  greatest(0, 100 - coalesce(trust, 70)) AS bot_percentage, coalesce(trust, 70) AS trust_score,
  CASE verdict WHEN 'HIGH_QUALITY' THEN 'HIGH' WHEN 'BOT_FARM' THEN 'LOW' ELSE 'MEDIUM' END AS authenticity_tier,
  CASE WHEN ads > 0 THEN CAST(trunc(ads * 1e0 / posts * 100) AS INT) ELSE 0 END AS ad_percentage
FROM (SELECT key, turn, json_extract_string(body, '$.classification.category') AS cat, json_extract_string(body, '$.safety.status') AS status,
  CAST(json_extract(body, '$.safety.is_scam') AS BOOLEAN) AS scam, upper(json_extract_string(body, '$.safety.flags[0]')) AS flag,
  CAST(json_extract(body, '$.audience.trust_score') AS INT) AS trust, json_extract_string(body, '$.audience.verdict') AS verdict,
  json_array_length(body, '$.ad_analysis.ad_post_ids') AS ads FROM llm_v)
JOIN (SELECT conv_id AS key, count(*) * 3 AS posts FROM conversations GROUP BY 1) USING (key)"""
SQL["JSN-01b"] = """
SELECT key, turn, 'repaired' AS level,
  CASE WHEN cat IN ('TECH', 'NEWS', 'CRYPTO') THEN cat ELSE 'LIFESTYLE' END AS category, status IN ('CRITICAL', 'HIGH') OR scam AS is_toxic, status AS toxic_severity,
  CASE WHEN flag LIKE '%CASINO%' THEN 'GAMBLING' WHEN flag LIKE '%18+%' THEN 'ADULT' WHEN flag LIKE '%FAKE%' THEN 'SCAM' END AS toxic_category,
  trust AS trust_score, CASE verdict WHEN 'HIGH_QUALITY' THEN 'HIGH' WHEN 'BOT_FARM' THEN 'LOW' ELSE 'MEDIUM' END AS authenticity_tier, flags, ad_percentage, ad_post_count, total_posts, severity_label, ad_posts
FROM (SELECT key, turn, json_extract_string(clean, '$.classification.category') AS cat, json_extract_string(clean, '$.safety.status') AS status,
  CAST(json_extract(clean, '$.safety.is_scam') AS BOOLEAN) AS scam, upper(json_extract_string(clean, '$.safety.flags[0]')) AS flag, CAST(json_array_length(clean, '$.safety.flags') AS INT) AS flags,
  CAST(json_extract(clean, '$.audience.trust_score') AS INT) AS trust, json_extract_string(clean, '$.audience.verdict') AS verdict,
  CAST(json_extract(clean, '$.ad_percentage') AS INT) AS ad_percentage, CAST(json_extract(clean, '$.ad_post_count') AS INT) AS ad_post_count, CAST(json_extract(clean, '$.total_posts') AS INT) AS total_posts,
  json_extract_string(clean, '$.severity_label') AS severity_label, CAST(json_array_length(clean, '$.ad_analysis.ad_post_ids') AS INT) AS ad_posts FROM answers_v)"""
