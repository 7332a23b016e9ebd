"""Oracle SQL of the points."""

SQL: dict[str, str] = {
    "PTS-01": "SELECT channel_id, cv_points FROM points_v",
    "PTS-02": "SELECT channel_id, reach_points FROM points_v",
    "PTS-03": "SELECT channel_id, reactions_max, reaction_points FROM points_v",
    "PTS-04": "SELECT channel_id, forwards_max, forward_points FROM points_v",
    "PTS-05": "SELECT channel_id, posts_per_day, regularity_points FROM points_v",
    "PTS-06": "SELECT channel_id, comments_max, comment_points FROM points_v",
    "PTS-07": "SELECT channel_id, er_status, er_points FROM points_v",
    "PTS-08": "SELECT channel_id, stability_points FROM points_v",
    "PTS-09": "SELECT channel_id, age_days, age_points FROM points_v",
    "PTS-10": "SELECT channel_id, coalesce(premium_count, 0) AS premium_count, premium_points FROM points_v",
    "PTS-11": "SELECT channel_id, source_points FROM points_v",
    "PTS-12": "SELECT channel_id, is_verified, 0 AS verified_points FROM points_v",
    "PTS-13": """SELECT channel_id, CASE WHEN decay >= 0.3 AND decay <= 0.95 THEN 'healthy_organic' WHEN decay >= 1.05 AND decay <= 2 THEN 'viral_growth'
        WHEN decay >= 0.98 AND decay <= 1.02 THEN 'bot_wall' WHEN decay < 0.2 THEN 'budget_cliff' WHEN decay > 0.95 AND decay < 1.05 THEN 'stable'
        WHEN decay >= 0.2 AND decay < 0.3 THEN 'suspicious_gap' WHEN decay > 2 THEN 'suspicious_growth' ELSE 'unknown' END AS zone FROM metrics_v""",
    "PTS-14": "SELECT channel_id, comments_max, reactions_max, forwards_max FROM points_v",
    "PTS-15": """SELECT channel_id, coalesce(accounts, 0) AS accounts,
        CASE WHEN coalesce(accounts, 0) >= 10 THEN 'normal' ELSE 'hardcore' END AS scoring_mode FROM points_v""",
    "PTS-16": """SELECT channel_id, age_days, CASE WHEN age_days >= 730 THEN 'veteran' WHEN age_days >= 365 THEN 'established' WHEN age_days >= 180 THEN 'mature'
        WHEN age_days >= 90 THEN 'young' ELSE 'newborn' END AS age_status FROM channels_v""",
    "SCL-01": "SELECT post_id, coalesce(r1 + r2 + r3, 0) AS reacted FROM posts_v",
    "SCL-02": """SELECT post_id, emoji, count FROM (
        SELECT post_id, '👍' AS emoji, r1 AS count FROM posts_v UNION ALL SELECT post_id, '❤', r2 FROM posts_v
        UNION ALL SELECT post_id, '🎉', r3 FROM posts_v) WHERE count > 0""",
    "SCL-03": "SELECT channel_id, age_days FROM channels_v",
    "SCL-04": """SELECT channel_id, members, CASE WHEN members < 200 THEN 'micro' WHEN members < 1000 THEN 'small' WHEN members < 5000 THEN 'medium'
        ELSE 'large' END AS size_class FROM channels_v""",
}
