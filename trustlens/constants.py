"""Scoring constants. All values below are fixed values of the scoring rules."""

from __future__ import annotations

# Sampling
SAMPLE_POSTS = 50
MIN_POSTS = 10
MIN_MEMBERS = 100
MIN_SCAN_MEMBERS = 200
MIN_ACCOUNTS = 10
NEIGHBOUR_GAP = 500

# Member-count tiers (upper bounds, exclusive)
MICRO, SMALL, MEDIUM, LARGE = 200, 1000, 5000, 50000

# Score cut-offs
GOOD_SCORE = 70
COLLECT_SCORE = 72
VERDICTS = [(75, "EXCELLENT"), (55, "GOOD"), (40, "MEDIUM"), (25, "HIGH_RISK")]

# Category names
CATEGORIES = [
    "CRYPTO", "FINANCE", "REAL_ESTATE", "BUSINESS", "TECH", "AI_ML", "EDUCATION", "BEAUTY",
    "HEALTH", "TRAVEL", "RETAIL", "ENTERTAINMENT", "NEWS", "LIFESTYLE", "GAMBLING", "ADULT",
]

# Posts per day (active, heavy, spam) by category
POSTING_TIERS = {
    "NEWS": (20, 40, 60), "ADULT": (20, 40, 60),
    "ENTERTAINMENT": (10, 18, 30), "AI_ML": (10, 18, 30), "FINANCE": (10, 18, 30), "EDUCATION": (10, 18, 30),
    "CRYPTO": (6, 12, 20), "LIFESTYLE": (6, 12, 20), "BUSINESS": (6, 12, 20), "TECH": (6, 12, 20), "HEALTH": (6, 12, 20),
    "RETAIL": (4, 8, 15), "TRAVEL": (4, 8, 15), "REAL_ESTATE": (4, 8, 15), "BEAUTY": (4, 8, 15), "GAMBLING": (4, 8, 15),
}
POSTING_DEFAULT = (6, 12, 20)
POSTING_MULTIPLIERS = (0.90, 0.75, 0.55)

# Maxima of the metrics: (comments, reactions, forwards) by (comments on, reactions on)
FLOATING_MAX = {
    (True, True): (15, 8, 15),
    (True, False): (20, 0, 18),
    (False, True): (0, 13, 25),
    (False, False): (0, 0, 38),
}
CATEGORY_MAX = {"quality": 42, "engagement": 38, "reputation": 20}

# Emoji counted as simple reactions
SIMPLE_EMOJI = ["👍", "❤️", "❤", "🔥"]

# Data centres counted as foreign
FOREIGN_DC = [1, 3, 5]
NATIVE_DC = [2, 4]
