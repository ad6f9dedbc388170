"""Tuned constants and the three source roles."""

from __future__ import annotations

LIVE, RETIRED, PARTNER = "live", "retired", "partner"

# Fixed values that results depend on.
MAX_CHUNK_WORDS, OVERLAP_WORDS = 220, 30
TOP_K, MIN_SCORE, WEAK_SCORE, SHORT_QUESTION = 8, 0.28, 0.50, 30
DENSE_WEIGHT, RRF_K = 0.5, 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
WEIGHT_SUPERSEDED, WEIGHT_CURRENT, WEIGHT_EQUIVALENT, WEIGHT_GONE, WEIGHT_UNKNOWN = 0.60, 1.0, 0.88, 1.0, 0.90
STATUS_EQUIVALENT = ("kept", "renamed", "merged", "restructured")
STATUS_GONE = ("dropped", "downgraded")
STATUS_WARNED = ("dropped", "downgraded", "restructured")
CHARS_PER_TOKEN = 3.6
REVIEW_NOTICE_DAYS = 14
COPIED_LINE, COPIED_SHARE = 60, 0.5
