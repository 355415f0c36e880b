"""Vocabulary and constants of the data model."""

from __future__ import annotations

#: Reference time of all relative ages; never the wall clock.
NOW_MS = 1_706_745_600_000
DAY_MS = 86_400_000

# The weights and bands of the ranking.
WHO_WEIGHT = {"user": 1.0, "subagent": 0.85, "agent": 0.8, "tool": 0.4}
WHO_WEIGHT_OTHER = 0.5
SOURCE_SCALE = {"subagent": 0.85, "recap": 0.65, "control": 0.65, "synthetic": 0.60, "harness": 0.60, "tool": 0.55}
HALF_LIFE_DAYS = 14.0
META_SCALE = 0.45
USER_RECENCY_FLOOR, EXPLICIT_RECENCY_FLOOR = 0.35, 0.5
PENALTY_FLOOR, PRIOR_WEIGHT = 0.12, 32.0
WEAK_COSINE, STRONG_COSINE = 0.82, 0.84
EVENT_CAP, REPLY_CAP, FIRST_TEXT_CAP, SNIPPET_PAD = 800, 64_000, 120, 80
BM25_K1, BM25_B = 1.2, 0.75

# Roles of rows.
MACHINE_ROLES = ("control", "synthetic", "recap", "harness")
LANE_CLASS = {"all-terms": 1, "content-terms": 2}

# Connective words that carry no content in a question.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can could did do does for from had has have how i if in is it its me my not of on or our should "
    "so that the their them they this these those to was we were what when where which who why will with would you your "
    "whats what's im i'm dont don't isnt isn't didnt didn't".split()
)

MSGS = (
    "id bigint, session string, turn int, ts bigint, agent string, project string, concept string, model string, model_source string, "
    "who string, text string, content_digest string"
)
MESSAGES = (
    "agent string, project string, session string, ts bigint, turn int, text string, who string, model string, model_source string, "
    "reply string, reply_chars bigint, side boolean, parent string"
)
EVENTS = (
    "agent string, session string, ts bigint, kind string, name string, input string, output string, input_chars bigint, output_chars bigint, "
    "output_bytes bigint, ok boolean, call_id string, child_session string"
)
