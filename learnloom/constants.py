"""Enums, thresholds, intervals and text tables of the learning model."""

# Enums, in their natural order.
SUBJECTS = ["math", "japanese", "life", "insight"]
MODES = ["learn", "review", "challenge"]
TAGS = [
    "unknown_guess",
    "attention_slip",
    "math_counting_slip",
    "math_operation_confusion",
    "math_place_value_confusion",
    "math_carry_confusion",
    "math_borrow_confusion",
    "jp_sound_confusion",
    "jp_dakuten_confusion",
    "jp_particle_confusion",
    "jp_vocab_meaning_confusion",
    "jp_antonym_confusion",
]

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# Mission assembly and difficulty.
MISSION_SIZE = 5
MIN_DIFFICULTY = 1
MAX_DIFFICULTY = 5
DEFAULT_MASTERY = 45.0
CANDIDATE_PRIORITY = 25.0
MISCONCEPTION_SLOTS = 2
REVIEW_SLOTS = 2
MISCONCEPTION_BAND = 2
SKILL_BAND = 1
RECENT_PENALTY = 2
CHALLENGE_PENALTY = 3

# Promotion and demotion gates.
PROMOTE_ACCURACY = 0.8
PROMOTE_MASTERY = 55.0
PROMOTE_UNRESOLVED = 0.35
PROMOTE_DIFFICULTY_SLACK = 0.25
DEMOTE_ACCURACY = 0.4
DEMOTE_UNRESOLVED = 0.65

# Misconception and review intervals (milliseconds).
ERROR_INTERVAL_MS = 3 * MINUTE_MS
ERROR_INTERVAL_CAP_MS = 24 * HOUR_MS
RESOLVE_INTERVAL_MS = 8 * HOUR_MS
WRONG_REVIEW_MS = 3 * MINUTE_MS
REVIEW_LADDER_MS = [
    5 * MINUTE_MS,
    30 * MINUTE_MS,
    2 * HOUR_MS,
    8 * HOUR_MS,
    24 * HOUR_MS,
    72 * HOUR_MS,
]

# Guess threshold.
GUESS_DEFAULT_MS = 900
GUESS_MIN_MS = 700
GUESS_MAX_MS = 1400
GUESS_FACTOR = 0.35
GUESS_MIN_SAMPLES = 20

# Retention, look-ahead, rewards.
LOG_RETENTION = 200
RESULT_RETENTION = 30
RECENT_QUESTIONS = 30
RECURRENCE_LOOKAHEAD = 15
XP_PER_LEVEL = 100
MODE_XP = {"challenge": 12, "review": 8, "learn": 5}

# Minimum spacing between accepted effects (milliseconds).
COOLDOWN_MS = {"tap": 65, "combo": 820, "clear": 420}

# Tag texts (label, feedback, remediation hint).
TAG_LABELS = {
    "unknown_guess": "あわてて えらんだ",
    "attention_slip": "うっかり まちがい",
    "math_counting_slip": "かぞえまちがい",
    "math_operation_confusion": "＋と−の こんらん",
    "math_place_value_confusion": "くらいの こんらん",
    "math_carry_confusion": "くりあがりの つまずき",
    "math_borrow_confusion": "くりさがりの つまずき",
    "jp_sound_confusion": "おとの こんらん",
    "jp_dakuten_confusion": "てんてん・まるの こんらん",
    "jp_particle_confusion": "じょしの つかいかた",
    "jp_vocab_meaning_confusion": "ことばの いみ",
    "jp_antonym_confusion": "はんたいことば",
}
TAG_FEEDBACK = {
    "unknown_guess": "あわてずに よんでみよう",
    "attention_slip": "もういちど ゆっくり みてみよう",
    "math_counting_slip": "かずを いちどずつ かぞえよう",
    "math_operation_confusion": "＋と−を よくみよう",
    "math_place_value_confusion": "くらいを たしかめよう",
    "math_carry_confusion": "くりあがりを たしかめよう",
    "math_borrow_confusion": "くりさがりを たしかめよう",
    "jp_sound_confusion": "こえにだして よんでみよう",
    "jp_dakuten_confusion": "てんてん・まるを みよう",
    "jp_particle_confusion": "ぶんの つながりを みよう",
    "jp_vocab_meaning_confusion": "ことばの いみを たしかめよう",
    "jp_antonym_confusion": "はんたいことばを かんがえよう",
}
TAG_HINTS = {
    "unknown_guess": "あわてずに よんでみよう",
    "attention_slip": "もういちど ていねいに",
    "math_counting_slip": "かずを いちどずつ かぞえよう",
    "math_operation_confusion": "＋と−を よくみよう",
    "math_place_value_confusion": "くらいに きをつけよう",
    "math_carry_confusion": "くりあがりを かくにん",
    "math_borrow_confusion": "くりさがりを かくにん",
    "jp_sound_confusion": "おとを こえにだしてみよう",
    "jp_dakuten_confusion": "てんてん・まるを みなおそう",
    "jp_particle_confusion": "ぶんの つながりを みよう",
    "jp_vocab_meaning_confusion": "ことばの いみを たしかめよう",
    "jp_antonym_confusion": "はんたいことばを かんがえよう",
}

# Curated wrong-choice tags by question id.
CURATED_TAGS = {
    "m88": ["math_counting_slip", "math_operation_confusion", "math_place_value_confusion"],
    "m89": ["math_place_value_confusion", "math_operation_confusion", "math_counting_slip"],
    "j145": ["jp_antonym_confusion", "jp_vocab_meaning_confusion", "jp_antonym_confusion"],
    "j146": ["jp_vocab_meaning_confusion", "jp_antonym_confusion", "jp_antonym_confusion"],
}

# Badge master (id, name, description) and the text shown while locked.
BADGES = [
    ("first_clear", "はじめてクリア", "ミッションを1回クリアした"),
    ("perfect_mission", "かんぺきスター", "1回のミッションを全問正解"),
    ("three_day_streak", "3にちれんぞく", "3日連続で学習した"),
    ("math_explorer", "さんすうたんけんたい", "算数ミッションを3回クリア"),
    ("word_adventurer", "ことばぼうけんか", "国語ミッションを3回クリア"),
    ("difficulty_climber", "レベルアップたんけん", "おすすめ難易度を1段階上げた"),
    ("challenge_clear", "チャレンジせいは", "チャレンジモードを全問正解した"),
]
LOCKED_NAME = "？？？"
LOCKED_DESCRIPTION = "まだ みつけていないバッジ"

# Money denominations, largest first.
DENOMINATIONS = [1000, 500, 100, 50, 10, 5, 1]
BILL_FROM = 1000
