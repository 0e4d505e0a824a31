"""Scalar column functions (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from learnloom import constants as K


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp(value, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(value)))


def js_round(value) -> Column:
    """Half-up toward +infinity."""
    return F.floor(_c(value).cast("double") + F.lit(0.5))


def to_fixed(value, digits: int) -> Column:
    scale = float(10**digits)
    return js_round(_c(value).cast("double") * F.lit(scale)).cast("double") / F.lit(scale)


def choice_number(choice) -> Column:
    """Number in a choice text; null when nothing numeric remains."""
    stripped = F.regexp_replace(_c(choice), r"[^0-9.\-]", "")
    return F.when(F.length(stripped) > 0, stripped.try_cast("double"))


def performance_band(accuracy) -> Column:
    a = _c(accuracy)
    return (
        F.when(a.isNull(), "no_data").when(a >= 0.9, "excellent").when(a >= 0.7, "good").otherwise("retry")
    )


def day_part(ts) -> Column:
    hour = F.hour(_c(ts))
    return (
        F.when(hour.between(5, 10), "morning").when(hour.between(11, 17), "daytime").otherwise("night")
    )


def slot_key(ts) -> Column:
    t = _c(ts)
    quarter = F.floor(F.minute(t) / 15)
    return (
        F.year(t).cast("bigint") * 1_000_000
        + F.month(t) * 10_000
        + F.dayofmonth(t) * 100
        + F.hour(t) * 4
        + quarter
    )


def celebration_tier(accuracy) -> Column:
    a = _c(accuracy)
    return F.when(a >= 0.95, "high").when(a >= 0.8, "mid")


def level(xp) -> Column:
    return F.floor(_c(xp) / K.XP_PER_LEVEL) + 1


def play_date(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def month_day(ts) -> Column:
    return F.date_format(_c(ts), "MM-dd")


def duration_sec(start_ms, finish_ms) -> Column:
    return F.greatest(F.lit(10).cast("bigint"), js_round((_c(finish_ms) - _c(start_ms)) / 1000))


def duration_min(seconds) -> Column:
    return to_fixed(_c(seconds) / 60, 1)


def latency_ms(started_ms, answered_ms) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), _c(answered_ms) - _c(started_ms))


def epoch_ms(ts) -> Column:
    return F.unix_millis(_c(ts))


def at(array, index) -> Column:
    """0-based element, null out of range."""
    return F.get(_c(array), _c(index))


def review_interval_ms(streak) -> Column:
    ladder = F.array(*[F.lit(v).cast("bigint") for v in K.REVIEW_LADDER_MS])
    return F.get(ladder, F.least(_c(streak).cast("int"), F.lit(len(K.REVIEW_LADDER_MS) - 1)))


def error_interval_ms(recent_errors) -> Column:
    """3 minutes doubled per repeated error, capped at a day (the exponent is bounded first)."""
    steps = F.least(F.greatest(_c(recent_errors) - 1, F.lit(0)), F.lit(20))
    return F.least(
        (F.lit(K.ERROR_INTERVAL_MS) * F.pow(F.lit(2.0), steps)).cast("bigint"),
        F.lit(K.ERROR_INTERVAL_CAP_MS).cast("bigint"),
    )


def mission_xp(correct, total, mode, before, after, avg_difficulty) -> Column:
    bonus = F.lit(K.MODE_XP["learn"])
    for name in ("review", "challenge"):
        bonus = F.when(_c(mode) == name, K.MODE_XP[name]).otherwise(bonus)
    share = F.when(_c(total) == 0, F.lit(0).cast("bigint")).otherwise(js_round(_c(correct) / _c(total) * 10))
    return (
        _c(correct).cast("bigint") * 10
        + bonus
        + share
        + F.when(_c(after) > _c(before), 15).otherwise(0)
        + js_round(_c(avg_difficulty) * 2)
    )


def mission_stars(correct, total, before, after) -> Column:
    return (
        _c(correct).cast("bigint")
        + F.when(_c(correct) == _c(total), 3).otherwise(1)
        + F.when(_c(after) > _c(before), 1).otherwise(0)
    )


def next_difficulty(before, accuracy, avg_mastery, unresolved, avg_difficulty, mode) -> Column:
    """Target difficulty after a mission: promotion first, then demotion, then clamp."""
    up = (
        (_c(accuracy) >= K.PROMOTE_ACCURACY)
        & (_c(avg_mastery) >= K.PROMOTE_MASTERY)
        & (_c(unresolved) <= K.PROMOTE_UNRESOLVED)
        & (_c(avg_difficulty) >= _c(before) - K.PROMOTE_DIFFICULTY_SLACK)
        & (_c(mode) != "review")
    )
    down = (_c(accuracy) <= K.DEMOTE_ACCURACY) | (_c(unresolved) >= K.DEMOTE_UNRESOLVED)
    return clamp(
        _c(before) + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0),
        K.MIN_DIFFICULTY,
        K.MAX_DIFFICULTY,
    )


def combo_milestone(streak) -> Column:
    return (_c(streak) >= 3) & (F.pmod(_c(streak) - 3, F.lit(2)) == 0)


def combo_next_target(streak) -> Column:
    s = _c(streak)
    return F.when(s < 3, F.lit(3)).when(s % 2 == 0, s + 1).otherwise(s + 2)


def combo_progress(streak) -> Column:
    s = _c(streak)
    return F.when(s < 3, js_round(s / 3 * 100)).when(s % 2 == 0, F.lit(50)).otherwise(F.lit(100))
