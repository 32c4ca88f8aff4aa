"""Severity and fluency expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, cut points and defaults of the scores.
BLOCK_WEIGHT = 3.0
PROLONGATION_WEIGHT = 2.0
REPETITION_WEIGHT = 1.5
FILLER_WEIGHT = 1.0
MILD_BELOW = 0.1
MODERATE_BELOW = 0.25
LIGHT_PLAN_BELOW = 0.2
POINTS_PER_STAMMER = 5
OLDER_CONFIDENCE = 75


def severity_score(blocks: Column, prolongations: Column, repetitions: Column, fillers: Column, words: Column) -> Column:
    """Weighted disfluencies per word; null for a run without words."""
    weighted = (
        F.lit(BLOCK_WEIGHT) * blocks
        + F.lit(PROLONGATION_WEIGHT) * prolongations
        + F.lit(REPETITION_WEIGHT) * repetitions
        + F.lit(FILLER_WEIGHT) * fillers
    )
    return F.try_divide(weighted, words)


def severity_level(score: Column) -> Column:
    return F.when(score < MILD_BELOW, "Mild").when(score < MODERATE_BELOW, "Moderate").when(
        score.isNotNull(), "Severe"
    )


def half_up(number: Column, places: int) -> Column:
    """A double rounded like ``F.round``, ties away from zero and no negative zero.

    ``F.round`` goes through the text of a number. That is left to numbers that are large or close to a tie;
    for all others the nearest whole number of steps, divided, is the same double.
    """
    steps = number * F.lit(10.0**places)
    clear = (F.abs(steps) < 1e12) & (F.abs(F.abs(steps) - F.floor(F.abs(steps)) - 0.5) > 0.001)
    return F.when(clear, F.rint(steps) / F.lit(10.0**places) + F.lit(0.0)).otherwise(F.round(number, places))


def speech_rate(words: Column, duration: Column) -> Column:
    """Words per second; 0 if the duration is not positive, null if there is none."""
    return F.when(duration > 0, F.try_divide(words.cast("double"), duration)).when(
        duration.isNotNull(), F.lit(0.0)
    )


def plan_track(severity: Column, fillers: Column, repetitions: Column, long_pauses: Column) -> Column:
    """``light`` for a nearly faultless run, ``full`` for any other, null for one without metrics."""
    clean = (severity < LIGHT_PLAN_BELOW) & ((fillers + repetitions + long_pauses) == 0)
    return F.when(clean, "light").when(severity.isNotNull(), "full")


def number_or_zero(value: Column) -> Column:
    """A number written as text; 0 if it is missing or no number."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def fluency(severity: Column) -> Column:
    """Fluency as the forecast sees it: unrounded, and negative for a severity above 1."""
    return severity * F.lit(-100.0) + F.lit(100.0)


def fluency_rounded(severity: Column) -> Column:
    """Fluency as the dashboard shows it: one decimal."""
    return round_one_decimal((F.lit(1.0) - severity) * F.lit(100.0))


def round_one_decimal(x: Column) -> Column:
    """Round the exact binary value to one decimal, ties to even.

    ``round`` and ``bround`` look at the shortest decimal print of a double, so
    they turn 0.35 (which is slightly less) into 0.4. Here ten times ``x`` is
    taken as 8x + 2x together with the error of that one addition, which settles
    on which side of the middle the exact value lies.
    """
    eight, two = x * 8.0, x * 2.0
    ten = eight + two
    lost = two - (ten - eight)
    low = F.floor(ten)
    past_middle = (ten - low) - 0.5
    up = (
        F.when(past_middle != 0, past_middle > 0)
        .when(lost != 0, lost > 0)
        .otherwise(F.pmod(low, F.lit(2)) == 1)
    )
    return F.when(up, low + 1).otherwise(low) / 10.0


def older_score(stammer_count: Column) -> Column:
    """Score of the older session form: 100 less a fixed number of points per stammer."""
    return F.lit(100) - stammer_count * POINTS_PER_STAMMER
