"""Progress over time: history, daily fluency, dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluentrail.functions import scores
from fluentrail.schemas import OLDER_ANALYSIS
from fluentrail.session import once


def with_metric_fields(runs: DataFrame, fields: dict[str, str], metrics_col: str = "metrics") -> DataFrame:
    """Fields of the metrics JSON as double columns, 0 where missing, null or no number.

    Metrics are JSON text, which is parsed once for all fields and not again by a filter put on them, or a VARIANT, which
    was parsed when it was stored: then only the fields asked for are read out of it.
    """
    raw = [f"_raw_{name}" for name in fields]
    if runs.schema[metrics_col].dataType == T.VariantType():
        # as text, so that numbers and numbers written as text come out as they do of JSON text
        parsed = runs.withColumns({r: F.try_variant_get(F.col(metrics_col), f"$.{field}", "string") for r, field in zip(raw, fields.values(), strict=True)})
    else:
        parsed = runs.select("*", F.json_tuple(metrics_col, *fields.values()).alias(*raw))
    numbers = {name: scores.number_or_zero(F.col(f"_raw_{name}")) for name in fields}
    return parsed.withColumns(numbers).drop(*raw)


def history(runs: DataFrame, series: tuple[str, ...] = (), metrics_col: str = "metrics", in_order: bool = False) -> DataFrame:
    """Day, rounded fluency and counts of each run; runs without a time have no place here.

    ``in_order`` sorts by time for display. Nothing downstream needs the order.
    """
    fields = {"_severity": "severity_score", "filler_count": "filler_count", "repetitions": "repetitions", "total_words": "total_words"}
    parsed = with_metric_fields(runs.select(*series, "run_id", "processed_at", metrics_col), fields, metrics_col)
    rows = once(
        parsed,
        day=F.date_format("processed_at", "yyyy-MM-dd"),
        fluency_score=scores.fluency_rounded(F.col("_severity")),
    ).select(
        *series,
        "run_id",
        "processed_at",
        "day",
        "fluency_score",
        *[F.col(name).cast("long").alias(name) for name in ("filler_count", "repetitions", "total_words")],
    )
    rows = rows.dropna(subset=["day", "fluency_score"])
    return rows.orderBy("processed_at", "run_id") if in_order else rows


def daily_fluency(runs: DataFrame, series: tuple[str, ...] = (), metrics_col: str = "metrics") -> DataFrame:
    """Mean unrounded fluency per day, the input of the forecast."""
    parsed = with_metric_fields(
        runs.select(*series, "processed_at", metrics_col), {"_severity": "severity_score"}, metrics_col
    )
    return (
        parsed.select(
            *series, F.to_date("processed_at").alias("processed_day"), scores.fluency(F.col("_severity")).alias("_fluency")
        )
        .groupBy(*series, "processed_day")
        .agg(F.avg("_fluency").alias("fluency_score"))
    )


def daily_fluency_rounded(rows: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the rounded scores of ``history`` per day, as the dashboard charts it."""
    return rows.groupBy(*series, "day").agg(F.avg("fluency_score").alias("fluency_score"))


def kpis(rows: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Latest score, mean number of fillers and number of sessions out of ``history``."""
    return rows.groupBy(*series).agg(
        F.max_by("fluency_score", F.struct("processed_at", "run_id")).alias("latest_fluency"),
        F.avg("filler_count").alias("avg_fillers"),
        F.count("*").alias("sessions"),
    )


def summary(daily: DataFrame, forecast: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """First and latest daily score, their difference, the days between them, and the last forecast.

    A series too short for a forecast keeps its row.
    """
    keys = list(series) or ["_all"]
    if not series:
        daily, forecast = daily.withColumn("_all", F.lit(0)), forecast.withColumn("_all", F.lit(0))
    seen = daily.groupBy(*keys).agg(
        F.min_by("fluency_score", "day").alias("initial_fluency"),
        F.max_by("fluency_score", "day").alias("latest_fluency"),
        F.max("day").alias("latest_day"),
        (F.count("*") - 1).alias("days"),
    )
    coming = forecast.groupBy(*keys).agg(F.max_by("fluency_forecast", "forecast_timestamp").alias("projected_fluency"))
    both = seen.join(coming, keys, "left").withColumn("improvement", F.col("latest_fluency") - F.col("initial_fluency"))
    return both.select(
        *series, "initial_fluency", "latest_fluency", "latest_day", "improvement", "days", "projected_fluency"
    )


def older_analyses(df: DataFrame, json_col: str) -> DataFrame:
    """Add transcript, stammer count, patterns and suggestions of the older analysis form.

    Whatever is missing or unreadable takes its default: an empty text, 0, an empty list.
    """
    parsed = F.from_json(F.col(json_col), OLDER_ANALYSIS)
    none = F.array().cast("array<string>")
    return (
        df.withColumn("_older", parsed)
        .withColumn("transcript", F.coalesce("_older.transcript", F.lit("")))
        .withColumn("stammer_count", F.coalesce("_older.analysis.stammer_count", F.lit(0)))
        .withColumn("patterns", F.coalesce("_older.analysis.patterns", none))
        .withColumn("suggestions", F.coalesce("_older.analysis.suggestions", none))
        .drop("_older")
    )


def older_sessions(analyses: DataFrame, day: str) -> DataFrame:
    """Add the older session figures: the day given, the score, and the constant confidence."""
    return analyses.withColumns(
        {
            "date": F.lit(day),
            "fluency_score": scores.older_score(F.col("stammer_count")),
            "confidence": F.lit(scores.OLDER_CONFIDENCE),
        }
    )
