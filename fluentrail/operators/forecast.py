"""Forecast of daily fluency: a straight line per series with a prediction interval."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Number of days ahead, and the share of the interval.
HORIZON = 10
CONFIDENCE = 0.8


def forecast(
    daily: DataFrame,
    series: tuple[str, ...] = (),
    horizon: int = HORIZON,
    confidence: float = CONFIDENCE,
    day_col: str = "processed_day",
    value_col: str = "fluency_score",
) -> DataFrame:
    """``horizon`` days after each series' last day: value and bounds.

    One aggregate gives the sums of a least-squares line; a series with fewer than
    three days, or with one day only repeated, gets no rows. Every value comes from
    real days: nothing is filled in.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    points = daily.where(F.col(day_col).isNotNull() & F.col(value_col).isNotNull()).select(
        *series, F.col(day_col).alias("_day"), F.unix_date(day_col).alias("_x"), F.col(value_col).alias("_y")
    )
    line = points.groupBy(*series).agg(
        F.count("*").alias("_n"),
        F.max("_day").alias("_last_day"),
        F.max("_x").alias("_last_x"),
        F.regr_avgx("_y", "_x").alias("_mean_x"),
        F.regr_avgy("_y", "_x").alias("_mean_y"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.regr_syy("_y", "_x").alias("_syy"),
    )
    fitted = line.where((F.col("_n") >= 3) & (F.col("_sxx") > 0)).withColumns(
        {
            "_slope": F.col("_sxy") / F.col("_sxx"),
            "_spread": F.sqrt(
                F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (F.col("_n") - 2)
            ),
        }
    )
    ahead = fitted.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    away = F.col("_last_x") + F.col("_step") - F.col("_mean_x")
    half = F.lit(z) * F.col("_spread") * F.sqrt(1.0 + 1.0 / F.col("_n") + away * away / F.col("_sxx"))
    return (
        ahead.withColumns({"_value": F.col("_mean_y") + F.col("_slope") * away, "_half": half})
        .select(
            *series,
            F.date_add("_last_day", F.col("_step")).cast("timestamp").alias("forecast_timestamp"),
            F.col("_value").alias("fluency_forecast"),
            (F.col("_value") - F.col("_half")).alias("prediction_interval_lower_bound"),
            (F.col("_value") + F.col("_half")).alias("prediction_interval_upper_bound"),
        )
    )
