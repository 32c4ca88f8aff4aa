from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluentrail.operators import progress
from fluentrail.operators.forecast import forecast

RUNS = "run_id BIGINT, processed_at TIMESTAMP, user_id BIGINT, metrics STRING"


def day(n, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=n, hours=hour)


def test_missing_and_bad_metrics_count_as_zero_severity(spark):
    texts = ["{}", '{"severity_score":"abc"}', "not json", None, '{"severity_score":0.3,"filler_count":4}', '{"severity_score":null}']
    df = spark.createDataFrame([(i, day(0), 1, t) for i, t in enumerate(texts)], RUNS)
    rows = progress.history(df).orderBy("run_id").collect()
    assert [r.fluency_score for r in rows] == [100.0, 100.0, 100.0, 100.0, 70.0, 100.0]
    assert [r.filler_count for r in rows] == [0, 0, 0, 0, 4, 0]
    assert progress.daily_fluency(df).first().fluency_score == pytest.approx(95.0)


def test_rows_without_a_day_are_dropped(spark):
    df = spark.createDataFrame([(1, None, 1, "{}"), (2, day(0), 1, "{}")], RUNS)
    assert [r.run_id for r in progress.history(df).collect()] == [2]


def test_history_in_order(spark):
    df = spark.createDataFrame([(3, day(1), 1, "{}"), (2, day(0), 1, "{}"), (1, day(1), 1, "{}")], RUNS)
    assert [r.run_id for r in progress.history(df, in_order=True).collect()] == [2, 1, 3]


def test_the_two_daily_means_differ(spark):
    df = spark.createDataFrame(
        [(1, day(0), 1, '{"severity_score":0.12345}'), (2, day(0, 5), 1, '{"severity_score":0.2}')], RUNS
    )
    assert progress.daily_fluency(df).first().fluency_score == pytest.approx((87.655 + 80) / 2)
    shown = progress.daily_fluency_rounded(progress.history(df)).first()
    assert (shown.day, shown.fluency_score) == ("2024-01-01", pytest.approx((round(87.655, 1) + 80) / 2))


def test_kpis(spark):
    df = spark.createDataFrame(
        [
            (1, day(0), 1, '{"severity_score":0.5,"filler_count":3}'),
            (3, day(2), 1, '{"severity_score":0.25,"filler_count":1}'),
            (2, day(2), 1, '{"severity_score":0.75,"filler_count":2}'),
            (4, day(1), 2, "{}"),
        ],
        RUNS,
    )
    by_user = {r.user_id: r for r in progress.kpis(progress.history(df, ("user_id",)), ("user_id",)).collect()}
    assert (by_user[1].latest_fluency, by_user[1].avg_fillers, by_user[1].sessions) == (75.0, 2.0, 3)
    assert (by_user[2].latest_fluency, by_user[2].avg_fillers, by_user[2].sessions) == (100.0, 0.0, 1)
    assert progress.kpis(progress.history(df)).first().sessions == 4


def daily(spark, *values, start=0, user=1):
    return spark.createDataFrame(
        [(user, day(start + i).date(), float(v)) for i, v in enumerate(values)],
        "user_id BIGINT, processed_day DATE, fluency_score DOUBLE",
    )


def test_two_days_give_no_forecast(spark):
    assert forecast(daily(spark, 1, 2)).count() == 0
    assert forecast(daily(spark)).count() == 0


def test_a_perfect_line_has_no_width(spark):
    rows = forecast(daily(spark, 10, 12, 14)).orderBy("forecast_timestamp").collect()
    assert len(rows) == 10
    assert [r.fluency_forecast for r in rows] == pytest.approx([16 + 2 * h for h in range(10)])
    assert rows[0].forecast_timestamp == day(3)
    for r in rows:
        assert r.prediction_interval_lower_bound == pytest.approx(r.prediction_interval_upper_bound, abs=1e-5)


def test_forecast_formula(spark):
    y = np.array([50.0, 55.0, 48.0, 60.0, 61.0, 59.5])
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    s = np.sqrt(((y - intercept - slope * x) ** 2).sum() / (len(y) - 2))
    at = len(y) - 1 + np.arange(1, 6)
    half = NormalDist().inv_cdf(0.95) * s * np.sqrt(1 + 1 / len(y) + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    rows = forecast(daily(spark, *y), horizon=5, confidence=0.9).orderBy("forecast_timestamp").collect()
    assert [r.fluency_forecast for r in rows] == pytest.approx(list(intercept + slope * at))
    assert [r.prediction_interval_upper_bound for r in rows] == pytest.approx(list(intercept + slope * at + half))
    assert [r.prediction_interval_lower_bound for r in rows] == pytest.approx(list(intercept + slope * at - half))


def test_series_are_apart_and_short_ones_keep_their_summary(spark):
    df = daily(spark, 10, 12, 14).unionByName(daily(spark, 50, 40, user=2))
    ahead = forecast(df, ("user_id",))
    assert {r.user_id for r in ahead.collect()} == {1}
    shown = df.withColumn("day", F.date_format("processed_day", "yyyy-MM-dd"))
    rows = {r.user_id: r for r in progress.summary(shown, ahead, ("user_id",)).collect()}
    assert (rows[1].initial_fluency, rows[1].latest_fluency, rows[1].improvement, rows[1].days) == (10, 14, 4, 2)
    assert rows[1].projected_fluency == pytest.approx(34)
    assert (rows[2].improvement, rows[2].projected_fluency) == (-10, None)
    assert rows[2].latest_day == "2024-01-02"


def test_bad_confidence(spark):
    with pytest.raises(ValueError):
        forecast(daily(spark, 1, 2, 3), confidence=1.0)


def test_older_analyses(spark):
    texts = [
        '{"transcript": "t", "analysis": {"stammer_count": 3, "patterns": ["p"], "suggestions": ["s"]}}',
        '{"transcript": "t"}',
        "{broken",
        None,
        '{"analysis": {}}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, j STRING")
    rows = progress.older_sessions(progress.older_analyses(df, "j"), "2024-02-01").orderBy("i").collect()
    got = [(r.transcript, r.stammer_count, r.patterns, r.suggestions, r.fluency_score, r.confidence) for r in rows]
    nothing = ("", 0, [], [], 100, 75)
    assert got == [("t", 3, ["p"], ["s"], 85, 75), ("t", *nothing[1:]), nothing, nothing, nothing]
    assert {r.date for r in rows} == {"2024-02-01"}
