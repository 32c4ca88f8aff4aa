"""Reports out of the roll-up equal those out of the runs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fluentrail.operators import progress, rollup
from fluentrail.operators.forecast import forecast

SERIES = ("user_id",)


@pytest.fixture
def runs(spark):
    def run(i, user, day, severity, fillers=1):
        at = None if day is None else datetime(2024, 1, day, i % 24)
        return i, user, at, json.dumps({"severity_score": severity, "filler_count": fillers})

    rows = [run(i, i % 3, 1 + i % 11, (i * 37 % 101) / 100, i % 5) for i in range(80)]
    rows += [run(100, 0, None, 0.5), run(101, 5, None, 0.5), run(102, 6, 4, 0.2), run(103, 6, 4, "n/a"), run(104, None, 3, 0.1), (105, 0, datetime(2024, 1, 12), None), (106, 0, datetime(2024, 1, 12), "{broken")]
    return spark.createDataFrame(rows, "run_id BIGINT, user_id INT, processed_at TIMESTAMP, metrics STRING")


def rows(df):
    return sorted((tuple(round(v + 1e-9, 6) if isinstance(v, float) else v for v in row) for row in df.collect()), key=repr)


def check(runs, days):
    history = progress.history(runs, SERIES)
    shown = progress.daily_fluency_rounded(history, SERIES)
    daily = progress.daily_fluency(runs, SERIES)
    assert rows(rollup.daily_means(days, SERIES)) == rows(daily)
    assert rows(rollup.daily_shown(days, SERIES)) == rows(shown)
    assert rows(rollup.kpis(days, SERIES)) == rows(progress.kpis(history, SERIES))
    # a join on the series leaves the forecast of a null series out
    wanted = progress.summary(shown, forecast(daily, SERIES), SERIES)
    assert rows(rollup.summary(days, SERIES).where("user_id is not null")) == rows(wanted.where("user_id is not null"))


def test_reports(runs):
    days = rollup.rollup(runs, SERIES)
    check(runs, days)
    summary = rollup.summary(days, SERIES)
    summary.collect()
    plan = summary._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 1 and plan.count(" Exchange") == 2


def test_stored_parts_add_up(spark, runs, tmp_path):
    path, schema = str(tmp_path / "rollup"), rollup.rollup_schema(runs, SERIES)
    assert rollup.read_rollup(spark, path, schema, SERIES).count() == 0
    order = [0, 1, 1, 2, 0]
    for batch in order:
        rollup.add_runs(runs.where(F.col("run_id") % 3 == batch), path, batch, SERIES)
        if batch == 2:
            rollup.fold(spark, path, schema, SERIES)
    rollup.fold(spark, path, schema, SERIES)
    check(runs, rollup.read_rollup(spark, path, schema, SERIES))


def test_no_runs(runs):
    days = rollup.rollup(runs.limit(0), SERIES)
    assert days.count() == 0 and rollup.summary(days, SERIES).count() == 0 and rollup.kpis(days, SERIES).count() == 0
