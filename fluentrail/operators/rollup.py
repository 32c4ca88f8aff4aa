"""Partial sums of runs per series and day, from which the progress reports are worked out.

A row holds what the reports need of one day: the number of runs, the sums of their scores and fillers, and
the last run. Rows of the same day add up, so new runs are added as rows of their own and merged when
read; no report goes back to the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.functions import scores
from fluentrail.operators.forecast import HORIZON
from fluentrail.operators.progress import with_metric_fields
from fluentrail.session import once
from fluentrail.sources import keyed, versions
from fluentrail.sources.tables import read_table

LAST = "STRUCT<processed_at: TIMESTAMP, run_id: {run_id}, fluency_score: DOUBLE>"
SUMS = ("runs", "total", "sessions", "shown", "fillers")


def rollup_schema(runs: DataFrame, series: tuple[str, ...] = ()) -> str:
    own = ", ".join(f"{name} {runs.schema[name].dataType.simpleString()}" for name in series)
    last = LAST.format(run_id=runs.schema["run_id"].dataType.simpleString())
    return f"{own}{', ' if own else ''}processed_day DATE, runs BIGINT, total DOUBLE, sessions BIGINT, shown DOUBLE, fillers BIGINT, last {last}"


def rollup(runs: DataFrame, series: tuple[str, ...] = (), metrics_col: str = "metrics") -> DataFrame:
    """One row per series and day; runs without a time are those of the null day and no sessions."""
    fields = {"_severity": "severity_score", "_fillers": "filler_count"}
    parsed = with_metric_fields(runs.select(*series, "run_id", "processed_at", metrics_col), fields, metrics_col)
    rows = once(
        parsed,
        _fluency=scores.fluency(F.col("_severity")),
        _shown=F.when(F.col("processed_at").isNotNull(), scores.fluency_rounded(F.col("_severity"))),
    )
    seen = F.col("_shown").isNotNull()
    last = F.struct("processed_at", "run_id", F.col("_shown").alias("fluency_score"))
    return rows.groupBy(*series, F.to_date("processed_at").alias("processed_day")).agg(
        F.count("_fluency").alias("runs"),
        F.sum("_fluency").alias("total"),
        F.count("_shown").alias("sessions"),
        F.sum("_shown").alias("shown"),
        F.sum(F.when(seen, F.col("_fillers").cast("bigint"))).alias("fillers"),
        F.max_by(last, F.when(seen, F.struct("processed_at", "run_id"))).alias("last"),
    )


def merged(parts: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the same series and day added up."""
    sums = [F.sum(name).alias(name) for name in SUMS]
    last = F.max_by("last", F.struct("last.processed_at", "last.run_id")).alias("last")
    return parts.groupBy(*series, "processed_day").agg(*sums, last)


# The stored roll-up


def add_runs(runs: DataFrame, path: str, batch: int, series: tuple[str, ...] = ()) -> None:
    """Add a batch of runs that are not in the roll-up; a batch that is tried again under its number counts once."""
    keyed.put_rows(rollup(runs, series), path, rollup_schema(runs, series), batch)


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The base, and the batches behind the last one in it."""
    path, numbered = path.rstrip("/"), f"{schema}, {keyed.BATCH} BIGINT"
    base = read_table(spark, f"{path}/{keyed.BASE}", numbered)
    upto = base.agg(F.max(keyed.BATCH)).first()[0]
    log = read_table(spark, f"{path}/{keyed.LOG}", numbered)
    return base.unionByName(log if upto is None else log.where(F.col(keyed.BATCH) > upto))


def read_rollup(spark: SparkSession, path: str, schema: str, series: tuple[str, ...] = ()) -> DataFrame:
    return merged(_parts(spark, path, schema), series)


def fold(spark: SparkSession, path: str, schema: str, series: tuple[str, ...] = ()) -> None:
    """Make all batches so far the base; ended half way, the base has them and the batches no longer count."""
    path, upto = path.rstrip("/"), keyed.last_batch(spark, path)
    versions.publish(read_rollup(spark, path, schema, series).withColumn(keyed.BATCH, F.lit(upto).cast("bigint")), f"{path}/{keyed.BASE}")
    for batch in keyed.batches(spark, path)[:-1]:
        versions.remove(spark, f"{path}/{keyed.LOG}/{keyed.BATCH}={batch}")
    versions.discard(spark, f"{path}/{keyed.BASE}", keep=0)


# Reports


def daily_means(days: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """The mean unrounded fluency of each day, as ``daily_fluency``."""
    return days.select(*series, "processed_day", F.try_divide("total", "runs").alias("fluency_score"))


def daily_shown(days: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """The mean of the rounded scores of each day, as ``daily_fluency_rounded``."""
    mean = F.try_divide("shown", "sessions").alias("fluency_score")
    return days.where("sessions > 0").select(*series, F.date_format("processed_day", "yyyy-MM-dd").alias("day"), mean)


def kpis(days: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Latest score, mean number of fillers and number of sessions, as over all runs."""
    return days.where("sessions > 0").groupBy(*series).agg(
        F.max_by("last.fluency_score", F.struct("last.processed_at", "last.run_id")).alias("latest_fluency"),
        F.try_divide(F.sum("fillers"), F.sum("sessions")).alias("avg_fillers"),
        F.sum("sessions").alias("sessions"),
    )


def summary(days: DataFrame, series: tuple[str, ...] = (), horizon: int = HORIZON) -> DataFrame:
    """First and latest daily score, their difference, the days between them, and the last forecast, in one aggregate.

    The forecast is the line of ``forecast`` through the unrounded means, at its last day. A series too
    short for one keeps its row; one without sessions has none.
    """
    dated = days.where(F.col("processed_day").isNotNull())
    x, y = F.unix_date("processed_day"), F.try_divide("total", "runs")
    means = dated.select(*series, "processed_day", "sessions", x.alias("_x"), y.alias("_y"), F.try_divide("shown", "sessions").alias("_shown"))
    seen = F.when(F.col("sessions") > 0, F.col("processed_day"))
    both = means.groupBy(*series).agg(
        F.min_by("_shown", seen).alias("initial_fluency"),
        F.max_by("_shown", seen).alias("latest_fluency"),
        F.date_format(F.max(seen), "yyyy-MM-dd").alias("latest_day"),
        (F.count(seen) - 1).alias("days"),
        F.count("_y").alias("_n"),
        F.max(F.when(F.col("_y").isNotNull(), F.col("_x"))).alias("_last_x"),
        F.regr_avgx("_y", "_x").alias("_mean_x"),
        F.regr_avgy("_y", "_x").alias("_mean_y"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    ahead = F.col("_mean_y") + F.col("_sxy") / F.col("_sxx") * (F.col("_last_x") + horizon - F.col("_mean_x"))
    return both.where("days >= 0").select(
        *series,
        "initial_fluency",
        "latest_fluency",
        "latest_day",
        (F.col("latest_fluency") - F.col("initial_fluency")).alias("improvement"),
        "days",
        F.when((F.col("_n") >= 3) & (F.col("_sxx") > 0), ahead).alias("projected_fluency"),
    )
