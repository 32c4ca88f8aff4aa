"""Daily mean fluency as runs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluentrail.functions import scores
from fluentrail.operators.progress import daily_fluency, with_metric_fields
from fluentrail.sources import keyed, versions


def daily_fluency_stream(
    runs: DataFrame, series: tuple[str, ...] = (), delay: str = "1 day", metrics_col: str = "metrics"
) -> DataFrame:
    """The batch job ``daily_fluency`` on a stream, in append mode.

    A day comes out once the watermark has passed its end, and then for good; runs
    later than ``delay`` after that are left out (``keep_days`` takes them in). State is one row per series and
    open day. ``processed_at`` must be a timestamp with time zone.
    """
    parsed = with_metric_fields(
        runs.select(*series, "processed_at", metrics_col), {"_severity": "severity_score"}, metrics_col
    )
    return (
        parsed.select(*series, "processed_at", scores.fluency(F.col("_severity")).alias("_fluency"))
        .withWatermark("processed_at", delay)
        .groupBy(F.window("processed_at", "1 day"), *series)
        .agg(F.avg("_fluency").alias("fluency_score"))
        .select(*series, F.to_date("window.start").alias("processed_day"), "fluency_score")
    )


def write_days(daily: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a table, up to what is there now."""
    return (
        daily.writeStream.outputMode("append")
        .format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


DAY_TOTALS = "processed_day DATE, total DOUBLE, runs BIGINT"


def day_totals_stream(runs: DataFrame, series: tuple[str, ...] = (), metrics_col: str = "metrics") -> DataFrame:
    """Sum and number of the fluency scores per series and day, for update mode.

    The state is one row per series and day, of the size of the result, and has no watermark: a run of any
    day counts whenever it arrives. ``processed_day`` is null for runs without a time.
    """
    parsed = with_metric_fields(
        runs.select(*series, "processed_at", metrics_col), {"_severity": "severity_score"}, metrics_col
    )
    fluency = parsed.select(
        *series, F.to_date("processed_at").alias("processed_day"), scores.fluency(F.col("_severity")).alias("_fluency")
    )
    return fluency.groupBy(*series, "processed_day").agg(F.sum("_fluency").alias("total"), F.count("_fluency").alias("runs"))


def keep_day_totals(totals: DataFrame, table: str, checkpoint: str, series: tuple[str, ...] = ()) -> StreamingQuery:
    """Keep the totals of a stream in a table by series and day, up to what is there now.

    Each batch sets the rows of the series and days it touched. The state that the totals come from is that of the
    checkpoint, so a table is kept by one checkpoint; to start anew, start both anew.
    """
    schema = totals_schema(totals, series)
    if keyed.started(totals.sparkSession, table) and not versions.exists(totals.sparkSession, checkpoint):
        raise ValueError(f"{table} was kept by another checkpoint than {checkpoint}")
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: keyed.put_rows(batch, table, schema, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def totals_schema(rows: DataFrame, series: tuple[str, ...] = ()) -> str:
    return ", ".join([f"{name} {rows.schema[name].dataType.simpleString()}" for name in series] + [DAY_TOTALS])


def day_means(totals: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Daily mean fluency out of totals, equal to ``daily_fluency`` over all runs that have arrived."""
    mean = F.when(F.col("runs") > 0, F.col("total") / F.col("runs"))
    return totals.select(*series, "processed_day", mean.alias("fluency_score"))


def keep_days(
    arriving: DataFrame, runs: str, table: str, checkpoint: str, series: tuple[str, ...] = (), metrics_col: str = "metrics"
) -> StreamingQuery:
    """Keep a table of daily means equal to the batch job over all stored runs, open days and late runs too.

    ``arriving`` is a stream of the runs stored at ``runs``. Each batch works the days it touches out again from
    there and replaces them, one folder of the table a day; a batch that is tried again gives the same.
    """

    def update(batch: DataFrame, _: int) -> None:
        day = F.to_date("processed_at")
        touched = batch.select(day.alias("_day")).distinct()
        stored = batch.sparkSession.read.schema(arriving.schema).parquet(runs)
        own = stored.join(touched, day.eqNullSafe(F.col("_day")), "left_semi")
        days = daily_fluency(own, series, metrics_col)
        days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("processed_day").parquet(table)

    return (
        arriving.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
