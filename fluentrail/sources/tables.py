"""Tables with fixed schemas: create, append, replace."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluentrail.schemas import HISTORY, WIDE_TABLES, conform
from fluentrail.session import WIDE, WRITTEN, stored
from fluentrail.sources import versions

# Fixed value: the time zone of the local time stamp.
LOCAL_ZONE = "Asia/Kolkata"


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table in its current version, or an empty one if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(versions.located(spark, path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """Make an empty table, unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append_rows(df: DataFrame, path: str, schema: str) -> None:
    """Add rows to the current version of a table."""
    conform(df, schema).write.mode("append").options(**_written(schema)).parquet(versions.located(df.sparkSession, path))


def replace_table(df: DataFrame, path: str, schema: str) -> None:
    """Make ``df`` the whole table, at once and only when all of it is written.

    It may be worked out from the table itself. What was there before stays on disk as an older version.
    """
    versions.publish(conform(df, schema), path, options=_written(schema))


def _written(schema: str) -> dict[str, str]:
    return WIDE if schema in WIDE_TABLES else WRITTEN


def set_apart(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of ``df`` with a key. Those without go to the table ``<path>-without-<key>``.

    Rows there are told apart by all their columns, so a second try adds nothing; equal ones count once.
    """
    apart, content = f"{path.rstrip('/')}-without-{key}", F.sha2(F.to_json(F.struct(*df.columns)), 256)
    have = read_table(df.sparkSession, apart, df.schema).select(content.alias("_content"))
    lost = df.where(F.col(key).isNull()).withColumn("_content", content).join(have, "_content", "left_anti")
    lost = lost.dropDuplicates(["_content"]).select(df.columns)
    if not lost.isEmpty():
        lost.write.mode("append").parquet(apart)
    return df.where(F.col(key).isNotNull())


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the one that is last in the order of its JSON text."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def not_stored(df: DataFrame, path: str, schema: str, key: str) -> DataFrame:
    """One row for each key of ``df`` that the table lacks, so that a second try adds nothing.

    Rows without key are set apart; of several with one key the last by its JSON text counts.
    The keys alone are counted and compared first: whole rows are moved only if some are known or repeated, and
    turned into text only if they are repeated.
    """
    have = read_table(df.sparkSession, path, schema).select(key).distinct().withColumn("_known", F.lit(True))
    rows = set_apart(df, path, key)
    keys = stored(rows.groupBy(key).agg(F.count("*").alias("_rows")).join(have, key, "left"), "keys")
    known, most = keys.agg(F.count("_known"), F.max(F.when(F.col("_known").isNull(), F.col("_rows")))).first()
    if most is None:  # nothing new
        return rows.where(F.lit(False))
    if most == 1 and not known:
        return rows
    fresh = keys.where(F.col("_known").isNull())
    single = rows.join(fresh.where(F.col("_rows") == 1), key, "left_semi").select(df.columns)
    if most == 1:
        return single
    return single.unionByName(one_per_key(rows.join(fresh.where(F.col("_rows") > 1), key, "left_semi"), key).select(df.columns))


def append_new(df: DataFrame, path: str, schema: str, key: str) -> None:
    append_rows(not_stored(df, path, schema, key), path, schema)


def history_rows(results: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """What reports read of the results: run, time and series, and the metrics as VARIANT; text that is no JSON gives none."""
    return results.select("run_id", "processed_at", F.try_parse_json("metrics").alias("metrics"), *series)


def append_history(results: DataFrame, path: str) -> None:
    """Add the runs of the results table that the history table at ``path`` lacks; runs without id are not in it.

    The metrics are parsed here, once; reports read their fields and parse no text.
    """
    have = read_table(results.sparkSession, path, HISTORY).select("run_id").distinct()
    named = results.where(F.col("run_id").isNotNull())
    append_rows(history_rows(named.join(have, "run_id", "left_anti")), path, HISTORY)


def run_id(uri_col: str = "uri"):
    """A run's key: the same for the same file whenever it is worked out."""
    return F.sha2(F.col(uri_col).cast("string"), 256)


def with_local_time(df: DataFrame, utc_col: str = "processed_at", local_col: str = "processed_at_ist") -> DataFrame:
    """Add the local time of a UTC time, without its zone."""
    utc = F.col(utc_col)
    if dict(df.dtypes)[utc_col] == "timestamp":
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), utc.cast("timestamp_ntz"))
    return df.withColumn(local_col, F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc))


def stamp_processed(df: DataFrame, at: datetime) -> DataFrame:
    """Add ``processed_at`` (``at``, a time with its zone) and the local time of it."""
    if at.tzinfo is None:
        raise ValueError("the time needs a zone")
    return with_local_time(df.withColumn("processed_at", F.lit(at)))


def split_courses(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Course rows fit to be stored, and the others with the reason.

    A row needs an id. The check that an id occurs once is ``repeated_courses``.
    """
    fit = F.col("course_id").isNotNull() & (F.trim("course_id") != "")
    return courses.where(fit), courses.where(~F.coalesce(fit, F.lit(False))).withColumn("reason", F.lit("no course_id"))


def repeated_courses(courses: DataFrame) -> DataFrame:
    """Course ids that occur more than once."""
    return courses.groupBy("course_id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
