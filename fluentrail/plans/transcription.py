"""Transcription as a job that can be run again and again.

A queue table has one row per audio file: waiting, done or failed, how often it was tried, and why it failed last. A run takes the
files that are new and those that failed, as long as they have tries left; files that are done are never tried
again. Answers are stored before the queue says so, so a run that ends early leaves files to be tried again, and the
transcripts of a file are stored once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.operators.incremental import split_transcripts
from fluentrail.operators.models import transcribe
from fluentrail.schemas import TRANSCRIPTS
from fluentrail.sources import keyed, versions
from fluentrail.sources.tables import append_rows, read_table, set_apart, stamp_processed

#: Tries of a file unless the caller says otherwise.
TRIES = 3
QUEUE = "uri STRING, content_type STRING, state STRING, tries INT, reason STRING, changed_at TIMESTAMP"
WAITING, DONE, FAILED = "waiting", "done", "failed"


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue of the job at ``path``: one row per file."""
    return keyed.read_keyed(spark, f"{path}/queue", QUEUE, ("uri",))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/transcripts", TRANSCRIPTS)


def add_to_queue(files: DataFrame, path: str, at: datetime) -> None:
    """Queue the files (``uri, content_type``) that the queue does not have; files without name are set apart."""
    spark = files.sparkSession
    named = set_apart(files.select("uri", "content_type"), f"{path}/queue", "uri")
    one = named.groupBy("uri").agg(F.max("content_type").alias("content_type"))
    fresh = one.join(read_queue(spark, path).select("uri"), "uri", "left_anti")
    rows = fresh.select("uri", "content_type", F.lit(WAITING).alias("state"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("reason"), F.lit(at).alias("changed_at"))
    keyed.put_rows(rows, f"{path}/queue", QUEUE, keyed.last_batch(spark, f"{path}/queue") + 1)


def run_queue(spark: SparkSession, path: str, make_recogniser: Callable[[], Callable], at: datetime, tries: int = TRIES) -> None:
    """Try every file that is waiting, or has failed fewer than ``tries`` times, once.

    The recogniser's answers are written to a folder of the run before anything else is made of them, so it is called once for a
    file and run. A run that is ended and started again under the same number goes on from that folder if it is whole.
    """
    queue = f"{path}/queue"
    number = keyed.last_batch(spark, queue) + 1
    due = read_queue(spark, path).drop("reason").where((F.col("state") == WAITING) | (F.col("state") == FAILED) & (F.col("tries") < tries))
    folder = f"{path}/answers/{number}"
    if not versions.exists(spark, f"{folder}/_SUCCESS"):
        # a model is paid by the file: what is done by now, in the transcripts, is not tried whatever the queue says
        open_files = due.join(read_transcripts(spark, path).select("uri"), "uri", "left_anti")
        work = open_files.select("uri", "content_type", "tries")
        transcribe(work, make_recogniser).write.mode("overwrite").parquet(folder)
    answers = spark.read.parquet(folder)
    worked, failed = split_transcripts(answers)
    stored = read_transcripts(spark, path).select("uri")
    append_rows(stamp_processed(worked.join(stored, "uri", "left_anti").drop("content_type", "tries"), at), f"{path}/transcripts", TRANSCRIPTS)
    reasons = failed.select("uri", "reason")
    done = due.join(read_transcripts(spark, path).select("uri", F.lit(True).alias("_done")).distinct(), "uri", "left").join(reasons, "uri", "left")
    rows = done.select(
        "uri",
        "content_type",
        F.when(F.col("_done"), DONE).otherwise(FAILED).alias("state"),
        (F.col("tries") + 1).alias("tries"),
        F.when(~F.coalesce("_done", F.lit(False)), F.coalesce("reason", F.lit("Unknown error"))).alias("reason"),
        F.lit(at).alias("changed_at"),
    )
    keyed.put_rows(rows, queue, QUEUE, number)
