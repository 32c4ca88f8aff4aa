"""How the given tables stand in for speech data.

Documents are recordings (their words get made-up times), events are the history
of runs, part is the course catalogue, conversations are practice texts, benchmark
holds questions, and embeddings are those of past cases.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.functions.text import split_words
from fluentrail.operators.words import WORD_ARRAY
from fluentrail.schemas import TRANSCRIPTS
from fluentrail.session import scratch_path, spread
from fluentrail.sources.tables import append_rows, read_table, stamp_processed


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """``uri, text`` of each document, and more of its columns."""
    rows = spread(table(spark, sf, "documents", "doc_id", "text", *more))
    return rows.select("doc_id", _uri().alias("uri"), "text", *more)


def _uri() -> Column:
    return F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))


def _start_ms(pos: Column) -> Column:
    """Word ``pos`` starts every 400 ms, with 1,600 ms more after each g-th word, g between 10 and 50."""
    g = F.lit(10) + F.col("doc_id") % 41
    return F.lit(400) * pos + F.lit(1600) * F.floor(pos / g)


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """``uri, transcript, words`` of each document; a word lasts 300 ms."""

    def timed(word: Column, pos: Column) -> Column:
        return F.struct(
            word.alias("word"),
            (_start_ms(pos) / 1000.0).alias("start_time"),
            ((_start_ms(pos) + 300) / 1000.0).alias("end_time"),
        )

    words = F.transform(split_words(F.col("text")), timed).cast(WORD_ARRAY)
    return documents(spark, sf).select("uri", F.col("text").alias("transcript"), words.alias("words"))


def transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser answers with the same words: ``uri, transcripts, ml_transcribe_result``, 50 words to a result."""

    def seconds(ms: Column) -> Column:
        return F.concat((ms.cast("decimal(18,0)") / 1000).cast("decimal(18,3)").cast("string"), F.lit("s"))

    offsets = F.transform(
        split_words(F.col("text")),
        lambda word, pos: F.struct(
            word.alias("word"),
            seconds(_start_ms(pos)).alias("start_offset"),
            seconds(_start_ms(pos) + 300).alias("end_offset"),
        ),
    )
    n = F.size("_words")
    results = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n, F.lit(50))),
        lambda start: F.struct(
            F.array(F.struct(F.slice("_words", start, F.lit(50)).alias("words"))).alias("alternatives")
        ),
    )
    inline = F.struct(F.struct(F.struct(results.alias("results")).alias("transcript")).alias("inline_result"))
    return (
        documents(spark, sf)
        .withColumn("_words", offsets)
        .select(
            "uri",
            F.col("text").alias("transcripts"),
            F.to_json(F.struct(F.create_map(F.col("uri"), inline).alias("results"))).alias("ml_transcribe_result"),
        )
    )


def stored_transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    """The recogniser answers stamped, appended to a table, and read from there."""
    path = scratch_path(spark, "transcripts")
    answers = transcriptions(spark, sf).withColumn("ml_transcribe_status", F.lit(""))
    append_rows(stamp_processed(answers, datetime(2024, 1, 31, 12, tzinfo=UTC)), path, TRANSCRIPTS)
    return spread(read_table(spark, path, TRANSCRIPTS))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs_of(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props"))


def runs_of(events: DataFrame) -> DataFrame:
    """History out of events: ``run_id, processed_at, user_id, metrics`` (JSON text).

    Severity is k / 100. Runs of type ``error`` have no metrics, those of type
    ``view`` a severity that is no number; both count as 0.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    severity = (
        F.when(F.col("event_type") == "view", F.lit('"n/a"'))
        .otherwise((k.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string"))
    )
    metrics = F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(
        F.concat(
            F.lit('{"severity_score": '),
            severity,
            F.lit(', "filler_count": '),
            k.cast("string"),
            F.lit(', "total_words": '),
            F.col("event_id").cast("string"),
            F.lit("}"),
        )
    )
    return events.select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("processed_at"), "user_id", metrics.alias("metrics")
    )


def courses(spark: SparkSession, sf: str) -> DataFrame:
    """Courses out of part."""
    return spread(table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")).select(
        F.col("p_partkey").cast("string").alias("course_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("category"),
        F.concat(F.lit("https://courses.example/"), F.col("p_partkey").cast("string")).alias("url"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
