"""File listings and the JSON files a user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.functions.text import content_type
from fluentrail.schemas import COURSES
from fluentrail.sources.versions import located

# File names taken as audio and as documents.
AUDIO = "*.{mp3,wav}"
DOCUMENTS = "*.pdf"


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder as ``uri, content_type, length, modified``; their contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.col("path").alias("uri"),
            content_type(F.col("path")).alias("content_type"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def list_audio(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, AUDIO)


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, DOCUMENTS)


def read_courses(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Courses of a JSON file; a missing key is null.

    A file that is one JSON array is read in one piece. A large catalogue is better
    kept as JSON lines, which split.
    """
    return spark.read.schema(COURSES).option("multiLine", not json_lines).json(path)


def read_practice_texts(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """A JSON file ``{category: [text, ...]}`` as ``category, pos, text``.

    Such a file is read in one piece. JSON lines ``{"category": ..., "texts": [...]}`` split.
    """
    if json_lines:
        lines = spark.read.schema("category STRING, texts ARRAY<STRING>").json(path)
        return lines.select("category", F.posexplode("texts").alias("pos", "text"))
    whole = spark.read.text(path, wholetext=True)
    by_category = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "texts"))
    return by_category.select("category", F.posexplode("texts").alias("pos", "text"))


def read_history(spark: SparkSession, path: str, series: tuple[str, ...] = ()) -> DataFrame:
    """The columns that progress reports need, of the analysis results or a history table; no others are read."""
    return spark.read.parquet(located(spark, path)).select("run_id", "metrics", "processed_at", *series)
