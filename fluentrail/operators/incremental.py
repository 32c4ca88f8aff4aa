"""Which files are new, and which transcriptions worked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processed_files(done: DataFrame) -> DataFrame:
    """The distinct files of a table that has many rows per file."""
    return done.select("uri").distinct()


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files with no row in ``done``. Its rows are reduced to distinct files before the shuffle,
    so a file with very many rows weighs no more than any other."""
    return files.join(processed_files(done), "uri", "left_anti")


def wanted_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the files asked for, to be taken before a model sees any file."""
    return files.join(wanted.select("uri").distinct(), "uri", "left_semi")


def split_transcripts(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcribed rows, and failed ones as ``uri, reason``."""
    worked = F.col("transcripts").isNotNull()
    failed = transcripts.where(~worked).select(
        "uri", F.coalesce("ml_transcribe_status", F.lit("Unknown error")).alias("reason")
    )
    return transcripts.where(worked), failed
