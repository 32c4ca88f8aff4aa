"""Fixed table schemas as DDL text, and the check applied before a table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the stored tables.
TRANSCRIPTS = (
    "uri STRING, transcripts STRING, ml_transcribe_result STRING, ml_transcribe_status STRING, "
    "processed_at TIMESTAMP, processed_at_ist TIMESTAMP_NTZ"
)
WORDS = (
    "uri STRING, pos BIGINT, word STRING, start_time DOUBLE, end_time DOUBLE"
)
WORD_FLAGS = (
    "word STRING, start_time DOUBLE, end_time DOUBLE, pause DOUBLE, "
    "is_filler BOOLEAN, is_repetition BOOLEAN, is_prolongation BOOLEAN, is_block BOOLEAN"
)
METRICS = (
    "total_words BIGINT, total_duration_sec DOUBLE, speech_rate_wps DOUBLE, filler_count BIGINT, "
    "repetitions BIGINT, prolongations BIGINT, blocks BIGINT, long_pauses BIGINT, "
    "severity_score DOUBLE, severity_level STRING"
)
ANALYSIS_RESULTS = (
    "run_id STRING, transcript STRING, metrics STRING, therapy_plan STRING, words_df STRING, "
    "processed_at TIMESTAMP, transcript_embedding ARRAY<DOUBLE>"
)
#: Tables whose rows have all words of a recording as text.
WIDE_TABLES = (TRANSCRIPTS, ANALYSIS_RESULTS)
HISTORY = (
    "run_id STRING, processed_at TIMESTAMP, metrics VARIANT"
)
COURSES = (
    "course_id STRING, title STRING, description STRING, category STRING, url STRING"
)
COURSE_EMBEDDINGS = f"{COURSES}, course_embedding ARRAY<DOUBLE>"
CHUNKS = (
    "uri STRING, chunk_id STRING, content STRING, page_start BIGINT, page_end BIGINT"
)
DOCUMENT_EMBEDDINGS = f"{CHUNKS}, text_embeddings ARRAY<DOUBLE>"

# Shape of the recogniser's JSON answer and of a parsed document's chunk list.
TRANSCRIBE_RESULT = (
    "results MAP<STRING, STRUCT<inline_result: STRUCT<transcript: STRUCT<results: ARRAY<STRUCT<"
    "alternatives: ARRAY<STRUCT<words: ARRAY<STRUCT<"
    "word: STRING, start_offset: STRING, end_offset: STRING>>>>>>>>>>"
)
CHUNK_LIST = (
    "ARRAY<STRUCT<chunkId: STRING, content: STRING, pageSpan: STRUCT<pageStart: STRING, pageEnd: STRING>>>"
)
OLDER_ANALYSIS = (
    "transcript STRING, analysis STRUCT<"
    "stammer_count: INT, patterns: ARRAY<STRING>, suggestions: ARRAY<STRING>>"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order.

    Extra columns are dropped; a missing column or another type is an error, so
    that a table never changes its schema through an append.
    """
    wanted = T.StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in wanted.fields:
        if field.name not in have:
            raise ValueError(f"column {field.name} is missing")
        got, want = have[field.name], field.dataType
        if got.simpleString() != want.simpleString():
            raise ValueError(f"column {field.name} is {got.simpleString()}, not {want.simpleString()}")
    return df.select(*[F.col(f.name) for f in wanted.fields])
