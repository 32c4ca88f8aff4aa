"""Documents to chunks: by word count, or out of a parser's JSON answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.functions import text
from fluentrail.functions.embedding import hashed_embedding
from fluentrail.operators.words import unnest
from fluentrail.schemas import CHUNK_LIST
from fluentrail.session import once

# Fixed value: words per chunk.
CHUNK_SIZE = 200


def chunk_text(df: DataFrame, uri_col: str = "uri", text_col: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """Cut each text into chunks of ``size`` words, no overlap; a text without words has none."""
    words = df.select(F.col(uri_col).alias("uri"), text.split_words(F.col(text_col)).alias("_words"))
    n = F.size("_words")
    chunks = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))),
        lambda start, i: F.struct(
            F.concat(F.lit("c"), (i + 1).cast("string")).alias("chunk_id"),
            F.array_join(F.slice("_words", start, F.lit(size)), " ").alias("content"),
            F.lit(None).cast("bigint").alias("page_start"),
            F.lit(None).cast("bigint").alias("page_end"),
        ),
    )
    return unnest(words, ["uri"], chunks, "chunk_id")


def chunks_from_json(df: DataFrame, uri_col: str = "uri", result_col: str = "ml_process_document_result") -> DataFrame:
    """One row per chunk of a document parser's JSON answer; a file without chunks has none."""
    answer = F.from_json(F.col(result_col), f"chunkedDocument STRUCT<chunks: {CHUNK_LIST}>")
    parsed = df.select(F.col(uri_col).alias("uri"), answer["chunkedDocument"]["chunks"].alias("_chunks"))
    chunks = F.transform(
        "_chunks",
        lambda c, i: F.struct(
            i.alias("_place"),
            c["chunkId"].alias("chunk_id"),
            c["content"].alias("content"),
            c["pageSpan"]["pageStart"].try_cast("bigint").alias("page_start"),
            c["pageSpan"]["pageEnd"].try_cast("bigint").alias("page_end"),
        ),
    )
    return unnest(parsed, ["uri"], chunks, "_place").drop("_place")


def embed(df: DataFrame, text_col: str, vector_col: str) -> DataFrame:
    """Add the default embedding of a text column."""
    return once(df, **{vector_col: hashed_embedding(F.col(text_col))})
