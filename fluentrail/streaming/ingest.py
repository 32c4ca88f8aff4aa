"""Documents as they arrive: skip known files, chunk, embed, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fluentrail.operators.chunks import CHUNK_SIZE, chunk_text, embed
from fluentrail.schemas import DOCUMENT_EMBEDDINGS
from fluentrail.session import stored
from fluentrail.sources import known_files
from fluentrail.sources.tables import append_rows, one_per_key, set_apart


def embed_documents(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Rows of the document embeddings table for files with ``uri, text``; a projection and an unnest."""
    return embed(chunk_text(files, size=size), "content", "text_embeddings")


def ingest_batch(files: DataFrame, table: str, size: int = CHUNK_SIZE) -> None:
    """Append the chunks of the files that the table does not have yet, each file once.

    The index ``<table>-files`` says which those are: a batch reads the index folders of its own names, not the
    table. A file's chunks leave one task in one file, so the table has all of them or
    none, and a batch that is tried again adds only what is missing. Files without
    name are set apart unchunked; of several texts of one name the last counts. A file without words has no
    chunks and is known all the same.
    """
    spark, index = files.sparkSession, f"{table.rstrip('/')}-files"
    known_files.recover(spark, index, table, DOCUMENT_EMBEDDINGS)
    named = set_apart(files.select("uri", "text"), table, "uri")
    fresh = stored(one_per_key(known_files.unknown(named, index), "uri"), "fresh-files")
    known_files.begin(fresh, index)
    append_rows(embed_documents(fresh, size), table, DOCUMENT_EMBEDDINGS)
    known_files.finish(spark, index)


def ingest_stream(files: DataFrame, table: str, checkpoint: str, size: int = CHUNK_SIZE) -> StreamingQuery:
    """Run ``ingest_batch`` on every batch of a stream of ``uri, text``, up to what is there now.

    The index of the table tells which files are known, so the stream keeps no state that
    would grow with the number of files.
    """
    return (
        files.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, table, size))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
