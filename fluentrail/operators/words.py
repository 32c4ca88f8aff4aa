"""Word timings out of recogniser JSON, and out of plain text.

A transcript stays one row with an array of words for as long as possible: the
order of the words is the order of the array, and no shuffle is needed to look
at a word's neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.functions import text
from fluentrail.functions.binding import bind
from fluentrail.schemas import TRANSCRIBE_RESULT

WORD_ARRAY = "array<struct<word:string,start_time:double,end_time:double>>"


def parse_transcripts(df: DataFrame, result_col: str = "ml_transcribe_result", words_col: str = "words") -> DataFrame:
    """Add the timed words of each recogniser answer, in the answer's order.

    Only the first entry under ``results`` and the first alternative of each
    result count. A result without words is passed over. The first bad word (a
    missing part, or an offset that is no number) ends its own file: the words
    before it stay. An empty, null or broken answer has no words; its row stays.
    """
    answer = F.from_json(F.col(result_col), TRANSCRIBE_RESULT)
    results = F.get(F.map_values(answer["results"]), F.lit(0))["inline_result"]["transcript"]["results"]
    nothing = F.array().cast("array<struct<word:string,start_offset:string,end_offset:string>>")
    no_word = F.array(F.lit(None).cast("struct<word:string,start_offset:string,end_offset:string>"))
    raw = F.flatten(
        F.transform(
            results,
            lambda r: F.when(r.isNull(), no_word).otherwise(
                F.coalesce(F.get(r["alternatives"], F.lit(0))["words"], nothing)
            ),
        )
    )
    timed = F.transform(
        raw,
        lambda w: F.struct(
            w["word"].alias("word"),
            text.offset_seconds(w["start_offset"]).alias("start_time"),
            text.offset_seconds(w["end_offset"]).alias("end_time"),
        ),
    )
    none = F.array().cast(WORD_ARRAY)
    return df.withColumn(words_col, F.coalesce(bind(timed, _before_first_bad), none))


def _before_first_bad(timed: Column) -> Column:
    def bad(w: Column) -> Column:
        return w["word"].isNull() | w["start_time"].isNull() | w["end_time"].isNull()

    first_bad = F.array_position(F.transform(timed, bad), F.lit(True)).cast("int")
    return F.when(F.exists(timed, bad), F.slice(timed, F.lit(1), first_bad - 1)).otherwise(timed)


def with_result(df: DataFrame, result_col: str = "ml_transcribe_result") -> DataFrame:
    """Only the rows whose recogniser answer is neither null nor empty."""
    return df.where(F.col(result_col).isNotNull() & (F.col(result_col) != ""))


def unnest(df: DataFrame, keep: list, items: Column, present: str) -> DataFrame:
    """One row per struct of an array, next to the columns ``keep``; no row for an empty array.

    ``inline_outer`` and a later filter on the field ``present``, which no struct
    lacks: for a plain ``explode`` or ``inline`` of a computed column, the optimizer
    infers a filter on the array's size and pushes it to the scan, where the whole
    computation then runs several times over.
    """
    return df.select(*keep, F.inline_outer(items)).where(F.col(present).isNotNull())


def numbered(df: DataFrame, keep: list, words_col: str = "words") -> DataFrame:
    """One row per word, ``_pos`` from 0 and the word as ``_word``, next to the columns ``keep``.

    What is made of such rows runs as generated code, a function over an array does not. A null place in the
    array is a row; ``posexplode_outer`` and the filter as in ``unnest``.
    """
    return df.select(*keep, F.posexplode_outer(words_col).alias("_pos", "_word")).where(F.col("_pos").isNotNull())


def explode_words(df: DataFrame, uri_col: str = "uri", words_col: str = "words") -> DataFrame:
    """One row per word: ``uri, pos, word, start_time, end_time``, ``pos`` from 0 within its file."""
    rows = numbered(df, [F.col(uri_col).alias("uri")], words_col)
    return rows.select("uri", F.col("_pos").cast("long").alias("pos"), "_word.word", "_word.start_time", "_word.end_time")
