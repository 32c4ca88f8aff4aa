"""Disfluency flags of words: fillers, repetitions, prolongations, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluentrail.functions import text
from fluentrail.operators.words import numbered, unnest
from fluentrail.session import once

# Fixed value: a pause longer than this many seconds is a block.
LONG_PAUSE = 1.5

# Display colours by flag, first match wins.
HIGHLIGHTS = [
    ("is_filler", "yellow"),
    ("is_repetition", "orange"),
    ("is_block", "red"),
    ("is_prolongation", "lightblue"),
]

BLOCK_ROWS = 100_000


def _flags(word: Column, start: Column, end: Column, previous: Column, next_start: Column, long_pause: float) -> list[Column]:
    pause = next_start - end
    return [
        word.alias("word"),
        start.alias("start_time"),
        end.alias("end_time"),
        pause.alias("pause"),
        F.coalesce(text.is_filler(word), F.lit(False)).alias("is_filler"),
        F.coalesce(word == previous, F.lit(False)).alias("is_repetition"),
        F.coalesce(text.is_prolongation(word), F.lit(False)).alias("is_prolongation"),
        F.coalesce(pause > F.lit(long_pause), F.lit(False)).alias("is_block"),
    ]


def flag_words(words: Column, long_pause: float = LONG_PAUSE) -> Column:
    """The flagged words of one transcript, from its array of timed words.

    The neighbours of a word sit in the same array, one place before and after, so
    no window and no exchange is needed, however long a recording is.
    """
    return F.transform(
        words,
        lambda w, i: F.struct(
            i.cast("long").alias("pos"),
            *flag_fields(words, w, i, long_pause),
        ),
    )


def flag_fields(words: Column, w: Column, i: Column, long_pause: float = LONG_PAUSE) -> list[Column]:
    """The word ``w`` at place ``i`` of an array of timed words, and its flags."""
    return _flags(w["word"], w["start_time"], w["end_time"], _previous(words, i), _next_start(words, i), long_pause)


def _previous(words: Column, i: Column) -> Column:
    return F.get(words, i - 1)["word"]


def _next_start(words: Column, i: Column) -> Column:
    return F.get(words, i + 1)["start_time"]


def flag_counts(words: Column, long_pause: float = LONG_PAUSE) -> list[Column]:
    """How many words of one transcript have each flag, without a record for each word."""

    def found(flag) -> Column:
        return F.size(F.filter(words, flag)).cast("long")

    return [
        found(lambda w: text.is_filler(w["word"])).alias("filler_count"),
        found(lambda w, i: w["word"] == _previous(words, i)).alias("repetitions"),
        found(lambda w: text.is_prolongation(w["word"])).alias("prolongations"),
        found(lambda w, i: _next_start(words, i) - w["end_time"] > F.lit(long_pause)).alias("blocks"),
    ]


def annotate_transcripts(df: DataFrame, words_col: str = "words", flags_col: str = "flags", long_pause: float = LONG_PAUSE) -> DataFrame:
    """Add the flagged words of each transcript as an array."""
    return once(df, **{flags_col: flag_words(F.col(words_col), long_pause)})


def flag_rows(df: DataFrame, uri_col: str = "uri", words_col: str = "words", long_pause: float = LONG_PAUSE) -> DataFrame:
    """One row per flagged word, ``uri, pos`` and the flags: ``explode_flags`` of ``annotate_transcripts``.

    Each word is put beside the one before and the next start first, so its neighbours need no window, a row
    holds no array, and all of it runs as generated code.
    """
    words = F.col(words_col)
    size = F.size(words)
    beside = df.select(
        F.col(uri_col).alias("uri"),
        words.alias("_words"),
        F.slice(F.concat(F.array(F.lit(None).cast("string")), words["word"]), F.lit(1), size).alias("_previous"),
        F.slice(words["start_time"], F.lit(2), size).alias("_next_start"),
    )
    rows = numbered(beside.withColumn("_beside", F.arrays_zip("_words", "_previous", "_next_start")), ["uri"], "_beside")
    word, pos = F.col("_word._words"), F.col("_pos").cast("long")
    flags = _flags(word["word"], word["start_time"], word["end_time"], F.col("_word._previous"), F.col("_word._next_start"), long_pause)
    return rows.select("uri", pos.alias("pos"), *flags)


def explode_flags(df: DataFrame, uri_col: str = "uri", flags_col: str = "flags") -> DataFrame:
    """One row per flagged word: ``uri, pos`` and the flags."""
    return unnest(df, [F.col(uri_col).alias("uri")], F.col(flags_col), "pos")


def annotate_words(words: DataFrame, long_pause: float = LONG_PAUSE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flag the rows of a stored word table (``uri, pos, word, start_time, end_time``).

    ``pos`` counts from 0 without gaps within a file. A file is cut into blocks of
    ``block_rows`` positions, so one long file never lands in one task. The first
    and last row of a block also go to the neighbouring block, where they only
    serve as neighbour, so the cut does not show in the result.
    """
    pos, block = F.col("pos"), F.floor(F.col("pos") / F.lit(block_rows))
    inside = pos % F.lit(block_rows)
    homes = F.array_compact(
        F.array(
            block,
            F.when((inside == 0) & (pos > 0), block - 1),
            F.when(inside == block_rows - 1, block + 1),
        )
    )
    spread = words.select(*words.columns, F.explode(homes).alias("_block"))
    window = Window.partitionBy("uri", "_block").orderBy("pos")
    linked = spread.withColumn("_previous", F.lag("word").over(window)).withColumn(
        "_next_start", F.lead("start_time").over(window)
    )
    return linked.where(F.col("_block") == block).select(
        "uri",
        "pos",
        *_flags(
            F.col("word"), F.col("start_time"), F.col("end_time"), F.col("_previous"), F.col("_next_start"), long_pause
        ),
    )


def highlight(flags: DataFrame) -> DataFrame:
    """Add the display colour of a flagged word: filler, repetition, block, prolongation, in this order."""
    (first, colour), *rest = HIGHLIGHTS
    label = F.when(F.col(first), colour)
    for flag, colour in rest:
        label = label.when(F.col(flag), colour)
    return flags.withColumn("highlight", label)
