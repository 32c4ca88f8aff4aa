"""Per-run metrics, severity, and the reports read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.functions import scores
from fluentrail.functions.binding import bind
from fluentrail.functions.text import number_text
from fluentrail.operators.disfluency import LONG_PAUSE, flag_counts, flag_fields, flag_words
from fluentrail.session import once

# What a report says about each pattern, and about none.
PATTERN_TEXTS = [
    ("filler_count", "Frequent filler words (uh, um, etc.)"),
    ("repetitions", "Word repetitions detected"),
    ("blocks", "Long pauses (>1.5s) detected"),
    ("prolongations", "Prolonged/stretched sounds detected"),
]
NO_PATTERN = "No major patterns detected."

# Exercises with their points, by severity (below the bound; the last has none).
EXERCISES = [
    (0.3, [("Read aloud a short story in 2 minutes.", 10), ("Explain your daily routine in 1 minute.", 15)]),
    (
        0.6,
        [
            ("Practice breathing pauses after every sentence.", 20),
            ("Read a paragraph avoiding filler words.", 25),
        ],
    ),
    (None, [("Repeat 5 tongue-twisters slowly, then faster.", 30), ("Record a 1-minute self-introduction.", 35)]),
]

PACKED = {"ignoreNullFields": "false"}

METRIC_NAMES = [
    "total_words",
    "total_duration_sec",
    "speech_rate_wps",
    "filler_count",
    "repetitions",
    "prolongations",
    "blocks",
    "long_pauses",
    "severity_score",
    "severity_level",
]


def _with_scores(counts: DataFrame) -> DataFrame:
    """Counts to metrics; a run without words keeps its row and has no metrics."""
    duration = F.col("_last_end") - F.col("_first_start")
    some = F.col("_n") > 0
    scored = counts.withColumn("total_words", F.when(some, F.col("_n")))
    for name in ("filler_count", "repetitions", "prolongations", "blocks"):
        scored = scored.withColumn(name, F.when(some, F.col(name)))
    return (
        scored.withColumn("long_pauses", F.col("blocks"))
        .withColumn("total_duration_sec", duration)
        .withColumn("speech_rate_wps", scores.speech_rate(F.col("total_words"), F.col("total_duration_sec")))
        .withColumn(
            "severity_score",
            scores.severity_score(
                F.col("blocks"), F.col("prolongations"), F.col("repetitions"), F.col("filler_count"), F.col("total_words")
            ),
        )
        .withColumn("severity_level", scores.severity_level(F.col("severity_score")))
        .drop("_n", "_last_end", "_first_start")
    )


def _counts(flags: Column) -> list[Column]:
    def trues(name: str) -> Column:
        column = flags[name]
        return (F.size(column) - F.size(F.array_remove(column, F.lit(True)))).cast("long")

    return [
        *_extent(flags),
        trues("is_filler").alias("filler_count"),
        trues("is_repetition").alias("repetitions"),
        trues("is_prolongation").alias("prolongations"),
        trues("is_block").alias("blocks"),
    ]


def _extent(words: Column) -> list[Column]:
    return [
        F.size(words).cast("long").alias("_n"),
        F.array_max(words["end_time"]).alias("_last_end"),
        F.array_min(words["start_time"]).alias("_first_start"),
    ]


def transcript_metrics(
    df: DataFrame, words_col: str = "words", packed_col: str | None = None, long_pause: float = LONG_PAUSE
) -> DataFrame:
    """Add the metrics of each transcript from its array of timed words; no shuffle.

    With ``packed_col`` the flagged words are added too, packed as JSON. The array of
    flags itself is not kept, which spares writing it out between two steps.
    """

    words = F.col(words_col)
    if packed_col is None:
        found = F.struct(*_extent(words), *flag_counts(words, long_pause))
    else:
        found = bind(flag_words(words, long_pause), lambda flags: F.struct(*_counts(flags), pack_words(flags).alias(packed_col)))
    # Worked out once, which also keeps the loops over the array out of the code generated for
    # later columns: a generated method that grows too long is never compiled.
    counted = once(df, _found=found).select(*df.columns, "_found.*")
    kept = df.columns if packed_col is None else [*df.columns, packed_col]
    return _with_scores(counted).select(*kept, *METRIC_NAMES)


def word_metrics(flags: DataFrame, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Metrics per run from flagged word rows, summed up before the shuffle."""
    counts = flags.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.max("end_time").alias("_last_end"),
        F.min("start_time").alias("_first_start"),
        F.count_if("is_filler").alias("filler_count"),
        F.count_if("is_repetition").alias("repetitions"),
        F.count_if("is_prolongation").alias("prolongations"),
        F.count_if("is_block").alias("blocks"),
    )
    return _with_scores(counts).select(*keys, *METRIC_NAMES)


def metrics_json() -> Column:
    """The metrics columns of a run as one JSON text; ``{}`` for a run without words."""
    return F.to_json(F.struct(*METRIC_NAMES))


def pack_words(flags: Column) -> Column:
    """The flagged words of a run as one JSON array of records, nulls included.

    Pauses keep ten decimals; offsets never have more.
    """

    fields = ("word", "start_time", "end_time", "pause", "is_filler", "is_repetition", "is_prolongation", "is_block")
    return F.to_json(F.transform(flags, lambda f: F.struct(*_record([f[name].alias(name) for name in fields]))), PACKED)


def _record(fields: list[Column]) -> list[Column]:
    word, start, end, pause, *flags = fields
    return [word, start, end, F.round(pause, 10).alias("pause"), *flags]


def packed(words: Column, long_pause: float = LONG_PAUSE) -> Column:
    """``pack_words`` of ``flag_words``, each record made in one go."""
    return F.to_json(F.transform(words, lambda w, i: F.struct(*_record(flag_fields(words, w, i, long_pause)))), PACKED)


def metrics_long(metrics: DataFrame, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Metrics as ``keys, metric, value`` rows, values as text."""
    types = dict(metrics.dtypes)
    texts = metrics.select(
        *keys,
        *[
            (number_text(F.col(name)) if types[name] == "double" else F.col(name).cast("string")).alias(name)
            for name in METRIC_NAMES
        ],
    )
    return texts.unpivot(list(keys), METRIC_NAMES, "metric", "value")


def patterns() -> Column:
    """The texts of the patterns a run shows, or the one text that says there are none."""
    found = F.array_compact(F.array(*[F.when(F.col(name) > 0, text) for name, text in PATTERN_TEXTS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_PATTERN)))


def exercises(runs: DataFrame, severity_col: str = "severity_score") -> DataFrame:
    """One row per exercise of each run's severity tier; a missing severity counts as 0.

    The tiers are a fixed list, so they are chosen in the row, not joined.
    """
    severity = F.coalesce(F.col(severity_col), F.lit(0.0))

    def tier(number: int) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(number).alias("tier"),
                    F.lit(place).alias("exercise"),
                    F.lit(task).alias("task"),
                    F.lit(points).alias("points"),
                )
                for place, (task, points) in enumerate(EXERCISES[number][1], start=1)
            ]
        )

    chosen = F.when(severity < EXERCISES[0][0], tier(0)).when(severity < EXERCISES[1][0], tier(1)).otherwise(tier(2))
    return runs.select("*", F.inline(chosen))
