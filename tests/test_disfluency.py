import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluentrail.functions import text
from fluentrail.operators import disfluency, metrics, words
from fluentrail.operators.words import WORD_ARRAY

FLAGS = ["is_filler", "is_repetition", "is_prolongation", "is_block"]


def transcripts(spark, **files):
    return spark.createDataFrame(list(files.items()), f"uri STRING, words {WORD_ARRAY}")


def spoken(*said, step=0.5, length=0.3):
    return [(w, i * step, i * step + length) for i, w in enumerate(said)]


def flags_of(spark, timed, **options):
    rows = disfluency.explode_flags(disfluency.annotate_transcripts(transcripts(spark, f=timed), **options))
    return rows.orderBy("pos").collect()


def expected(timed, long_pause=1.5):
    """The flags of one file, word by word."""
    rows = []
    for i, (word, _, end) in enumerate(timed):
        pause = timed[i + 1][1] - end if i + 1 < len(timed) else None
        rows.append(
            (
                word.lower().strip(",.") in {"uh", "um", "ah", "er", "hmm"},
                i > 0 and timed[i - 1][0] == word,
                re.match(r"([a-z])\1{2,}", word, re.IGNORECASE) is not None,
                pause is not None and pause > long_pause,
            )
        )
    return rows


def test_fillers(spark):
    said = ["Um,", ".uh.", "um?", "hmm", "ER", "era", ",.ah.,", "a,h"]
    rows = flags_of(spark, spoken(*said))
    assert [r.word for r in rows if r.is_filler] == ["Um,", ".uh.", "hmm", "ER", ",.ah.,"]


def test_repetitions_are_exact(spark):
    rows = flags_of(spark, spoken("The", "the", "I,", "I", "I", "no", "no", "no"))
    assert [r.pos for r in rows if r.is_repetition] == [4, 6, 7]


def test_prolongations_look_at_the_raw_start(spark):
    rows = flags_of(spark, spoken("Sssso", "brrr", '"aaah', "aaab", "aab", "111", "ééé", "AaA"))
    assert [r.word for r in rows if r.is_prolongation] == ["Sssso", "aaab", "AaA"]


def test_blocks_are_strict_and_the_last_word_has_none(spark):
    timed = [("a", 0.0, 0.5), ("b", 2.0, 2.5), ("c", 4.25, 5.0)]
    rows = flags_of(spark, timed)
    assert [r.pause for r in rows] == [1.5, 1.75, None]
    assert [r.is_block for r in rows] == [False, True, False]
    assert [r.is_block for r in flags_of(spark, timed, long_pause=1.4)] == [True, True, False]


def test_words_out_of_time_order_keep_their_place(spark):
    rows = flags_of(spark, [("a", 5.0, 6.0), ("b", 1.0, 2.0), ("c", 9.0, 9.5)])
    assert [r.word for r in rows] == ["a", "b", "c"]
    assert [r.pause for r in rows] == [-5.0, 7.0, None]


def test_files_do_not_touch(spark):
    df = transcripts(spark, f=spoken("a", "same"), g=spoken("same", "b"))
    rows = disfluency.explode_flags(disfluency.annotate_transcripts(df)).where("is_repetition").collect()
    assert rows == []
    cut = disfluency.annotate_words(words.explode_words(df), block_rows=1).where("is_repetition").collect()
    assert cut == []


def test_empty_transcript_keeps_its_row_without_metrics(spark):
    df = transcripts(spark, f=[], g=spoken("a"))
    found = {r.uri: r for r in metrics.transcript_metrics(df).collect()}
    assert all(found["f"][name] is None for name in metrics.METRIC_NAMES)
    assert found["g"].total_words == 1 and found["g"].severity_score == 0.0
    assert found["g"].severity_level == "Mild"


def test_one_word_and_no_duration(spark):
    df = transcripts(spark, f=[("a", 1.0, 1.0)], g=[("a", 2.0, 1.0)])
    found = {r.uri: r for r in metrics.transcript_metrics(df).collect()}
    assert found["f"].speech_rate_wps == 0.0 and found["g"].speech_rate_wps == 0.0
    assert found["g"].total_duration_sec == -1.0


def test_a_word_counts_once_per_flag(spark):
    timed = [("um", 0.0, 0.1), ("um", 0.2, 0.3), ("go", 3.0, 3.1)]
    run = metrics.transcript_metrics(transcripts(spark, f=timed)).first()
    assert (run.filler_count, run.repetitions, run.blocks, run.long_pauses) == (2, 1, 1, 1)
    assert run.severity_score == pytest.approx((3 + 1.5 + 2) / 3)
    assert run.severity_level == "Severe"


def test_highlight_priority(spark):
    row = dict.fromkeys(FLAGS, False)
    cases = [
        ({**row, "is_filler": True, "is_repetition": True}, "yellow"),
        ({**row, "is_repetition": True, "is_block": True}, "orange"),
        ({**row, "is_block": True, "is_prolongation": True}, "red"),
        ({**row, "is_prolongation": True}, "lightblue"),
        (row, None),
    ]
    schema = ", ".join(f"{name} BOOLEAN" for name in FLAGS)
    df = spark.createDataFrame([(i, *c.values()) for i, (c, _) in enumerate(cases)], f"i INT, {schema}")
    got = disfluency.highlight(df).orderBy("i").collect()
    assert [r.highlight for r in got] == [colour for _, colour in cases]


WORD = st.sampled_from(["um", "Um,", "a", "aaa", "the", "the", "sss", "x."])
FILE = st.lists(st.tuples(WORD, st.integers(0, 60), st.integers(0, 20)), max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(files=st.lists(FILE, min_size=1, max_size=4), block_rows=st.integers(1, 7))
def test_both_ways_agree_with_the_rules(spark, files, block_rows):
    timed = {f"f{i}": [(w, s / 10, s / 10 + d / 10) for w, s, d in f] for i, f in enumerate(files)}
    df = transcripts(spark, **timed)
    in_row = disfluency.explode_flags(disfluency.annotate_transcripts(df))
    by_rows = disfluency.annotate_words(words.explode_words(df).repartition(3), block_rows=block_rows)
    for flagged in (in_row, by_rows):
        got = {name: [] for name in timed}
        for r in flagged.orderBy("uri", "pos").collect():
            got[r.uri].append(tuple(r[name] for name in FLAGS))
        assert got == {name: expected(said) for name, said in timed.items()}
    once = {r.uri: r.asDict() for r in metrics.transcript_metrics(df).drop("words").collect()}
    summed = {r.uri: r.asDict() for r in metrics.word_metrics(by_rows).collect()}
    assert summed == {uri: run for uri, run in once.items() if timed[uri]}


def test_prolongation_like_python(spark):
    said = ["sss", "SsS", "ſss", "KKk", "ııı", "aab", "zzzz", "", "éée", "a aa", "bbB!"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(said)], "i INT, w STRING").orderBy("i")
    got = [r.p for r in df.select("i", text.is_prolongation(F.col("w")).alias("p")).orderBy("i").collect()]
    assert got == [re.match(r"([a-zA-Z])\1{2,}", w, re.IGNORECASE) is not None for w in said]


def test_the_flags_are_worked_out_once(spark):
    df = transcripts(spark, f=spoken("a"))
    severe = metrics.transcript_metrics(df).where("severity_score > 0.1").select("uri", "severity_level")
    blocks = disfluency.explode_flags(disfluency.annotate_transcripts(df)).where("is_block").select("uri", "pos")
    for found in (severe, blocks):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("RLIKE(") == 1 and "Exchange" not in plan


def test_one_long_file_is_cut(spark):
    rows = spark.range(1000).selectExpr("'f' AS uri", "id AS pos", "'w' AS word", "id * 1.0D AS start_time", "id + 0.5D AS end_time")
    flagged = disfluency.annotate_words(rows, block_rows=10)
    assert "Window" in flagged._jdf.queryExecution().executedPlan().toString()
    run = metrics.word_metrics(flagged).first()
    assert (run.total_words, run.repetitions, run.blocks) == (1000, 999, 0)


def test_flag_rows_are_the_exploded_flags(spark):
    said = spoken("um", "Um,", "um", "sooo", "sss", None, None, "end", step=1.0)
    files = {"a": said, "b": [], "c": None, "d": spoken("one"), "e": [None, *spoken("uh", "uh"), None], "f": spoken("x", "x", step=2.0)}
    df = transcripts(spark, **files)
    rows = disfluency.flag_rows(df)
    before = disfluency.explode_flags(disfluency.annotate_transcripts(df))
    assert rows.dtypes == before.dtypes
    assert rows.orderBy("uri", "pos").collect() == before.orderBy("uri", "pos").collect()
    assert rows.count() == len(said) + 1 + 4 + 2


def test_word_rows_are_made_by_generated_code(spark, sf):
    from catalogue.queries import QUERIES

    for name, wanted in (("words_from_text", 1), ("disfluency_flags", 1)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        # one function over an array: the one that makes the given words
        assert plan.count("transform(") == wanted, name
