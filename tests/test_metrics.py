import json
import random

from pyspark.sql import functions as F

from fluentrail.functions import scores
from fluentrail.operators import disfluency, metrics
from fluentrail.operators.words import WORD_ARRAY
from fluentrail.plans import prompts

RUN = "uri STRING, total_words BIGINT, total_duration_sec DOUBLE, speech_rate_wps DOUBLE, filler_count BIGINT, repetitions BIGINT, prolongations BIGINT, blocks BIGINT, long_pauses BIGINT, severity_score DOUBLE, severity_level STRING"


def runs(spark, *severities, fillers=0):
    rows = [(f"f{i}", 10, 5.0, 2.0, fillers, 0, 0, 0, 0, s, "x") for i, s in enumerate(severities)]
    return spark.createDataFrame(rows, RUN)


def test_cuts(spark):
    cuts = [0.0, 0.0999, 0.1, 0.2, 0.2499, 0.25, 0.3, 0.6, 2.0, None]
    df = runs(spark, *cuts)
    level = [r[0] for r in df.orderBy("uri").select(scores.severity_level(F.col("severity_score"))).collect()]
    assert level == ["Mild"] * 2 + ["Moderate"] * 3 + ["Severe"] * 4 + [None]
    track = [r[0] for r in df.orderBy("uri").select(prompts.plan_track()).collect()]
    assert track == ["light"] * 3 + ["full"] * 6 + [None]
    assert [r[0] for r in runs(spark, 0.1, fillers=1).select(prompts.plan_track()).collect()] == ["full"]
    tiers = {}
    for r in metrics.exercises(df).collect():
        tiers.setdefault(r.uri, []).append((r.tier, r.points))
    assert [tiers[f"f{i}"][0][0] for i in range(10)] == [0, 0, 0, 0, 0, 0, 1, 2, 2, 0]
    assert sorted(tiers["f0"]) == [(0, 10), (0, 15)] and sorted(tiers["f8"]) == [(2, 30), (2, 35)]


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    values = [k / 8 for k in range(-900, 900)] + [k / 20 for k in range(-2100, 2100)]
    values += [rng.uniform(-300, 100) for _ in range(2000)] + [0.35, 0.25, 87.25, 87.35, 2.675, 1e-20, -0.05, 0.05]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    got = [r.x for r in df.select("i", scores.round_one_decimal(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [round(v, 1) + 0.0 for v in values]


def test_fluency_may_be_negative(spark):
    row = runs(spark, 1.5).select(
        scores.fluency(F.col("severity_score")), scores.fluency_rounded(F.col("severity_score"))
    ).first()
    assert tuple(row) == (-50.0, -50.0)


def test_patterns(spark):
    rows = [("a", 1, 0, 0, 0), ("b", 0, 2, 3, 4), ("c", 0, 0, 0, 0), ("d", None, None, None, None)]
    df = spark.createDataFrame(rows, "uri STRING, filler_count BIGINT, repetitions BIGINT, blocks BIGINT, prolongations BIGINT")
    got = {r.uri: r.p for r in df.select("uri", metrics.patterns().alias("p")).collect()}
    texts = [text for _, text in metrics.PATTERN_TEXTS]
    assert got == {"a": texts[:1], "b": texts[1:], "c": [metrics.NO_PATTERN], "d": [metrics.NO_PATTERN]}


def test_packed_words_read_back(spark):
    timed = [('say "hi"\\', 0.0, 0.1), ("naïve\n", 0.3, 0.6)]
    df = spark.createDataFrame([("f", timed)], f"uri STRING, words {WORD_ARRAY}")
    packed = disfluency.annotate_transcripts(df).select(metrics.pack_words(F.col("flags"))).first()[0]
    records = json.loads(packed)
    assert [r["word"] for r in records] == ['say "hi"\\', "naïve\n"]
    assert [r["pause"] for r in records] == [0.2, None]
    assert list(records[0]) == [
        "word", "start_time", "end_time", "pause", "is_filler", "is_repetition", "is_prolongation", "is_block",
    ]


def test_long_form(spark):
    rows = {r.metric: r.value for r in metrics.metrics_long(runs(spark, 0.25)).collect()}
    assert list(rows) == metrics.METRIC_NAMES
    assert rows["total_words"] == "10" and rows["severity_score"] == "0.25" and rows["speech_rate_wps"] == "2.0"
    empty = metrics.metrics_long(runs(spark, None)).where("metric = 'severity_score'").first()
    assert empty.value is None


def test_long_form_numbers_like_python(spark):
    values = [5e-05, 0.00012345, -0.0005, 0.001, 0.1, 1.0, 123456.789, 9999999.5, 12345678.25, -1e7, 1e15, 1.5e16, 0.0, 1.25e-7]
    rows = [(f"f{i:02d}", 10, value, 2.0, 0, 0, 0, 0, 0, 0.0, "x") for i, value in enumerate(values)]
    long = metrics.metrics_long(spark.createDataFrame(rows, RUN)).where("metric = 'total_duration_sec'")
    assert [r.value for r in long.orderBy("uri").collect()] == [str(v) for v in values]


def test_prompt_names_the_track(spark):
    df = runs(spark, 0.0, 0.5).withColumn("transcript", F.lit("some words"))
    rows = prompts.therapy_prompts(df).orderBy("uri").collect()
    assert [r.plan_track for r in rows] == ["light", "full"]
    for r, severity in zip(rows, ("0.000000", "0.500000")):
        assert "some words" in r.prompt and f'"severity_score":{severity}' in r.prompt
        assert prompts.PLAN_STEPS[r.plan_track] in r.prompt


def test_prompt_without_words(spark):
    df = spark.createDataFrame([("f", "", None)], "uri STRING, transcript STRING, total_words BIGINT")
    for name in metrics.METRIC_NAMES[1:]:
        kind = "string" if name == "severity_level" else "double"
        df = df.withColumn(name, F.lit(None).cast(kind))
    row = prompts.therapy_prompts(df).first()
    assert row.plan_track is None and "{}" in row.prompt


def test_counts_need_no_record_for_each_word(spark):
    """Metrics without packed words make no flagged word; words that are cut short or odd count as before."""
    words = [("iiİ", 0.0, 0.3), ("iiİ", 2.0, 2.3), (None, 2.4, 2.5), ("Um,", 2.6, None), ("İii", 9.0, 9.1), ("aaa", 9.2, 9.3), ("", 9.4, 9.5)]
    runs = spark.createDataFrame([("a", words), ("b", []), ("c", None)], "uri STRING, words array<struct<word:string,start_time:double,end_time:double>>")
    counted = metrics.transcript_metrics(runs).drop("words")
    assert "is_filler" not in counted._jdf.queryExecution().toString()
    packed = metrics.transcript_metrics(runs, packed_col="packed").drop("words", "packed")
    assert sorted(counted.collect()) == sorted(packed.collect())
    row = counted.where("uri = 'a'").first()
    assert (row.filler_count, row.repetitions, row.prolongations, row.blocks) == (1, 1, 3, 1)


def test_half_up_is_round(spark):
    near = [k / 1e6 + d for k in (0, 1, 7, 250000, 1499999) for d in (0.0, 5e-7, 4.999999e-7, 5.000001e-7, 1e-16)]
    odd = [0.8 - 0.7, 1e5 + 0.1234565, 123456789.1234565, 1e300, float("inf"), float("nan"), 2.5e-6, 1.0000005, None, 4e-324]
    randomly = [random.Random(3).uniform(-5, 5) for _ in range(500)]
    numbers = [(x,) for x in [*near, *odd, *randomly] for x in (x, None if x is None else -x)]
    df = spark.createDataFrame(numbers, "x DOUBLE")
    for places in (6, 10):
        both = df.select(scores.half_up(F.col("x"), places).cast("string").alias("a"), F.round("x", places).cast("string").alias("b"))
        assert both.where("not a <=> b").collect() == []


def test_words_are_packed_in_one_go(spark):
    rows = "array(named_struct('word', 'um', 'start_time', 0D, 'end_time', 0.3D), named_struct('word', 'um', 'start_time', 2.123456789012D, 'end_time', 2.5D), named_struct('word', null, 'start_time', null, 'end_time', 3D), null)"
    df = spark.sql(f"select {rows} as words union all select filter({rows}, w -> false) union all select null")
    both = df.select(metrics.packed(F.col("words")), metrics.pack_words(disfluency.flag_words(F.col("words")))).collect()
    assert all(one == other for one, other in both) and both[0][0].startswith('[{"word":"um"') and both[1][0] == "[]"
