import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from fluentrail.operators.progress import daily_fluency
from fluentrail.plans import analysis
from fluentrail.schemas import ANALYSIS_RESULTS, COURSES, DOCUMENT_EMBEDDINGS, TRANSCRIPTS, conform
from fluentrail.session import scratch_path
from fluentrail.sources import files, tables
from fluentrail.streaming import daily, ingest


def test_create_append_replace(spark, tmp_path):
    path = str(tmp_path / "courses")
    assert tables.read_table(spark, path, COURSES).count() == 0
    tables.create_table(spark, path, COURSES)
    row = spark.createDataFrame([("1", "t", "d", "c", "u", "more")], COURSES + ", extra STRING")
    tables.append_rows(row, path, COURSES)
    tables.append_rows(row, path, COURSES)
    tables.create_table(spark, path, COURSES)
    stored = tables.read_table(spark, path, COURSES)
    assert stored.count() == 2 and stored.columns == ["course_id", "title", "description", "category", "url"]
    tables.replace_table(row, path, COURSES)
    assert tables.read_table(spark, path, COURSES).count() == 1


def test_schema_is_checked(spark):
    with pytest.raises(ValueError, match="url is missing"):
        conform(spark.createDataFrame([("1", "t", "d", "c")], "course_id STRING, title STRING, description STRING, category STRING"), COURSES)
    with pytest.raises(ValueError, match="course_id is int"):
        conform(spark.createDataFrame([(1, "t", "d", "c", "u")], COURSES.replace("course_id STRING", "course_id INT")), COURSES)


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "courses")
    rows = spark.createDataFrame([("1", "t", "d", "c", "u"), ("1", "t", "d", "c", "u"), ("2", "t", "d", "c", "u")], COURSES)
    tables.append_new(rows, path, COURSES, "course_id")
    tables.append_new(rows, path, COURSES, "course_id")
    tables.append_new(rows.unionByName(rows.withColumn("course_id", F.lit("3"))), path, COURSES, "course_id")
    assert sorted(r.course_id for r in tables.read_table(spark, path, COURSES).collect()) == ["1", "2", "3"]


def test_course_file_and_bad_rows(spark, tmp_path):
    listed = [{"course_id": "1", "title": "t"}, {"title": "no id", "url": "u"}, {"course_id": " "}, {"course_id": "1"}]
    (tmp_path / "courses.json").write_text(json.dumps(listed, indent=1))
    courses = files.read_courses(spark, str(tmp_path / "courses.json"))
    fit, unfit = tables.split_courses(courses)
    assert [(r.course_id, r.title, r.url) for r in fit.collect()] == [("1", "t", None), ("1", None, None)]
    assert sorted((r.title or "", r.reason) for r in unfit.collect()) == [("", "no course_id"), ("no id", "no course_id")]
    assert [tuple(r) for r in tables.repeated_courses(fit).collect()] == [("1", 2)]


def test_practice_texts(spark, tmp_path):
    (tmp_path / "texts.json").write_text(json.dumps({"Songs": ["a", "b"], "Reading": ["c"]}, indent=1))
    rows = files.read_practice_texts(spark, str(tmp_path / "texts.json"))
    assert sorted(tuple(r) for r in rows.collect()) == [("Reading", 0, "c"), ("Songs", 0, "a"), ("Songs", 1, "b")]


def test_listings_do_not_read_contents(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for name in ("a.mp3", "audio/b.wav", "c.pdf", "d.txt"):
        (tmp_path / name).write_bytes(b"1234")
    audio = files.list_audio(spark, str(tmp_path))
    assert sorted((r.uri.split("/")[-1], r.content_type, r.length) for r in audio.collect()) == [
        ("a.mp3", "audio/mpeg", 4), ("b.wav", "audio/wav", 4),
    ]
    assert "content#" not in audio._jdf.queryExecution().executedPlan().toString().replace("content_type#", "")
    assert [r.content_type for r in files.list_documents(spark, str(tmp_path)).collect()] == ["application/pdf"]


def test_times(spark):
    at = datetime(2024, 1, 31, 20, 0, tzinfo=UTC)
    row = tables.stamp_processed(spark.range(1), at).select(
        F.unix_timestamp("processed_at").alias("s"), "processed_at_ist"
    ).first()
    assert row.s == int(at.timestamp()) and row.processed_at_ist == datetime(2024, 2, 1, 1, 30)
    with pytest.raises(ValueError):
        tables.stamp_processed(spark.range(1), datetime(2024, 1, 1))


def test_scratch_path_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(root + "/x-")


def words_json(*timed):
    found = [{"word": w, "start_offset": f"{s}s", "end_offset": f"{e}s"} for w, s, e in timed]
    return json.dumps({"results": {"k": {"inline_result": {"transcript": {"results": [{"alternatives": [{"words": found}]}]}}}}})


def test_analysis_results(spark, tmp_path):
    rows = [("a", "um the the", words_json(("um", 0, 0.3), ("the", 0.5, 0.8), ("the", 3, 3.3))), ("b", "", "")]
    answers = spark.createDataFrame(rows, "uri STRING, transcripts STRING, ml_transcribe_result STRING")

    def make_model():
        return lambda rows: {"therapy_plan": [f"plan of {len(p)} letters" for p in rows["prompt"]]}

    at = datetime(2024, 1, 31, tzinfo=UTC)
    results = analysis.analysis_results(answers, at, make_model)
    assert results.columns == [f.split()[0] for f in ANALYSIS_RESULTS.split(", ")]
    path = str(tmp_path / "results")
    for _ in range(2):
        analysis.store_new_results(answers.unionByName(answers.limit(1)), path, at, make_model)
    stored = {r.transcript: r for r in tables.read_table(spark, path, ANALYSIS_RESULTS).collect()}
    assert len(stored) == 2 and stored["um the the"].therapy_plan.startswith("plan of")
    found = json.loads(stored["um the the"].metrics)
    assert (found["filler_count"], found["repetitions"], found["blocks"]) == (1, 1, 1)
    assert found["severity_score"] == pytest.approx(5.5 / 3)
    assert stored[""].metrics == "{}" and stored[""].words_df == "[]"
    plain = analysis.analysis_results(answers, at)
    assert {r.therapy_plan for r in plain.collect()} == {"No therapy plan generated."}
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_ingest_twice_and_duplicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = str(tmp_path / "chunks")

    def deliver(name, *rows):
        spark.createDataFrame(list(rows), "uri STRING, text STRING").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("uri STRING, text STRING").parquet(str(tmp_path / "in"))
        ingest.ingest_stream(stream, table, str(tmp_path / name)).awaitTermination()
        return sorted((r.uri, r.chunk_id) for r in tables.read_table(spark, table, DOCUMENT_EMBEDDINGS).collect())

    first = deliver("one", ("a", "x " * 250), ("b", "y"), ("b", "y"))
    assert first == [("a", "c1"), ("a", "c2"), ("b", "c1")]
    assert deliver("one", ("a", "x " * 250), ("c", "z")) == [*first, ("c", "c1")]
    assert deliver("other", ("c", "z")) == [*first, ("c", "c1")]


def test_files_without_name_are_set_apart(spark, tmp_path):
    table = str(tmp_path / "chunks")
    files = spark.createDataFrame([(None, "a b"), (None, "c d"), ("f", "one"), ("f", "two"), ("g", "x")], "uri STRING, text STRING")
    for _ in range(2):
        ingest.ingest_batch(files.orderBy(F.rand()), table)
    assert sorted((r.uri, r.content) for r in spark.read.parquet(table).collect()) == [("f", "two"), ("g", "x")]
    assert sorted(r.text for r in spark.read.parquet(f"{table}-without-uri").collect()) == ["a b", "c d"]


def test_rows_without_key_are_set_apart(spark, tmp_path):
    path = str(tmp_path / "courses")
    rows = spark.createDataFrame([(None, "t1", "d", "c", "u"), (None, "t2", "d", "c", "u"), ("1", "a", "d", "c", "u"), ("1", "b", "d", "c", "u")], COURSES)
    for _ in range(2):
        tables.append_new(rows, path, COURSES, "course_id")
    assert [(r.course_id, r.title) for r in tables.read_table(spark, path, COURSES).collect()] == [("1", "b")]
    assert sorted(r.title for r in spark.read.parquet(f"{path}-without-course_id").collect()) == ["t1", "t2"]


def test_late_runs_and_open_days_count(spark, tmp_path):
    def run(day, hour, severity):
        return datetime(2024, 1, day, hour), 1, json.dumps({"severity_score": severity})

    schema = "processed_at TIMESTAMP, user_id BIGINT, metrics STRING"
    source, table = str(tmp_path / "runs"), str(tmp_path / "days")
    for rows in ([run(1, 1, 0.1), run(9, 1, 0.2)], [run(1, 2, 0.3)], [(None, 1, "{}"), run(9, 3, 0.4), run(5, 1, 0.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        daily.keep_days(stream, source, table, str(tmp_path / "checkpoint"), ("user_id",)).awaitTermination()
        runs = spark.read.schema(schema).parquet(source)
        wanted = {(r.user_id, r.processed_day): r.fluency_score for r in daily_fluency(runs, ("user_id",)).collect()}
        got = [((r.user_id, r.processed_day), r.fluency_score) for r in spark.read.parquet(table).collect()]
        assert len(got) == len(wanted) and dict(got) == {k: v if v is None else pytest.approx(v) for k, v in wanted.items()}


def test_daily_stream_gives_closed_days(spark, tmp_path):
    rows = [(datetime(2024, 1, d, h), 1, json.dumps({"severity_score": d / 100 + h / 1000})) for d in range(1, 6) for h in (1, 9)]
    runs = spark.createDataFrame(rows, "processed_at TIMESTAMP, user_id BIGINT, metrics STRING")
    runs.write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    days = daily.daily_fluency_stream(stream, ("user_id",))
    daily.write_days(days, str(tmp_path / "days"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.processed_day.day: r.fluency_score for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert got == {d: pytest.approx(100 - d - 0.5) for d in (1, 2, 3)}


def test_transcript_table(spark, tmp_path):
    path = str(tmp_path / "transcripts")
    rows = spark.createDataFrame([("a", "t", "{}", "")], "uri STRING, transcripts STRING, ml_transcribe_result STRING, ml_transcribe_status STRING")
    tables.append_rows(tables.stamp_processed(rows, datetime(2024, 1, 1, tzinfo=UTC)), path, TRANSCRIPTS)
    assert tables.read_table(spark, path, TRANSCRIPTS).first().processed_at_ist == datetime(2024, 1, 1, 5, 30)


def test_rows_stay_where_they_are_if_all_are_new(spark, tmp_path):
    """Only keys are compared; rows are moved if some are known, and made into text if one key has several."""
    path, schema = str(tmp_path / "t"), "k STRING, v STRING"
    rows = spark.createDataFrame([(str(i), "x" * i) for i in range(20)], schema)

    def plan(df):
        return df._jdf.queryExecution().toString()

    fresh = tables.not_stored(rows, path, schema, "k")
    assert "Exchange" not in plan(fresh) and fresh.count() == 20
    tables.append_new(rows, path, schema, "k")
    assert tables.not_stored(rows, path, schema, "k").count() == 0
    more = rows.unionByName(spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("b", "3")], schema))
    once = tables.not_stored(more.where("v != '3'"), path, schema, "k")
    assert "to_json" not in plan(once) and sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "2")]
    assert sorted(map(tuple, tables.not_stored(more, path, schema, "k").collect())) == [("a", "1"), ("b", "3")]
    tables.append_new(more, path, schema, "k")
    assert tables.read_table(spark, path, schema).count() == 22
