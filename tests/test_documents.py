import json
import math
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from fluentrail.functions.embedding import hashed_embedding
from fluentrail.operators import catalog, chunks, incremental
from fluentrail.operators.lists import build_lists
from fluentrail.operators.models import apply_model, transcribe
from fluentrail.plans import prompts, retrieval
from fluentrail.streaming.ingest import embed_documents


def reckoned(text, buckets=64):
    counts = Counter(int(md5(t.encode()).hexdigest()[:4], 16) % buckets for t in re.findall(r"[^\W_]+", text.lower()))
    length = math.sqrt(sum(n * n for n in counts.values()))
    return [counts[b] / length if length else 0.0 for b in range(buckets)]


def test_embedding(spark):
    texts = ["", "one", "One, two; TWO!", "naïve über 12 a_b", "  ...  ", "word " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = df.select("i", hashed_embedding(F.col("t")).alias("v"), hashed_embedding(F.col("t"), 8).alias("w")).orderBy("i").collect()
    for row, text in zip(rows, texts):
        assert row.v == pytest.approx(reckoned(text))
        assert row.w == pytest.approx(reckoned(text, 8))


def test_embedding_is_one_projection(spark):
    plan = spark.range(5).select(hashed_embedding(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(450))
    df = spark.createDataFrame([("a", text), ("b", "  "), ("c", " x\ny "), ("d", None)], "uri STRING, text STRING")
    rows = chunks.chunk_text(df).orderBy("uri", "chunk_id").collect()
    assert [(r.uri, r.chunk_id, len(r.content.split())) for r in rows] == [("a", "c1", 200), ("a", "c2", 200), ("a", "c3", 50), ("c", "c1", 2)]
    assert " ".join(r.content for r in rows[:3]) == text
    assert rows[3].content == "x y" and rows[3].page_start is None


def test_chunks_out_of_json(spark):
    def answer(*found):
        return json.dumps({"chunkedDocument": {"chunks": list(found)}})

    full = {"chunkId": "c1", "content": "x", "pageSpan": {"pageStart": 1, "pageEnd": 2}}
    rows = [
        ("a", answer(full, {"chunkId": "c2", "pageSpan": {"pageStart": "3"}}, {"content": "no id"})),
        ("b", answer()),
        ("c", "broken"),
        ("d", None),
    ]
    df = spark.createDataFrame(rows, "uri STRING, ml_process_document_result STRING")
    got = {tuple(r) for r in chunks.chunks_from_json(df).collect()}
    assert got == {("a", "c1", "x", 1, 2), ("a", "c2", None, 3, None), ("a", None, "no id", None, None)}


def test_rag_prompts(spark):
    files = spark.createDataFrame(
        [("a", "slow breathing helps"), ("b", "slow breathing"), ("c", "football"), ("d", "slow")], "uri STRING, text STRING"
    )
    passages = embed_documents(files)
    gone = passages.withColumn("content", F.when(F.col("uri") != "b", F.col("content")))
    questions = spark.createDataFrame([(1, "slow breathing"), (2, "  ")], "question_id INT, question STRING")
    row, = retrieval.rag_prompts(questions, passages, k=2, instructions="Help.").collect()
    assert row.prompt == (
        "Help. and User Question: slow breathingDocument Content: slow breathing,Document Content: slow breathing helps"
    )
    row, = retrieval.rag_prompts(questions, gone, k=2, instructions="Help.").collect()
    assert row.prompt == "Help. and User Question: slow breathingDocument Content: slow breathing helps"
    row, = retrieval.rag_prompts(questions, passages.limit(0), k=2).collect()
    assert row.prompt is None


def test_rag_over_lists(spark):
    files = spark.createDataFrame([(f"d{i}", f"topic{i % 5} note{i}") for i in range(40)], "uri STRING, text STRING")
    passages = embed_documents(files)
    lists = build_lists(passages, ["uri", "chunk_id"], "text_embeddings", n_lists=4)
    questions = spark.createDataFrame([(i, f"topic{i}") for i in range(3)], "question_id INT, question STRING")
    exact = {tuple(r) for r in retrieval.rag_prompts(questions, passages).collect()}
    assert {tuple(r) for r in retrieval.rag_prompts(questions, passages, lists=lists, fraction=1.0).collect()} == exact
    part = retrieval.rag_prompts(questions, passages, lists=lists).collect()
    assert len(part) == 3 and all(r.prompt.count("Document Content") >= 1 for r in part)


def test_answers_fall_back(spark):
    asked = spark.createDataFrame([(1, "p"), (2, None)], "question_id INT, prompt STRING")

    def make_model():
        return lambda rows: {"answer": [None if p is None else p.upper() for p in rows["prompt"]]}

    got = {r.question_id: r.answer for r in retrieval.answers(asked, make_model).collect()}
    assert got == {1: "P", 2: prompts.NO_ANSWER}


def test_failed_answers_are_told_from_none(spark):
    asked = spark.createDataFrame([(1, "good"), (2, None), (3, "bad"), (4, "blank"), (5, "long")], "question_id INT, prompt STRING")

    def make_model():
        def model(rows):
            if (rows["prompt"] == "bad").any():
                raise ValueError("refused")
            return {"answer": [" " if p == "blank" else (p * 9)[:n] for p, n in zip(rows["prompt"], rows["max_output_tokens"], strict=True)]}

        return model

    got = {r.question_id: (r.answer, r.outcome, r.status) for r in retrieval.answers(asked, make_model, max_tokens=8).collect()}
    assert got == {
        1: ("goodgood", "answered", None),
        2: (prompts.NO_ANSWER, "no answer", None),
        3: (retrieval.FAILED_ANSWER, "error", "refused"),
        4: (prompts.NO_ANSWER, "no answer", None),
        5: ("longlong", "answered", None),
    }
    with pytest.raises(ValueError):
        retrieval.answers(asked, make_model, max_tokens=0)


def test_similar_cases_and_courses(spark):
    results = spark.createDataFrame([("r1", "slow speech", "{}", "plan"), ("r2", "fast talk", "{}", "other")],
                                    "run_id STRING, transcript STRING, metrics STRING, therapy_plan STRING")
    results = results.withColumn("processed_at", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "transcript_embedding", hashed_embedding(F.col("transcript"))
    )
    asked = spark.createDataFrame([(1, "fast talk")], "query_id INT, t STRING").select(
        "query_id", hashed_embedding(F.col("t")).alias("transcript_embedding")
    )
    row, = retrieval.similar_cases(results, asked, k=1).collect()
    assert (row.run_id, row.transcript, row.therapy_plan, row.distance, row["rank"]) == ("r2", "fast talk", "other", 0.0, 1)
    courses = catalog.embed_courses(
        spark.createDataFrame([("c1", "a", "fast talk", "x", "u"), ("c2", "b", None, "x", "u")],
                              "course_id STRING, title STRING, description STRING, category STRING, url STRING")
    )
    queries = spark.createDataFrame([("f", "fast talk")], "uri STRING, q STRING")
    found = retrieval.recommend_courses(courses, queries, ["uri"], "q").collect()
    assert [(r.course_id, r.title, r.url) for r in found] == [("c1", "a", "u")]


def test_courses_join_their_embeddings(spark):
    courses = spark.createDataFrame([("1", "t"), ("2", "u")], "course_id STRING, title STRING")
    made = spark.createDataFrame([("2", [1.0]), ("3", [2.0])], "course_id STRING, course_embedding ARRAY<DOUBLE>")
    assert [tuple(r) for r in catalog.join_embeddings(courses, made).collect()] == [("2", "u", [1.0])]


def test_practice(spark):
    df = spark.createDataFrame([("Longer Reading",), ("Songs",), (None,)], "category STRING")
    rows = prompts.practice_prompts(df).collect()
    assert [r.max_tokens for r in rows] == [2500, 150, 150]
    assert "'Songs'" in rows[1].prompt


def test_rotation(spark):
    texts = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "only")]
    df = spark.createDataFrame(texts, "category STRING, pos INT, text STRING")
    got = sorted((r.category, r.pos, r.next_pos, r.next_text) for r in catalog.next_texts(df).collect())
    assert got == [("a", 0, 1, "y"), ("a", 1, 2, "z"), ("a", 2, 0, "x"), ("b", 0, 0, "only")]


def test_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "uri STRING")
    done = spark.createDataFrame([("b", 1), ("b", 2), ("x", 1)], "uri STRING, chunk INT")
    assert sorted(r.uri for r in incremental.new_files(files, done).collect()) == ["a", "c"]
    assert sorted(r.uri for r in incremental.processed_files(done).collect()) == ["b", "x"]
    assert sorted(r.uri for r in incremental.wanted_files(files, done).collect()) == ["b"]


def test_transcript_split(spark):
    df = spark.createDataFrame([("a", "t", None), ("b", None, "bad audio"), ("c", None, None)],
                               "uri STRING, transcripts STRING, ml_transcribe_status STRING")
    worked, failed = incremental.split_transcripts(df)
    assert [r.uri for r in worked.collect()] == ["a"]
    assert sorted(tuple(r) for r in failed.collect()) == [("b", "bad audio"), ("c", "Unknown error")]


def test_model_keeps_rows_and_reports_failures(spark):
    df = spark.range(40).repartition(4).withColumn("note", F.when(F.col("id") % 7 == 0, None).otherwise("n"))

    def make_model():
        def model(rows):
            if (rows["id"] % 5 == 0).any():
                raise ValueError("cannot do fives")
            return {"twice": rows["id"] * 2}

        return model

    rows = {r.id: r for r in apply_model(df, make_model, "twice BIGINT", ["id"]).collect()}
    assert len(rows) == 40
    for i, row in rows.items():
        assert row.note == (None if i % 7 == 0 else "n")
        assert (row.twice, row.status) == ((None, "cannot do fives") if i % 5 == 0 else (2 * i, None))


def test_model_with_too_few_rows(spark):
    rows = apply_model(spark.range(3), lambda: lambda rows: {"x": []}, "x INT", ["id"]).collect()
    assert all(r.x is None and "0 rows for 1" in r.status for r in rows)


def test_transcribe(spark):
    files = spark.createDataFrame([("gs://a.wav", "audio/wav"), ("gs://b.mp3", "audio/mpeg")], "uri STRING, content_type STRING")

    def make_recogniser():
        def recognise(rows):
            if (rows["content_type"] != "audio/wav").any():
                raise ValueError("unknown encoding")
            return {"transcripts": ["hello"] * len(rows), "ml_transcribe_result": ["{}"] * len(rows)}

        return recognise

    worked, failed = incremental.split_transcripts(transcribe(files, make_recogniser))
    assert [(r.uri, r.transcripts) for r in worked.collect()] == [("gs://a.wav", "hello")]
    assert [tuple(r) for r in failed.collect()] == [("gs://b.mp3", "unknown encoding")]
