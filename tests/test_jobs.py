"""Transcription as a job, and answers that are kept."""

from datetime import UTC, datetime

import pytest

from fluentrail.operators import kept
from fluentrail.plans import transcription
from fluentrail.sources import keyed

AT = datetime(2024, 1, 31, tzinfo=UTC)


def calls(folder):
    return sorted(line for file in folder.glob("*") for line in file.read_text().split())


def make_recogniser(folder, bad=()):
    """A recogniser that notes every file it is asked for, and fails for some."""
    folder.mkdir(exist_ok=True)
    path, bad = str(folder), set(bad)

    def make():
        import os
        import uuid

        out = f"{path}/{os.getpid()}-{uuid.uuid4().hex}"

        def recognise(rows):
            if len(rows) > 1:
                raise ValueError("one at a time")  # so that calls are counted by file
            with open(out, "a") as file:
                file.write(f"{rows['uri'][0]}\n")
            if rows["uri"][0] in bad:
                raise ValueError(f"cannot read {rows['uri'][0]}")
            return {"transcripts": ["t"], "ml_transcribe_result": ["{}"]}

        return recognise

    return make


def queue(spark, path):
    return {r.uri: (r.state, r.tries, r.reason) for r in transcription.read_queue(spark, path).collect()}


def test_done_files_never_and_failed_files_again(spark, tmp_path):
    path = str(tmp_path / "job")
    files = spark.createDataFrame([(u, "audio/wav") for u in ("a", "b", "c", "c", None)], "uri STRING, content_type STRING")
    for run, bad in enumerate((("b", "c"), ("c",), ("c",), ())):
        transcription.add_to_queue(files, path, AT)
        transcription.run_queue(spark, path, make_recogniser(tmp_path / f"calls{run}", bad), AT, tries=3)
        assert calls(tmp_path / f"calls{run}") == [["a", "b", "c"], ["b", "c"], ["c"], []][run]
    assert queue(spark, path) == {"a": ("done", 1, None), "b": ("done", 2, None), "c": ("failed", 3, "cannot read c")}
    assert sorted(r.uri for r in transcription.read_transcripts(spark, path).collect()) == ["a", "b"]
    transcription.run_queue(spark, path, make_recogniser(tmp_path / "more"), AT, tries=4)
    assert calls(tmp_path / "more") == ["c"] and queue(spark, path)["c"] == ("done", 4, None)


def test_a_run_that_ended_early_asks_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "job")
    files = spark.createDataFrame([("a", "audio/wav"), ("b", "audio/wav")], "uri STRING, content_type STRING")
    transcription.add_to_queue(files, path, AT)

    def ended(*_):
        raise RuntimeError("ended")

    for name in ("append_rows", "keyed.put_rows"):
        with monkeypatch.context() as m:
            if name == "append_rows":
                m.setattr(transcription, "append_rows", ended)
            else:
                m.setattr(keyed, "put_rows", ended)
            with pytest.raises(RuntimeError):
                transcription.run_queue(spark, path, make_recogniser(tmp_path / "calls", ("b",)), AT)
    assert queue(spark, path) == {"a": ("waiting", 0, None), "b": ("waiting", 0, None)}
    transcription.run_queue(spark, path, make_recogniser(tmp_path / "calls", ("b",)), AT)
    assert calls(tmp_path / "calls") == ["a", "b"]
    assert queue(spark, path) == {"a": ("done", 1, None), "b": ("failed", 1, "cannot read b")}
    assert transcription.read_transcripts(spark, path).count() == 1


def test_no_files(spark, tmp_path):
    path = str(tmp_path / "job")
    transcription.add_to_queue(spark.createDataFrame([], "uri STRING, content_type STRING"), path, AT)
    transcription.run_queue(spark, path, make_recogniser(tmp_path / "calls"), AT)
    assert queue(spark, path) == {} and calls(tmp_path / "calls") == []


def make_length(folder, bad=()):
    folder.mkdir(exist_ok=True)
    path, bad = str(folder), set(bad)

    def make():
        import os
        import uuid

        out = f"{path}/{os.getpid()}-{uuid.uuid4().hex}"

        def model(rows):
            if len(rows) > 1:
                raise ValueError("one at a time")
            with open(out, "a") as file:
                file.write(f"<{rows['text'][0]}>\n")
            if rows["text"][0] in bad:
                raise ValueError("refused")
            return {"size": rows["text"].str.len().fillna(-1)}

        return model

    return make


def test_answers_are_asked_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = [(i, t, "clash") for i, t in enumerate(("one", "one", "three", "bad", None, None, ""))]
    df = spark.createDataFrame(rows, "id INT, text STRING, model STRING").repartition(3)

    def answered(run, bad=()):
        got = kept.apply_kept(df, make_length(tmp_path / run, bad), "size BIGINT", ["text"], path, "length", run)
        assert got.columns == ["id", "text", "model", "size", "made_in", "status"]
        return {r.id: (r.size, r.made_in, r.status) for r in got.collect()}

    first = answered("run1", ("bad",))
    good = {0: (3, "run1", None), 1: (3, "run1", None), 2: (5, "run1", None), 4: (-1, "run1", None), 5: (-1, "run1", None), 6: (0, "run1", None)}
    assert first == {**good, 3: (None, None, "refused")}
    assert calls(tmp_path / "run1") == ["<>", "<None>", "<bad>", "<one>", "<three>"]
    assert answered("run2") == {**good, 3: (3, "run2", None)}
    assert calls(tmp_path / "run2") == ["<bad>"]
    assert answered("run3") == answered("run2") and calls(tmp_path / "run3") == []
    other = kept.apply_kept(df, make_length(tmp_path / "run4"), "size BIGINT", ["text"], path, "another model", "run4")
    assert {r.made_in for r in other.collect()} == {"run4"}
    assert kept.apply_kept(df.limit(0), make_length(tmp_path / "run5"), "size BIGINT", ["text"], path, "length", "run5").count() == 0
