import json

import pytest
from pyspark.sql import functions as F

from fluentrail.functions import text
from fluentrail.operators import words


def answer(*results, key="gs://a", **more):
    return json.dumps({"results": {key: {"inline_result": {"transcript": {"results": list(results)}}}, **more}})


def result(*timed):
    return {"alternatives": [{"words": [{"word": w, "start_offset": s, "end_offset": e} for w, s, e in timed]}]}


def parsed(spark, *answers):
    df = spark.createDataFrame([(f"f{i}", a) for i, a in enumerate(answers)], "uri STRING, ml_transcribe_result STRING")
    rows = words.explode_words(words.parse_transcripts(df)).orderBy("uri", "pos").collect()
    found = {}
    for row in rows:
        found.setdefault(row.uri, []).append((row.pos, row.word, row.start_time, row.end_time))
    return [found.get(f"f{i}", []) for i in range(len(answers))]


def test_results_are_joined_in_order(spark):
    a = answer(result(("one", "0s", "0.5s"), ("two", "0.600s", "1s")), result(("three", "1.2s", "1.5s")))
    assert parsed(spark, a) == [[(0, "one", 0.0, 0.5), (1, "two", 0.6, 1.0), (2, "three", 1.2, 1.5)]]


def test_results_without_words_are_passed_over(spark):
    a = answer({}, {"alternatives": []}, {"alternatives": [{}]}, result(("x", "1s", "2s")))
    assert parsed(spark, a) == [[(0, "x", 1.0, 2.0)]]


def test_only_the_first_alternative_counts(spark):
    both = {"alternatives": result(("x", "1s", "2s"))["alternatives"] + result(("y", "1s", "2s"))["alternatives"]}
    assert parsed(spark, answer(both)) == [[(0, "x", 1.0, 2.0)]]


@pytest.mark.parametrize("offset", ["abc", "", "1.5ds", "0x10s", "1.2.3s", None])
def test_a_bad_offset_ends_its_own_file_only(spark, offset):
    five = [("a", "0s", "1s"), ("b", "1s", "2s"), ("c", offset, "3s"), ("d", "3s", "4s"), ("e", "4s", "5s")]
    later = result(("z", "9s", "9s"))
    found = parsed(spark, answer(result(*five), later), answer(result(*five[:2], *five[3:])))
    assert [w[1] for w in found[0]] == ["a", "b"]
    assert [w[1] for w in found[1]] == ["a", "b", "d", "e"]


def test_a_missing_part_ends_the_file(spark):
    broken = {"alternatives": [{"words": [{"word": "a", "start_offset": "0s", "end_offset": "1s"}, {"word": "b", "end_offset": "2s"}]}]}
    assert [w[1] for w in parsed(spark, answer(broken, result(("c", "2s", "3s"))))[0]] == ["a"]
    no_word = {"alternatives": [{"words": [{"start_offset": "0s", "end_offset": "1s"}]}]}
    assert parsed(spark, answer(no_word, result(("c", "2s", "3s"))))[0] == []


def test_a_null_result_ends_the_file(spark):
    assert [w[1] for w in parsed(spark, answer(result(("a", "0s", "1s")), None, result(("c", "2s", "3s"))))[0]] == ["a"]


def test_unreadable_answers_have_no_words(spark):
    assert parsed(spark, "", None, "{not json", "{}", '{"results": {}}', '{"results": {"k": {}}}') == [[]] * 6


def test_only_the_first_key_is_read(spark):
    second = {"inline_result": {"transcript": {"results": [result(("second", "0s", "1s"))]}}}
    a = answer(result(("first", "0s", "1s")), key="gs://z", **{"gs://a": second})
    assert [w[1] for w in parsed(spark, a)[0]] == ["first"]


def test_with_result_drops_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "uri STRING, ml_transcribe_result STRING")
    assert [r.uri for r in words.with_result(df).collect()] == ["c"]


def test_offsets_like_python(spark):
    texts = ["1.200s", "0s", "-1.5s", " 2 s", "1e3s", "+4.s", ".5s", "infs", "nans", "s", "1_s", "--1s"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r.x for r in df.select("i", text.offset_seconds(F.col("t")).alias("x")).orderBy("i").collect()]

    def python(value):
        try:
            return float(value.replace("s", ""))
        except ValueError:
            return None

    assert [repr(x) for x in got] == [repr(python(t)) for t in texts]


def test_split_words(spark):
    texts = ["", "    ", "one", " a  b\tc\n d　", "x y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r.w for r in df.select("i", text.split_words(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [[], [], ["one"], ["a", "b", "c", "d"], ["x y", "z"]]


def test_trim_is_python_strip(spark):
    spaces = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert set(spaces) == set(text.WHITESPACE)
    df = spark.createDataFrame([(spaces + "a b" + spaces,)], "t STRING")
    assert df.select(text.trim_text(F.col("t"))).first()[0] == "a b"


def test_file_names(spark):
    paths = ["gs://b/audio/x.MP3", "x.wav", "audio/y.pdf", "a.b/c"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i INT, p STRING").orderBy("i")
    p = F.col("p")
    rows = df.select(text.file_name(p), text.content_type(p), text.destination(p)).collect()
    assert [tuple(r) for r in rows] == [
        ("x.MP3", "audio/mpeg", "audio/x.MP3"),
        ("x.wav", "audio/wav", "audio/x.wav"),
        ("y.pdf", "application/pdf", "audio/y.pdf"),
        ("c", "application/octet-stream", "audio/c"),
    ]


def test_offsets_of_digits_and_points_need_no_decimal(spark):
    offsets = ["1.200s", "1.", ".5", ".", "", "s", "ss1", "1.2.3s", "9" * 45, "1.5ds", "1e3s", " 1.5 s", "1.5\n", "1.5s\n", "0x1p3", "\u0661s", "-0.0s", "+2s", "infs", "nan", "1 2", None]
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(offsets)], "i int, o string").select("i", text.offset_seconds(F.col("o")).alias("x")).orderBy("i").collect()
    number = F.replace("o", F.lit("s"), F.lit(""))
    before = F.when(number.try_cast("decimal(38,9)").isNotNull() | F.lower(number).rlike(text._NUMBER), number.try_cast("double"))
    wanted = spark.createDataFrame([(i, o) for i, o in enumerate(offsets)], "i int, o string").select("i", before.alias("x")).orderBy("i").collect()
    assert [str(r.x) for r in rows] == [str(r.x) for r in wanted]
    assert [r.x for r in rows][:4] == [1.2, 1.0, 0.5, None]


def test_offsets_are_tried_as_decimals_last(spark):
    column = str(text.offset_seconds(F.col("o"))).lower()
    assert column.index("rlike") < column.index("decimal")
