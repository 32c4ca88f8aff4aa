"""Tables replaced as a whole, tables by key, and daily totals by a stream."""

import itertools
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fluentrail.operators.progress import daily_fluency
from fluentrail.schemas import COURSES
from fluentrail.sources import keyed, tables, versions
from fluentrail.streaming import daily

PAIR = "k INT, v STRING"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("1", "t", "d", "c", "u")], COURSES)
    tables.append_rows(old, path, COURSES)
    tables.replace_table(tables.read_table(spark, path, COURSES).withColumn("title", F.lit("second")), path, COURSES)
    failing = spark.range(4, numPartitions=4).select(
        F.when(F.col("id") == 3, F.raise_error(F.lit("half way")).cast("string")).otherwise(F.col("id").cast("string")).alias("course_id"),
        *[F.lit("x").alias(c) for c in ("title", "description", "category", "url")],
    )
    with pytest.raises(Exception, match="half way"):
        tables.replace_table(failing, path, COURSES)
    assert [r.title for r in tables.read_table(spark, path, COURSES).collect()] == ["second"]


def test_a_reader_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None
    versions.publish(spark.createDataFrame([(1, "a"), (2, "a")], PAIR), path)
    reader = tables.read_table(spark, path, PAIR)
    # worked out from itself
    tables.replace_table(tables.read_table(spark, path, PAIR).withColumn("v", F.lit("b")), path, PAIR)
    assert pairs(reader) == [(1, "a"), (2, "a")]
    assert pairs(tables.read_table(spark, path, PAIR)) == [(1, "b"), (2, "b")]
    tables.append_rows(spark.createDataFrame([(3, "b")], PAIR), path, PAIR)
    assert tables.read_table(spark, path, PAIR).count() == 3
    versions.publish(tables.read_table(spark, path, PAIR), path)
    assert versions.discard(spark, path, keep=1) == 1 and versions.discard(spark, path, keep=0) == 1
    assert versions.discard(spark, path, keep=0) == 0
    assert tables.read_table(spark, path, PAIR).count() == 3


def test_the_last_batch_of_a_key_holds(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.read_keyed(spark, path, PAIR, ("k",)).count() == 0 and keyed.last_batch(spark, path) == -1
    keyed.put_rows(spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], PAIR), path, PAIR, 0)
    for _ in range(2):  # a batch tried again
        keyed.put_rows(spark.createDataFrame([(2, "b"), (3, None)], PAIR), path, PAIR, 1)
    wanted = [(1, "a"), (2, "b")]
    rows = {tuple(r) for r in keyed.read_keyed(spark, path, PAIR, ("k",)).collect()}
    assert rows == {*wanted, (None, "a"), (3, None)} and keyed.last_batch(spark, path) == 1
    keyed.fold(spark, path, PAIR, ("k",))
    assert {tuple(r) for r in keyed.read_keyed(spark, path, PAIR, ("k",)).collect()} == rows
    keyed.put_rows(spark.createDataFrame([(3, "c")], PAIR), path, PAIR, keyed.last_batch(spark, path) + 1)
    keyed.fold(spark, path, PAIR, ("k",))
    assert {tuple(r) for r in keyed.read_keyed(spark, path, PAIR, ("k",)).collect()} == rows - {(3, None)} | {(3, "c")}
    keyed.put_rows(spark.createDataFrame([], PAIR), path, PAIR, 3)
    keyed.fold(spark, path, PAIR, ("k",))
    assert keyed.last_batch(spark, path) == 3 and keyed.batches(spark, path) == [3]


def test_day_totals_in_any_order_of_arrival(spark, tmp_path):
    schema = "processed_at TIMESTAMP, user_id BIGINT, metrics STRING"

    def run(day, hour, severity, user=1):
        return datetime(2024, 1, day, hour), user, json.dumps({"severity_score": severity})

    deliveries = [[run(9, 1, 0.2), run(1, 1, 0.1)], [run(1, 2, 0.3), (None, 1, "{}"), run(1, 5, 0.5, 2)], [run(5, 1, 0.0), run(9, 3, "n/a"), (datetime(2023, 1, 1), None, None)]]
    for number, order in enumerate(itertools.permutations(deliveries)):
        source, table, checkpoint = (str(tmp_path / f"{name}{number}") for name in ("runs", "days", "checkpoint"))
        for rows in order:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            totals = daily.day_totals_stream(spark.readStream.schema(schema).parquet(source), ("user_id",))
            daily.keep_day_totals(totals, table, checkpoint, ("user_id",)).awaitTermination()
        runs = spark.read.schema(schema).parquet(source)
        wanted = {(r.user_id, r.processed_day): r.fluency_score for r in daily_fluency(runs, ("user_id",)).collect()}
        stored = keyed.read_keyed(spark, table, daily.totals_schema(runs, ("user_id",)), ("user_id", "processed_day"))
        got = [((r.user_id, r.processed_day), r.fluency_score) for r in daily.day_means(stored, ("user_id",)).collect()]
        assert len(got) == len(wanted) and dict(got) == {k: pytest.approx(v) for k, v in wanted.items()}
        if number == 1:
            break
    with pytest.raises(ValueError):
        daily.keep_day_totals(totals, table, str(tmp_path / "another"), ("user_id",))
