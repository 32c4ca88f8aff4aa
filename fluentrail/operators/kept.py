"""Answers of a model that are kept by what was asked.

The table of answers has one row per model and digest of the input columns. What it has is not
asked again, in this run or a later one, whichever rows the inputs come with; equal inputs of one run
are asked once. Failures are reported and not kept, so the next run asks them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluentrail.operators.models import apply_model
from fluentrail.session import stored
from fluentrail.sources.tables import append_rows, read_table

#: Shards of a digest among the rows that ask it, so that one asked by a third of all rows is spread in the join.
SHARDS = 32


def input_digest(model: str, inputs: list[str]) -> Column:
    """SHA-256 of the model's name and the inputs, nulls and order of columns told apart."""
    fields = F.to_json(F.struct(F.lit(model).alias("model"), F.struct(*inputs).alias("inputs")), {"ignoreNullFields": "false"})
    return F.sha2(fields, 256)


def kept_schema(output: str) -> str:
    return f"digest STRING, model STRING, {output}, made_in STRING"


def apply_kept(
    df: DataFrame,
    make_model: Callable[[], Callable],
    output: str,
    inputs: list[str],
    path: str,
    model: str,
    run: str,
    status_col: str = "status",
) -> DataFrame:
    """``df`` with the model's output, a status, and the run (``made_in``) that the answer comes from.

    Like ``apply_model``, through the table at ``path``. The model is called once for each input that the table
    lacks; its answers are written before they are used, so a task that runs again later does not call it. ``made_in``
    is null where there is no answer.
    """
    schema = kept_schema(output)
    names = T.StructType.fromDDL(output).fieldNames()
    asked = df.select(input_digest(model, inputs).alias("digest"), *inputs)
    # the distinct inputs, with partial sums before the shuffle
    distinct = asked.groupBy("digest").agg(*[F.first(c).alias(c) for c in inputs])
    known = read_table(df.sparkSession, path, schema).where(F.col("model") == model)
    missing = distinct.join(known.select("digest"), "digest", "left_anti")
    made = stored(apply_model(missing, make_model, output, inputs, status_col).select("digest", *names, status_col), "answers")
    fresh = made.where(F.col(status_col).isNull()).select("digest", F.lit(model).alias("model"), *names, F.lit(run).alias("made_in"))
    append_rows(fresh, path, schema)
    # one row a digest: the answers as they are now, and the failures of this run; two runs at a time may both add one
    now = read_table(df.sparkSession, path, schema).where(F.col("model") == model)
    held = now.groupBy("digest").agg(F.min_by(F.struct(*names, "made_in"), "made_in").alias("_held"))
    answers = held.select("digest", "_held.*", F.lit(None).cast("string").alias(status_col)).unionByName(
        made.where(F.col(status_col).isNotNull()).withColumn("made_in", F.lit(None).cast("string")).select("digest", *names, "made_in", status_col)
    )
    spread = answers.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    keyed = df.withColumn("digest", input_digest(model, inputs)).withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(SHARDS)).cast("int"))
    return keyed.join(spread, ["digest", "_shard"], "left").drop("digest", "_shard").select(*df.columns, *names, "made_in", status_col)
