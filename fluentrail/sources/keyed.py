"""Tables with one row per key that batches bring up to date.

A batch writes its changed rows into a folder of its own number and replaces that folder if it
is tried again, so each batch counts once. Of the rows of a key the one of the highest batch
holds. ``fold`` makes the rows that hold the base of the table and drops the batches in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluentrail.schemas import conform
from fluentrail.sources import versions

LOG = "log"
BASE = "base"
BATCH = "batch"


def started(spark: SparkSession, path: str) -> bool:
    """Whether the table has a batch."""
    path = path.rstrip("/")
    return versions.exists(spark, f"{path}/{LOG}") or versions.exists(spark, f"{path}/{BASE}")


def put_rows(df: DataFrame, path: str, schema: str, batch: int) -> None:
    """Set the rows of the keys in ``df``, which has each key once. Numbers of later batches are higher."""
    conform(df, schema).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{LOG}/{BATCH}={batch}")


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the base and of all batches, the base having the number of the last batch in it."""
    path, numbered = path.rstrip("/"), T.StructType.fromDDL(f"{schema}, {BATCH} BIGINT")
    base = versions.current(spark, f"{path}/{BASE}")
    found = spark.read.schema(numbered).parquet(base) if base else spark.createDataFrame([], numbered)
    if versions.exists(spark, f"{path}/{LOG}"):
        found = found.unionByName(spark.read.schema(numbered).parquet(f"{path}/{LOG}"))
    return found


def read_keyed(spark: SparkSession, path: str, schema: str, key: tuple[str, ...]) -> DataFrame:
    """The row that holds of each key."""
    return _latest(_rows(spark, path, schema), schema, key).drop(BATCH)


def _latest(rows: DataFrame, schema: str, key: tuple[str, ...]) -> DataFrame:
    names = T.StructType.fromDDL(schema).fieldNames()
    rest = [name for name in names if name not in key]
    held = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), BATCH).alias("_held"), F.max(BATCH).alias(BATCH))
    return held.select(*key, "_held.*", BATCH).select(*names, BATCH)


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are not folded, and of the last one."""
    names = versions.names(spark, f"{path.rstrip('/')}/{LOG}")
    return sorted(int(name.removeprefix(f"{BATCH}=")) for name in names if name.startswith(f"{BATCH}="))


def last_batch(spark: SparkSession, path: str) -> int:
    """The highest number so far, -1 before the first batch. A batch without rows counts."""
    return max(batches(spark, path), default=-1)


def fold(spark: SparkSession, path: str, schema: str, key: tuple[str, ...]) -> None:
    """Make the rows that hold the new base, then drop the batches they come from.

    No batch may be written meanwhile. Ended half way, the base has the batches and they are there too, which
    gives the same rows. The last batch stays, so that the next one is numbered after it.
    """
    path = path.rstrip("/")
    versions.publish(_latest(_rows(spark, path, schema), schema, key), f"{path}/{BASE}")
    for batch in batches(spark, path)[:-1]:
        versions.remove(spark, f"{path}/{LOG}/{BATCH}={batch}")
    versions.discard(spark, f"{path}/{BASE}", keep=0)
