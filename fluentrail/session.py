"""Session helpers: where to put intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: How tables are written, and those whose rows have the words of a recording as text. A row group is the most that a
#: reader takes at once; the thousands of such rows that make a batch otherwise are hundreds of megabytes in one array.
#: Bytes do not bound it, since a writer counts them compressed.
WRITTEN = {"compression": "zstd"}
WIDE = WRITTEN | {"parquet.block.row.count.limit": "256"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder of ``spark.checkpoint.dir``.

    Executors on other machines must see what is written there, so a folder of
    this machine is only used by a local session that has no such setting.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="fluentrail-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] = WRITTEN) -> DataFrame:
    """Write a table to a path not used before and read it back: what follows starts from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan's rows out to all cores where its files give too few splits.

    A file that is one row group is one task, whatever its size. A large table
    has more splits than the cluster has cores and passes through untouched.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, whatever is done with them later.

    A filter on a computed column is pushed below the projection that computes it,
    with the whole expression copied into the filter, and once more for each column
    built on it. It is not pushed below a generator, so these columns come out of
    one, as the fields of a single struct.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
