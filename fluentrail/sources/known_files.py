"""An index of the files that were taken in, of which a batch reads only what it may need.

``names`` has the files in folders by a hash of the name. ``filters`` has a Bloom filter for each of these folders, as rows of 64
bits. A batch looks its names up in the filters of their folders first: a name that is not in them is new for certain. Only
folders with a name that may be known are read. So what a batch reads depends on its own names and not on how
many files are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentrail.sources import versions
from fluentrail.sources.tables import read_table

#: Folders of names, and bits of the filter of each. At ten bits a name, a folder has room for 1.6 million names, the
#: index for 100 million; beyond that more names are looked up in vain, and none is lost.
FOLDERS = 64
FILTER_BITS = 1 << 24
PROBES = 4
NAMES = "uri STRING, folder INT"
FILTERS = "word INT, bits BIGINT, folder INT"


def _folder() -> Column:
    return F.pmod(F.xxhash64("uri"), F.lit(FOLDERS)).cast("int")


def _probes(named: DataFrame) -> DataFrame:
    """``uri, folder, word, mask``: the bits of each name in the filter of its folder."""
    places = F.array(*[F.pmod(F.xxhash64("uri", F.lit(i)), F.lit(FILTER_BITS)) for i in range(PROBES)])
    bit = named.select("uri", "folder", F.explode(F.array_distinct(places)).alias("_bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_bit", F.lit(64)).cast("int"))
    return bit.select("uri", "folder", F.expr("_bit div 64").cast("int").alias("word"), mask.alias("mask"))


def _folders(named: DataFrame) -> list[int]:
    """The folders of some names, ``FOLDERS`` at most."""
    return [row[0] for row in named.select("folder").distinct().collect()]


def maybe_known(files: DataFrame, index: str) -> DataFrame:
    """``uri, folder`` of the files whose names are in the filters: all known ones, and a few others."""
    named = files.select("uri").where(F.col("uri").isNotNull()).distinct().withColumn("folder", _folder())
    probes = _probes(named)
    filters = read_table(files.sparkSession, f"{index}/filters", FILTERS).where(F.col("folder").isin(_folders(named)))
    words = filters.groupBy("folder", "word").agg(F.bit_or("bits").alias("bits"))
    found = probes.join(words, ["folder", "word"], "left")
    missing = F.coalesce(F.col("bits"), F.lit(0).cast("bigint")).bitwiseAND(F.col("mask")) != F.col("mask")
    return found.groupBy("uri", "folder").agg(F.count_if(missing).alias("_missing")).where("_missing = 0").select("uri", "folder")


def known(files: DataFrame, index: str) -> DataFrame:
    """The distinct names of ``files`` (``uri``) that the index has."""
    spark = files.sparkSession
    maybe = maybe_known(files, index)
    names = read_table(spark, f"{index}/names", NAMES).where(F.col("folder").isin(_folders(maybe)))
    return maybe.join(names, ["folder", "uri"], "left_semi").select("uri")


def unknown(files: DataFrame, index: str) -> DataFrame:
    """The rows of ``files`` whose name the index does not have; rows without a name are among them."""
    return files.join(known(files, index), "uri", "left_anti")


def add_files(files: DataFrame, index: str) -> None:
    """Add the names of ``files`` that are not there yet; adding them twice adds nothing."""
    path = f"{index}/adding"
    unknown(files.select("uri").where(F.col("uri").isNotNull()).distinct(), index).write.mode("overwrite").parquet(path)
    _add_new(files.sparkSession.read.schema("uri STRING").parquet(path), index)


def _add_new(files: DataFrame, index: str) -> None:
    """Add names that the index does not have.

    Filters are written first: ended in between, the filters have a name that the index lacks, which is looked
    up in vain until it is added.
    """
    fresh = files.withColumn("folder", _folder())
    bits = _probes(fresh).groupBy("folder", "word").agg(F.bit_or("mask").alias("bits"))
    for rows, name in ((bits.select("word", "bits", "folder"), "filters"), (fresh, "names")):
        # one file a folder and batch
        rows.repartition("folder").write.mode("append").partitionBy("folder").parquet(versions.located(files.sparkSession, f"{index}/{name}"))


def fold_index(spark: SparkSession, index: str) -> None:
    """Write the index anew with one file a folder, after many batches have added theirs."""
    names = read_table(spark, f"{index}/names", NAMES).distinct()
    words = read_table(spark, f"{index}/filters", FILTERS).groupBy("folder", "word").agg(F.bit_or("bits").alias("bits"))
    versions.publish(words.select("word", "bits", "folder").repartition("folder"), f"{index}/filters", ("folder",))
    versions.publish(names.repartition("folder"), f"{index}/names", ("folder",))
    for name in ("filters", "names"):
        versions.discard(spark, f"{index}/{name}", keep=1)


# What a table keeps with its index


def begin(files: DataFrame, index: str) -> DataFrame:
    """Note the names that a batch is about to store; gives them as they were noted."""
    files.select("uri").distinct().write.mode("overwrite").parquet(f"{index}/pending")
    return files.sparkSession.read.schema("uri STRING").parquet(f"{index}/pending")


def finish(spark: SparkSession, index: str) -> None:
    """Add the names noted last, which are new and all of whose rows are stored."""
    _add_new(read_table(spark, f"{index}/pending", "uri STRING"), index)
    versions.remove(spark, f"{index}/pending")


def recover(spark: SparkSession, index: str, table: str, schema: str) -> None:
    """Settle what a batch that did not end has left: of the names noted, those with rows in the table are known.

    Also makes the index of a table that has none yet. Only in these two cases is the table read.
    """
    if versions.exists(spark, f"{index}/pending"):
        noted = spark.read.schema("uri STRING").parquet(f"{index}/pending")
        add_files(noted.join(read_table(spark, table, schema).select("uri").distinct(), "uri", "left_semi"), index)
        versions.remove(spark, f"{index}/pending")
    elif versions.exists(spark, table) and not versions.exists(spark, f"{index}/names"):
        add_files(read_table(spark, table, schema).select("uri"), index)
