"""The index of known files."""

import re

from pyspark.sql import functions as F

from fluentrail.schemas import DOCUMENT_EMBEDDINGS
from fluentrail.sources import known_files, tables
from fluentrail.streaming import ingest


def names(spark, *uris):
    return spark.createDataFrame([(u, "x") for u in uris], "uri STRING, text STRING")


def test_adding_twice_adds_nothing(spark, tmp_path):
    index = str(tmp_path / "index")
    assert known_files.known(names(spark, "a"), index).count() == 0
    for _ in range(2):
        known_files.add_files(names(spark, "a", "b", "b", None), index)
    known_files.add_files(names(spark, "b", "c"), index)
    stored = tables.read_table(spark, f"{index}/names", known_files.NAMES)
    assert sorted(r.uri for r in stored.collect()) == ["a", "b", "c"]
    known_files.fold_index(spark, index)
    known_files.add_files(names(spark, "d", "a"), index)
    asked = names(spark, "a", "c", "d", "e", None)
    assert sorted(r.uri for r in known_files.known(asked, index).collect()) == ["a", "c", "d"]
    assert sorted(str(r.uri) for r in known_files.unknown(asked, index).collect()) == ["None", "e"]


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(int(n) for n in re.findall(r"PartitionFilters: \[.*?folder", plan.toString()) and [leaf.metrics().apply("numFiles").value() for leaf in _leaves(plan)])


def _leaves(plan):
    found = []
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    if "QueryStage" in plan.nodeName():
        plan = plan.plan()
    if plan.metrics().contains("numFiles"):
        found.append(plan)
    children = plan.children()
    for i in range(children.size()):
        found += _leaves(children.apply(i))
    return found


def test_a_batch_reads_the_folders_of_its_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_files, "FOLDERS", 64)
    index, read = str(tmp_path / "index"), []
    for n in (200, 2000):
        known_files.add_files(spark.range(n).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("uri")), index)
        known_files.fold_index(spark, index)
        read.append(files_read(known_files.known(names(spark, "f/7", "f/8", "g/1"), index)))
    assert read[0] == read[1] and 0 < read[0] <= 6
    new = known_files.known(names(spark, *[f"h/{i}" for i in range(50)]), index)
    assert new.count() == 0
    # names that no filter has are not looked up: at two bits a thousand, none of fifty should be
    assert known_files.maybe_known(names(spark, *[f"h/{i}" for i in range(50)]), index).count() <= 1


def test_a_batch_that_did_not_end(spark, tmp_path):
    table = str(tmp_path / "chunks")
    index = f"{table}-files"
    ingest.ingest_batch(names(spark, "a", "b"), table)
    # ended behind the table and before the index: b2 is stored, c is not
    known_files.begin(names(spark, "b2", "c"), index)
    tables.append_rows(ingest.embed_documents(names(spark, "b2")), table, DOCUMENT_EMBEDDINGS)
    ingest.ingest_batch(names(spark, "a", "b2", "c"), table)
    assert sorted(r.uri for r in spark.read.parquet(table).collect()) == ["a", "b", "b2", "c"]
    # a table from before there was an index
    older = str(tmp_path / "older")
    tables.append_rows(ingest.embed_documents(names(spark, "a")), older, DOCUMENT_EMBEDDINGS)
    ingest.ingest_batch(names(spark, "a", "b"), older)
    assert sorted(r.uri for r in spark.read.parquet(older).collect()) == ["a", "b"]
