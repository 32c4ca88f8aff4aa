"""The registered queries of the subpackage, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from fluentrail.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    answer = connection.execute(ORACLE[name])
    places = [[d[0] for d in answer.description].index(c) for c in names]
    wanted = [tuple(row[i] for i in places) for row in answer.fetchall()]
    assert wanted
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(wanted, key=repr)


def test_pipeline(spark, sf):
    packed = corpus_pipeline.run(spark, sf).toPandas()
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = set(packed["doc_id"])
    assert kept <= {r.doc_id for r in documents.select("doc_id").collect()} and len(kept) > 100
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "passages", "packing"]
    odd = documents.limit(3).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars").union(documents.limit(2)).union(documents.limit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd, sf)
        assert left.columns == documents.columns and left.filter("doc_id is null").count() == 3


def test_stages_decide_for_each_row(spark, sf, monkeypatch):
    from fluentrail.llm.toxicity import Lexicon

    monkeypatch.setattr(corpus_pipeline, "learn_labels", lambda *_: Lexicon(((" idiot ", 9.0),), scale=(-4.0, 0.0, 4.0)))
    core = " ".join(f"wörd{i}" for i in range(70))
    other = " ".join(f"日本{i}" for i in range(90))
    rows = [(None, "you idiot"), (1, "you idiot"), (1, "a clean text"), (2, core), (3, core + " more"), (3, other), (4, ""), (5, ""), (6, "same"), (6, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def texts(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    assert texts(corpus_pipeline.drop_toxic(spark, docs, sf)) == sorted(rows[2:], key=repr)
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, sf)) == sorted((rows[i] for i in (0, 1, 2, 3, 5, 6, 7, 8)), key=repr)
    cut = texts(corpus_pipeline.cut_passages(spark, docs, sf))
    assert (3, other) in cut and len(cut) == len(rows)
    assert sum(core in text for _, text in cut) == 1
