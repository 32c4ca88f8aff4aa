"""Metrics parsed when they are stored."""

from datetime import datetime

from fluentrail.operators import progress, rollup
from fluentrail.schemas import ANALYSIS_RESULTS, HISTORY
from fluentrail.sources import files, tables

METRICS = [
    '{"severity_score": 0.25, "filler_count": 3, "repetitions": 1, "total_words": 12345678901}',
    '{"severity_score": "0.5", "filler_count": "2"}',
    '{"severity_score": "n/a", "filler_count": 2.5}',
    '{"severity_score": null, "filler_count": true}',
    '{"severity_score": {"a": 1}, "filler_count": [1]}',
    '{"severity_score": 1e-3}',
    "{}",
    "[1]",
    "not json",
    "{broken",
    "",
    None,
]


def test_variant_reads_as_text_does(spark, tmp_path):
    rows = [(str(i), "t", m, "p", "[]", datetime(2024, 1, 1 + i), [0.0]) for i, m in enumerate(METRICS)]
    rows.append((None, "t", "{}", "p", "[]", datetime(2024, 1, 1), [0.0]))
    results = spark.createDataFrame(rows, ANALYSIS_RESULTS)
    path = str(tmp_path / "history")
    for part in (results.where("run_id < '5'"), results, results):
        tables.append_history(part, path)
    history = tables.read_table(spark, path, HISTORY)
    assert history.count() == len(METRICS)
    named = results.where("run_id is not null")
    read = files.read_history(spark, path)
    assert sorted(map(tuple, progress.history(read).collect())) == sorted(map(tuple, progress.history(named).collect()))
    assert sorted(map(tuple, progress.daily_fluency(read).collect())) == sorted(map(tuple, progress.daily_fluency(named).collect()))
    assert rollup.rollup(read).count() == len(METRICS)
    for report in (progress.history(read), progress.daily_fluency(read)):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert not any(name in plan for name in ("from_json", "json_tuple", "get_json_object", "parse_json"))
