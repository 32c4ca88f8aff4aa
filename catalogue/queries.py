"""The registered queries. Each takes the session and the folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs
from fluentrail.functions import scores, text
from fluentrail.operators import catalog, chunks, disfluency, incremental, kept, lists, metrics, progress, rollup, search, words
from fluentrail.operators.forecast import forecast
from fluentrail.operators.models import apply_model
from fluentrail.plans import analysis, prompts, retrieval, transcription
from fluentrail.schemas import ANALYSIS_RESULTS, DOCUMENT_EMBEDDINGS, METRICS
from fluentrail.session import scratch_path, spread, stored
from fluentrail.sources import files, keyed, known_files, tables
from fluentrail.streaming import daily as daily_stream
from fluentrail.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def six(column: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def averaged(df: DataFrame, *names: str) -> DataFrame:
    """``rounded`` for sums of fractions, whose last digits depend on the order of addition.

    A value that ends in 5 at the seventh place could go either way; the shift,
    which the SQL side has too, sends all of these up.
    """
    return df.withColumns({name: six(F.col(name) + 1e-9) for name in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: six(name) for name in names})


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})


# Words, flags, metrics


@query
def words_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return words.explode_words(inputs.transcripts(spark, sf))


@query
def words_from_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = words.parse_transcripts(words.with_result(inputs.stored_transcriptions(spark, sf)))
    return words.explode_words(parsed)


def _pauses_rounded(flags: DataFrame) -> DataFrame:
    """``rounded`` for a table of very many words."""
    return flags.withColumn("pause", scores.half_up(F.col("pause"), 6) + F.lit(0.0))


@query
def disfluency_flags(spark: SparkSession, sf: str) -> DataFrame:
    flagged = disfluency.flag_rows(inputs.transcripts(spark, sf))
    return _pauses_rounded(disfluency.highlight(flagged))


@query
def disfluency_flags_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = words.explode_words(inputs.transcripts(spark, sf))
    return _pauses_rounded(disfluency.highlight(disfluency.annotate_words(rows)))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.transcript_metrics(inputs.transcripts(spark, sf)).drop("words")


FRACTIONS = ("total_duration_sec", "speech_rate_wps", "severity_score")


@query
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = (
        _runs(spark, sf)
        .drop("transcript")
        .withColumn("fluency", scores.fluency(F.col("severity_score")))
        .withColumn("fluency_shown", scores.fluency_rounded(F.col("severity_score")))
    )
    return rounded(scored, *FRACTIONS, "fluency")


@query
def run_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = words.parse_transcripts(words.with_result(inputs.stored_transcriptions(spark, sf)))
    return rounded(metrics.transcript_metrics(parsed).select("uri", *metrics.METRIC_NAMES), *FRACTIONS)


@query
def run_metrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = words.explode_words(inputs.transcripts(spark, sf))
    return rounded(metrics.word_metrics(disfluency.annotate_words(rows)), *FRACTIONS)


@query
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metrics_long(_runs(spark, sf).drop("transcript"))


@query
def run_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("uri", F.array_join(metrics.patterns(), " | ").alias("patterns"))


@query
def plan_track(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("uri", prompts.plan_track().alias("plan_track"))


@query
def exercise_tiers(spark: SparkSession, sf: str) -> DataFrame:
    tiers = metrics.exercises(_runs(spark, sf).select("uri", "severity_score")).drop("severity_score")
    return long(tiers, "tier", "exercise", "points")


@query
def words_packed(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.transcripts(spark, sf).select("uri", metrics.packed(F.col("words")).alias("words_json"))


@query
def therapy_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.therapy_prompts(_runs(spark, sf)).select("uri", "plan_track", "prompt")


PROCESSED = datetime(2024, 1, 31, 12, tzinfo=UTC)


def _vector_text(column: str) -> Column:
    """All components in six decimals."""
    return F.array_join(F.transform(column, lambda x: (six(x)).cast("decimal(9,6)").cast("string")), ",")


def _shown(results: DataFrame) -> DataFrame:
    """All of the results; metrics one by one."""
    parsed = results.withColumn("_metrics", F.from_json("metrics", METRICS))
    shown = parsed.select(
        "run_id",
        "transcript",
        "therapy_plan",
        "_metrics.*",
        F.col("words_df").alias("words_json"),
        F.unix_timestamp("processed_at").alias("processed_at"),
        _vector_text("transcript_embedding").alias("embedding"),
    )
    return rounded(shown, *FRACTIONS)


@query
def analysis_results(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(analysis.analysis_results(inputs.stored_transcriptions(spark, sf), PROCESSED))


@query
def analysis_with_courses(spark: SparkSession, sf: str) -> DataFrame:
    """Whole results with the three courses for each run."""
    courses = stored(catalog.embed_courses(inputs.courses(spark, sf)), "courses")
    results = analysis.results_with_courses(inputs.stored_transcriptions(spark, sf), courses, PROCESSED)
    titles = F.transform("top_courses", lambda c: F.concat(c["course_id"], F.lit(" "), c["title"]))
    shown = _shown(results.drop("top_courses")).drop("words_json", "embedding")
    return shown.join(results.select("run_id", F.array_join(titles, ", ").alias("top_courses")), "run_id")


@query
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Results stored twice; the second time adds nothing."""
    path = scratch_path(spark, "results")
    tables.create_table(spark, path, ANALYSIS_RESULTS)
    answers = inputs.stored_transcriptions(spark, sf)
    for _ in range(2):
        analysis.store_new_results(answers, path, PROCESSED)
    replaced = scratch_path(spark, "replaced")
    tables.replace_table(tables.read_table(spark, path, ANALYSIS_RESULTS), replaced, ANALYSIS_RESULTS)
    return _shown(tables.read_table(spark, replaced, ANALYSIS_RESULTS))


def _stored_results(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "results")
    analysis.store_new_results(inputs.stored_transcriptions(spark, sf), path, PROCESSED)
    return path


@query
def stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history of the stored runs: their metrics were parsed into a history table, which is brought up to date twice."""
    results, path = tables.read_table(spark, _stored_results(spark, sf), ANALYSIS_RESULTS), scratch_path(spark, "history")
    for _ in range(2):
        tables.append_history(results, path)
    return progress.history(files.read_history(spark, path)).drop("processed_at")


@query
def similar_runs(spark: SparkSession, sf: str) -> DataFrame:
    """For every stored run the three nearest ones, itself among them."""
    results = tables.read_table(spark, _stored_results(spark, sf), ANALYSIS_RESULTS)
    asked = results.select(F.col("run_id").alias("query_id"), "transcript_embedding")
    shown = results.select(
        "run_id",
        "transcript_embedding",
        "therapy_plan",
        F.length("transcript").cast("bigint").alias("length"),
        F.get_json_object("metrics", "$.severity_level").alias("severity_level"),
    )
    columns = ("therapy_plan", "length", "severity_level")
    return _hits(retrieval.similar_cases(shown, asked, columns=columns)).select("query_id", "run_id", "rank", "distance", *columns)


# Progress and forecast

USER = ("user_id",)


@query
def progress_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = progress.history(inputs.runs(spark, sf), USER, in_order=True)
    return rows.drop("processed_at")


@query
def daily_fluency(spark: SparkSession, sf: str) -> DataFrame:
    return _days(progress.daily_fluency(inputs.runs(spark, sf), USER))


@query
def daily_fluency_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The same out of metrics that were parsed when they were stored."""
    return _days(progress.daily_fluency(stored(tables.history_rows(inputs.runs(spark, sf), USER), "history"), USER))


@query
def daily_fluency_all(spark: SparkSession, sf: str) -> DataFrame:
    return _days(progress.daily_fluency(inputs.runs(spark, sf)))


def _days(daily: DataFrame) -> DataFrame:
    return averaged(daily, "fluency_score").withColumn("processed_day", F.date_format("processed_day", "yyyy-MM-dd"))


@query
def daily_fluency_rounded(spark: SparkSession, sf: str) -> DataFrame:
    rows = progress.history(inputs.runs(spark, sf), USER)
    return averaged(progress.daily_fluency_rounded(rows, USER), "fluency_score")


@query
def progress_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(progress.kpis(progress.history(inputs.runs(spark, sf), USER), USER), "avg_fillers")


@query
def progress_kpis_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(progress.kpis(progress.history(inputs.runs(spark, sf))), "avg_fillers")


@query
def fluency_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast_shown(forecast(progress.daily_fluency(inputs.runs(spark, sf), USER), USER))


@query
def fluency_forecast_all(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast_shown(forecast(progress.daily_fluency(inputs.runs(spark, sf))))


def _forecast_shown(rows: DataFrame) -> DataFrame:
    shown = averaged(
        rows, "fluency_forecast", "prediction_interval_lower_bound", "prediction_interval_upper_bound"
    )
    return shown.withColumn("forecast_timestamp", F.date_format("forecast_timestamp", "yyyy-MM-dd HH:mm:ss"))


SUMMARY = ("initial_fluency", "latest_fluency", "improvement", "projected_fluency")


def _summary(spark: SparkSession, sf: str, series: tuple[str, ...]) -> DataFrame:
    return averaged(rollup.summary(rollup.rollup(inputs.runs(spark, sf), series), series), *SUMMARY)


def _stored_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of runs that came in four batches; the second came twice, and the first three were folded."""
    path, runs = scratch_path(spark, "rollup"), inputs.runs(spark, sf)
    schema = rollup.rollup_schema(runs, USER)
    for batch in (0, 1, 1, 2, 3):
        if batch == 3:
            rollup.fold(spark, path, schema, USER)
        rollup.add_runs(runs.where(F.pmod(F.xxhash64("run_id"), F.lit(4)) == batch), path, batch, USER)
    return rollup.read_rollup(spark, path, schema, USER)


@query
def rollup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return averaged(rollup.summary(_stored_rollup(spark, sf), USER), *SUMMARY)


@query
def rollup_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.kpis(_stored_rollup(spark, sf), USER), "avg_fillers")


@query
def rollup_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast_shown(forecast(rollup.daily_means(_stored_rollup(spark, sf), USER), USER))


@query
def progress_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, USER)


@query
def progress_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, ())


@query
def daily_fluency_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive in three deliveries, each with runs of all days: late runs and open days count."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, out, checkpoint = (scratch_path(spark, name) for name in ("arriving", "daily", "daily-checkpoint"))
    for delivery in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == delivery).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.schema).parquet(source)
        totals = daily_stream.day_totals_stream(inputs.runs_of(arriving), USER)
        daily_stream.keep_day_totals(totals, out, checkpoint, USER).awaitTermination()
    schema = daily_stream.totals_schema(events, USER)
    return _days(daily_stream.day_means(keyed.read_keyed(spark, out, schema, (*USER, "processed_day")), USER))


@query
def legacy_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two types carry an older analysis, the others text that is none."""
    events = inputs.table(spark, sf, "events", "event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    older = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit('{"transcript": "run '), F.col("event_id").cast("string"),
                F.lit('", "analysis": {"stammer_count": '), k, F.lit(', "patterns": ["block", "filler"]}}'),
            ),
        )
        .when(F.col("event_type") == "error", F.lit("not json"))
        .when(F.col("event_type") == "signup", F.lit('{"transcript": "short"}'))
        .otherwise(F.col("props"))
    )
    parsed = progress.older_analyses(events.withColumn("older", older), "older")
    sessions = progress.older_sessions(parsed, "2024-01-31")
    shown = sessions.select(
        "event_id",
        "transcript",
        "stammer_count",
        F.array_join("patterns", ",").alias("patterns"),
        F.array_join("suggestions", ",").alias("suggestions"),
        "date",
        "fluency_score",
        "confidence",
    )
    return long(shown, "stammer_count", "fluency_score", "confidence")


@query
def timestamps_local(spark: SparkSession, sf: str) -> DataFrame:
    events = inputs.table(spark, sf, "events", "event_id", "ts").withColumnRenamed("ts", "processed_at")
    return tables.with_local_time(events).select(
        "event_id",
        F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"),
        F.date_format("processed_at_ist", "yyyy-MM-dd HH:mm:ss").alias("processed_at_ist"),
    )


# Vector search


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = inputs.table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return base, base.select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(hits: DataFrame) -> DataFrame:
    return long(rounded(hits, "distance"), "rank")


@query
def similar_cases(spark: SparkSession, sf: str) -> DataFrame:
    base, asked = _cases(spark, sf)
    return long(_hits(search.top_k(base, asked, 3, ["vec_id"], ["query_id"], base_columns=("label",))), "label")


@query
def similar_cosine(spark: SparkSession, sf: str) -> DataFrame:
    base, asked = _cases(spark, sf)
    return _hits(search.top_k(base, asked, 5, ["vec_id"], ["query_id"], metric="cosine"))


@query
def similar_dot(spark: SparkSession, sf: str) -> DataFrame:
    base, asked = _cases(spark, sf)
    return _hits(search.top_k(base, asked, 5, ["vec_id"], ["query_id"], metric="dot"))


@query
def similar_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken when neither side is small."""
    base, asked = _cases(spark, sf)
    return _hits(search.top_k(base, asked, 3, ["vec_id"], ["query_id"], max_rows=1))


@query
def similar_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """All lists of a stored index searched, so the answer is exact."""
    base, asked = _cases(spark, sf)
    built = lists.build_lists(base, ["vec_id"], path=scratch_path(spark, "lists"))
    return _hits(lists.search_lists(built, asked, 3, ["query_id"], "embedding", fraction=1.0))


SHARE = 0.3


@query
def similar_share(spark: SparkSession, sf: str) -> DataFrame:
    """A share of stored lists searched: those whose centroids, the means of the labels, are nearest."""
    base, asked = _cases(spark, sf)
    path = scratch_path(spark, "lists")
    lists.build_lists(base, ["vec_id"], path=path, centroids=lists.mean_centroids(base, "label"))
    return _hits(lists.search_lists(lists.open_lists(spark, path), asked, 3, ["query_id"], "embedding", fraction=SHARE))


# Documents and retrieval


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_text(inputs.documents(spark, sf))


@query
def chunks_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """A parser's answer per document, its lines as chunks, taken apart again."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.concat(F.lit("c"), (i + 1).cast("string")).alias("chunkId"),
            line.alias("content"),
            F.struct((i + 1).alias("pageStart"), (i + 2).alias("pageEnd")).alias("pageSpan"),
        ),
    )
    answer = F.to_json(F.struct(F.struct(lines.alias("chunks")).alias("chunkedDocument")))
    parsed = inputs.documents(spark, sf).select("uri", answer.alias("ml_process_document_result"))
    return chunks.chunks_from_json(parsed)


def _components(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(vector).alias("bucket", "value"))
    return long(rounded(exploded, "value"), "bucket")


@query
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(inputs.table(spark, sf, "conversations", "conv_id", "turn", "text"))
    return _components(chunks.embed(rows, "text", "embedding"), ["conv_id", "turn"], "embedding")


@query
def course_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    embedded = catalog.embed_courses(inputs.courses(spark, sf))
    return _components(embedded, ["course_id", "title", "url"], "course_embedding")


@query
def course_embeddings_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Courses with vectors made elsewhere: those without one drop out."""
    made = inputs.table(spark, sf, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").cast("string").alias("course_id"), F.col("embedding").cast("array<double>").alias("course_embedding")
    )
    joined = catalog.join_embeddings(inputs.courses(spark, sf), made)
    return _components(joined, ["course_id", "title"], "course_embedding")


@query
def recommend_courses(spark: SparkSession, sf: str) -> DataFrame:
    """Three courses for every run."""
    runs = prompts.therapy_plans(prompts.therapy_prompts(_runs(spark, sf))).select(
        "uri", prompts.course_query().alias("query_text")
    )
    courses = stored(catalog.embed_courses(inputs.courses(spark, sf)), "courses")
    return _hits(retrieval.recommend_courses(courses, runs, ["uri"], "query_text"))


@query
def rag_prompts(spark: SparkSession, sf: str) -> DataFrame:
    passages = stored(ingest.embed_documents(inputs.documents(spark, sf)), "passages")
    return retrieval.rag_prompts(inputs.questions(spark, sf), passages)


@query
def rag_prompts_share(spark: SparkSession, sf: str) -> DataFrame:
    """Passages from a share of stored lists, one list for the passages of each language."""
    documents = inputs.documents(spark, sf, "lang")
    passages = stored(ingest.embed_documents(documents), "passages")
    centroids = lists.mean_centroids(passages.join(documents.select("uri", "lang"), "uri"), "lang", "text_embeddings")
    built = lists.build_lists(passages, ["uri", "chunk_id"], "text_embeddings", centroids=centroids)
    return retrieval.rag_prompts(inputs.questions(spark, sf), passages, lists=built, fraction=SHARE)


@query
def recommend_courses_share(spark: SparkSession, sf: str) -> DataFrame:
    """Three courses for every run out of a share of stored lists, one list for each category of courses."""
    runs = prompts.therapy_plans(prompts.therapy_prompts(_runs(spark, sf))).select(
        "uri", prompts.course_query().alias("query_text")
    )
    courses = stored(catalog.embed_courses(inputs.courses(spark, sf)), "courses")
    centroids = lists.mean_centroids(courses, "category", "course_embedding")
    built = lists.build_lists(courses, ["course_id"], "course_embedding", centroids=centroids)
    return _hits(retrieval.recommend_courses(courses, runs, ["uri"], "query_text", lists=built, fraction=SHARE))


@query
def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a stand-in for a model, which refuses some questions, says nothing to some, and keeps to the limit."""

    def make_model() -> Callable:
        def model(rows):
            if (rows["prompt"].str.len() % 3 == 0).any():
                raise ValueError("refused")
            said = rows["prompt"].str.slice(0, 5).where(rows["prompt"].str.len() % 3 == 1, " ")
            return {"answer": [text[:limit] for text, limit in zip(said, rows["max_output_tokens"], strict=True)]}

        return model

    asked = inputs.questions(spark, sf).withColumnRenamed("question", "prompt")
    return retrieval.answers(asked, make_model, max_tokens=4).drop("prompt")


@query
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents delivered twice; the second delivery adds nothing."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    out = scratch_path(spark, "chunks")
    for _ in range(2):
        rows = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
        arriving = rows.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"), "text")
        ingest.ingest_stream(arriving, out, scratch_path(spark, "chunks-checkpoint")).awaitTermination()
    stored = tables.read_table(spark, out, DOCUMENT_EMBEDDINGS)
    return stored.select(
        "uri",
        "chunk_id",
        "content",
        _vector_text("text_embeddings").alias("embedding"),
    )


# Files, courses, practice texts, models


@query
def new_files_only(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label are the new ones."""
    done = inputs.table(spark, sf, "labels", "doc_id").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri")
    )
    return incremental.new_files(inputs.documents(spark, sf).select("uri"), done)


@query
def known_file_index(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are added to the index in two batches, one of them twice; asked for are all documents."""
    index = scratch_path(spark, "index")
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri")
    labels = inputs.table(spark, sf, "labels", "doc_id", "quality")
    for good in (1, 0, 1):
        known_files.add_files(labels.where(F.coalesce("quality", F.lit(0)) == good).select(name), index)
    known_files.fold_index(spark, index)
    asked = inputs.table(spark, sf, "documents", "doc_id").select(name)
    found = known_files.known(asked, index).withColumn("known", F.lit(True))
    return asked.join(found, "uri", "left").select("uri", F.coalesce("known", F.lit(False)).alias("known"))


@query
def processed_files(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.processed_files(chunks.chunk_text(inputs.documents(spark, sf)))


@query
def wanted_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have a label, picked out before any model runs."""
    wanted = inputs.table(spark, sf, "labels", "doc_id").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri")
    )
    return incremental.wanted_files(inputs.documents(spark, sf).select("uri", "text"), wanted)


@query
def transcribe_split(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled documents and good ones were transcribed; a poor one failed, a toxic one for a known reason."""
    labels = inputs.table(spark, sf, "labels", "doc_id", "quality", "toxic")
    rows = inputs.table(spark, sf, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    transcripts = rows.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, F.col("text")).alias("transcripts"),
        F.when(F.col("toxic") == 1, "audio rejected").alias("ml_transcribe_status"),
    )
    worked, failed = incremental.split_transcripts(transcripts)
    return worked.select("uri", F.lit("transcribed").alias("outcome"), F.length("transcripts").cast("bigint").alias("length")).unionByName(
        failed.select("uri", F.col("reason").alias("outcome"), F.lit(None).cast("bigint").alias("length"))
    )


@query
def transcription_job(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as audio files, transcribed by a job of four runs.

    A stand-in for a recogniser gives the text back. It never takes files of toxic documents, and those of poor quality only from
    the second run on.
    """
    path = scratch_path(spark, "transcription")
    labels = inputs.table(spark, sf, "labels", "doc_id", "quality", "toxic")
    rows = inputs.table(spark, sf, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good")
    files_there = rows.select(F.concat(F.lit("audio/"), kind, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("uri"))
    listed = files_there.withColumn("content_type", text.content_type(F.col("uri")))

    def recogniser(run: int) -> Callable:
        def make() -> Callable:
            def recognise(given):
                if given["uri"].str.startswith("audio/toxic").any():
                    raise ValueError("audio rejected")
                if run == 0 and given["uri"].str.startswith("audio/poor").any():
                    raise ValueError("no answer in time")
                return {"transcripts": "of " + given["uri"], "ml_transcribe_result": "{}"}

            return recognise

        return make

    for run in range(4):
        # each run finds all files again, the first one but every other
        transcription.add_to_queue(listed.where("right(uri, 5) < '5.wav'") if run == 0 else listed, path, PROCESSED)
        transcription.run_queue(spark, path, recogniser(run), PROCESSED)
    stored_answers = transcription.read_transcripts(spark, path).groupBy("uri").agg(F.count("*").alias("stored"), F.max("transcripts").alias("transcripts"))
    queue = transcription.read_queue(spark, path).join(stored_answers, "uri", "left")
    return long(queue.select("uri", "content_type", "state", "tries", "reason", F.coalesce("stored", F.lit(0)).alias("stored"), "transcripts"), "tries", "stored")


@query
def answers_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Turns asked in two runs of a stand-in for a model: the second finds what the first kept, and asks no more of it.

    The first run asks the turns of users; the second all, and its model fails at any of a user's.
    """
    path = scratch_path(spark, "answers")
    turns = inputs.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")

    def make_model(run: str) -> Callable:
        def make() -> Callable:
            def model(rows):
                if run == "second" and (rows["role"] == "user").any():
                    raise ValueError("asked again")
                return {"characters": rows["text"].str.len()}

            return model

        return make

    for run, part in (("first", turns.where("role = 'user'")), ("second", turns)):
        answered = kept.apply_kept(part, make_model(run), "characters BIGINT", ["role", "text"], path, "length", run)
    held = spark.read.parquet(path).count()
    return answered.select("conv_id", "turn", "characters", "made_in", "status", F.lit(held).cast("bigint").alias("kept"))


@query
def practice_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language as categories: three known ones, the fourth unknown."""
    names = list(catalog.TOKEN_LIMITS)
    category = (
        F.when(F.col("lang") == "en", names[0])
        .when(F.col("lang") == "fr", names[1])
        .when(F.col("lang") == "de", names[3])
        .otherwise(F.col("lang"))
    )
    rows = inputs.table(spark, sf, "documents", "doc_id", "lang").select("doc_id", category.alias("category"))
    return long(prompts.practice_prompts(rows), "max_tokens")


@query
def practice_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as categories, their turns as texts."""
    return catalog.next_texts(
        inputs.table(spark, sf, "conversations", "conv_id", "turn", "text"), group="conv_id", pos="turn"
    ).withColumnRenamed("next_pos", "next_turn")


@query
def practice_texts_file(spark: SparkSession, sf: str) -> DataFrame:
    """Practice texts in JSON lines, one per category, read back and shown in turn."""
    path = scratch_path(spark, "texts")
    turns = inputs.table(spark, sf, "conversations", "conv_id", "turn", "text")
    # a line holds the texts of its category
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    listed.select(F.col("conv_id").cast("string").alias("category"), F.col("turns.text").alias("texts")).write.json(path)
    shown = catalog.next_texts(files.read_practice_texts(spark, path, json_lines=True))
    return long(shown, "pos", "next_pos")


@query
def courses_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Courses written as JSON lines and read back; rows without an id are set apart."""
    path = scratch_path(spark, "courses")
    courses = inputs.courses(spark, sf)
    courses.withColumn("url", F.when(F.col("category") != "Brand#1", F.col("url"))).write.json(path)
    fit, unfit = tables.split_courses(files.read_courses(spark, path, json_lines=True))
    return fit.withColumn("reason", F.lit(None).cast("string")).unionByName(unfit)


@query
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = inputs.table(spark, sf, "pages", "page_id", "url")
    name = text.file_name(F.col("url"))
    return pages.select(
        "page_id",
        name.alias("name"),
        text.content_type(F.col("url")).alias("content_type"),
        text.destination(F.col("url"), "documents").alias("destination"),
    )


@query
def apply_model_fake(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a model: it counts characters, and cannot read German."""

    def make_model() -> Callable:
        def model(rows):
            if (rows["lang"] == "de").any():
                raise ValueError("language not supported")
            return {"characters": rows["text"].str.len()}

        return model

    rows = spread(inputs.table(spark, sf, "documents", "doc_id", "lang", "text"))
    return apply_model(rows, make_model, "characters BIGINT", ["text", "lang"]).drop("text")
