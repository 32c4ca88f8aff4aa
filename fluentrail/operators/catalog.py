"""Courses and practice texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.functions.embedding import hashed_embedding
from fluentrail.session import once

# Tokens a generated practice text may have, by category, and for any other.
TOKEN_LIMITS = {
    "Warm-up (short & simple)": 200,
    "Practice Sentences": 2000,
    "Conversational": 2000,
    "Longer Reading": 2500,
    "Therapy Drills": 2000,
}
OTHER_LIMIT = 150


def course_text() -> Column:
    """What of a course is embedded; null if any part is."""
    return F.concat("title", F.lit(" "), "description", F.lit(" Category: "), "category")


def embed_courses(courses: DataFrame) -> DataFrame:
    """Courses with the default embedding, in one pass over the table."""
    return once(courses, course_embedding=hashed_embedding(course_text()))


def join_embeddings(courses: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Courses with embeddings made elsewhere (``course_id, course_embedding``); both must have the id."""
    return courses.join(embeddings.select("course_id", "course_embedding"), "course_id", "inner")


def token_limit(category: Column) -> Column:
    """The token limit of a category; the lookup is five fixed values, so it is no join."""
    limits = F.create_map(*[F.lit(x) for pair in TOKEN_LIMITS.items() for x in pair])
    return F.coalesce(F.try_element_at(limits, category), F.lit(OTHER_LIMIT))


def next_texts(texts: DataFrame, group: str = "category", pos: str = "pos", text: str = "text") -> DataFrame:
    """Each text with the one shown after it: the next of its group, and after the last the first.

    ``pos`` counts from 0 without gaps within a group. Every text is sent to its own place and to the one before,
    where it is the follower; texts and followers meet by group and place, which spreads a large group over all
    tasks. Two rows a group stay alone, the last text and the first follower, and these two meet in the end.
    """
    own = F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))
    none = F.lit(None).cast(own_type(texts, pos, text))
    sent = F.array(
        F.struct(F.col(pos).alias("_place"), own.alias("_own"), none.alias("_next")),
        F.struct((F.col(pos) - 1).alias("_place"), none.alias("_own"), own.alias("_next")),
    )
    places = texts.select(group, F.inline(sent))
    met = places.groupBy(group, "_place").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_own", "_next")])
    inner = met.where(F.col("_own").isNotNull() & F.col("_next").isNotNull()).select(group, "_own", "_next")
    alone = met.where(F.col("_own").isNull() | F.col("_next").isNull())
    around = alone.groupBy(group).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_own", "_next")])
    return inner.unionByName(around).select(
        group, F.col("_own.pos").alias(pos), F.col("_own.text").alias(text), F.col("_next.pos").alias("next_pos"), F.col("_next.text").alias("next_text")
    )


def own_type(texts: DataFrame, pos: str, text: str) -> str:
    return f"struct<pos: {texts.schema[pos].dataType.simpleString()}, text: {texts.schema[text].dataType.simpleString()}>"
