"""The default text embedding: hashed word counts.

It is lexical, not semantic: texts come out close if they share words. A caller
with a real model uses ``operators.models.apply_model`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluentrail.functions.binding import bind

# Width of the vectors, and what counts as a token.
BUCKETS = 64
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The first four hex digits of a token's MD5, as a number below ``buckets``."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % buckets


def hashed_embedding(text: Column, buckets: int = BUCKETS) -> Column:
    """Count of tokens per bucket, scaled to length 1; zeros for a text without tokens, null for none.

    All within the row, so embedding a table is a projection: no shuffle, and the
    other columns stay where they are.
    """

    def counts(hashes: Column) -> Column:
        each = F.sequence(F.lit(0), F.lit(buckets - 1))
        return F.transform(each, lambda b: (F.size(hashes) - F.size(F.array_remove(hashes, b))).cast("double"))

    hashes = F.transform(tokens(text), lambda t: bucket(t, buckets))
    return F.when(text.isNotNull(), bind(hashes, lambda h: unit_vector(counts(h))))


def unit_vector(vector: Column) -> Column:
    """A vector scaled to length 1; zeros stay zeros."""

    def scaled(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
        return bind(
            F.sqrt(squares), lambda length: F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))
        )

    return bind(vector, scaled)
