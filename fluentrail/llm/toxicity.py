"""Toxicity of texts by a weighted lexicon, matched by Aho-Corasick in folded texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps, stored

#: Labelled rows that the lexicon and its scale are fitted on, at most: those with the smallest hashes.
TRAIN_ROWS = 12_000
#: Entries of a lexicon, at most; and of its exception phrases.
MOST_TERMS, MOST_EXCEPTIONS = 2_000, 500
#: Letters of word beginnings that may become an entry, besides whole words of the first of these or more.
STEM_LETTERS = range(4, 9)
#: Share of the toxic training rows, and rows, in which an entry occurs at least; its least weight.
LEAST_SHARE, LEAST_ROWS, LEAST_WEIGHT = 0.01, 3, 2.0
#: Standard errors by which an entry's log ratio must stay above 0.
SURE = 1.64
#: Words by which a text counts as longer than it is, so that one weak entry in a few words says little.
EXTRA_WORDS = 20
#: Clean training rows in which an exception phrase occurs at least.
EXCEPTION_ROWS = 3

#: Signs that look like a Latin letter, digits and signs written in its place.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Signs that do not show.
UNSEEN = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in UNSEEN}
    return table


PLAIN = _table()


def fold(text: str | None) -> str:
    """Lower case, lookalikes as letters, all other signs as spaces, a space at either end.

    Digits and signs become letters only in a word that also holds a letter and ends in one, so that
    numbers stay apart and an exclamation mark behind a word is none of its letters.
    """
    if not text:
        return "  "
    text = text.lower()
    if any(sign in text for sign in SUBSTITUTES):
        text = " ".join(_unmask(word) for word in text.split())
    return f" {text.translate(PLAIN)} "


def _unmask(word: str) -> str:
    if word.isalpha():
        return word
    body = word.rstrip(".,;:!?)\"'")
    if body.isalpha() or not any(sign in body for sign in SUBSTITUTES) or not any(map(str.isalpha, body)):
        return word
    return "".join(SUBSTITUTES.get(sign, sign) for sign in body) + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, phrases in which an entry does not count, and the scale of the score.

    An entry or phrase is folded text: ``" idiot "`` is a word, ``" idio"`` the beginning of one.
    """

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        """0 to 1 from the weight found and the length in words."""
        bias, by_length, by_weight = self.scale
        x = bias + by_length * np.log1p(100 * weight / (words + EXTRA_WORDS)) + by_weight * np.log1p(weight)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    entries: dict[str, tuple[int, float | None]] = {term: (len(term), weight) for term, weight in terms}
    entries |= {phrase: (len(phrase), None) for phrase in exceptions}
    for text, value in entries.items():
        machine.add_word(text, value)
    if entries:
        machine.make_automaton()
    return machine if entries else None


def hits(folded: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """Start, end and weight of the entries that count: the heaviest of those that start at one place."""
    machine = _automaton(lexicon.terms, lexicon.exceptions)
    if machine is None:
        return []
    found: dict[int, tuple[int, float]] = {}
    excepted = []
    for last, (length, weight) in machine.iter(folded):
        start = last + 1 - length
        if weight is None:
            excepted.append((start, last + 1))
        elif start not in found or found[start][1] < weight:
            found[start] = (last + 1, weight)
    for start, end in excepted:
        for at in [at for at, (upto, _) in found.items() if start <= at and upto <= end]:
            del found[at]
    return [(start, end, weight) for start, (end, weight) in found.items()]


def _batches(out: pa.Schema, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(make(part), out, strict=True)], schema=out)

    return run


def _grams(folded: str) -> set[str]:
    words = {word for word in folded.split() if len(word) >= STEM_LETTERS[0]}
    return {" " + word[:k] for word in words for k in STEM_LETTERS if len(word) >= k} | {f" {word} " for word in words}


GRAM_SCHEMA = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
FEATURE_SCHEMA = pa.schema([("label", pa.int32()), ("weight", pa.float64()), ("words", pa.int64())])


def _count_grams(part: pa.RecordBatch):
    count = (Counter(), Counter())
    for label, folded in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        count[1 - label].update(_grams(folded))
    names = list(count[0] | count[1])
    return [names, [count[0][g] for g in names], [count[1][g] for g in names]]


def _phrases(folded: str, found: list[tuple[int, int, float]]) -> set[str]:
    """Each entry's word with the word before it, and with the word behind it."""
    out = set()
    for start, end, _ in found:
        close = end if folded[end - 1] == " " else folded.index(" ", end) + 1
        if len(behind := folded[close : close + 64].split(" ", 1)) > 1 and behind[0]:
            out.add(folded[start:close] + behind[0] + " ")
        if before := folded[max(0, start - 64) : start].rsplit(" ", 1)[-1]:
            out.add(" " + before + folded[start:close])
    return out


def _select(rows: list, toxic: int, clean: int) -> tuple[tuple[str, float], ...]:
    """Weighted entries: of beginnings that occur in the same rows the longest, then none that a shorter one covers."""
    known = {r["gram"]: (r["toxic"], r["clean"]) for r in rows}
    longer = {g[:-1]: g for g in sorted(known) if known.get(g[:-1]) == known[g]}
    ratio = {g: math.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5)) for g, (t, c) in known.items() if g not in longer}
    weight = {g: w for g, w in ratio.items() if w > SURE * math.sqrt(1 / (known[g][0] + 0.5) + 1 / (known[g][1] + 0.5))}
    chosen: dict[str, float] = {}
    for gram in sorted(weight, key=lambda g: (len(g), g)):
        covered = max((chosen[gram[:k]] for k in range(2, len(gram)) if gram[:k] in chosen), default=-math.inf)
        if weight[gram] >= LEAST_WEIGHT and weight[gram] > covered + 0.5:
            chosen[gram] = round(weight[gram], 6)
    return tuple(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MOST_TERMS])


def _fit(label: np.ndarray, weight: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two measures, by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(label)), np.log1p(100 * weight / (words + EXTRA_WORDS)), np.log1p(weight)], 1)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - label) + 0.05 * np.array([0, *b[1:]])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.05]), slope)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 9) for v in b)


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon, exception phrases and scale from rows with a label of 0 or 1.

    Rows with another label or none do not count. Of more than ``rows`` rows those with the smallest
    hashes of key and text are taken. Counts are formed in Spark; the driver gets the entries and one short
    row per training row. Without toxic rows the lexicon is empty and the score is the same everywhere.
    """
    source = labelled.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")).filter("label in (0, 1)")
    order = F.xxhash64(F.col("key").cast("string"), "text")
    return _learn(source.orderBy(order, "label").limit(rows).select("label", "text"))


def _learn(sample: DataFrame) -> Lexicon:
    folded = _batches(pa.schema([("label", pa.int32()), ("folded", pa.string())]), lambda part: [part.column(0), [fold(t) for t in part.column(1).to_pylist()]])
    train = stored(sample.repartition(16).mapInArrow(folded, "label int, folded string"), "toxicity-train")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon((), scale=(-4.0, 0.0, 0.0))
    grams = train.mapInArrow(_batches(GRAM_SCHEMA, _count_grams), "gram string, toxic long, clean long")
    grams = grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * toxic))
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    rich = grams.filter((F.col("toxic") >= least) & (ratio * (clean + 1) / (toxic + 1) >= math.exp(LEAST_WEIGHT)))
    terms = _select(rich.orderBy(ratio.desc(), F.col("toxic").desc(), "gram").limit(10 * MOST_TERMS).collect(), toxic, clean)
    plain = Lexicon(terms)

    def contexts(part: pa.RecordBatch):
        pairs = [(p, y) for y, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for p in _phrases(f, hits(f, plain))]
        return [[p for p, _ in pairs], [y for _, y in pairs], [1 - y for _, y in pairs]]

    seen = train.mapInArrow(_batches(GRAM_SCHEMA, contexts), "gram string, toxic long, clean long")
    seen = seen.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    benign = seen.filter((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_ROWS)).orderBy(F.col("clean").desc(), "gram").limit(MOST_EXCEPTIONS)
    lexicon = Lexicon(terms, tuple(r["gram"] for r in benign.collect()))

    def features(part: pa.RecordBatch):
        texts = part.column(1).to_pylist()
        return [part.column(0), [sum(w for _, _, w in hits(f, lexicon)) for f in texts], [len(f.split()) for f in texts]]

    fit = train.mapInArrow(_batches(FEATURE_SCHEMA, features), "label int, weight double, words long").toPandas()
    fit = fit.sort_values(["label", "weight", "words"])
    scale = _fit(fit["label"].to_numpy(float), fit["weight"].to_numpy(float), fit["words"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.exceptions, scale)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``score double``, ``weight double``, ``words long``, ``terms array<string>``.

    The weight is that of the entries in the folded whole text, the score sets it against the length. A null
    or empty text scores as one without entries; null keys stay null, repeated rows are scored each, other
    columns are left out. Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType
    out = pa.schema([("key", to_arrow_type(kind)), ("score", pa.float64()), ("weight", pa.float64()), ("words", pa.int64()), ("terms", pa.list_(pa.string()))])

    def make(part: pa.RecordBatch):
        texts = [fold(t) for t in part.column(1).to_pylist()]
        found = [hits(f, lexicon) for f in texts]
        weight = np.array([math.fsum(w for _, _, w in h) for h in found])
        words = np.array([len(f.split()) for f in texts], np.int64)
        terms = [sorted({f[a:b] for a, b, _ in h}) for f, h in zip(texts, found, strict=True)]
        return [part.column(0), lexicon.score(weight, words), weight, words, terms]

    return source.mapInArrow(_batches(out, make), f"key {kind.simpleString()}, score double, weight double, words long, terms array<string>").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, lexicon: Lexicon, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores below ``least``; each is decided where it is read."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, place):
                folded = [fold(t) for t in part.column(place).to_pylist()]
                weight = np.array([math.fsum(w for _, _, w in hits(f, lexicon)) for f in folded])
                yield part.filter(pa.array(lexicon.score(weight, np.array([len(f.split()) for f in folded], np.int64)) < least))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def learn_labels(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """Lexicon of the documents whose label may be learned from; contradicting labels count as 1.

    At most ``TRAIN_ROWS`` labelled keys are learned from, each with one text: of several, the smallest.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    # a bounded sample of keys first: the texts are read once and only those of the sample are moved
    sample = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_ROWS)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text a key, so that the bound holds for rows too
    return _learn(labelled.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text"))
