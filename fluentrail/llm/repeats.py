"""Removal of byte strings that occur more than once, by difference-cover samples and their names.

Two places i and j of equal strings have a common shift after which both are sample places, since the sample is
a difference cover. So samples with the same name as another one show where repeats can begin; only there
the remaining places get names of the full length, which are sorted, and neighbours compared. A name is the
64-bit number of a string; names meet in fragments of their order, one task each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps, stored
from fluentrail.llm.shingles import mix, raw

#: Bytes of a string that counts as a repeat.
LENGTH = 200
#: Names of a fragment, about (up to twice as many of the full length); names that a task holds before it passes them on.
FRAGMENT, HELD = 7 << 20, 1 << 21
#: Parts in which a fragment is sorted: only one of them is held a second time.
SORTED = 16
#: Bytes that are numbered in one go.
BLOCK = 1 << 20
_rng = np.random.default_rng(73)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1


def difference_cover(r: int) -> tuple[int, list[int]]:
    """A period and places in it among which every difference occurs, after the construction of Colbourn and Ling."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *np.cumsum(gaps).tolist()]


PERIOD, COVER = difference_cover(1)
_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[COVER] = True


@lru_cache(maxsize=2)
def _powers(base: int, upto: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(upto, base, np.uint64)]), dtype=np.uint64)


def names(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the strings of ``length`` bytes that begin at the sorted places ``at``."""
    up = _powers(_BASE, BLOCK + LENGTH)
    down = _powers(pow(_BASE, -1, 1 << 64), BLOCK + LENGTH)
    out = np.empty(len(at), np.uint64)
    for start in range(0, len(body), BLOCK):
        low, high = np.searchsorted(at, [start, start + BLOCK])
        if low == high:
            continue
        part = body[start : start + BLOCK + length]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        place = at[low:high] - start
        out[low:high] = (sums[place + length] - sums[place]) * down[place]
    return mix(out)


def _fragment(name: np.ndarray, fragments: int) -> np.ndarray:
    return ((name >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _sample(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the samples in some texts one after another, and the text of each."""
    place = np.arange(ends[-1])
    sizes = np.diff(ends)
    inside = place - np.repeat(ends[:-1], sizes)
    keep = _SAMPLED[inside % PERIOD] & (inside + (length - PERIOD + 1) <= np.repeat(sizes, sizes))
    at = np.flatnonzero(keep)
    return at, (np.searchsorted(ends, at, side="right") - 1).astype(np.int64)


SENT = "fragment int, ids binary, counts binary, names binary"


def _send(ids: np.ndarray, owner: np.ndarray, name: np.ndarray, fragments: int, kind) -> pa.RecordBatch:
    """A row per fragment: documents, how many names each has there, and the names, by document and place."""
    fragment = _fragment(name, fragments)
    order = np.argsort(fragment, kind="stable")
    owner, name, fragment = owner[order], name[order], fragment[order]
    cuts = np.searchsorted(fragment, np.arange(fragments + 1))
    rows = []
    for f in np.flatnonzero(np.diff(cuts)).tolist():
        who, count = np.unique(owner[cuts[f] : cuts[f + 1]], return_counts=True)
        rows.append((f, ids[who].tobytes(), count.astype(np.uint32).tobytes(), name[cuts[f] : cuts[f + 1]].astype(kind).tobytes()))
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["fragment", "ids", "counts", "names"])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of a column of bytes, one row after another."""
    return np.concatenate([raw(chunk)[0].view(kind) for chunk in column.chunks])


def _again(*names: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Whether each name of some arrays, one after another, occurs again; parts by the last bits are sorted one at a time.

    With ``kept`` only the names it says count. The arrays are not put together: a copy is made of one part at a time.
    """
    starts = np.cumsum([0, *map(len, names)])
    again = np.zeros(starts[-1], bool)
    for p in range(SORTED):
        at = []
        for start, name in zip(starts.tolist(), names, strict=False):
            mine = name.view(np.uint8)[:: name.itemsize] % SORTED == p  # the last byte alone: no copy of the names
            if kept is not None:
                mine &= kept[start : start + len(name)]
            at.append(np.flatnonzero(mine).astype(np.uint32))
        own = np.concatenate([name[a] for name, a in zip(names, at, strict=True)])
        order = np.argsort(own)
        own = own[order]
        same = np.zeros(len(own) + 1, bool)
        same[1:-1] = own[1:] == own[:-1]
        found = np.zeros(len(own), bool)
        found[order] = same[1:] | same[:-1]
        ends = np.cumsum([len(a) for a in at])
        for start, a, end in zip(starts[:-1].tolist(), at, ends.tolist(), strict=True):
            again[start + a[found[end - len(a) : end]].astype(np.int64)] = True
    return again


def _meet(kind) -> Callable[[pa.Table], pa.Table]:
    """Sort a fragment's names; per document, in its own order, whether each is next to an equal one."""

    def run(table: pa.Table) -> pa.Table:
        ids, counts = _joined(table.column("ids"), np.int64), _joined(table.column("counts"), np.uint32).astype(np.int64)
        kept = None
        _, first = np.unique(ids, return_index=True)
        if len(first) < len(ids):
            once = np.zeros(len(ids), bool)
            once[first] = True  # equal texts count as one
            kept = np.repeat(once, counts)
        # the names stay where they came, row by row: a second copy of them would be the largest thing held
        again = _again(*(raw(chunk)[0].view(kind) for chunk in table.column("names").chunks), kept=kept)
        ends = np.cumsum(counts)
        some = np.flatnonzero(np.logical_or.reduceat(again, ends - counts)) if len(ids) else []
        bits = [np.packbits(again[ends[i] - counts[i] : ends[i]]).tobytes() for i in some]
        number = table.column("fragment")[0].as_py()
        return pa.table({"id": pa.array(ids[some], pa.int64()), "fragment": pa.array([number] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _repeated(sent: DataFrame, kind) -> DataFrame:
    """``id, marks``: of each document the fragments in which some of its names occur again, and which."""
    met = sent.groupBy("fragment").applyInArrow(_meet(kind), "id long, fragment int, bits binary")
    return met.groupBy("id").agg(F.collect_list(F.struct("fragment", "bits")).alias("marks"))


def _marked(name: np.ndarray, marks: list[dict], fragments: int) -> np.ndarray:
    """Which of a document's names, in their own order, are marked."""
    fragment = _fragment(name, fragments)
    out = np.zeros(len(name), bool)
    for mark in marks or []:
        own = np.flatnonzero(fragment == mark["fragment"])
        out[own] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=len(own)).astype(bool)
    return out


def _begins(body: np.ndarray, marks: list[dict], fragments: int, length: int) -> np.ndarray:
    """Places at which a repeat may begin: those before a sample that occurs again, up to a period away."""
    at, _ = _sample(np.array([0, len(body)]), length)
    again = at[_marked(names(body, at, length - PERIOD + 1), marks, fragments)]
    step = np.zeros(len(body) + 2, np.int32)
    np.add.at(step, np.maximum(again - PERIOD + 1, 0), 1)
    np.add.at(step, again + 1, -1)
    may = np.flatnonzero(np.cumsum(step) > 0)
    return may[may + length <= len(body)]


def _runs(places: np.ndarray) -> np.ndarray:
    """Sorted places as runs: the first and the last of each."""
    cut = np.flatnonzero(np.diff(places) > 1)
    ends = np.concatenate([places[:1], places[np.stack([cut, cut + 1], 1).ravel()], places[-1:]])
    return ends.astype(np.int32)


def _places(runs: bytes) -> np.ndarray:
    """The places of such runs."""
    first, last = np.frombuffer(runs, np.int32).astype(np.int64).reshape(-1, 2).T
    sizes = last - first + 1
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def spans(begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` that begin at the sorted places: starts and ends."""
    if not len(begins):
        return begins, begins
    cut = np.flatnonzero(np.diff(begins) > length)
    return begins[np.append(0, cut + 1)], begins[np.append(cut, len(begins) - 1)] + length


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``digest, id, size, copies, spans array<struct<start, end>>, kept_digest`` of each distinct text, in bytes.

    A span is a maximal run of bytes covered by strings of ``length`` (at least 74) bytes that begin at two or
    more places of the table; ``digest`` is the SHA-256 of the text, ``kept_digest``
    that of its bytes outside the spans. A text that several rows have is one span
    where it is long enough. Null counts as empty; short texts have no spans.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be above {PERIOD}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = docs.select(F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    classes = sized.groupBy("digest", "size").agg(F.count("*").alias("copies")).withColumn("id", F.xxhash64("digest"))
    classes = stored(classes.select("digest", "id", "size", "copies"), "repeat-classes")
    total = classes.filter(f"size >= {length}").agg(F.sum("size")).first()[0] or 0
    source = docs.select(F.xxhash64(F.sha2(body, 256)).alias("id"), body.alias("text")).filter(F.octet_length("text") >= length)

    # names of the samples
    fragments = max(8, math.ceil(total * len(COVER) / PERIOD / FRAGMENT))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, waiting, ids = 0, [], batch.column(0).to_numpy()
            upto = 0
            for part in steps(batch):
                flat, ends = raw(part.column(1))
                at, owner = _sample(ends, length)
                waiting.append((owner + upto, names(flat, at, length - PERIOD + 1)))
                upto += len(part)
                held += len(at)
                if held >= HELD:
                    yield _send(ids, *(np.concatenate(c) for c in zip(*waiting, strict=True)), fragments, np.uint32)
                    held, waiting = 0, []
            if waiting:
                yield _send(ids, *(np.concatenate(c) for c in zip(*waiting, strict=True)), fragments, np.uint32)

    again = _repeated(source.mapInArrow(samples, SENT), np.uint32)

    # the remaining places that may begin a repeat, as runs; their names may need more fragments

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, number = [], []
            for one, marks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                begins = _begins(np.frombuffer(one.as_buffer(), np.uint8), marks, fragments, length)
                found.append(_runs(begins).tobytes())
                number.append(len(begins))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(number, pa.int64())], ["id", "text", "begins", "places"])

    open_texts = source.join(again, "id").select("id", "text", "marks").mapInArrow(opened, "id long, text string, begins binary, places long")
    open_texts = stored(open_texts, "repeat-open")
    named = max(fragments, math.ceil((open_texts.agg(F.sum("places")).first()[0] or 0) / (2 * FRAGMENT)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, waiting, ids = 0, [], batch.column(0).to_numpy()
            for i, (one, runs) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                flat = np.frombuffer(one.as_buffer(), np.uint8)
                begins = _places(runs)
                waiting.append((np.full(len(begins), i), names(flat, begins, length)))
                held += len(begins)
                if held >= HELD:
                    yield _send(ids, *(np.concatenate(c) for c in zip(*waiting, strict=True)), named, np.uint64)
                    held, waiting = 0, []
            if waiting:
                yield _send(ids, *(np.concatenate(c) for c in zip(*waiting, strict=True)), named, np.uint64)

    equal = _repeated(open_texts.select("id", "text", "begins").mapInArrow(places, SENT), np.uint64).withColumnRenamed("marks", "equal")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out, kept = [], []
            for one, runs, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flat = np.frombuffer(one.as_buffer(), np.uint8)
                begins = _places(runs)
                starts, ends = spans(begins[_marked(names(flat, begins, length), found, named)], length)
                out.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                body = one.as_buffer().to_pybytes()
                rest = b"".join(body[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(body)], strict=True))
                kept.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(kept, pa.string())], ["id", "spans", "kept_digest"])

    covered = open_texts.join(equal, "id").select("id", "text", "begins", "equal").mapInArrow(cover, "id long, spans array<struct<start: long, end: long>>, kept_digest string")
    covered = covered.groupBy("id").agg(F.max("spans").alias("spans"), F.max("kept_digest").alias("kept_digest"))  # the same for all copies
    none = F.array().cast("array<struct<start: long, end: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    copied = (F.col("copies") > 1) & (F.col("size") >= length)
    found = F.when(copied, whole).otherwise(F.coalesce("spans", none))
    rest = F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_digest", "digest"))
    return classes.join(covered, "id", "left").select("digest", "id", "size", "copies", found.alias("spans"), rest.alias("kept_digest"))


def removed_bytes(found: Column) -> Column:
    none = F.array().cast("array<struct<start: long, end: long>>")
    return F.aggregate(F.coalesce(found, none), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, kept binary, n_bytes, n_removed, spans`` per row: its text without the bytes of repeated strings.

    Every byte covered by a string of ``length`` bytes that also begins anywhere else, in the same text or in
    another, is removed, at all places; overlapping strings count. A null text is empty; null keys stay null;
    rows that repeat a text lose it whole where it is long enough. Other columns are left out; an empty table
    gives no rows. What is left may end within a sign, so ``kept`` is bytes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).alias("key"), body.alias("text"), F.sha2(body, 256).alias("digest"))
    known = stored(repeated_spans(docs, text, length).filter(F.size("spans") > 0).select("digest", "spans"), "repeat-spans")
    joined = source.join(known, "digest", "left").select("key", "text", "spans")
    removed = removed_bytes(F.col("spans"))
    raw_bytes = F.col("text").cast("binary")
    # what lies before each span, and behind the last
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    pieces = F.zip_with(ends, starts, lambda a, b: F.hex(F.substring(raw_bytes, (a + 1).cast("int"), (b - a).cast("int"))))
    kept = F.when(F.col("spans").isNull(), raw_bytes).otherwise(F.unhex(F.array_join(pieces, "")))
    return joined.select(F.col("key").alias(key), kept.alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), "spans")
