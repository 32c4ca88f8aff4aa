"""Packing token pieces into few sequences by best fit in supersteps.

A superstep deals the unplaced pieces and the gaps of open sequences out to ranges of their size, the largest
first. Each task sweeps down its range: a piece goes to its successor, the smallest gap that holds it; where
several pieces have one successor, the first in rank (the longer, then the smaller number) gets it, and the others
the next one. What a placement leaves free is a gap again. Pieces and gaps that a sweep leaves over meet
other ranges in the next superstep, until every piece is placed.

Where a gap goes, and how many pieces open a sequence, is worked out from counts of pieces and gaps by size
class: at most 64 classes for each doubling of the capacity, however many documents there are.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps, stored

#: What a row of a superstep is.
PIECE, GAP, PLACED = 0, 1, 2
#: Rows of a range.
RANGE_ROWS = 1 << 15
#: Quantiles of the places in a class.
POINTS = 256
#: Bits of a piece's number within its task.
TASK_SHIFT = 36
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level vocabulary file, special tokens in the text as such."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        described = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {token["content"]: token["id"] for token in described["added_tokens"]}
    ranks = {bytes(signs[c] for c in token): rank for token, rank in described["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    plain = Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of white space that is too long for its pattern
            return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document: ``piece_no, doc_id, piece, start, length, crc32`` and, if wanted, ``ids``.

    A document longer than the capacity is cut so that all pieces but the first are as long as the capacity.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"piece_no long, doc_id {key}, piece int, start long, length long, crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(vocabulary), TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            for part in steps(batch):
                rows: list[tuple[int, int, int, int, int]] = []
                ids: list[np.ndarray] = []
                for row, text in enumerate(part.column(1)):
                    coded = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    first = len(coded) % capacity or capacity
                    for piece, start in enumerate([0, *range(first, len(coded), capacity)]):
                        own = coded[start : first if piece == 0 else start + capacity]
                        rows.append((row, piece, start, len(own), zlib.crc32(own)))
                        ids.append(own)
                at, piece, start, length, crc = (np.array(column, np.int64) for column in zip(*rows, strict=True))
                columns = [pa.array(number + np.arange(len(rows))), part.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                number += len(rows)
                names = ["piece_no", "doc_id", "piece", "start", "length", "crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def size_class(size: Column) -> Column:
    """The smallest size of a class; sizes of a class have seven leading binary digits in common."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


class Routes:
    """Where gaps of a class are to go, as shares: up to which part of their rows, to the pieces of which class."""

    def __init__(self) -> None:
        self.shares: dict[tuple[int, int], list[list[float]]] = defaultdict(list)
        self.open: dict[int, int] = {}

    def add(self, origin: tuple[int, int], share: float, target: int) -> None:
        known = self.shares[origin]
        upto = (known[-1][0] if known else 0.0) + share
        if known and known[-1][1] == target:
            known[-1][0] = upto
        else:
            known.append([upto, target])

    def target(self, origin: tuple[int, int], place: float) -> int:
        """The class for the gap at a place from 0 to 1 among those of its origin; its own if none wants it."""
        for upto, target in self.shares.get(origin, ()):
            if place < upto:
                return target
        return origin[1]


def plan_routes(pieces: dict[int, tuple[int, int]], gaps: dict[int, tuple[int, int]], capacity: int) -> Routes:
    """Best fit of classes, longest pieces first: ``class -> (rows, size)`` of pieces and of gaps.

    A gap's first use says where it goes in this superstep; a class that finds no gap opens sequences.
    """
    routes = Routes()
    free: dict[int, list[list]] = defaultdict(list)
    sizes: list[int] = []

    def put(size: int, rows: int, origin: tuple[int, int] | None, of: int) -> None:
        if size > 0 and rows > 0:
            if not free.get(size):
                insort(sizes, size)
            free[size].append([rows, origin, of])

    for key, (rows, size) in gaps.items():
        put(size, rows, (GAP, key), rows)
    for key in sorted(pieces, reverse=True):
        rows, size = pieces[key]
        left = rows
        while left > 0:
            at = bisect_left(sizes, size)
            if at == len(sizes):
                each = capacity // size
                opened = -(-left // each)
                routes.open[key] = opened
                if min(each, left) > 1:
                    routes.add((PIECE, key), 1.0, key)
                origin = (PIECE, key) if min(each, left) == 1 else None
                put(capacity - each * size, left // each, origin, opened)
                put(capacity - left % each * size, int(left % each > 0), origin, opened)
                break
            gap = sizes[at]
            stack = free[gap]
            have, origin, of = stack[-1]
            each = gap // size
            used = min(have, -(-left // each))
            last = max(0, used * each - left)
            left -= used * each
            if origin is not None:
                routes.add(origin, used / of, key)
            if used == have:
                stack.pop()
                if not stack:
                    del sizes[at]
            else:
                stack[-1][0] -= used
            put(gap - each * size, used - (last > 0), None, used)
            put(gap - (each - last) * size, int(last > 0), None, used)
    return routes


def _route(routes: Routes, places: dict[int, tuple[int, float, list[float]]], shelves: dict[int, int], smallest: int, capacity: int) -> Callable:
    """Rows of a superstep with the class they go to, and the shelf there; pieces that open a sequence become placed and a gap.

    A class of many rows has several shelves. The rows of one shelf meet in one range, however few rows a range has.

    ``places`` has for each class of pieces its rows, the first of their places, and ``POINTS`` quantiles: as many
    pieces open a sequence as planned, or up to one in ``POINTS`` fewer where a class has more rows than that.
    """
    open_upto = {}
    for key, opened in routes.open.items():
        rows, first, points = places[key]
        at = opened * POINTS // rows
        open_upto[key] = points[at - 1] if at else first

    def shelf(key: int, place: float) -> int:
        return int(place * shelves.get(key, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, number, size, key, place, other in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == GAP:
                    if size >= smallest:
                        target = routes.target((GAP, key), place)
                        out.append((GAP, number, size, target, shelf(target, other), None, None))
                elif place <= open_upto.get(key, -1.0):
                    out.append((PLACED, number, size, key, shelf(key, other), number, 0))
                    if capacity - size >= smallest:
                        target = routes.target((PIECE, key), other)
                        # what decides the target must not decide the shelf
                        out.append((GAP, number, capacity - size, target, shelf(target, number * 0.6180339887498949 % 1), None, None))
                else:
                    out.append((PIECE, number, size, key, shelf(key, other), None, None))
            yield _batch(out, ["kind", "id", "size", "class", "shelf", "sequence", "offset"], ROUTED)

    return run


ROUTED = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
SWEPT = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _sweep(capacity: int) -> Callable:
    """One pass down a range: each piece to its successor among the gaps met so far."""
    names = ["kind", "id", "size", "sequence", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[int, list[int]] = defaultdict(list)
        sizes: list[int] = []
        for batch in batches:
            out: list[tuple] = []
            for kind, number, size, sequence, offset in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == PLACED:
                    out.append((PLACED, number, size, sequence, offset))
                    continue
                if kind == GAP:
                    rest, sequence = size, number
                else:
                    at = bisect_left(sizes, size)
                    if at == len(sizes):
                        out.append((PIECE, number, size, None, None))
                        continue
                    gap = sizes[at]
                    sequence = free[gap].pop()
                    if not free[gap]:
                        del sizes[at]
                    out.append((PLACED, number, size, sequence, capacity - gap))
                    rest = gap - size
                if rest:
                    if not free[rest]:
                        insort(sizes, rest)
                    free[rest].append(sequence)
            yield _batch(out, names, SWEPT)
        for size in sizes:
            own = free[size]
            yield _batch([(GAP, number, size, None, None) for number in own], names, SWEPT)

    return run


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``id, sequence, offset`` of pieces given as ``id, size``, all shorter than the capacity and not empty."""
    state = pieces.select(F.lit(PIECE).alias("kind"), "id", "size")
    placed, before, step = [], -1, 0
    quantiles = F.percentile_approx(F.when(F.col("kind") == PIECE, F.col("place")), [(i + 1) / POINTS for i in range(POINTS)], 10000)
    while True:
        key = size_class(F.col("size"))
        draw = [(F.pmod(F.xxhash64("id", F.lit(step), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)) for i in (0, 1)]
        rows = state.filter(F.col("kind") != PLACED).select("kind", "id", "size", key.alias("class"), draw[0].alias("place"), draw[1].alias("other"))
        counted = rows.groupBy("kind", "class").agg(F.count("*"), F.sum("size"), F.min("size"), F.max("size"), F.min("place"), quantiles).collect()
        waiting = {row[1]: row for row in counted if row[0] == PIECE}
        if not waiting:
            break
        left = sum(row[2] for row in waiting.values())
        # after a superstep without effect, sizes are rounded so that a match of classes is one of rows, and
        # all rows of a class meet, so that the next one has an effect
        exact = left == before
        smallest = min(row[4] for row in waiting.values())
        gaps = {row[1]: (row[2], row[4] if exact else row[3] // row[2]) for row in counted if row[0] == GAP and row[5] >= smallest}
        wanted = {k: (row[2], row[5] if exact else -(-row[3] // row[2])) for k, row in waiting.items()}
        routes = plan_routes(wanted, gaps, capacity)
        shelves = {} if exact else {k: 1 + row[2] // RANGE_ROWS for k, row in waiting.items()}
        route = _route(routes, {k: (row[2], row[6], row[7]) for k, row in waiting.items()}, shelves, smallest, capacity)
        routed = rows.mapInArrow(route, "kind int, id long, size long, class long, shelf int, sequence long, offset long")
        ranges = 1 + (left + sum(n for n, _ in gaps.values())) // RANGE_ROWS
        dealt = routed.repartitionByRange(ranges, F.desc("class"), "shelf")
        in_order = dealt.sortWithinPartitions(F.desc("class"), F.desc(F.col("kind") == GAP), F.desc("size"), "id")
        swept = in_order.select("kind", "id", "size", "sequence", "offset").mapInArrow(_sweep(capacity), "kind int, id long, size long, sequence long, offset long")
        state = stored(swept, f"bestfit-{step}")
        placed.append(state.filter(F.col("kind") == PLACED).select("id", "sequence", "offset"))
        before, step = left, step + 1
    found = pieces.limit(0).select("id", F.lit(0).cast("long").alias("sequence"), F.lit(0).cast("long").alias("offset"))
    for more in placed:
        found = found.union(more)
    return found


def pack_best_fit(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into few sequences of at most ``capacity`` tokens.

    Args:
        docs: Other columns are not read.
        vocabulary: A byte-level vocabulary file that all executors can read.
        capacity: Most tokens of a sequence, 1 at least.
        end_id: The id behind each document.
        with_ids: Whether to return the ids of each piece.

    Returns:
        A row per piece: ``doc_id, piece`` (from 0), ``start`` (the document's ids before it), ``length, crc32``
        (of the ids as little-endian unsigned 32-bit numbers), ``sequence_id, offset`` and, if wanted, ``ids``. The
        pieces of a sequence lie behind each other from 0 without gaps.

    A document without text, null or empty, is its end id alone. Null ids stay null. Repeated rows and rows that share
    an id are documents of their own. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = stored(cut_pieces(docs, vocabulary, capacity, end_id, with_ids), "bestfit-pieces")
    short = pieces.filter(F.col("length") < capacity).select(F.col("piece_no").alias("id"), F.col("length").alias("size"))
    places = place_pieces(short, capacity)
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("piece_no")).withColumn("offset", F.lit(0).cast("long"))
    fitted = pieces.filter(F.col("length") < capacity).join(places.withColumnsRenamed({"id": "piece_no", "sequence": "sequence_id"}), "piece_no")
    return whole.unionByName(fitted).drop("piece_no")
