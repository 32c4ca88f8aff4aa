"""Ranked search over documents by best-first descent into intervals of their posting lists.

Documents are dealt out to blocks and numbered by their key in each. A block keeps for every term the
documents that hold it, with the impact of the term in each, and a sparse table of range maxima over these impacts. For a
query, an interval of documents is bounded by the sum of its terms' maxima in it. The interval with the
highest bound is taken first: it is split at the document of its largest single impact, which is scored; an interval with few
postings is scored whole. The search of a block ends when no interval left can reach its result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fluentrail.llm.common import steps, stored

#: Documents of a block, queries that a block answers in one task, and postings of an interval that is scored whole.
BLOCK_DOCS, CHUNK_QUERIES, WHOLE = 8192, 512, 1024
#: Bits of the filter that keeps terms of no query out of the index; its size does not depend on the tables.
FILTER_BITS = 1 << 23
#: Bits of a row's number within its task.
TASK_SHIFT = 36
#: Bytes of terms as they are, A-Z as a-z, all others as spaces.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
SEED = 42


def words(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: letters, digits and signs beyond ASCII; only A-Z are lower-cased."""
    return text.translate(FOLD).split()


def _scan(rows: DataFrame, key: str, bits: bytes | None = None) -> DataFrame:
    """``no, key, n, terms, tfs`` of each row with a term: how many terms it has, and the different ones that pass the filter."""
    kind = rows.schema[key].dataType.simpleString()

    def passes(term: bytes) -> bool:
        import xxhash

        h = xxhash.xxh64_intdigest(term, SEED)
        p, q = h & FILTER_BITS - 1, h >> 32 & FILTER_BITS - 1
        return bool(bits[p >> 3] >> (p & 7) & 1 and bits[q >> 3] >> (q & 7) & 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_SHIFT
        for batch in batches:
            for part in steps(batch):
                at, sizes, ends, terms, tfs = [], [], [0], [], []
                for row, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    found = words(text or b"")
                    if found:
                        for term, tf in Counter(found).items():
                            if bits is None or passes(term):
                                terms.append(term)
                                tfs.append(tf)
                        at.append(row)
                        sizes.append(len(found))
                        ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(len(at), dtype=np.int64)),
                        part.column(0).take(pa.array(at, pa.int64())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                    ],
                    ["no", "key", "n", "terms", "tfs"],
                )
                number += len(at)

    return rows.select(key, "text").mapInArrow(scan, f"no long, key {kind}, n long, terms array<binary>, tfs array<long>")


def _filter_bits(terms: DataFrame) -> bytes:
    """A filter with two bits for each of the ``term`` values; of fixed size, at most an eighth of ``FILTER_BITS`` bytes."""
    h = F.xxhash64("term")
    places = F.array(F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(FILTER_BITS)))
    bit = terms.select(F.explode(places).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words_set = bit.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    for word, value in words_set:
        bits[word] = value
    return bits.tobytes()


class Block:
    """The postings of some documents, with range maxima."""

    def __init__(self, docs: pa.Table) -> None:
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("key", "ascending")], null_placement="at_end")).combine_chunks()
        self.keys = docs.column("key").combine_chunks()
        self.count = docs.num_rows
        terms = docs.column("terms").combine_chunks()
        lengths = pc.list_value_length(terms).to_numpy()
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(self.count, dtype=np.int64), lengths)
        tf = docs.column("tfs").combine_chunks().flatten().to_numpy()
        m = np.repeat(docs.column("m").to_numpy(), lengths)
        order = np.argsort(code, kind="stable")
        self.doc = doc[order]
        self.impact = (1_000_000_000 * tf // (1000 * tf + 20 * m))[order]
        self.place = code[order] * self.count + self.doc
        self.codes = {term: i for i, term in enumerate(coded.dictionary.to_pylist())}
        self.starts = np.searchsorted(code[order], np.arange(len(self.codes) + 1))
        longest = int(np.diff(self.starts).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1
        levels = [np.arange(len(self.doc), dtype=np.int32)]
        for level in range(int(self.log[longest])):
            half, last = 1 << level, levels[-1]
            upper = np.minimum(np.arange(len(last)) + half, max(len(last) - 1, 0))
            right = last[upper]
            levels.append(np.where(self.impact[last] >= self.impact[right], last, right))
        self.table = np.stack(levels)

    def _bound(self, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int]:
        """The sum of the terms' largest scores in their ranges, and the document of the largest one."""
        level = self.log[end - start]
        left, right = self.table[level, start], self.table[level, end - (1 << level)]
        top = np.where(self.impact[left] >= self.impact[right], left, right)
        score = weight * self.impact[top]
        return int(score.sum()), int(self.doc[top[score.argmax()]])

    def search(self, terms: list[bytes], weights: list[int], k: int, floor: int) -> list[tuple[int, int]]:
        """``score, document`` of the k best documents with a score above 0 and not below ``floor``; of equal ones the first."""
        known = [(self.codes[t], w) for t, w in zip(terms, weights, strict=True) if t in self.codes and w > 0]
        best: list[tuple[int, int]] = []
        if not known:
            return best
        code = np.array([c for c, _ in known], np.int64)
        weight = np.array([w for _, w in known], np.int64)
        agenda: list[tuple] = []
        turn = 0

        def push(first: int, code: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            nonlocal turn
            held = end > start
            if not held.any():
                return
            if not held.all():
                code, weight, start, end = code[held], weight[held], start[held], end[held]
            bound, at = self._bound(weight, start, end)
            if bound >= max(floor, 1):
                heappush(agenda, (-bound, first, turn, at, code, weight, start, end))
                turn += 1

        def keep(score: int, doc: int) -> None:
            if score >= max(floor, 1):
                if len(best) < k:
                    heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapreplace(best, (score, -doc))

        push(0, code, weight, self.starts[code], self.starts[code + 1])
        while agenda:
            bound, first, _, at, code, weight, start, end = heappop(agenda)
            if len(best) == k and (-bound, -first) < best[0]:
                break
            size = end - start
            if size.sum() <= WHOLE:
                posting = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                docs, own = np.unique(self.doc[posting], return_inverse=True)
                scores = np.zeros(len(docs), np.int64)
                np.add.at(scores, own, np.repeat(weight, size) * self.impact[posting])
                least = best[0][0] if len(best) == k else 1
                for i in np.flatnonzero(scores >= max(least, floor)).tolist():
                    keep(int(scores[i]), int(docs[i]))
                continue
            split = np.searchsorted(self.place, code * self.count + at)
            split = np.clip(split, start, end)
            hit = (split < end) & (self.doc[np.minimum(split, len(self.doc) - 1)] == at)
            keep(int((weight[hit] * self.impact[split[hit]]).sum()), at)
            push(first, code, weight, start, split)
            push(at + 1, code, weight, split + hit, end)
        return [(score, -doc) for score, doc in best]


def _answers(k: int, key_kind: pa.DataType, item_kind: pa.DataType) -> Callable:
    schema = pa.schema([("no", pa.int64()), ("item", item_kind), ("key", key_kind), ("score", pa.int64())])

    def answer(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return schema.empty_table()
        block = Block(docs)
        number, at, score, doc = [], [], [], []
        queries = asked.select(["no", "terms", "weights", "floor"]).to_pylist()
        for row, query in enumerate(queries):
            for s, d in block.search(query["terms"], query["weights"], k, query["floor"]):
                number.append(query["no"])
                at.append(row)
                score.append(s)
                doc.append(d)
        items = asked.column("item").combine_chunks().take(pa.array(at, pa.int64()))
        return pa.Table.from_arrays([pa.array(number, pa.int64()), items, block.keys.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], schema=schema)

    return answer


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents (``doc_id``, ``text``) of every item (``item_id``, ``text``).

    A term is a maximal run of letters, digits and signs beyond ASCII. N counts the documents with a term, L all their
    terms; a term in df documents weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``. For a document of n terms,
    ``m = 50 + 50 n N div L``, and a term that it holds tf times adds ``w (1000000000 tf div (1000 tf + 20 m))``, once for each of the item's
    different terms.

    Returns:
        ``item_id, rank`` (from 1), ``doc_id, score``: documents with a score above 0, the highest first, equal scores
        by ascending ``doc_id``, null last.

    Rows without a term, null texts among them, are found by nothing and find nothing. Rows that share an id are documents (items)
    of their own. Other columns are not read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    item_type, key_type = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    asked = stored(_scan(items, "item_id"), "ranked-items")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    index = stored(_scan(docs, "doc_id", _filter_bits(terms)), "ranked-docs")
    count, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    queries = asked.count()
    if not count or not queries:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {key_type}, score long")

    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * count + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = asked.select("no", "key", F.explode("terms").alias("term")).join(held, "term").select("no", "key", "term", weight.cast("long").alias("weight"))
    prepared = weighted.groupBy("no").agg(F.first("key").alias("item"), F.collect_list(F.struct("term", "weight")).alias("known"))
    prepared = stored(prepared.select("no", "item", F.col("known.term").alias("terms"), F.col("known.weight").alias("weights")), "ranked-queries")

    blocks, chunks = -(-count // BLOCK_DOCS), -(-queries // CHUNK_QUERIES)
    m = F.expr(f"50L + (50L * n * {count}L) div {total}L")
    dealt = index.filter(F.size("terms") > 0).select(F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("block"), "key", m.alias("m"), "terms", "tfs")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = F.pmod(F.xxhash64("no"), F.lit(chunks)).cast("int").alias("chunk")
    answer = _answers(k, to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(items.schema["item_id"].dataType))

    def found(first: int, last: int, queries: DataFrame) -> DataFrame:
        spread = queries.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("block"), chunk, "no", "item", "terms", "weights", "floor")
        own = dealt.filter(F.col("block").between(first, last))
        return own.groupBy("block", "chunk").cogroup(spread.groupBy("block", "chunk")).applyInArrow(answer, f"no long, item {item_type}, key {key_type}, score long")

    # the k-th score within the first block, which is a sample by hash, bounds the k-th score from below
    hits = stored(found(0, 0, prepared.withColumn("floor", F.lit(0).cast("long"))), "ranked-first")
    if blocks > 1:
        floors = hits.groupBy("no").agg(F.min("score").alias("least"), F.count("*").alias("hits"))
        floors = floors.select("no", F.when(F.col("hits") >= k, F.col("least")).otherwise(0).alias("floor"))
        hits = hits.union(found(1, blocks - 1, prepared.join(floors, "no", "left").fillna(0, ["floor"])))
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")

