"""SentencePiece encoding and decoding of merge-type vocabularies."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Segments longer than this are worked out each time instead of being remembered.
LONGEST_KEPT = 48
#: Segments that a worker remembers before it starts a new memory beside the one before.
MOST_KEPT = 400_000
MERGE_MODEL, NORMAL, BYTE = 2, 1, 6
#: Two symbols make one number; a sign that is in no piece, and the place of a symbol that was joined to its left.
SHIFT, NO_SYMBOL, GONE = 24, (1 << 24) - 1, -1
#: Symbols up to which a segment's agenda is a plain list, and the rank of a pair that does not join.
SHORT, LAST = 40, 1 << 30


class PieceModel:
    """A merge vocabulary: which neighbouring symbols join, and in which order."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules = model.normalizer_spec
        kinds = {piece.type for piece in model.pieces}
        if model.trainer_spec.model_type != MERGE_MODEL or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: not a merge vocabulary with byte pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{path}: only texts that are taken as they are, with a leading space, are supported")
        self.bytes = {int(piece.piece[3:5], 16): i for i, piece in enumerate(model.pieces) if piece.type == BYTE}
        self.symbols = {piece.piece: i for i, piece in enumerate(model.pieces) if piece.type == NORMAL}
        score = {piece.piece: piece.score for piece in model.pieces if piece.type == NORMAL}
        self.pieces = len(model.pieces)
        for char in sorted(set("".join(score)) - set(self.symbols)):
            self.symbols[char] = self.pieces + len(self.symbols)
        self.signs = {symbol: char for char, symbol in self.symbols.items() if symbol >= self.pieces}
        #: (left symbol, right symbol): (minus the score, joined symbol)
        self.joins = {
            self.symbols[text[:i]] << SHIFT | self.symbols[text[i:]]: (-value, self.symbols[text])
            for text, value in score.items()
            for i in range(1, len(text))
            if text[:i] in self.symbols and text[i:] in self.symbols
        }
        rank = {value: i for i, value in enumerate(sorted({value for value, _ in self.joins.values()}))}
        self.ranks = {pair: rank[value] for pair, (value, _) in self.joins.items()}
        #: Where no piece has a space sign after another sign or a line end, no join crosses the start of a word.
        inner = re.compile(f"[^{SPACE}]{SPACE}|\\n").search
        self.segment = re.compile(f"[ {SPACE}]+[^ {SPACE}\\n]*|\\n+[^ {SPACE}\\n]*" if not any(map(inner, score)) else r"(?s).+").findall
        self.symbols[" "] = self.symbols[SPACE]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge_listed(self, at: list[int]) -> list[int]:
        """The same with the agenda as a list in text order, which is quicker for words."""
        ranks, joins = self.ranks.get, self.joins
        agenda = [ranks(a << SHIFT | b, LAST) for a, b in pairwise(at)]
        while agenda and (best := min(agenda)) != LAST:
            left = agenda.index(best)
            at[left] = symbol = joins[at[left] << SHIFT | at[left + 1]][1]
            del at[left + 1], agenda[left]
            if left < len(agenda):
                agenda[left] = ranks(symbol << SHIFT | at[left + 1], LAST)
            if left:
                agenda[left - 1] = ranks(at[left - 1] << SHIFT | symbol, LAST)
        return at

    def merge(self, segment: str) -> bytes:
        """Ids of one segment, 32 bits each: take the best pair off the agenda, join it, put its new neighbours on."""
        at = [self.symbols.get(char, NO_SYMBOL) for char in segment]
        if len(at) <= SHORT:
            return self._ids(segment, self._merge_listed(at))
        joins, count, agenda = self.joins.get, len(at), []
        for i, (a, b) in enumerate(pairwise(at)):
            if (best := joins(a << SHIFT | b)) is not None:
                agenda.append((best[0], i, i + 1, a, b, best[1]))
        heapify(agenda)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        while agenda:
            _, left, right, a, b, joined = heappop(agenda)
            if at[left] != a or at[right] != b or after[left] != right:
                continue
            at[left], at[right] = joined, GONE
            beyond = after[left] = after[right]
            if beyond < count:
                before[beyond] = left
                if (best := joins(joined << SHIFT | at[beyond])) is not None:
                    heappush(agenda, (best[0], left, beyond, joined, at[beyond], best[1]))
            if (prior := before[left]) >= 0 and (best := joins(at[prior] << SHIFT | joined)) is not None:
                heappush(agenda, (best[0], prior, left, at[prior], joined, best[1]))
        return self._ids(segment, [symbol for symbol in at if symbol != GONE])

    def _ids(self, segment: str, symbols: list[int]) -> bytes:
        if max(symbols) >= self.pieces:  # signs that are no pieces, in their order
            unknown = (char for char in segment if char not in self.symbols)
            chars = (self.signs.get(s) or next(unknown) if s >= self.pieces else s for s in symbols)
            symbols = [i for x in chars for i in ([self.bytes[b] for b in x.encode()] if isinstance(x, str) else [x])]
        return array("i", symbols).tobytes()

    def check(self, fresh: dict[str, bytes]) -> None:
        """Hold new segments against the library, which puts a space in front by itself."""
        lone = array("i", [self.symbols[SPACE]]).tobytes()
        pairs = [(s[1:], ids) if s[0] in (" ", SPACE) else (s, lone + ids) for s, ids in fresh.items() if s not in (" ", SPACE)]
        wanted = self.library.encode([text for text, _ in pairs], num_threads=1)
        for (text, ids), other in zip(pairs, wanted, strict=True):
            if array("i", other).tobytes() != ids:
                raise ValueError(f"ids of {text[:80]!r} differ from the library's")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.kept) > MOST_KEPT:
            self.kept, self.older = {}, self.kept
        cut = [self.segment(" " + text) if text else [] for text in texts]
        known, fresh = {}, {}
        for segment in {s for segments in cut for s in segments}:
            if (ids := self.kept.get(segment)) is None:
                if (ids := self.older.get(segment)) is None:
                    ids = fresh[segment] = self.merge(segment)
                if len(segment) <= LONGEST_KEPT:
                    self.kept[segment] = ids
            known[segment] = ids
        if fresh:
            self.check(fresh)
        return [np.frombuffer(b"".join(map(known.__getitem__, segments)), np.int32) for segments in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([i.tolist() for i in ids], num_threads=1) if ids else []


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _pieces(model: str, key: pa.DataType, decode: bool):
    fields = [("key", key), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.large_string())] * decode
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model)
        for batch in batches:
            for part in steps(batch):
                ids = vocabulary.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids))]
                if decode:
                    columns.append(pa.array(vocabulary.decode(ids), pa.large_string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``ids array<int>`` and, if asked for, ``decoded string``.

    ``model`` is a file on every machine. Adjacent symbols join in the order of the agenda: best score
    first, then leftmost. Each Arrow batch's segments that the task has not met are checked against the
    library, which also decodes; a difference fails the job. Nothing is shuffled.

    A null or empty text has no ids and decodes to an empty text. A null key stays null. Repeated rows
    give repeated rows; an empty table gives none. Other columns are left out, whatever their names.
    A text of any length is encoded whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType
    out = f"key {kind.simpleString()}, ids array<int>" + ", decoded string" * decode
    return source.mapInArrow(_pieces(model, to_arrow_type(kind), decode), out).withColumnRenamed("key", key)
