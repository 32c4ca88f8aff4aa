"""Packing token sequences into windows of equal capacity by multiway differencing."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import steps

#: Windows that a task fills at a time; it holds their ids in memory.
GROUP_WINDOWS = 256
#: Tokens a window that differencing leaves free on average, to be filled with cut pieces.
SPARE = 128
#: Steps whose words are told apart in one go.
TOGETHER = 4
#: Words a worker remembers before it starts a new memory beside the one before.
MOST_KEPT = 200_000
LONGEST_KEPT = 48
#: Bits of a sequence's number within its task.
TASK_SHIFT = 36
#: The rules of a tokenizer under which words are cut here: lower case, and then letters, digits and other signs apart.
CUT_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Signs of one and two bytes that no rule composes or takes as space, in a set; letters and digits of them in lower case.
PLAIN = [chr(code) for code in (*range(0x21, 0x7F), *range(0xA1, 0x100)) if code != 0xAD]
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+").findall


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, sums being as equal as repeated differencing makes them.

    Each size starts as a partial partition with all but one window empty. The two partial partitions
    with the widest spread are merged again and again, the fullest window of one with the emptiest of
    the other, until one is left.
    """
    count = len(sizes)
    if windows <= 1 or not count:
        return np.zeros(count, np.int64)
    empty = np.full(windows, -1, np.int64)
    agenda = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(windows, np.int64), empty.copy()
        sums[0], nodes[0] = size, i
        agenda.append((-size, i, sums, nodes))
    heapify(agenda)
    joined: list[tuple[np.ndarray, np.ndarray, int]] = []
    upto, turn = count, count
    while len(agenda) > 1:
        _, _, sums, nodes = heappop(agenda)
        _, _, other_sums, other_nodes = heappop(agenda)
        sums, other_nodes = sums + other_sums[::-1], other_nodes[::-1]
        both = np.flatnonzero((nodes >= 0) & (other_nodes >= 0))
        merged = np.maximum(nodes, other_nodes)
        if len(both):
            joined.append((nodes[both], other_nodes[both], upto))
            merged[both] = np.arange(upto, upto + len(both))
            upto += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        heappush(agenda, (int(sums[-1] - sums[0]), turn, sums, merged))
        turn += 1
    window = np.empty(upto, np.int64)
    last = agenda[0][3]
    window[last[last >= 0]] = np.flatnonzero(last >= 0)
    for left, right, first in reversed(joined):
        window[left] = window[right] = window[first : first + len(left)]
    return window[:count]


def windows_of(sizes: np.ndarray, windows: int, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of sizes that are at most the capacity; their count rises until none is overfull."""
    while True:
        window = differencing(sizes, windows)
        if not len(sizes) or np.bincount(window, sizes, windows).max() <= capacity:
            return window, windows
        windows += 1


@dataclass
class Plan:
    """Pieces as lists side by side: which document, from where, how long, which sequence, where in it."""

    capacity: int
    sequences: int = 0
    pieces: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def sequence(self, segments: list[list[int]]) -> None:
        offset = 0
        for doc, start, end in segments:
            self.pieces.append((doc, start, end - start, self.sequences, offset))
            offset += end - start
        self.sequences += 1


def plan_windows(lengths: np.ndarray, capacity: int) -> Plan:
    """Deal documents of the given lengths out to sequences of at most ``capacity`` tokens.

    Whole windows of long documents are sequences of their own. Of the rests, the longest are kept back;
    differencing deals the others out to as many windows as hold them, and the rests kept back are cut to
    fill what is free in each; if they do not suffice, the emptiest windows are cut up for it too. What is left
    goes into sequences whose lengths are the capacity or smaller powers of two.
    """
    plan = Plan(capacity)
    starts = np.zeros(len(lengths), np.int64)
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        for start in range(0, int(lengths[doc]) - capacity + 1, capacity):
            plan.sequence([[doc, start, start + capacity]])
            starts[doc] = start + capacity
    rests = lengths - starts
    order = np.argsort(-rests, kind="stable")
    order = order[rests[order] > 0]
    windows, free = divmod(int(rests.sum()), capacity)
    back = int(np.searchsorted(np.cumsum(rests[order]), free + SPARE * windows)) + 1 if windows else len(order)
    spare = [[doc, int(starts[doc]), int(lengths[doc])] for doc in order[:back].tolist()]
    dealt = order[back:]
    window, windows = windows_of(rests[dealt], windows, capacity) if windows else (dealt, 0)
    members: list[list[list[int]]] = [[] for _ in range(windows)]
    for doc, w in zip(dealt.tolist(), window.tolist(), strict=True):
        members[w].append([doc, int(starts[doc]), int(lengths[doc])])
    free_of = [capacity - sum(end - start for _, start, end in own) for own in members]
    queue = sorted(range(windows), key=lambda w: free_of[w])
    while queue:
        w = queue.pop(0)
        while free_of[w]:
            if not spare:
                if not queue:  # not full: into the short sequences
                    spare, members[w], free_of[w] = members[w], [], 0
                    break
                spare = members[queue.pop()]  # the emptiest window is cut up to fill the others
            segment = _cut(spare, free_of[w])
            members[w].append(segment)
            free_of[w] -= segment[2] - segment[1]
        if members[w]:
            plan.sequence(members[w])
    left = sum(end - start for _, start, end in spare)
    while left:
        size = room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        own = []
        while room:
            own.append(_cut(spare, room))
            room -= own[-1][2] - own[-1][1]
        plan.sequence(own)
        left -= size
    return plan


def _cut(spare: list[list[int]], room: int) -> list[int]:
    """The next segment of what is kept back, ``room`` tokens of it at most."""
    doc, start, end = spare[-1]
    if end - start <= room:
        return spare.pop()
    spare[-1][1] = start + room
    return [doc, start, start + room]


class WordIds(dict):
    """Ids of whole texts from those of their words, 32 bits each, little-endian; the tokenizer works a word out once.

    Where the tokenizer's rules are ``CUT_RULES``, a word of plain signs is cut into letters, digits and other
    signs here, and only parts that are new go to the merges; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.plain = None
        if {name: rules.get(name) for name in CUT_RULES} == CUT_RULES:
            # a word that may hold a token with a text of its own is not plain
            marked = {token["content"][0] for token in rules["added_tokens"]}
            self.plain = re.compile("[" + "".join(re.escape(sign) for sign in PLAIN if sign not in marked) + "]+").fullmatch
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.signs = {code: as_bytes(chr(code))[0][0] for code in range(0xA1, 0x100)}
        self.merges = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self.plain is not None and self.plain(word):
                lower = word.lower()
                parts = [lower] if lower.isalpha() else _CUT(lower)
                ids = b"".join([self.parts.get(part) or self._merged(part) for part in parts])
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def _merged(self, part: str) -> bytes:
        signs = part if part.isascii() else part.translate(self.signs)
        ids = array("I", [token.id for token in self.merges.tokenize(signs)]).tobytes()
        if len(part) <= LONGEST_KEPT:
            self.parts[part] = ids
        return ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts one after another, each with ``end`` behind it, and how many each has."""
        if len(self) > MOST_KEPT:
            self.older = dict(self)
            self.clear()
        if len(self.parts) > MOST_KEPT:
            self.parts.clear()
        lines = pa.compute.replace_substring(pa.compute.fill_null(texts, ""), "\n", " ")
        cut = pa.compute.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        each = [*map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        words = coded.indices.to_numpy()
        own = sizes[words]
        upto = np.cumsum(own)
        starts = (np.cumsum(sizes) - sizes)[words]
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(starts - upto + own, own) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.append(0, upto)[np.cumsum(pa.compute.list_value_length(cut).to_numpy())]
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def _pack(path: str, end: int, capacity: int, group: int, key: pa.DataType, with_ids: bool):
    fields = [("key", key)] + [(name, pa.int64()) for name in ("start", "length", "crc32", "tokens", "sequence_id", "offset")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(keys: list, ids: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(i) // 4 for i in ids], np.int64)
        plan = plan_windows(lengths, capacity)
        doc, start, length, sequence, offset = np.array(plan.pieces, np.int64).reshape(-1, 5).T
        cuts = [memoryview(ids[d])[4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        crcs = np.array([zlib.crc32(cut) for cut in cuts], np.int64)
        columns = [pa.array(keys, key).take(pa.array(doc)), start, length, crcs, lengths[doc], sequence + first, offset]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *length], dtype=np.int32), np.frombuffer(b"".join(cuts), "<i4")))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema), plan.sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        first = TaskContext.get().partitionId() << TASK_SHIFT
        keys, ids, held = [], [], 0
        for batch in batches:
            parts, at = [*steps(batch)], 0
            for some in (parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)):
                size = sum(map(len, some))
                fresh, counts = words.encode(batch.column(1).slice(at, size), end)
                each = [own.tobytes() for own in np.split(fresh, np.cumsum(counts)[:-1])]
                at, upto = at + size, 0
                for part in some:
                    keys += part.column(0).to_pylist()
                    ids += each[upto : upto + len(part)]
                    held += int(counts[upto : upto + len(part)].sum())
                    upto += len(part)
                    if held >= group * capacity:
                        out, sequences = rows(keys, ids, first)
                        yield out
                        first += sequences
                        keys, ids, held = [], [], 0
        if keys:
            yield rows(keys, ids, first)[0]

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end: int = 2,
    group: int = GROUP_WINDOWS,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of tokenized documents in sequences of at most ``capacity`` (a power of two) tokens.

    Columns: ``key, start, length, crc32, tokens, sequence_id, offset`` and, if asked for, ``ids
    array<int>``; ``start`` counts the document's ids before the piece, ``offset`` those before it in its
    sequence, ``tokens`` all ids of the document with the ``end`` id. Each task packs its own rows, as many
    windows at a time as ``group`` says, so nothing is shuffled and no source or long text weighs on one
    task; a sequence's number holds its task's number, so a task that runs again gives the same numbers.

    A null or empty text is the ``end`` id alone. Null keys stay null; repeated rows are packed each for
    itself; an empty table gives no rows. Other columns are left out, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType
    out = f"key {kind.simpleString()}, start long, length long, crc32 long, tokens long, sequence_id long, offset long"
    run = _pack(tokenizer, end, capacity, group, to_arrow_type(kind), with_ids)
    return source.mapInArrow(run, out + ", ids array<int>" * with_ids).withColumnRenamed("key", key)
