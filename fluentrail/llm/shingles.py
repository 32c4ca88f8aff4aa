"""Word shingles of texts as 64-bit numbers, worked out for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WORDS = 5
#: Bytes whose words are numbered in one go; a longer text is cut between words.
PIECE_BYTES = 1 << 22
SEED = 20
_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(_rng.integers(1, 1 << 63) | 1)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly: the finisher of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(upto: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(upto, _BASE, np.uint64)]), dtype=np.uint64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins and the last ends; null is empty."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return body, ends - ends[0]


def _numbered(body: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of the words of some bytes, in which texts begin at ``starts_text``."""
    solid = ~_SPACE[body]
    starts = np.empty(len(body), bool)
    starts[:1] = solid[:1]
    starts[1:] = solid[1:] & ~solid[:-1]
    edges = starts_text[(starts_text >= 0) & (starts_text < len(body))]
    starts[edges] = solid[edges]
    starts = np.flatnonzero(starts)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    count = np.add.reduceat(solid, starts, dtype=np.int64)
    place = np.zeros(len(body), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(body)) - np.repeat(starts, np.diff(np.append(starts, len(body))))
    longest = int(count.max())
    powers = _powers(1 << max(6, longest.bit_length()))
    value = _BYTE[body] * powers[np.minimum(place, longest)]
    value[~solid] = 0
    return starts, starts + count, mix(np.add.reduceat(value, starts) ^ count.astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, lower-cased in A-Z; how many each text has; where each word starts and ends in its text.

    Words are runs of bytes other than space and the signs 0x09 to 0x0D.
    """
    body, ends = raw(texts)
    out, at = [], 0
    while at < len(body):
        upto = min(len(body), at + PIECE_BYTES)
        if upto < len(body):
            rest = np.flatnonzero(_SPACE[body[at + 1 : upto]])
            if len(rest):
                upto = at + 1 + int(rest[-1])
            else:
                while upto < len(body) and not _SPACE[body[upto]]:
                    upto += 1
        starts, stops, numbers = _numbered(body[at:upto], ends[:-1] - at)
        out.append((starts + at, stops + at, numbers))
        at = upto
    if not out:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(ends) - 1, np.int64), none, none
    starts, stops, numbers = (np.concatenate(x) for x in zip(*out, strict=True))
    first = np.searchsorted(starts, ends[:-1])
    counts = np.diff(np.append(first, len(starts)))
    shift = np.repeat(ends[:-1], counts)
    return numbers, counts, starts - shift, stops - shift


def shingles(numbers: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Numbers of the shingles of one text's words, in order; fewer words than ``size`` are one shingle, none is none."""
    if not len(numbers):
        return numbers
    if len(numbers) < size:
        count = len(numbers)
        return mix((numbers * _PLACE[:count]).sum(keepdims=True) + _SHORT[count : count + 1])
    total = np.zeros(len(numbers) - size + 1, np.uint64)
    for i in range(size):
        total += numbers[i : len(numbers) - size + 1 + i] * _PLACE[i]
    return mix(total)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    numbers, counts, _, _ = words(texts)
    at = 0
    for count in counts.tolist():
        yield np.unique(shingles(numbers[at : at + count]))
        at += count


def signature(shingle_set: np.ndarray) -> int:
    """A 64-bit number of a whole set, signed."""
    x = mix(shingle_set ^ np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True) + np.uint64(len(shingle_set))
    return int(mix(x).view(np.int64)[0])
