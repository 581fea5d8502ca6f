"""Vectorised word splitting and hashing of Arrow string columns.

A batch of texts is one byte buffer. Words are found and hashed with a constant number of
array operations per segment of that buffer, so the cost per byte does not depend on how
many words or texts there are. Only ASCII bytes decide where a word ends, which makes the
byte view of UTF-8 equal to the character view.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_FOLDED, _EXACT = _byte_codes(True), _byte_codes(False)
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SEGMENT * 2)
        for at, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class Words(NamedTuple):
    """Words of a batch in reading order: text index, byte span in ``data``, hash."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more entry at the end
    offset: np.ndarray  # of each text, its first byte; one more entry at the end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The byte buffer of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Segments of about SEGMENT bytes that end between texts, or else just before a gap."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = at + SEGMENT
        if to >= stop:
            to = stop
        else:
            near = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if near > at:
                to = near
            else:  # inside one text
                gaps = _gap_starts(word[data[at:to]])
                while not len(gaps) and to < stop:
                    more = min(stop, to + SEGMENT)
                    gaps = _gap_starts(word[data[to - 1 : more]]) + (to - 1 - at)
                    to = more
                to = at + int(gaps[-1]) if len(gaps) else to
        yield at, to
        at = to


def _gap_starts(inside: np.ndarray) -> np.ndarray:
    return np.flatnonzero(inside[:-1] & ~inside[1:]) + 1


def split_words(
    column: pa.Array, word: np.ndarray, fold_case: bool = True, with_gaps: bool = False
) -> Words:
    """All words of all texts; ``word`` marks the bytes that words consist of.

    ``with_gaps`` returns units that cover every byte instead: a word with the gap before
    it, or a gap at the end of a text.
    """
    data, offsets = text_bytes(column)
    codes = _FOLDED if fold_case else _EXACT
    starts, ends, hashes = [], [], []
    for a, b in _cuts(data, offsets, word):
        part = data[a:b]
        inside = word[part]
        edge = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        if with_gaps:
            begins = np.zeros(b - a, bool)
            begins[_gap_starts(inside)] = True
            begins[edge] = True
            begins[0] = True
            s = np.flatnonzero(begins)
            e = np.append(s[1:], b - a)
        else:
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[edge] = inside[edge]
            finish = inside.copy()
            finish[:-1] &= ~inside[1:]
            last = edge[edge > 0] - 1
            finish[last] = inside[last]
            s, e = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        up, down = _power_tables(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(codes[part] * up[: b - a], out=sums[1:])
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end = join(starts, np.int64), join(ends, np.int64)
    first = np.searchsorted(start, offsets, "left")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, text, start, end, join(hashes, np.uint64), first, offsets)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, which bounds what the arrays of a part take."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one run of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_ODD) + words[j : j + n]
    return mix(out + np.uint64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
