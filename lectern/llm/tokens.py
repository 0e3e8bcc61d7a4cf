"""Vectorised word hashing over Arrow string buffers.

A *token* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text; everything else separates.  Texts never
become Python strings: the bytes of an Arrow column are viewed as NumPy arrays
and all words of a slice are hashed at once, by differences of one prefix sum
of a polynomial modulo 2**64.

Every text must end with a separator (``ready_text`` appends a newline), so
that no word runs into the next text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once; longer texts are cut between words.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def ready_text(text: Column) -> Column:
    """Lower-cased text, '' for null, closed by a newline."""
    return F.concat(F.coalesce(F.lower(text), F.lit("")), F.lit("\n"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit hashes."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array, and len + 1 offsets into them."""
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of bytes that begin and end between words."""
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, _U)
    up, down = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of each word, and the texts' bounds in these.

    Text ``i`` has the words ``bounds[i]:bounds[i + 1]``.
    """
    raw, offsets = _bytes_of(column)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SLICE_BYTES)
        if to < len(raw):
            back = np.flatnonzero(~_WORD[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:  # one word longer than a slice
                ahead = np.flatnonzero(~_WORD[raw[to:]])
                to = to + int(ahead[0]) + 1 if len(ahead) else len(raw)
        s, e, h = _hash_piece(raw[at:to])
        parts.append((s + at, e + at, h))
        at = to
    if not parts:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U), empty, empty, np.zeros(len(column) + 1, np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of text, a text at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    _, offsets = _bytes_of(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield batch.slice(at, to - at)
        at = to


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' n-grams of words, and the texts' bounds in these.

    A text of fewer than n words, but one at least, has all its words as one gram.
    """
    count = np.diff(bounds)
    last = np.maximum(count - n + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(last)])
    if not to[-1]:
        return np.zeros(0, _U), to
    first = np.repeat(bounds[:-1] - to[:-1], last) + np.arange(to[-1])
    size = np.repeat(np.minimum(count, n), last)
    out = np.zeros(to[-1], _U)
    for k in range(n):
        inside = k < size
        value = hashes[np.minimum(first + k, len(hashes) - 1)]
        out = np.where(inside, mix(out * _U(0x2545F4914F6CDD1D) + value + _U(k + 1)), out)
    return out, to
