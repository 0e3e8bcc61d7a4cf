"""A count sketch of hashed tokens over a whole table, of bounded size.

Token counts of a corpus grow with it; an order by rarity needs no exact
counts, only the same order everywhere.  Counts are summed in 2**bits buckets
over all rows and kept as their binary logarithms, one byte each: 4 MB, or as
``bits_for`` says up to 64.  Buckets that tokens share only make the order
coarser; where many share each, rare tokens look as frequent as others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 22
MOST_BITS = 26
#: Tokens, repeated ones counted again, that a bucket of a growing sketch gets on average.
PER_BUCKET = 40
_SLICE = 16  # a row of the result covers 2**16 buckets
_HELD = 1 << 23  # tokens that a task holds before it sends their counts


def bits_for(tokens: float) -> int:
    """Bits that leave ``PER_BUCKET`` tokens or fewer to a bucket, but from ``BITS`` to ``MOST_BITS``."""
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, tokens) / PER_BUCKET))))


def narrow(counts: np.ndarray) -> bytes:
    """Counts as compressed integers of the fewest bytes that hold them all; their width follows from their length."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def wide(packed: bytes, n: int) -> np.ndarray:
    """The n counts of ``narrow``."""
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, f"u{len(raw) // n}")


def sketch(df: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> np.ndarray:
    """uint8 array of 2**bits: 1 + floor(log2(count)) of each bucket, 0 if empty.

    A task sends its counts as packed slices, not as a row for each bucket.
    """

    def slices(at: np.ndarray) -> pa.RecordBatch:
        at.sort()
        bounds = np.append(np.searchsorted(at, (np.arange(1 << (bits - _SLICE)) << _SLICE).astype(np.uint32)), len(at))
        some = np.flatnonzero(np.diff(bounds))
        counts = [narrow(np.bincount(at[bounds[k] : bounds[k + 1]] & ((1 << _SLICE) - 1), minlength=1 << _SLICE)) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts, pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for hashes in tokens(batch):
                held.append((hashes >> np.uint64(64 - bits)).astype(np.uint32))
                many += len(hashes)
                if many >= _HELD:
                    yield slices(np.concatenate(held))
                    held, many = [], 0
        if many:
            yield slices(np.concatenate(held))

    def classes(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLICE, np.uint64)
        for batch in tables:
            for part in batch.column(batch.schema.get_field_index("counts")):
                total += wide(part.as_py(), 1 << _SLICE)
        level = np.zeros(1 << _SLICE, np.uint8)
        some = total > 0
        level[some] = 1 + np.floor(np.log2(total[some])).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], ["slice", "level"])

    out = np.zeros(1 << bits, np.uint8)
    for row in df.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(classes, "slice int, level binary").collect():  # 2**(bits - 16) rows
        out[row["slice"] << _SLICE : (row["slice"] + 1) << _SLICE] = np.frombuffer(zlib.decompress(row["level"]), np.uint8)
    return out
