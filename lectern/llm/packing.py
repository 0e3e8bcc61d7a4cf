"""Bounded-space online packing of documents into training windows.

Documents come one after the other; ``open_windows`` windows of ``capacity`` units
are open in each partition.  A document goes where it leaves the least room
(best fit); if it fits nowhere, the fullest window is emitted and a new one is
opened.  A document longer than a window is cut: its full windows are emitted as
they are, and its rest is placed like a document.  The windows still open at the
end of the partitions are merged the same way, over ever fewer partitions.

Partitions hold about ``partition_rows`` documents by hash of the id, in order of
the id; only ids and lengths are moved.  The result depends on the table and the
parameters alone, not on how Spark reads it.

The unit is the UTF-8 byte, the token of byte-level models; ``measure`` may be
another Column, or ``bpe_lengths`` gives exact counts of a byte-level BPE.

Defined results: a null text and an empty one have no length and are in no
window; a null id is packed as any other, under the id null; repeated rows are
packed as often as they occur; ties (equal room) go to the window opened first;
an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, drop_written, written

CAPACITY = 32768
OPEN_WINDOWS = 16
PARTITION_ROWS = 50_000
MERGE = 32

Piece = tuple[int | None, int, int]  # document, first unit, units
_SCHEMA = "bucket int, number int, pieces array<struct<doc_id:bigint,first:bigint,length:bigint>>, used bigint, final boolean"


def best_fit(groups: Iterable[list[Piece]], capacity: int, spaces: int) -> Iterator[tuple[list[Piece], bool]]:
    """Windows of the groups of pieces, each placed as a whole; True with the emitted, False with the left."""
    still: list[list] = []  # used, pieces; in order of opening
    for pieces in groups:
        need = sum(p[2] for p in pieces)
        best = None
        for w in still:
            if w[0] + need <= capacity and (best is None or w[0] > best[0]):
                best = w
        if best is None:
            if len(still) >= spaces:
                fullest = max(still, key=lambda w: w[0])
                still = [w for w in still if w is not fullest]
                yield fullest[1], True
            best = [0, []]
            still.append(best)
        best[0] += need
        best[1].extend(pieces)
        if best[0] == capacity:
            still = [w for w in still if w is not best]
            yield best[1], True
    for w in still:
        yield w[1], False


def pieces_of(doc_id: int | None, length: int, capacity: int) -> list[Piece]:
    """A document as pieces of a window at most."""
    return [(doc_id, at, min(capacity, length - at)) for at in range(0, length, capacity)]


def _out(bucket: int, windows: Iterable[tuple[list[Piece], bool]]) -> pa.RecordBatch:
    rows = [(bucket, k, [dict(zip(("doc_id", "first", "length"), p, strict=True)) for p in pieces], sum(p[2] for p in pieces), done) for k, (pieces, done) in enumerate(windows)]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("length", pa.int64())])), pa.int64(), pa.bool_()]
    names = ["bucket", "number", "pieces", "used", "final"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)


def pack(docs: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, partition_rows: int = PARTITION_ROWS, merge: int = MERGE, measure: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(window_id, doc_ids, firsts, lengths, used): every window, its pieces in the order they were placed."""
    if capacity < 1 or open_windows < 1 or merge < 2:
        raise ValueError("capacity and open_windows must be 1 at least, merge 2")
    rows = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")) if measure is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), measure.alias("length"))
    sizes = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("length")) if measure is None else rows
    sizes = written(sizes.where("length > 0"))
    buckets = max(1, math.ceil(sizes.count() / partition_rows))
    placed = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(table["doc_id"].to_pylist(), table["length"].to_pylist(), strict=True)
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        groups = ([p] for d, n in order for p in pieces_of(d, n, capacity))
        return pa.Table.from_batches([_out(key[0].as_py(), best_fit(groups, capacity, open_windows))])

    done = written(placed.groupBy("bucket").applyInArrow(first, _SCHEMA))
    drop_written(sizes)
    level, parts = 0, [done.where("final").withColumn("level", F.lit(0))]
    while buckets > 1:  # merge what is left of ``merge`` partitions at a time
        buckets = math.ceil(buckets / merge)

        def again(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["old"], r["number"]))
            groups = ([(p["doc_id"], p["first"], p["length"]) for p in r["pieces"]] for r in rows)
            return pa.Table.from_batches([_out(key[0].as_py(), best_fit(groups, capacity, open_windows))])

        left = done.where("not final").select(F.col("bucket").alias("old"), "number", "pieces", (F.col("bucket") / merge).cast("int").alias("bucket"))
        done = written(left.groupBy("bucket").applyInArrow(again, _SCHEMA))
        level += 1
        parts.append(done.where("final").withColumn("level", F.lit(level)))
    parts.append(done.where("not final").withColumn("level", F.lit(level)))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    field = lambda name: F.transform("pieces", lambda p: p[name])
    return every.select(F.format_string("%d-%d-%d", "level", "bucket", "number").alias("window_id"), field("doc_id").alias("doc_ids"), field("first").alias("firsts"), field("length").alias("lengths"), "used")


def bpe_lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length): token counts under a public byte-level BPE in the rank file's format."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "length"])

    return columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(count, "doc_id bigint, length bigint")
