"""Line deduplication by an exact set-similarity join.

The lines of all documents are sets of words.  A line goes if an earlier one
(by document id, then line number) has a Jaccard similarity of at least the
threshold with it.  Equal sets are found by a 128-bit hash of the set; other
pairs by prefix filtering: the words of a set are ordered by rarity over the
whole corpus, and two similar sets must share one of their first, rarest words.
Length and positional bounds, and bitwise parities of the sets, discard pairs
before their exact verification.  Equal sets post once, whatever their number.  A
word that more than ``heavy`` different sets post (by exact counts) is split: its
sets go to blocks by their hash, and each two blocks meet in a tile of their own, so
that no task gets all pairs of a frequent word.

Lines with fewer than ``min_tokens`` different words always stay.

Defined results: a null text has no lines; a null id makes a document nobody
can point at, so that its lines neither go nor make others go; rows that
repeat an id are one document, whose line numbers are compared as if the rows
were the same (a line never matches its own number in its own document, so
repeated rows don't remove each other); ties go to the lower id, then the lower
line number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns, finished, packed, sized_join, written
from .rarity import BITS, sketch

THRESHOLD = 0.9
MIN_TOKENS = 3
#: A word that more different sets post is split into tiles of blocks of half as many.
HEAVY = 8192
_U = np.uint64


def line_slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, their bounds by line, and row and number of each line, slice by slice."""
    for part in K.slices(batch):
        text = part.column(part.schema.get_field_index("text"))
        raw, offsets = K._bytes_of(text)
        # every text ends with a newline: the number of newlines before a text numbers its lines
        breaks = np.flatnonzero(raw == 10)
        hashes, starts, _, _ = K.words(text)
        line = np.searchsorted(breaks, starts)
        first = np.searchsorted(breaks, offsets[:-1])
        row = np.repeat(np.arange(len(text)), np.diff(np.append(first, len(breaks))))
        bounds = np.searchsorted(line, np.arange(len(breaks) + 1))
        yield hashes, bounds, row, np.arange(len(breaks)) - first[row], part


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Smallest overlap of sets of a and b elements with a Jaccard similarity of t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def line_sets(part_sets: tuple, rarity: np.ndarray, min_tokens: int) -> Iterator[tuple]:
    """Sets of the lines of a slice: their lines, sizes, 128-bit hashes and sorted elements.

    An element is a word's class of rarity in 6 bits above 44 bits of its hash, so
    that elements in ascending order are words from rare to common.
    """
    hashes, bounds, row, number, _ = part_sets
    for at in range(0, len(row), 1 << 14):  # line numbers of 14 bits in the sort key
        to = min(len(row), at + (1 << 14))
        h = hashes[bounds[at] : bounds[to]]
        line = np.repeat(np.arange(to - at, dtype=_U), np.diff(bounds[at : to + 1]))
        key = (line << _U(50)) | (rarity[(h >> _U(64 - BITS)).astype(np.int64)].astype(_U) << _U(44)) | (h & _U((1 << 44) - 1))
        key.sort()
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        line = (key >> _U(50)).astype(np.int64)
        size = np.bincount(line, minlength=to - at)
        keep = size >= max(1, min_tokens)
        if not keep.any():
            continue
        elem = (key & _U((1 << 50) - 1))[keep[line]]
        n = size[keep]
        b = np.append(0, np.cumsum(n))
        sums = (np.add.reduceat(K.mix(elem + _U(k)), b[:-1]).view(np.int64) for k in (0, 0x9E3779B97F4A7C15))
        yield row[at:to][keep], number[at:to][keep], n, *sums, elem, b


def parities(elem: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 parities of each set: two sets differ in as many elements at least as these differ in bits."""
    return np.bitwise_xor.reduceat(_U(1) << (K.mix(elem + _U(1)) & _U(63)), b[:-1]).view(np.int64)


def tiled(posts: DataFrame, heavy: int) -> DataFrame:
    """The postings with a side: 0 in the tile of one block with itself, else 1 or 2 for the lower and the higher block."""
    popular = written(posts.groupBy("elem").agg(F.count("*").alias("many")).where(F.col("many") > heavy))
    if popular.limit(1).count() == 0:
        return posts.withColumn("side", F.lit(0))
    rows = sized_join(posts, popular, "elem", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("many") * 2 / F.lit(heavy)), F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tile = F.when(F.col("blocks") == 1, F.col("elem")).otherwise(F.xxhash64("elem", pair))
    return rows.select(tile.alias("elem"), *(c for c in posts.columns if c != "elem"), side.alias("side"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, jaccard) of every line that goes.

    ``line_no`` counts from 0 over the text split at newlines; first_* is the
    earliest line that it matches.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark, t = docs.sparkSession, float(threshold)
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null")
    texts = texts.select("doc_id", K.ready_text(F.col("text")).alias("text"))

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in K.slices(batch):
            yield K.words(part.column(part.schema.get_field_index("text")))[0]

    level = spark.sparkContext.broadcast(sketch(texts.select("text"), hashed))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in line_slices(batch):
                ids = found[4].column(found[4].schema.get_field_index("doc_id"))
                for row, number, n, h1, h2, elem, b in line_sets(found, level.value, min_tokens):
                    alone = n / (n + 1) < t - 1e-12  # no set of another size comes near enough
                    longest = np.where(alone, 0, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1)
                    shorter = np.where(alone, 0, n - least_overlap(n, n, t) + 1)
                    pos = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest)
                    prefix = elem[np.repeat(b[:-1], longest) + pos]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(parities(elem, b)), pa.array(shorter.astype(np.int32)), packed(prefix, np.append(0, np.cumsum(longest)))], ["doc_id", "line_no", "n", "h1", "h2", "bits", "index", "prefix"])

    lines = written(texts.mapInArrow(sets, "doc_id bigint, line_no int, n int, h1 bigint, h2 bigint, bits bigint, index int, prefix binary"))
    place, key = F.struct("doc_id", "line_no"), F.struct("h1", "h2")
    # one line stands for all with its set: the earliest
    same = [F.first(c).alias(c) for c in ("n", "bits", "index", "prefix")]
    groups = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), *same))
    # postings of an element come together, by size; candidates are found as they pass
    posts = groups.where("index > 0").select("h1", "h2", "bits", "n", "index", "prefix").mapInArrow(_postings, "elem bigint, h1 bigint, h2 bigint, bits bigint, n int, pos int, index int")
    posts = tiled(posts, heavy).repartition("elem").sortWithinPartitions("elem", "n")
    pairs = posts.mapInArrow(lambda batches: _candidates(batches, t), "xh1 bigint, xh2 bigint, yh1 bigint, yh2 bigint").distinct()
    pairs = written(pairs.select(F.struct(F.col("xh1").alias("h1"), F.col("xh2").alias("h2")).alias("x"), F.struct(F.col("yh1").alias("h1"), F.col("yh2").alias("h2")).alias("y")))
    # the sets of the candidates are made once more, from the documents that hold them
    ends = pairs.select(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).union(pairs.select("y.h1", "y.h2")).distinct()
    wanted_docs = groups.join(ends, ["h1", "h2"], "left_semi").select("first.doc_id").distinct()
    present = spark.sparkContext.broadcast(sketch(ends.select("h1"), lambda batch: [K.mix(batch.column(0).to_numpy().view(_U))]))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in line_slices(batch):
                for _, _, n, h1, h2, elem, b in line_sets(found, level.value, min_tokens):
                    some = present.value[(K.mix(h1.view(_U)) >> _U(64 - BITS)).astype(np.int64)] > 0
                    some &= ~(n / (n + 1) < t - 1e-12)
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array(h1[some]), pa.array(h2[some]), packed(elem[np.repeat(some, n)], np.append(0, np.cumsum(n[some])))], ["h1", "h2", "elems"])

    body = sized_join(texts, wanted_docs, "doc_id", "left_semi").mapInArrow(bodies, "h1 bigint, h2 bigint, elems binary")
    body = written(body.dropDuplicates(["h1", "h2"]))
    joined = pairs.join(body.select(key.alias("x"), F.col("elems").alias("ex")), "x").join(body.select(key.alias("y"), F.col("elems").alias("ey")), "y")

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            common, both = _common(field("ex"), field("ey"))
            hit = common >= np.ceil(t * (both - common) - 1e-9)
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([field("x").filter(keep), field("y").filter(keep), pa.array((common / np.maximum(both - common, 1))[hit])], ["x", "y", "jaccard"])

    near = joined.select("x", "y", "ex", "ey").mapInArrow(overlaps, "x struct<h1:bigint,h2:bigint>, y struct<h1:bigint,h2:bigint>, jaccard double")
    near = written(near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "jaccard")))
    # the earliest match of a set's lines: in the set itself, or in a similar one
    firsts = groups.select(key.alias("y"), F.col("first").alias("other"))
    nearest = near.join(firsts, "y").groupBy(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.min(F.struct("other", (-F.col("jaccard")).alias("minus"))).alias("best"))
    wanted = groups.select("h1", "h2", "first", "last").join(nearest, ["h1", "h2"], "left").where("best is not null or first < last")
    itself = F.when(place > F.col("first"), F.struct(F.col("first").alias("other"), F.lit(-1.0).alias("minus")))
    out = (
        lines.select("doc_id", "line_no", "h1", "h2")
        .join(wanted, ["h1", "h2"])
        .withColumn("hit", F.least(itself, F.when(F.col("best.other") < place, F.col("best"))))
        .where("hit is not null")
        .select("doc_id", "line_no", F.col("hit.other.doc_id").alias("first_doc_id"), F.col("hit.other.line_no").alias("first_line_no"), F.round(-F.col("hit.minus"), 6).alias("jaccard"))
        .distinct()
    )
    return finished(out, lines, groups, pairs, body, near)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element of each prefix."""
    for batch in batches:
        field = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        column = field("prefix")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
        flat = np.frombuffer(column.buffers()[2], np.int64)[offsets[0] : offsets[-1]]
        many = np.diff(offsets)
        row = pa.array(np.repeat(np.arange(len(many)), many))
        pos = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], many)
        yield pa.RecordBatch.from_arrays([pa.array(flat), field("h1").take(row), field("h2").take(row), field("bits").take(row), field("n").take(row), pa.array(pos.astype(np.int32)), field("index").take(row)], ["elem", "h1", "h2", "bits", "n", "pos", "index"])


def _candidates(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share an element, from postings in order of element and size.

    Rows of the batches before are kept only as long as their element goes on and
    they aren't too small for the sets to come.
    """
    names = ["elem", "h1", "h2", "bits", "n", "pos", "index", "side"]
    kept = [np.zeros(0, np.int64) for _ in names]
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(kept[0])
        rows = [np.concatenate([k, batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64)]) for k, c in zip(kept, names, strict=True)]
        elem, h1, h2, bits, n, pos, index, side = rows
        at = np.arange(old, len(elem))
        # each row looks back: at rows of its element that are large enough
        begin = np.flatnonzero(np.append(True, elem[1:] != elem[:-1]))
        start = begin[np.searchsorted(begin, at, side="right") - 1]
        base = n.max() + 1
        order = np.searchsorted(begin, np.arange(len(elem)), side="right") * base + n  # ascends over the rows
        low = np.searchsorted(order, order[at] - n[at] + np.ceil(t * n[at] - 1e-9).astype(np.int64))
        low = np.maximum(low, start)
        for a in range(0, len(at), 4096):
            i, lo = at[a : a + 4096], low[a : a + 4096]
            many = i - lo
            big = np.cumsum(many)
            cuts = [0, *np.searchsorted(big, np.arange(1, int(big[-1] // 500_000) + 1) * 500_000).tolist(), len(i)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if q <= p or not (m := many[p:q]).sum():
                    continue
                y = np.repeat(i[p:q], m)
                x = np.repeat(lo[p:q] - np.cumsum(m) + m, m) + np.arange(m.sum())
                meet = (side[x] == 0) | (side[x] != side[y])
                x, y = x[meet], y[meet]
                x, y = _possible(x, y, h1, h2, bits, n, pos, index, t)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h1[x], h2[x], h1[y], h2[y])], ["xh1", "xh2", "yh1", "yh2"])
        last = max(int(np.searchsorted(order, order[-1] - n[-1] + math.ceil(t * n[-1] - 1e-9))), int(begin[-1]))
        kept = [r[last:] for r in rows]


def _possible(x: np.ndarray, y: np.ndarray, h1: np.ndarray, h2: np.ndarray, bits: np.ndarray, n: np.ndarray, pos: np.ndarray, index: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose positions and parities leave enough overlap; x the smaller, of equal ones that of the lower hash."""
    swap = (n[x] == n[y]) & ((h1[x] > h1[y]) | ((h1[x] == h1[y]) & (h2[x] > h2[y])))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    overlap = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
    least = least_overlap(n[x], n[y], t)
    good = (pos[x] < index[x]) & (overlap >= least) & (np.bitwise_count((bits[x] ^ bits[y]).view(_U)).astype(np.int64) <= n[x] + n[y] - 2 * least) & ((h1[x] != h1[y]) | (h2[x] != h2[y]))
    return x[good], y[good]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in an array of packed sets, and the sets' bounds in these."""
    if not len(column):
        return np.zeros(0, _U), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    return np.frombuffer(column.buffers()[2], _U)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _common(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of packed sets of 50-bit numbers the size of the intersection, and both sizes together."""
    (ex, bx), (ey, by) = _flat(x), _flat(y)
    common = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1 << 14):  # numbers of pairs of 14 bits in the sort key
        to = min(len(x), at + (1 << 14))
        keys = [(np.repeat(np.arange(to - at, dtype=_U), np.diff(b[at : to + 1])) << _U(50)) | e[b[at] : b[to]] for e, b in ((ex, bx), (ey, by))]
        key = np.concatenate(keys)
        key.sort()
        common[at:to] = np.bincount((key[1:][key[1:] == key[:-1]] >> _U(50)).astype(np.int64), minlength=to - at)
    return common, np.diff(bx) + np.diff(by)


def without_lines(docs: DataFrame, removed: DataFrame, least_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents without these lines.

    A document whose every line with words goes, goes, and so does one that loses
    lines and keeps less than ``least_share`` of its characters: shreds of a copy.  All
    columns stay as they are but the text of documents that lose lines, and the
    number of its characters where there is such a column.
    """
    names = docs.columns
    lost = removed.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))  # of one document
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = {name: f"c{names.index(name)}" for name in (id_col, text_col, size_col) if name in names}
    rows = plain.join(lost, F.col(at[id_col]).cast("long") == F.col("doc_id"), "left")
    left = F.filter(F.split(at[text_col], "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    text = F.when(F.col("gone").isNull(), F.col(at[text_col])).otherwise(F.array_join("left", "\n"))
    enough = F.exists("left", lambda x: F.trim(x) != "") & (F.length(F.array_join("left", "\n")) >= F.lit(float(least_share)) * F.length(at[text_col]))
    rows = rows.where(F.col("gone").isNull() | enough)
    new = {at[text_col]: text}
    if size_col in at:
        kind = docs.schema[names.index(size_col)].dataType
        new[at[size_col]] = F.when(F.col("gone").isNull(), F.col(at[size_col])).otherwise(F.length(text).cast(kind))
    return rows.select(*(new.get(f"c{k}", F.col(f"c{k}")) for k in range(len(names)))).toDF(*names)
