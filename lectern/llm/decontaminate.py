"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are counted over the whole corpus; those in no
more than ``rare_share`` of the documents (10 at least) are seeds, and so are the
``least_seeds`` rarest of each item, so that no item is without.  A second pass
joins documents to items by shared seeds.  Around each group of hits the
document's words are aligned with the item's by Smith-Waterman (match 2, mismatch
and gap -1); the score, as a share of a full match, decides.  A window whose
words can't reach the threshold, however arranged, is not aligned.

The windows reach as far as any alignment through a seed that scores enough: an
item of n words can have 2 * n * (1 - threshold) words between its own.

Items are held by every task in blocks of at most ``block_bytes`` of text, or of one
item; a larger benchmark takes one pass over the corpus for each block, so that
memory doesn't grow with it.

Defined results: null ids, null texts and texts without words take no part on
either side; items of fewer than n words are one seed; items that share an id
count as one, by their best alignment, and so do rows that repeat a document's
id; an empty table on either side gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns

NGRAM = 3
THRESHOLD = 0.5
RARE_SHARE = 1e-3
LEAST_SEEDS = 8
BLOCK_BYTES = 16 << 20
_U = np.uint64
_BITS = 20


class Seeds:
    """Items as word hashes, and their n-grams with the places where these stand."""

    def __init__(self, texts: pa.Array, n: int) -> None:
        hashes, _, _, bounds = K.words(texts)
        self.words = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        grams, to = K.grams(hashes, bounds, n)
        self.order = np.argsort(grams, kind="stable")
        self.item = np.repeat(np.arange(len(texts)), np.diff(to))
        self.place = np.arange(len(grams)) - to[self.item]
        self.grams = grams
        self.values, self.begin = np.unique(grams[self.order], return_index=True)
        self.begin = np.append(self.begin, len(grams))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.values >> _U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in grams of known n-grams, and their numbers in values."""
        at = np.flatnonzero(self.maybe[(grams >> _U(64 - _BITS)).astype(np.int64)])
        number = np.searchsorted(self.values, grams[at])
        same = self.values[np.minimum(number, len(self.values) - 1)] == grams[at]
        return at[same], number[same]

    def rare(self, counts: np.ndarray, most: float, least: int) -> np.ndarray:
        """Which occurrences in items (in gram order) are seeds."""
        n = counts[np.searchsorted(self.values, self.grams)]
        by_item = np.lexsort((self.place, n, self.item))
        rank = np.empty(len(n), np.int64)
        item = self.item[by_item]
        rank[by_item] = np.arange(len(n)) - np.searchsorted(item, item)
        return (n <= most) | (rank < least)


def local_scores(item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of the item in each window, all windows at once."""
    width = max(map(len, windows))
    text = np.zeros((len(windows), width), _U)  # 0 is no word's hash but by rarest chance
    inside = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        text[k, : len(w)] = w
        inside[k, : len(w)] = True
    slope = np.arange(width)
    row = np.zeros((len(windows), width + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    for word in item:
        score = np.where((text == word) & inside, 2, -1)
        now = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps in the item
        row[:, 1:] = now
        best = np.maximum(best, now.max(axis=1))
    return best


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end) of the best local alignment; of equal ones the first to end."""
    score = np.zeros(len(window) + 1, np.int64)
    origin = np.arange(len(window) + 1)
    best = (0, 0, 0)
    for word in item:
        new, start = score.copy(), origin.copy()
        new[0], start[0] = 0, 0
        for j in range(1, len(window) + 1):
            options = [(score[j - 1] + (2 if window[j - 1] == word else -1), -origin[j - 1]), (score[j] - 1, -origin[j]), (new[j - 1] - 1, -start[j - 1]), (0, -j)]
            value, minus = max(options)
            new[j], start[j] = value, -minus
            if (value, -j) > (best[0], -best[2]):
                best = (int(value), int(-minus), j)
        score, origin = new, start
    return best


def windows(places: np.ndarray, own: np.ndarray, length: int, words: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Stretches of a document that hold every good alignment through the seeds found at places, which stand at own in the item.

    Overlapping ones are joined up to a few lengths of the item; a seed beyond begins another.
    """
    slack = math.ceil(2 * length * (1 - threshold)) + 1
    starts = np.sort(places - own)
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, int(s) - slack), min(words, int(s) + length + slack)
        if out and a <= out[-1][1] and b - out[-1][0] <= 2 * (length + 2 * slack):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, rare_share: float = RARE_SHARE, least_seeds: int = LEAST_SEEDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of documents that hold items."""
    spark = docs.sparkSession
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null").select("doc_id", K.ready_text(F.col("text")).alias("text"))
    items = columns(benchmark, item_id=(item_col, "long"), text=(item_text_col, "string")).where("item_id is not null and text is not null").select("item_id", K.ready_text(F.col("text")).alias("text"))
    items = items.distinct()
    number, size = (lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), F.octet_length("text").cast("long")
    total, longest = (x or 0 for x in items.agg(F.sum(size), F.max(size)).collect()[0])
    blocks = max(1, math.ceil(total / block_bytes))
    while blocks > 1 and items.groupBy(number(blocks)).agg(F.sum(size).alias("n")).where(F.col("n") > max(block_bytes, longest)).limit(1).count():
        blocks *= 2
    most = max(10.0, rare_share * texts.count())
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(number(blocks) == k)
        found = _block(spark, texts, block.toArrow(), most, threshold, n, least_seeds)
        out = found if out is None else out.union(found)
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("a"), (-F.col("end_word")).alias("b"))).alias("x"))
    return out.select("doc_id", "item_id", "x.score", (-F.col("x.a")).alias("first_word"), (-F.col("x.b")).alias("end_word"))


def _block(spark, texts: DataFrame, items: pa.Table, most: float, threshold: float, n: int, least_seeds: int) -> DataFrame:
    seeds = Seeds(items["text"].combine_chunks() if items.num_rows else pa.array([], pa.string()), n)
    ids = items["item_id"].to_numpy()
    held = spark.sparkContext.broadcast(seeds)  # of block_bytes of text, or of one item

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known.values), np.int64)
        for batch in batches:
            for part in K.slices(batch):
                hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
                np.add.at(total, known.hits(K.grams(hashes, bounds, n)[0])[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    schema = "doc_id bigint, item_id bigint, score double, first_word int, end_word int"
    if not len(seeds.values):
        return spark.createDataFrame([], schema)
    counts = np.zeros(len(seeds.values), np.int64)
    found = texts.mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    counts[found["seed"].to_numpy()] = found["n"].to_numpy()
    rare = spark.sparkContext.broadcast(seeds.rare(counts, most, least_seeds))

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, good = held.value, rare.value
        for batch in batches:
            for part in K.slices(batch):
                hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
                grams, to = K.grams(hashes, bounds, n)
                at, number = known.hits(grams)
                if not len(at):
                    continue
                many = known.begin[number + 1] - known.begin[number]
                spot = known.order[np.repeat(known.begin[number] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                at = np.repeat(at, many)[good[spot]]
                spot = spot[good[spot]]
                if not len(at):
                    continue
                row = np.searchsorted(to, at, side="right") - 1
                item = known.item[spot]
                order = np.lexsort((at, row, item))
                at, spot, row, item = at[order], spot[order], row[order], item[order]
                cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
                todo: dict[int, list[tuple[int, int, np.ndarray]]] = {}
                for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    d, i = row[a], int(item[a])
                    doc, own = hashes[bounds[d] : bounds[d + 1]], known.words[i]
                    for first, end in windows(at[a:b] - to[d], known.place[spot[a:b]], len(own), len(doc), threshold):
                        window = doc[first:end]
                        if np.isin(own, window).sum() >= threshold * len(own):  # its words alone could reach the score
                            todo.setdefault(i, []).append((int(d), first, window))
                rows = []
                for i, cases in todo.items():
                    own = known.words[i]
                    for k in range(0, len(cases), 256):
                        some = cases[k : k + 256]
                        for (d, first, window), score in zip(some, local_scores(own, [c[2] for c in some]), strict=True):
                            if score >= threshold * 2 * len(own) - 1e-9:
                                best, a, b = align(own, window)
                                rows.append((d, int(ids[i]), round(best / (2 * len(own)), 6), first + a, first + b))
                if rows:
                    d, i, s, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return texts.mapInArrow(leaks, schema)
