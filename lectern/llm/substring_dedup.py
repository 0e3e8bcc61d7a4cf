"""Substring deduplication by hashed sentence spans.

A text is cut into sentences (at [.!?] before a blank, and at newlines).  A
sentence of more than ``LONG`` words is divided further, after [,;:] and after words
whose number of bytes is 7 more than a multiple of 8: at places that depend on
its words alone, so that a passage that begins or ends within a sentence still
meets the same cuts.  From every sentence (or part of one) on, the shortest run of
at least ``span`` of them with at least ``min_words`` words is hashed; it is repeated
if its words, in lower case, are those of another run anywhere.  All runs but the
first one (by document id, then position) of each kind are non-first, and
sentences that any non-first run covers go.

Each task first sorts the runs of its own rows: of equal ones only the first has
still to meet those of other tasks, whatever share of the rows holds the kind; the
others are known not to be first and go straight to their documents.  Runs, of 28
bytes each, are exchanged once by their 128-bit hash and sorted; one pass over
each partition finds those that aren't first, without holding equal ones together.

Defined results: null ids and null texts take no part; empty texts, texts without
words and those too short for a run have none; characters without a word belong
to the sentence before them; rows that repeat an id are one document whose runs
share positions (equal rows thus don't remove each other); runs of one document
also repeat each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns, written
from .rarity import BITS, sketch

SPAN = 3
MIN_WORDS = 40
LONG = 8
#: Runs that a task sorts at once before they are exchanged.
CHUNK = 1 << 20
_U = np.uint64
_SPANS = "h1 bigint, h2 bigint, doc_id bigint, pos int"


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a marked byte stands between each word and the one before it."""
    total = np.append(0, np.cumsum(marks))
    out = np.zeros(len(starts), bool)
    out[1:] = total[starts[1:]] > total[ends[:-1]]
    return out


def sentences(text: pa.Array, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words' hashes, first word of each sentence, the texts' bounds in sentences) of lower-case texts."""
    raw, _ = K._bytes_of(text)
    hashes, starts, ends, bounds = K.words(text)
    if not len(hashes):
        empty = np.zeros(0, np.int64)
        return hashes, empty, np.zeros(len(bounds), np.int64)
    stop = raw == 10
    stop[:-1] |= np.isin(raw[:-1], (33, 46, 63)) & np.isin(raw[1:], (9, 32))
    cut = _between(stop, starts, ends)
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(hashes)))
    inner = _between(np.isin(raw, (44, 58, 59)), starts, ends)
    inner[1:] |= (ends - starts)[:-1] % 8 == 7
    first = np.flatnonzero(cut | (inner & np.repeat(size > long, size)))
    return hashes, first, np.searchsorted(first, bounds)


def runs(first: np.ndarray, bounds: np.ndarray, words: int, span: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, sentence after the last, text) of the shortest run from each sentence on."""
    edge = np.append(first, words)
    k = np.arange(len(first))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.maximum(np.searchsorted(edge, first + least), k + span)
    good = end <= bounds[1:][text]
    return k[good], end[good], text[good]


def _hashes(words: np.ndarray, a: np.ndarray, z: np.ndarray) -> Iterator[np.ndarray]:
    """Two 64-bit hashes of the words from a up to z."""
    up, down = K._tables(len(words) + 1)
    for seed in (_U(1), _U(0x9E3779B97F4A7C15)):
        total = np.zeros(len(words) + 1, _U)
        np.cumsum((K.mix(words + seed) | _U(1)) * up[: len(words)], out=total[1:])
        yield K.mix((total[z] - total[a]) * down[a] + (z - a).astype(_U)).view(np.int64)


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Runs of a task: the first of each kind as it is, the others under a key of their own and negative."""
    h1, h2, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((pos, doc, h2, h1))
    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    later = (doc != doc[begin]) | (pos != pos[begin])
    own = K.mix(doc.view(_U) + K.mix(pos.astype(np.int64).view(_U) + _U(1))).view(np.int64)
    keep = new | later
    out = (np.where(later, own, h1), np.where(later, ~own, h2), doc, np.where(later, -1 - pos, pos).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], ["h1", "h2", "doc_id", "pos"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in order of their kind and place: those that aren't their kind's first."""
    last: tuple[int, int, int, int] | None = None  # kind and place of the first of the kind that goes on
    for batch in batches:
        h1, h2, doc, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("h1", "h2", "doc_id", "pos"))
        known = pos < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(-1 - pos[known])], ["doc_id", "pos"])
        h1, h2, doc, pos = h1[~known], h2[~known], doc[~known], pos[~known]
        if not len(doc):
            continue
        new = np.append(last is None or (h1[0], h2[0]) != last[:2], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        first, at = doc[begin], pos[begin]
        if last is not None:
            first, at = np.where(begin < 0, last[2], first), np.where(begin < 0, last[3], at)
        hit = (doc != first) | (pos != at)
        last = int(h1[-1]), int(h2[-1]), int(first[-1]), int(at[-1])
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(pos[hit])], ["doc_id", "pos"])


def repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed, n_sentences, kept_text) of documents that lose sentences.

    ``removed`` holds their numbers from 0; ``kept_text`` is the text without them ('' if
    none stays).
    """
    if span < 2 or min_words < 1:
        raise ValueError("span must be 2 at least, min_words 1")
    spark = docs.sparkSession
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null")
    ready = texts.select("doc_id", K.ready_text(F.col("text")).alias("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            for part in K.slices(batch):
                words, first, bounds = sentences(part.column(1))
                k, end, text = runs(first, bounds, len(words), span, min_words)
                if not len(k):
                    continue
                edge = np.append(first, len(words))
                parts.append((*_hashes(words, edge[k], edge[end]), part.column(0).to_numpy()[text], (k - bounds[text]).astype(np.int32)))
                many += len(k)
                if many >= CHUNK:
                    yield _combined(parts)
                    parts, many = [], 0
        if parts:
            yield _combined(parts)

    # one exchange: equal runs come together in order of their places, and pass one by one
    later = ready.mapInArrow(spans, _SPANS).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos").mapInArrow(_later, "doc_id bigint, pos int")
    gone = written(later.groupBy("doc_id").agg(F.collect_set("pos").alias("starts")))
    # texts are cut once more, those that lose sentences; a bitmap of fixed size keeps most others from the join
    some = spark.sparkContext.broadcast(sketch(gone.select("doc_id"), lambda batch: [K.mix(batch.column(0).to_numpy().view(_U))]) > 0)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = K.mix(batch.column(0).to_numpy().astype(np.int64).view(_U)) >> _U(64 - BITS)
            keep = some.value[ids.astype(np.int64)]
            if keep.any():
                yield batch.filter(pa.array(keep))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                words, first, bounds = sentences(part.column(1))
                k, end, text = runs(first, bounds, len(words), span, min_words)
                edge = np.append(first, len(words))
                starts = K.words(part.column(2))[1]  # the same words, as they stand in the text
                raw, offsets = K._bytes_of(part.column(2))
                rows = []
                for d, gone_from in enumerate(part.column(3).to_pylist()):
                    a, z = bounds[d], bounds[d + 1]
                    inside = np.flatnonzero(text == d)
                    inside = inside[np.isin(k[inside] - a, gone_from)]
                    change = np.zeros(z - a + 1, np.int64)
                    np.add.at(change, k[inside] - a, 1)
                    np.add.at(change, end[inside] - a, -1)
                    lost = np.cumsum(change)[:-1] > 0
                    if not lost.any():
                        continue
                    at = np.append(starts[edge[a:z]], offsets[d + 1] - 1)  # without the newline at the end
                    at[0] = offsets[d]
                    kept = b"".join(raw[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(~lost))
                    rows.append((part.column(0)[d].as_py(), np.flatnonzero(lost).astype(np.int32), int(z - a), kept.decode()))
                if rows:
                    i, r, n, t = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(r, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(t, pa.string())], ["doc_id", "removed", "n_sentences", "kept_text"])

    lose = texts.mapInArrow(candidates, "doc_id bigint, text string").join(gone, "doc_id").select("doc_id", "text", "starts").distinct()
    lose = lose.select("doc_id", K.ready_text(F.col("text")).alias("text"), F.concat("text", F.lit("\n")).alias("own"), "starts")
    return lose.mapInArrow(without, "doc_id bigint, removed array<int>, n_sentences int, kept_text string")
