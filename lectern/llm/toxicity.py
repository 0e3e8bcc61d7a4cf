"""Toxic passages as maximal scoring segments.

Words have log-odds between toxic and other labelled documents, with an
informative Dirichlet prior in proportion to the words' overall counts.  A word
counts once for each document, and copies count once: it is counted by the
different neighbours that it has where these hash least.  Words whose excess
among toxic documents may be chance (a likelihood ratio below that expected of
the greatest of so many words) count as neutral.  Every word's score is
its log-odds less ``drift``, so that ordinary text scores below zero.  A linear
scan finds all maximal scoring segments of a document (no segment overlaps
another, none can be extended or joined to gain).

Scores are calibrated as extreme values: lambda solves sum p(w) exp(lambda
score(w)) = 1 over the background; K is the censored maximum-likelihood
estimate over all documents, from each document's length and best score.  A
segment of score S among n words is expected K n exp(-lambda S) times by chance;
those expected at most ``significance`` times are toxic passages.  A document's
own e_value is that of its segments together (their normalised scores summed).

The word scores are fitted on at most ``per_class`` labelled documents of each
class, a sample by hash of the id; everything else covers all rows.

Defined results: null ids or texts take no part, as do labels that are null; a
document labelled more than once is toxic if any label says so; rows that repeat
an id are scored one by one and the one with the lowest e_value counts (equal
ones once); without toxic or without other labels nothing is toxic; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns, finished, written

PER_CLASS = 3000
PRIOR = 1000.0
DRIFT = 0.2
SIGNIFICANCE = 1e-5
_U = np.uint64


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), by a linear scan."""
    found: list[list[float]] = []  # first, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        now = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
        found.append(now)
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def sparse_segments(at: np.ndarray, gains: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """The segments where only the words at these places score above zero, the others -drift."""
    gaps = np.diff(at) - 1
    scores = np.empty(2 * len(at) - 1)
    scores[::2] = gains
    scores[1::2] = -drift * gaps
    return [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in segments(scores)]


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds of each word with a Dirichlet prior; 0 where its excess may be chance among so many words."""
    both = toxic + other
    alpha = prior * both / max(1.0, both.sum())
    odds = np.log((toxic + alpha) / (toxic.sum() + prior)) - np.log((other + alpha) / (other.sum() + prior))
    share = toxic.sum() / max(1.0, both.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (toxic * np.log(toxic / (both * share)) + np.where(other > 0, other * np.log(other / (both * (1 - share))), 0))
    return np.where((toxic > both * share) & (gain >= 2 * math.log(max(2, len(both)))), odds, 0.0)


def decay(scores: np.ndarray, p: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; scores must be negative on average."""
    f = lambda x: float((p * np.exp(x * scores)).sum()) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, drift: float = DRIFT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes of toxic words in order, their scores above drift, lambda)."""
    known = columns(labels, doc_id=(id_col, "long"), toxic=(label_col, "int")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    nothing = np.zeros(0, _U), np.zeros(0), 1.0
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("toxic"), F.lit(per_class / sizes[True])).otherwise(F.lit(per_class / sizes[False]))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < share)  # 2 * per_class rows, whatever the input
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("text is not null").join(F.broadcast(picked), "doc_id").select("toxic", K.ready_text(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
                if not len(hashes):
                    continue
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                before, after = np.append(_U(0), hashes[:-1]), np.append(hashes[1:], _U(0))
                before[bounds[:-1][np.diff(bounds) > 0]] = 0
                after[bounds[1:][np.diff(bounds) > 0] - 1] = 0
                around = K.mix(before + K.mix(after + _U(1)))
                order = np.lexsort((around, hashes, row))
                first = np.flatnonzero(np.append(True, (np.diff(row[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])))
                at = order[first]
                n = np.diff(np.append(first, len(order)))
                toxic = part.column(part.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)[row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(toxic), pa.array(around[at].view(np.int64)), pa.array(n.astype(np.int64))], ["word", "toxic", "around", "n"])

    found = texts.mapInArrow(count, "word bigint, toxic boolean, around bigint, n bigint").groupBy("word", "toxic", "around").agg(F.sum("n").alias("n"))
    each = lambda what, kind: F.sum(F.when(F.col("toxic") == kind, what).otherwise(0))
    counts = found.groupBy("word").agg(each(1, True).alias("t"), each(1, False).alias("o"), each(F.col("n"), False).alias("n")).toArrow()  # words of a sample of fixed size
    if not counts.num_rows:
        return nothing
    words, (t, o, n) = counts["word"].to_numpy().view(_U), (counts[c].to_numpy().astype(float) for c in ("t", "o", "n"))
    scores = log_odds(t, o) - drift
    p = (n + PRIOR * (t + o) / (t + o).sum()) / (n.sum() + PRIOR)
    chosen = scores > 0
    order = np.argsort(words[chosen])
    return words[chosen][order], scores[chosen][order], decay(scores, p)


def toxic_passages(docs: DataFrame, labels: DataFrame, significance: float = SIGNIFICANCE, drift: float = DRIFT, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, n_words, passages, max_score, e_value) of documents with toxic passages.

    A passage has its first word, the word after its last, score and e_value.
    """
    spark = docs.sparkSession
    words, gains, decay_rate = train(docs, labels, per_class, drift, id_col, text_col, label_col)
    known = spark.sparkContext.broadcast((words, gains))  # words of a sample of fixed size
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null").select("doc_id", K.ready_text(F.col("text")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, gain = known.value
        for batch in batches:
            for part in K.slices(batch):
                hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
                n = np.diff(bounds)
                found: list[list[dict]] = [[] for _ in n]
                if len(toxic):
                    near = np.minimum(np.searchsorted(toxic, hashes), len(toxic) - 1)
                    at = np.flatnonzero(toxic[near] == hashes)
                    row = np.searchsorted(bounds, at, side="right") - 1
                    for d in np.unique(row):
                        own = at[row == d]
                        found[d] = [{"first": a, "end": b, "score": s} for a, b, s in sparse_segments(own - bounds[d], gain[near[own]], drift)]
                best = [max((s["score"] for s in x), default=0.0) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n.astype(np.int64)), pa.array(best, pa.float64()), pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "n_words", "best", "found"])

    scored = written(texts.mapInArrow(scan, "doc_id bigint, n_words bigint, best double, found array<struct<first:int,end:int,score:double>>").where("n_words > 0"))
    fit = scored.agg(F.sum((F.col("best") > 0).cast("double")).alias("hits"), F.sum(F.col("n_words") * F.exp(-F.lit(decay_rate) * F.col("best"))).alias("mass")).collect()[0]
    k = max(fit["hits"] or 0.0, 1.0) / max(fit["mass"] or 1.0, 1.0)
    chance = lambda s: F.lit(k) * F.col("n_words") * F.exp(-F.lit(decay_rate) * s)
    passages = F.transform("found", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), F.round(s["score"], 4).alias("score"), chance(s["score"]).alias("e_value")))
    hits = scored.where("best > 0").select("doc_id", "n_words", F.filter(passages, lambda s: s["e_value"] <= significance).alias("passages")).where(F.size("passages") > 0)
    total = F.aggregate("passages", F.lit(0.0), lambda acc, s: acc - F.log(s["e_value"]))
    # r segments with a sum t of normalised scores: exp(-t) t^(r - 1) / (r! (r - 1)!), in logarithms
    r = F.size("passages")
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda acc, j: acc + F.log(F.greatest(j, F.lit(1)).cast("double")))
    log_e = -F.col("t") + (r - 1) * F.log(F.greatest(F.col("t"), F.lit(1.0))) - log_factorial(r) - log_factorial(r - 1)
    out = hits.withColumn("t", total).select("doc_id", "n_words", "passages", F.array_max(F.transform("passages", lambda s: s["score"])).alias("max_score"), F.exp(F.least(log_e, F.log(F.array_min(F.transform("passages", lambda s: s["e_value"]))))).alias("e_value"))
    out = out.groupBy("doc_id").agg(F.min(F.struct("e_value", "n_words", "passages", "max_score")).alias("x")).select("doc_id", "x.n_words", "x.passages", "x.max_score", "x.e_value")
    return finished(out, scored)


