"""Language identification of texts in several languages at once.

Each language has a trigram model of the characters (as 64 classes of UTF-8
bytes) of its words.  A document is a mixture: each word comes from one of its
languages, and expectation-maximisation over the words' likelihoods estimates
the proportions.  ``und`` is one more component, uniform over characters, for
words that no language explains.  Which languages a document has is decided by
penalised likelihood: the set S with the greatest
log L(S) - penalty * (|S| - 1) * log(1 + words).
The likelihood of all components together bounds every set's from above, so
that most documents are settled by one estimation; only where the bound leaves
room are larger sets tried, and of these only sets whose best component at each
word could together beat the best set so far.  Estimations go on until no
proportion moves by more than 1e-4.

The models are fitted on at most ``per_language`` labelled documents of each
language (a sample by hash of the id; the bound is a parameter); everything
else covers whole texts of all rows.

A document is rejected (``accepted`` false) if it has no words, or if ``und``
has at least half of its words in the chosen set.

Defined results: one row for each row of the table, rows without an id or with
a null text included (rejected if there is no text); null labels train nothing;
without any label all documents with words are ``und``; ties go to fewer
languages, then the first by name; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns

PER_LANGUAGE = 2000
PENALTY = 4.0
SMOOTHING = 0.05
UNKNOWN = "und"
_V = 64

_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[128:192] = 28 + (np.arange(128, 192) & 31)  # continuation bytes
_CLASS[192:256] = 60 + (np.arange(192, 256) & 3)  # lead bytes


def trigrams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram at each byte, first bytes and lengths (with the end) of the words, and bounds by text."""
    text = part.column(part.schema.get_field_index("text"))
    raw, _ = K._bytes_of(text)
    _, starts, ends, bounds = K.words(text)
    now = _CLASS[raw]
    one = np.append(np.int32(0), now[:-1])
    two = np.append(np.int32(0), one[:-1])
    two[one == 0] = 0
    return (two * _V + one) * _V + now, starts, ends, bounds


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log p(character | two before it) as [language, trigram]."""
    rows = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string")).where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, _V**3), np.float32)
    share = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))))
    place = F.create_map(*(x for k, v in enumerate(langs) for x in (F.lit(v), F.lit(k))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < share[F.col("lang")]).select(place[F.col("lang")].alias("lang"), K.ready_text(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), _V**3), np.int64)
        for batch in batches:
            for part in K.slices(batch):
                grams, starts, ends, bounds = trigrams(part)
                lang = part.column(part.schema.get_field_index("lang")).to_numpy()
                spread = ends - starts + 1
                at = np.repeat(starts - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
                np.add.at(total, (np.repeat(np.repeat(lang, np.diff(bounds)), spread), grams[at]), 1)
        for k in range(len(langs)):
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[k][some])], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # 64**3 rows a language at most
    total = np.full((len(langs), _V**3), SMOOTHING)
    np.add.at(total, (counts["lang"].to_numpy(), counts["gram"].to_numpy()), counts["n"].to_numpy())
    total = total.reshape(len(langs), _V * _V, _V)
    return langs, np.log(total / total.sum(axis=2, keepdims=True)).astype(np.float32).reshape(len(langs), -1)


def mixture(like: np.ndarray, starts: np.ndarray, allowed: np.ndarray, settled: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document under its allowed components.

    like: words' likelihoods [word, component], relative to their own best; starts:
    the documents' first words; allowed: [document, component].
    """
    docs = len(starts)
    n = np.diff(np.append(starts, len(like)))
    weight = allowed / allowed.sum(axis=1, keepdims=True)
    score = np.zeros(docs)
    active = np.arange(docs)
    rows = np.arange(len(like))
    while True:  # likelihoods only rise, so that the steps become small
        m = n[active]
        local = np.append(0, np.cumsum(m))[:-1]
        joint = like[rows] * np.repeat(weight[active], m, axis=0)
        total = np.maximum(joint.sum(axis=1), 1e-300)
        score[active] = np.add.reduceat(np.log(total), local)
        joint /= total[:, None]
        new = np.add.reduceat(joint, local, axis=0) / m[:, None]
        moved = np.abs(new - weight[active]).max(axis=1) > settled
        weight[active] = new
        if not moved.any():
            break
        rows = rows[np.repeat(moved, m)]
        active = active[moved]
    return weight, score


def choose(like: np.ndarray, starts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Chosen components [document, component] by penalised likelihood, and their proportions."""
    docs, parts = len(starts), like.shape[1]
    n = np.diff(np.append(starts, len(like)))
    price = penalty * np.log1p(n)
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), starts, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((docs, parts))
    chosen[np.arange(docs), best] = 1
    score = single.max(axis=1)
    weight = chosen.copy()
    if parts == 1:
        return chosen, weight
    _, bound = mixture(like, starts, np.ones((docs, parts)))
    # the bound of an estimation that isn't quite settled is a little low
    open_docs = np.flatnonzero(bound + 1e-3 * n + 0.01 - price > score)
    if not len(open_docs):
        return chosen, weight
    rows = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in open_docs])
    local = np.append(0, np.cumsum(n[open_docs]))[:-1]
    top = score[open_docs].copy()
    logs = np.log(np.maximum(like[rows], 1e-300))
    for size in range(2, parts + 1):
        worth = np.flatnonzero(bound[open_docs] + 1e-3 * n[open_docs] + 0.01 - price[open_docs] * (size - 1) > top)
        if not len(worth):
            break
        m = n[open_docs[worth]]
        begin = np.append(0, np.cumsum(m))[:-1]
        at = np.repeat(local[worth] - begin, m) + np.arange(m.sum())
        for combo in itertools.combinations(range(parts), size):
            # no mixture explains a word better than the best of its components
            most = np.add.reduceat(logs[at][:, combo].max(axis=1), begin) - price[open_docs[worth]] * (size - 1)
            can = np.flatnonzero(most > top[worth])
            if not len(can):
                continue
            mask = np.zeros(parts)
            mask[list(combo)] = 1
            some = at[np.repeat(np.isin(np.arange(len(worth)), can), m)]
            w, s = mixture(like[rows[some]], np.append(0, np.cumsum(m[can]))[:-1], np.tile(mask, (len(can), 1)))
            s = s - price[open_docs[worth[can]]] * (size - 1)
            won = s > top[worth[can]] + 1e-9
            top[worth[can[won]]] = s[won]
            chosen[open_docs[worth[can[won]]]] = mask
            weight[open_docs[worth[can[won]]]] = w[won]
    return chosen, weight


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, languages, proportions, main_language, n_words, accepted) of every row.

    ``languages`` go from the greatest proportion down; ``keep`` names columns to
    carry along unchanged, under names c0, c1, ...
    """
    langs, table = model if model is not None else train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    names = [*langs, UNKNOWN]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 64**3 floats a language
    rest = {f"c{k}": (c, docs.schema[c].dataType.simpleString()) for k, c in enumerate(keep)}
    rows = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **rest).withColumn("text", K.ready_text(F.col("text")))
    kept = [f.name for f in rows.schema if f.name in rest]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for part in K.slices(batch):
                grams, starts, ends, bounds = trigrams(part)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                languages, shares, main, accepted = ([None] * len(n) for _ in range(4))
                for k in range(len(n)):
                    languages[k], shares[k], accepted[k] = [], [], False
                if len(some):
                    like = np.empty((len(starts), len(names)))
                    for c in range(len(langs)):
                        value = logs[c][grams]
                        value[grams == 0] = 0  # between words
                        like[:, c] = np.add.reduceat(value, starts)
                    like[:, -1] = (ends - starts + 1) * -np.log(_V)
                    like = np.exp(like - like.max(axis=1, keepdims=True))
                    _, weight = choose(like, bounds[:-1][some], penalty)
                    order = np.argsort(-weight, axis=1, kind="stable")
                    for d, k in enumerate(some):
                        own = [c for c in order[d] if weight[d, c] > 0]
                        languages[k] = [names[c] for c in own]
                        shares[k] = [round(float(weight[d, c]), 4) for c in own]
                        main[k] = names[own[0]]
                        accepted[k] = bool(weight[d, -1] < 0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(main, pa.string()), pa.array(n.astype(np.int64)), pa.array(accepted, pa.bool_()), *(part.column(part.schema.get_field_index(c)) for c in kept)],
                    ["doc_id", "languages", "proportions", "main_language", "n_words", "accepted", *kept],
                )

    schema = "doc_id bigint, languages array<string>, proportions array<double>, main_language string, n_words bigint, accepted boolean"
    return rows.mapInArrow(label, schema + "".join(f", {c} {rest[c][1]}" for c in kept))
