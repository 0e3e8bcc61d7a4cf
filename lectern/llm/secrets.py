"""Secret scans by the cost of guessing.

Values in a credential context (a word such as password, token or api_key, then
= or :, then the value) are cut into segments so that guessing them costs the
least, in bits, by dynamic programming.  A segment costs ``SEGMENT_BITS``, to say
of which kind it is, and

- a word: log2(all words of the corpus / its count there), if it occurs there
  ``WORD_LEAST`` times at least, one bit for each letter written as a digit or
  sign, and bits for its capitals (one if it begins with its only capital or has
  nothing else, else one for each letter);
- a date: day, month and year (with 2 bits for separators), or a year alone;
- a repeat: the cost of a unit that is no repeat itself and log2 of how often it
  stands here (as often as it goes from where it begins);
- a keyboard walk: neighbouring keys, or following letters or digits, to where the
  walk ends: log2(47) to begin, and ``TURN_BITS`` for each straight piece and log2 of
  the length;
- a brute-force span: log2 of the size of each character's class.

A value of at least ``min_bits`` is a secret; weaker ones (placeholders, words) are
reported as such.  Word counts are taken over the whole corpus, but only those of
words that stand in some value are gathered.  Words have any length: up to
``LONGEST`` letters all stretches are looked up, above it those that are as long as
some word of the corpus that occurs often enough.

A quoted value goes to its closing quote, another one to white space or a sign that
ends it, however long.

Defined results: null ids and null texts take no part; texts without a context
give no rows; rows that repeat an id and a text give their values once; values
are reported by place, size and SHA-256, never in clear; of segmentations of
equal cost the bits are the same and the one found first is named; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns, finished, sized_join, written
from .rarity import BITS, sketch

MIN_BITS = 40.0
WORD_LEAST = 5
SHORTEST, LONGEST = 3, 24  # letters of a word that is looked up in any case
SEGMENT_BITS = math.log2(5)
TURN_BITS = math.log2(6)
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"}
#: Understood alike by Java's and Python's regular expressions; linear, as what it has passed isn't tried again.
CONTEXT = r"""(?i)(?<![a-z0-9_-])(?>[a-z0-9_-]*?(pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|credentials?|auth))[a-z0-9_-]*+["']?[ \t]*+(?::=|=>|==?|:)[ \t]*+(?:bearer[ \t]++)?(?:"([^"\n]{6,}+)"|'([^'\n]{6,}+)'|["']?([^\s"'`,;<>]{6,}+))"""
_CONTEXT = re.compile(CONTEXT, re.ASCII)
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_KEYS = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_SIGNS = "[-/._]"
_Y, _M, _D = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DATES = [re.compile(f"{a}({_SIGNS}?){b}\\1{c}") for a, b, c in ((_Y, _M, _D), (_D, _M, _Y), (_M, _D, _Y))]
_YEAR = re.compile(_Y)
_CLASS = {**dict.fromkeys("0123456789", math.log2(10)), **dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", math.log2(26)), **{chr(c): math.log2(33) for c in range(32, 127) if not chr(c).isalnum()}}

Spans = dict[int, list[tuple[int, float, str]]]  # start: (end, bits, kind)


def contexts(text: str) -> list[tuple[int, str, str]]:
    """(first character of the value, credential word, value) of each context."""
    out = []
    for m in _CONTEXT.finditer(text):
        k = next(k for k in (2, 3, 4) if m[k] is not None)
        out.append((m.start(k), m[1].lower(), m[k]))
    return out


def folded(value: str) -> str:
    """Lower-cased, with letters for the digits and signs that stand for them."""
    low = (c.lower() if len(c.lower()) == 1 else c for c in value)
    return "".join(LEET.get(c, c) for c in low)


def letter_spans(value: str, lengths: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Stretches that may be a word: letters, or signs for some, with one real letter at least; lengths: those above LONGEST."""
    plain = folded(value)
    real = np.append(0, np.cumsum([c.isalpha() for c in value]))
    out = []
    for run in re.finditer(r"[^\W\d_]+", plain):
        for a in range(run.start(), run.end() - SHORTEST + 1):
            ends = [*range(a + SHORTEST, min(run.end(), a + LONGEST) + 1), *(a + n for n in lengths if a + n <= run.end())]
            out += [(a, b) for b in ends if real[b] > real[a]]
    return out


def letter_run(value: str) -> int:
    """Letters of the longest stretch that may be a word."""
    return max((m.end() - m.start() for m in re.finditer(r"[^\W\d_]+", folded(value))), default=0)


def word_bits(written_as: str, count: int, total: int) -> float:
    """Bits of a word of the corpus, as it is written."""
    letters = [c for c in written_as if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    case = 0 if not upper else 1 if upper == len(letters) or (upper == 1 and written_as[0].isupper()) else len(letters)
    signs = sum(c != d for c, d in zip(written_as.lower(), folded(written_as), strict=False))
    return math.log2(max(total, 1) / count) + case + signs


def _step(a: str, b: str) -> tuple[int, int, int] | None:
    """Direction from one key to a neighbour, or along the alphabet or digits."""
    a, b = _SHIFT.get(a, a.lower()), _SHIFT.get(b, b.lower())
    if a.isascii() and b.isascii() and ((a.isalpha() and b.isalpha()) or (a.isdigit() and b.isdigit())) and abs(ord(a) - ord(b)) == 1:
        return (2, 0, ord(b) - ord(a))
    if a in _KEYS and b in _KEYS:
        dy, dx = _KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] - _KEYS[a][1]
        if (dy == 0 and abs(dx) == 1) or (dy == 1 and dx in (-1, 0)) or (dy == -1 and dx in (0, 1)):
            return (1, dy, dx)
    return None


def walks(value: str) -> Spans:
    """From each place to the end of its walk, three keys at least."""
    steps = [_step(a, b) for a, b in zip(value, value[1:], strict=False)]
    out: Spans = {}
    end, turns = len(value) - 1, 0
    for i in range(len(value) - 2, -1, -1):
        if steps[i] is None:
            end, turns = i, 0
            continue
        turns = turns + 1 if i + 1 >= end or steps[i + 1] != steps[i] else turns
        size = end - i + 1
        if size >= 3:
            out[i] = [(end + 1, math.log2(47) + turns * TURN_BITS + math.log2(size), "walk")]
    return out


def dates(value: str) -> Spans:
    out: Spans = {}
    for m in re.finditer(r"(?=[0-9])", value):
        i, found = m.start(), {}
        for pattern in _DATES:
            if d := pattern.match(value, i):
                bits = math.log2(365.25 * 200) + (2 if d[1] else 0)
                found[d.end()] = min(bits, found.get(d.end(), math.inf))
        if y := _YEAR.match(value, i):
            found[y.end()] = math.log2(200)
        if found:
            out[i] = [(end, bits, "date") for end, bits in found.items()]
    return out


def repeats(value: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size of a unit, places where such a unit begins a repeat, how often it stands there); units that are repeats are left out."""
    codes, n = np.array([ord(c) for c in value]), len(value)
    found: list[tuple[int, np.ndarray]] = []
    for unit in range(1, n // 2 + 1):
        broken = np.flatnonzero(codes[unit:] != codes[:-unit])
        edges = np.concatenate([[-1], broken, [n - unit]])
        if np.diff(edges).max() - 1 < unit:
            continue
        at = np.arange(n - unit)
        run = edges[1:][np.searchsorted(broken, at)] - at
        at = at[run >= unit]
        for smaller, own in found:
            if unit % smaller == 0:
                at = at[own[at] < unit - smaller]
        if len(at):
            found.append((unit, run))
            yield unit, at, run[at] // unit + 1


def guess_bits(value: str, words: dict[tuple[int, int], float]) -> tuple[float, list[tuple[str, int, int]]]:
    """Least cost of the value, and its segments (kind, start, end); words: bits of the spans that are words."""
    return _cheapest(value, words, 0, {})


def _cheapest(value: str, words: dict[tuple[int, int], float], base: int, known: dict) -> tuple[float, list[tuple[str, int, int]]]:
    n = len(value)
    spans: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for kind in (walks(value), dates(value)):
        for i, found in kind.items():
            spans[i] += found
    for (a, b), bits in words.items():
        if base <= a and b <= base + n:
            spans[a - base].append((b - base, bits, "word"))
    for unit, places, times in repeats(value):
        for i, many in zip(places.tolist(), times.tolist(), strict=True):
            piece = value[i : i + unit]
            # words within a unit are those of its place; equal units have equal ones
            if piece not in known:
                known[piece] = _cheapest(piece, {k: v for k, v in words.items() if base + i <= k[0] and k[1] <= base + i + unit} if words else {}, base + i, known)[0]
            spans[i].append((i + unit * many, known[piece] + math.log2(many), "repeat"))
    best = [math.inf] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    best[0] = 0.0
    brute, since = math.inf, 0  # cost of the best open brute-force span, and where it began
    for i in range(n):
        if best[i] + SEGMENT_BITS < brute:
            brute, since = best[i] + SEGMENT_BITS, i
        for end, bits, kind in spans[i]:
            cost = best[i] + SEGMENT_BITS + bits
            if cost < best[end]:
                best[end], back[end] = cost, (i, kind)
        brute += _CLASS.get(value[i], 11.0)
        if brute < best[i + 1]:
            best[i + 1], back[i + 1] = brute, (since, "brute")
    out, at = [], n
    while at > 0:
        start, kind = back[at]
        out.append((kind, start, at))
        at = start
    return best[n], out[::-1]


def guess_costs(docs: DataFrame, min_bits: float = MIN_BITS, word_least: int = WORD_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, context, length, sha256, bits, segments, secret) of every credential value.

    ``start`` counts characters from 0; ``segments`` names kinds and sizes in order.
    """
    spark = docs.sparkSession
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in contexts(t)]
            if rows:
                d, s, c, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(c), pa.array(v)], ["doc_id", "start", "context", "value"])

    hits = texts.where(F.col("text").rlike(CONTEXT)).mapInArrow(find, "doc_id bigint, start int, context string, value string").distinct()
    hits = written(hits.withColumn("digest", F.sha2("value", 256)))
    values = hits.select("digest", "value").distinct()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max(map(letter_run, batch.column(1).to_pylist()), default=0)], pa.int32())], ["n"])

    most = values.mapInArrow(runs, "n int").agg(F.max("n")).collect()[0][0] or 0
    lengths: tuple[int, ...] = ()
    if most > LONGEST:
        ready = texts.select(K.ready_text(F.col("text")).alias("text"))
        longer = ready.mapInArrow(lambda batches: _long_words(batches, most), "word bigint, size int").groupBy("word", "size").agg(F.count("*").alias("n"))
        lengths = tuple(r[0] for r in longer.where(F.col("n") >= word_least).select("size").distinct().orderBy("size").collect())  # as many as there are lengths

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = letter_spans(value, lengths)
                plain = folded(value)
                for k in range(0, len(spans), 1 << 14):
                    some = spans[k : k + (1 << 14)]
                    hashes = K.words(pa.array([plain[a:b] + "\n" for a, b in some]))[0]
                    a, b = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(some)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(hashes.view(np.int64))], ["digest", "a", "b", "word"])

    spans = written(values.mapInArrow(stretches, "digest string, a int, b int, word bigint"))
    wanted = spark.sparkContext.broadcast(sketch(spans.select("word"), lambda batch: [batch.column(0).to_numpy().view(np.uint64)]) > 0)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for part in K.slices(batch):
                hashes = K.words(part.column(part.schema.get_field_index("text")))[0]
                total += len(hashes)
                words, n = np.unique(hashes[wanted.value[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["word", "n"])  # the null word is all words

    counts = texts.select(K.ready_text(F.col("text")).alias("text")).mapInArrow(count, "word bigint, n bigint")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= word_least)))
    total = (counts.where("word is null").agg(F.sum("n")).collect()[0][0]) or 1
    some = counts.where("word is not null").join(spans.select("word").distinct(), "word", "left_semi")
    known = sized_join(spans, some, "word", "inner").groupBy("digest").agg(F.collect_list(F.struct("a", "b", "n")).alias("words"))  # of one value
    known = values.join(known, "digest", "left")

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, value, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = {(w["a"], w["b"]): word_bits(value[w["a"] : w["b"]], w["n"], total) for w in sorted(words or [], key=lambda w: (w["a"], w["b"]))}
                bits, parts = guess_bits(value, own)
                rows.append((digest, round(bits, 4), " ".join(f"{kind}:{b - a}" for kind, a, b in parts)))
            if rows:
                v, b, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(b), pa.array(p)], ["digest", "bits", "segments"])

    priced = known.select("digest", "value", "words").mapInArrow(cost, "digest string, bits double, segments string")
    out = hits.join(priced, "digest")
    out = out.select("doc_id", "start", "context", F.length("value").alias("length"), F.col("digest").alias("sha256"), "bits", "segments", (F.col("bits") >= min_bits).alias("secret"))
    return finished(out, hits, spans, counts)


def _long_words(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(hash, characters) of the words of more than LONGEST characters, and no more than the longest stretch of a value has."""
    for batch in batches:
        for part in K.slices(batch):
            text = part.column(0)
            raw, _ = K._bytes_of(text)
            hashes, starts, ends, _ = K.words(text)
            at = np.flatnonzero(ends - starts > LONGEST)
            begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # characters before each byte
            size = begins[ends[at]] - begins[starts[at]]
            some = (size > LONGEST) & (size <= most)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at[some]].view(np.int64)), pa.array(size[some].astype(np.int32))], ["word", "size"])
