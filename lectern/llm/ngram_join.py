"""Near duplicates: an exact Jaccard join over word n-grams by size-banded tiles and parity bitmaps.

A document is the set of its word n-grams, as 64-bit hashes.  Equal sets are
found by a 128-bit hash of the set, and from there on one document, that of the
lowest id, stands for all of them.  Other pairs are found by prefix filtering:
the n-grams of a set are ordered by rarity (coarse corpus-wide counts in a sketch
that grows with the table, then hash), the same order everywhere, and two sets that reach the threshold must
share k of the first n - ceil(threshold * n) + k of the larger set and of the
first n - ceil(2 * threshold / (1 + threshold) * n) + k of the smaller.  All of
these are posted, with k about an eighth of n; a posting that nobody shares
falls away where it is sorted.

The postings of an n-gram are a tile, sorted by the sets' sizes, in which a set
meets only those of its size band.  An n-gram that more than ``heavy`` different
sets post (by exact counts) is split: its sets go to blocks by their hash, and
each two blocks are a tile of their own, so that no task gets all of a popular
n-gram's pairs.  Tiles then go to the task of their first set: near copies have the
same one in most of their tiles, so that a pair is counted in few tasks.

A crowd is a large group of near copies: sets of which a good part of the n-grams
(one in 8 is looked at) are posted by ``crowd`` sets or more, mostly with the same
first set.  All pairs of a crowd are compared by matrix products over its n-grams, in
tasks of two blocks, which return each set's number of links and what joins it, not its
pairs; postings that only one crowd shares fall away, and others are paired only across
crowds.  Which crowd a set is in decides where its pairs are compared, never whether.

Pairs that share as many as the smaller set's k and whose sizes may reach the
threshold are compared by parity bitmaps: the bits in which two bitmaps differ
number at most the n-grams in which the sets differ, which bounds the overlap
from above.  Pairs within the bound are verified by exact intersection of sorted
arrays.

No pair is lost but by a collision of 64-bit hashes.  A group of m different near
copies has its m * (m - 1) / 2 links verified: their number is part of the result.  What
is written and exchanged for a crowd grows with m * ceil(m / DENSE), and its time as
m * m by products of matrices.

Defined results: documents without an id, with null text or without words link
with nothing; rows that repeat an id never link with themselves; a text of
fewer than n words is one n-gram; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .common import columns, drop_written, finished, packed, sized_join, written
from .rarity import bits_for, sketch

NGRAM = 3
THRESHOLD = 0.45
BLOCK = 256
#: An n-gram that more different sets post is split into tiles of blocks of half as many.
HEAVY = 2048
#: Sets whose n-grams as many sets post are compared in blocks of DENSE sets.
CROWD = 64
DENSE = 1024
#: Bytes of text for each n-gram, about, by which the sketch is sized.
GRAM_BYTES = 6
_U = np.uint64
_NEAR = pa.schema([("xh1", pa.int64()), ("xh2", pa.int64()), ("yh1", pa.int64()), ("yh2", pa.int64()), ("jaccard", pa.float64())])
#: A posting is an n-gram's hash above the set's size and, lowest, whether only a smaller set may meet it there.
_SIZE_BITS = 24
_FOUND = 1 << 20
_DENSE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def gram_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different n-gram hashes of each text of a slice, and their bounds."""
    hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
    grams, to = K.grams(hashes, bounds, n)
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return grams[new], np.searchsorted(row[new], np.arange(len(to)))


def bitmap(elems: np.ndarray) -> bytes:
    """Parity bitmap of twice as many bits as elements, 256 to 65536, by powers of 2."""
    width = 1 << min(16, max(8, (2 * len(elems) - 1).bit_length()))
    hits = np.bincount((elems & _U(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) folded to fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def possible(nx: np.ndarray, x: list[bytes], ny: np.ndarray, y: list[bytes], t: float) -> np.ndarray:
    """True for each pair of sets that sizes and bitmaps leave possible."""
    out = np.zeros(len(nx), bool)
    wx, wy = (np.array([len(b) for b in bits], np.int64) // 8 for bits in (x, y))
    for u, v in set(zip(wx.tolist(), wy.tolist(), strict=True)):
        at = np.flatnonzero((wx == u) & (wy == v))
        for k in range(0, len(at), 4096):
            i = at[k : k + 4096]
            a, b = (np.frombuffer(b"".join(bits[r] for r in i), _U).reshape(len(i), w) for bits, w in ((x, u), (y, v)))
            differ = np.bitwise_count(folded(a, min(u, v)) ^ folded(b, min(u, v))).sum(axis=1, dtype=np.int64)
            total = nx[i] + ny[i]
            out[i] = (total - differ) // 2 >= np.ceil(t / (1 + t) * total - 1e-9)
    return out


def shared_at_least(size: np.ndarray, t: float) -> np.ndarray:
    """k of the prefixes of a set of this size; never falls as sizes grow."""
    return np.minimum(1 + size // 8, np.ceil(t * size - 1e-9).astype(np.int64))


class _Found:
    """Pairs each once, with their least tile, the n-grams found and those needed."""

    def __init__(self) -> None:
        self.held = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int32, np.int32, np.int32))
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, x: np.ndarray, y: np.ndarray, tile: np.ndarray, need: np.ndarray) -> None:
        self.parts.append((x, y, tile, np.ones(len(x), np.int32), need))
        self.many += len(x)
        if self.many >= _FOUND:
            self.merge()

    def merge(self) -> None:
        x, y, tile, hits, need = (np.concatenate(c) for c in zip(self.held, *self.parts, strict=True))
        order = np.lexsort((tile, y, x))
        x, y, tile, hits, need = x[order], y[order], tile[order], hits[order], need[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
        self.held = x[new], y[new], tile[new], np.add.reduceat(hits, new).astype(np.int32) if len(x) else hits, need[new]
        self.parts, self.many = [], 0

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c) for c in self.held], ["x", "y", "tile", "hits", "need"])
        self.held = tuple(c[:0] for c in self.held)
        return out


def _candidates(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a posted n-gram, from postings in order of n-gram and size.

    Rows of the batches before are kept only as long as their n-gram goes on and
    they aren't too small for the sets to come.  The third column has a tile's side in its
    lowest 2 bits, and above these the crowd; sets of one crowd don't meet here.
    """
    key, ids, side = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    passed, found = 0, _Found()  # passed: rows of the first n-gram that aren't kept any more
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(key)
        key = np.concatenate([key, batch.column(0).to_numpy()])
        ids = np.concatenate([ids, batch.column(1).to_numpy()])
        side = np.concatenate([side, batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows, np.int32)])
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (side[1:] != side[:-1]))  # equal sets come together
        old, key, ids, side = int(new[:old].sum()), key[new], ids[new], side[new]
        elem, size, late = key >> _SIZE_BITS, (key & ((1 << _SIZE_BITS) - 1)) >> 1, (key & 1).astype(bool)
        begin = np.flatnonzero(np.append(True, elem[1:] != elem[:-1]))
        group = np.searchsorted(begin, np.arange(len(elem)), side="right") - 1
        rank = np.arange(len(elem)) - begin[group] + np.where(group == 0, passed, 0)
        base = int(size.max()) + 1
        order = group * base + size  # ascends over the rows
        low = np.maximum(np.searchsorted(order, group * base + np.ceil(t * size - 1e-9).astype(np.int64)), begin[group])
        least = int(low[-1])
        crowd, half = side >> 2, side & 3
        # rows of an n-gram's largest crowd look back only at its other rows
        rest = _outside(group, crowd)
        inner = np.ones(len(elem), bool)
        inner[rest] = False
        low = np.where(inner, np.searchsorted(rest, low), low)
        top = np.where(inner, np.searchsorted(rest, np.arange(len(elem))), np.arange(len(elem)))
        at = np.arange(old, len(elem))
        at = at[top[at] > low[at]]
        big = np.cumsum(top[at] - low[at])
        cuts = [0, *np.searchsorted(big, np.arange(1, int(big[-1] // 500_000) + 1) * 500_000).tolist(), len(at)] if len(at) else []
        for p, q in zip(cuts, cuts[1:], strict=False):
            if q <= p:
                continue
            i = at[p:q]
            m = top[i] - low[i]
            y = np.repeat(i, m)
            x = np.repeat(low[i] - np.cumsum(m) + m, m) + np.arange(m.sum())
            if len(rest):
                x = np.where(inner[y], rest[np.minimum(x, len(rest) - 1)], x)
            good = (ids[x] != ids[y]) & (~late[x] | ((size[x] == size[y]) & ~late[y])) & ((half[x] == 0) | (half[x] != half[y])) & ((crowd[x] == 0) | (crowd[x] != crowd[y]))
            x, y = x[good], y[good]
            if not len(x):
                continue
            tile = (K.mix(elem[x].view(_U) + (rank[x] // BLOCK * 1_000_003 + rank[y] // BLOCK).view(_U)) >> _U(33)).astype(np.int32)
            found.add(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), tile, shared_at_least(size[x], t).astype(np.int32))
            if len(found.held[0]) >= _FOUND:
                yield found.batch()
        last = max(least, int(begin[-1]))
        passed, key, ids, side = int(rank[last]), key[last:], ids[last:], side[last:]
    found.merge()
    if len(found.held[0]):
        yield found.batch()


def _outside(group: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """Rows, in order, that aren't of the largest crowd in their group; groups count up along the rows."""
    some = np.flatnonzero(crowd > 0)
    if not len(some):
        return np.arange(len(group))
    g, c = group[some], crowd[some]
    order = np.lexsort((c, g))
    g, c = g[order], c[order]
    runs = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
    many, g, c = np.diff(np.append(runs, len(g))), g[runs], c[runs]
    order = np.lexsort((many, g))
    ends = order[np.append(g[order][1:] != g[order][:-1], True)]
    largest = np.zeros(int(group[-1]) + 1, crowd.dtype)
    largest[g[ends]] = c[ends]
    return np.flatnonzero((crowd == 0) | (crowd != largest[group]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in order of n-gram and size those of n-grams that several sets post, not all of one crowd, with a home.

    The home is a hash of the n-gram's first set, of which near copies have the same for
    most of their n-grams; 16 bits tell enough of them apart.
    """
    names = ["key", "id", "side"]
    held = [np.zeros(0, np.int64) for _ in names]  # the rows of the n-gram that goes on, as long as one set or one crowd has it
    elem, home = None, 0  # that n-gram, once more post it, and its home
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, side = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (side[1:] != side[:-1]))  # equal sets come together
        key, ids, side = key[new], ids[new], side[new]
        gram = key >> _SIZE_BITS
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        many = np.diff(np.append(begin, len(gram)))
        homes = (K.mix(ids[begin].view(_U)) >> _U(48)).astype(np.int64)
        goes_on = elem is not None and gram[0] == elem
        if goes_on:
            homes[0] = home
        crowd = side >> 2
        least = np.minimum.reduceat(crowd, begin)
        keep = (many > 1) & ((least == 0) | (least != np.maximum.reduceat(crowd, begin)))
        keep[0] |= goes_on
        rows = np.repeat(keep, many)
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(homes, many)[rows].astype(np.int32)), pa.array(key[rows]), pa.array(ids[rows]), pa.array(side[rows].astype(np.int32))], ["home", "key", "id", "side"])
        elem, home = (gram[-1], int(homes[-1])) if keep[-1] else (None, 0)
        held = [c[:0] if keep[-1] else c[begin[-1] :] for c in (key, ids, side)]


def tiled(posts: DataFrame, popular: DataFrame, heavy: int) -> DataFrame:
    """The postings (key, id, side), those of popular n-grams (elem, n) once for each tile of two blocks.

    The lowest 2 bits of the side are 0 in the tile of one block with itself, else 1 or 2
    for the lower and the higher block; those above it stay.
    """
    if popular.limit(1).count() == 0:
        return posts.select("key", "id", "side")
    rows = sized_join(posts.withColumn("elem", F.shiftright("key", _SIZE_BITS)), popular, "elem", "left")
    blocks = F.coalesce(F.ceil(F.col("n") * 2 / F.lit(heavy)), F.lit(1))
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    tile = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.shiftleft(F.xxhash64("elem", pair), _SIZE_BITS).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << _SIZE_BITS) - 1))))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select(tile.alias("key"), "id", F.col("side").bitwiseOR(side.cast("int")).alias("side"))


def crowds(common: DataFrame, crowd: int) -> DataFrame:
    """(id, crowd) of the sets in large groups, from postings (elem, id, looked): the n-grams that all looked at have."""
    lists = common.where("elem & 7 = 0")
    to = written(lists.groupBy("elem").agg(F.min("id").alias("to"), F.count("*").alias("n")).where(F.col("n") >= crowd).select("elem", "to"))
    votes = sized_join(lists, to, "elem", "inner").groupBy("id", "to").agg(F.count("*").alias("votes"), F.max("looked").alias("looked")).where("votes >= 2 and votes * 5 >= looked")
    best = finished(votes.groupBy("id").agg(F.max(F.struct("votes", "to")).alias("best")).select("id", F.col("best.to").alias("to")), to)
    # a first set that is in a crowd itself is followed; it has a lower id
    own = best.select(F.col("id").alias("to"), F.col("to").alias("next"))
    out = best
    for _ in range(2):
        out = out.join(own, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return finished(out.select("id", (F.pmod(F.xxhash64("to"), F.lit((1 << 29) - 1)) + 1).cast("int").alias("crowd")), best)


def _counted(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets a with sorted sets b."""
    out = np.zeros((len(a), len(b)), np.float32)
    elems, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    parts = []
    for sets, cols in ((a, col[:cut]), (b, col[cut:])):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(cols, kind="stable")
        many = np.bincount(cols, minlength=len(elems))
        parts.append((row[order], np.append(0, np.cumsum(many)), many))
    (ra, ta, ma), (rb, tb, mb) = parts
    meet = (ma > 0) & (mb > 0)
    dense = np.flatnonzero(meet & (ma * mb > len(a) * len(b) / 1024))
    for k in range(0, len(dense), 2048):
        c = dense[k : k + 2048]
        x, y = (np.zeros((len(sets), len(c)), np.float32) for sets in (a, b))
        for to, rows, begin, many in ((x, ra, ta, ma), (y, rb, tb, mb)):
            m = many[c]
            to[rows[np.repeat(begin[c] - np.cumsum(m) + m, m) + np.arange(m.sum())], np.repeat(np.arange(len(c)), m)] = 1
        out += x @ y.T
    thin = np.flatnonzero(meet & (ma * mb <= len(a) * len(b) / 1024))
    big = np.cumsum(ma[thin] * mb[thin])
    cuts = [0, *np.unique(np.searchsorted(big, np.arange(1, int(big[-1] // 1_000_000) + 1) * 1_000_000)).tolist(), len(thin)] if len(thin) else []
    flat = out.reshape(-1)
    for p, q in zip(cuts, cuts[1:], strict=False):
        if q <= p:
            continue
        c = thin[p:q]
        m = ma[c] * mb[c]
        pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        x = ra[np.repeat(ta[c], m) + pos // np.repeat(mb[c], m)]
        y = rb[np.repeat(tb[c], m) + pos % np.repeat(mb[c], m)]
        at, n = np.unique(x * len(b) + y, return_counts=True)
        flat[at] += n.astype(np.float32)
    return out.astype(np.int64)


def _spanned(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of the connected component of each row and column of a matrix of links; -1 for columns without."""
    rows, cols = np.full(hit.shape[0], -1), np.full(hit.shape[1], -1)
    for s in range(len(rows)):
        if rows[s] >= 0:
            continue
        front = np.array([s])
        rows[s] = s
        while len(front):
            new = np.flatnonzero(hit[front].any(axis=0) & (cols < 0))
            cols[new] = s
            front = np.flatnonzero(hit[:, new].any(axis=1) & (rows < 0)) if len(new) else new
            rows[front] = s
    return rows, cols


def _block_links(table: pa.Table, t: float, each: bool) -> pa.Table:
    """The links between two blocks of a crowd, or within one: each pair, or numbers of links and what joins the sets."""
    table = table.combine_chunks()
    h1, h2, first = (table[c].to_numpy() for c in ("h1", "h2", "first"))
    own, i, j = (table[c].to_numpy() for c in ("own", "i", "j"))
    arrays = [np.frombuffer(x.as_buffer(), _U) for x in table["elems"]]
    one = bool(len(i)) and i[0] == j[0]
    p = np.flatnonzero(own == i)
    q = p if one else np.flatnonzero(own == j)
    if not len(p) or not len(q):
        return (_NEAR if each else _DENSE).empty_table()
    size = np.array([len(x) for x in arrays], np.int64)
    common = _counted([arrays[k] for k in p], [arrays[k] for k in q])
    union = size[p][:, None] + size[q] - common
    hit = (common >= np.ceil(t * union - 1e-9)) & (first[p][:, None] != first[q])
    if each:
        x, y = np.nonzero(np.triu(hit, 1) if one else hit)
        return pa.table({"xh1": h1[p[x]], "xh2": h2[p[x]], "yh1": h1[q[y]], "yh2": h2[q[y]], "jaccard": common[x, y] / union[x, y]}, schema=_NEAR)
    rows, cols = _spanned(hit | np.eye(len(p), dtype=bool) if one else hit)
    at, links, root = p, hit.sum(axis=1), first[p[rows]]
    if not one:
        at, links, root = np.append(p, q), np.append(links, hit.sum(axis=0)), np.append(root, first[p[np.maximum(cols, 0)]])
    some = links > 0
    return pa.table({"h1": h1[at[some]], "h2": h2[at[some]], "first": first[at[some]], "links": links[some], "root": root[some]}, schema=_DENSE)


def set_pairs(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, heavy: int = HEAVY, crowd: int = CROWD, block: int = DENSE, each: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets of documents, first document of each set, similar pairs of sets, links within crowds).

    The last has rows (h1, h2, first, links, root), several for a set, and together with the
    pairs all links; with ``each`` the pairs have all themselves, and it is empty.
    """
    spark, t = docs.sparkSession, float(threshold)
    texts = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).where("doc_id is not null and text is not null")
    octets = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = bits_for(octets / GRAM_BYTES)
    texts = texts.select("doc_id", K.ready_text(F.col("text")).alias("text"))

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in K.slices(batch):
            hashes, _, _, bounds = K.words(part.column(part.schema.get_field_index("text")))
            yield K.grams(hashes, bounds, n)[0]

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                elems, to = gram_sets(part, n)
                size = np.diff(to)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                sums = [np.add.reduceat(K.mix(elems + _U(k)), to[:-1][some]).view(np.int64) for k in (0, 0x9E3779B97F4A7C15)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")).take(pa.array(some)), *map(pa.array, sums)], ["doc_id", "h1", "h2"])

    def postings(batches: Iterator[pa.RecordBatch], only: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                elems, to = gram_sets(part, n)
                size = np.diff(to)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                size, starts = size[some], to[:-1][some]
                ids = np.add.reduceat(K.mix(elems), starts).view(np.int64)
                order = (level.value[(elems >> _U(64 - bits)).astype(np.int64)].astype(_U) << _U(58)) | (K.mix(elems) >> _U(6))
                order = order[np.lexsort((order, np.repeat(np.arange(len(some)), size)))]
                k = shared_at_least(size, t)
                longest = size - np.ceil(t * size - 1e-9).astype(np.int64) + k
                shorter = size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + k
                pos = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest)
                prefix = order[np.repeat(starts, longest) + pos]
                elem = prefix << _U(_SIZE_BITS)
                if only:  # the sketch bounds an n-gram's count from above
                    most, looked = _U(1) << (prefix >> _U(58)), (prefix & _U(7)) == 0
                    many = (most > _U(heavy)) | (looked & (most > _U(crowd)))
                    if many.any():
                        looked = np.add.reduceat(looked.astype(np.int32), np.cumsum(longest) - longest)
                        yield pa.RecordBatch.from_arrays([pa.array(elem[many].view(np.int64) >> _SIZE_BITS), *(pa.array(np.repeat(c, longest)[many]) for c in (ids, looked.astype(np.int32)))], ["elem", "id", "looked"])
                    continue
                of = np.repeat(np.minimum(size, (1 << (_SIZE_BITS - 1)) - 1), longest) * 2 + (pos >= np.repeat(shorter, longest))
                side = np.zeros(len(ids), np.int32)
                if (k := part.schema.get_field_index("marks")) >= 0 and len(marks := part.column(k).flatten()):
                    of_set, in_crowd = (c.to_numpy() for c in marks.flatten())
                    by = np.argsort(of_set)
                    found = by[np.minimum(np.searchsorted(of_set[by], ids), len(by) - 1)]
                    side = np.where(of_set[found] == ids, in_crowd[found] << 2, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((elem | of.astype(_U)).view(np.int64)), pa.array(np.repeat(ids, longest)), pa.array(np.repeat(side, longest))], ["key", "id", "side"])

    # rows that repeat an id are one document; large groups are counted in parts
    sets = written(texts.mapInArrow(signatures, "doc_id bigint, h1 bigint, h2 bigint").distinct())
    firsts = written(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")))
    # documents whose every set an earlier one has: their first document stands for them
    copies = sets.select("doc_id").join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_anti").distinct()
    single = sized_join(texts, written(copies), "doc_id", "left_anti")
    level = spark.sparkContext.broadcast(sketch(single.select("text"), hashed, bits))
    common = written(single.mapInArrow(lambda b: postings(b, True), "elem bigint, id bigint, looked int"))
    members = crowds(common, crowd)
    # rows that a popular n-gram's crowds don't pair among themselves
    popular = written(common.groupBy("elem").agg(F.count("*").alias("n")).where(F.col("n") > heavy))
    by_crowd = sized_join(sized_join(common, popular.select("elem"), "elem", "left_semi"), members, "id", "left").groupBy("elem", "crowd").agg(F.count("*").cast("double").alias("n"))
    paired = F.pow(F.sum("n"), 2) - F.sum(F.when(F.col("crowd").isNotNull(), F.col("n") * F.col("n")).otherwise(0))
    popular = finished(by_crowd.groupBy("elem").agg(F.ceil(F.sqrt(paired)).alias("n")).where(F.col("n") > heavy), common, popular)
    marks = sets.select("doc_id", F.col("h1").alias("id")).join(members, "id").groupBy("doc_id").agg(F.collect_set(F.struct("id", "crowd")).alias("marks"))
    # postings of an n-gram come together, by size; those that nobody shares fall away
    posts = tiled(sized_join(single, written(marks), "doc_id", "left", 64).mapInArrow(postings, "key bigint, id bigint, side int"), popular, heavy)
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # fewer tasks get more of a document's postings each, which compress better
    posts = posts.repartition(tasks, F.shiftright("key", _SIZE_BITS)).sortWithinPartitions("key", "id").mapInArrow(_shared, "home int, key bigint, id bigint, side int")
    # n-grams with one home come together: most of those of two near copies, whose pair is then sent once
    posts = posts.repartition("home").sortWithinPartitions("key", "id").select("key", "id", "side")
    found = posts.mapInArrow(lambda b: _candidates(b, t), "x bigint, y bigint, tile int, hits int, need int")
    found = written(found.groupBy("x", "y").agg(F.min("tile").alias("tile"), F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("x", "y", "tile"))
    del posts

    # the sets of the candidates are made once more, and meet in the tile of their pair
    ends = found.select("tile", F.col("x").alias("h1")).union(found.select("tile", "y"))
    crowded = firsts.join(members.select(F.col("id").alias("h1"), "crowd"), "h1").select("h1", "h2", "first", "crowd")
    ids = firsts.join(ends.select("h1").distinct(), "h1", "left_semi").select("first").union(crowded.select("first")).select(F.col("first").alias("doc_id")).distinct()

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                elems, to = gram_sets(part, n)
                some = np.diff(to) > 0
                if some.any():
                    starts = to[:-1][some]
                    sums = [np.add.reduceat(K.mix(elems + _U(k)), starts).view(np.int64) for k in (0, 0x9E3779B97F4A7C15)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, sums), packed(elems, np.append(starts, to[-1]))], ["h1", "h2", "elems"])

    body = written(sized_join(texts, written(ids), "doc_id", "left_semi").mapInArrow(bodies, "h1 bigint, h2 bigint, elems binary").dropDuplicates(["h1", "h2"]))
    buckets = max(1, math.ceil(found.count() / 1000))
    bucket = F.pmod(F.col("tile"), F.lit(buckets)).alias("bucket")
    present = ends.select(bucket, "h1").distinct().join(body, "h1")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        h1, h2 = right["h1"].to_numpy(), right["h2"].to_numpy()
        arrays = [np.frombuffer(x.as_buffer(), _U) for x in right["elems"]]
        sizes, bits = np.array([len(a) for a in arrays], np.int64), [bitmap(a) for a in arrays]
        order = np.argsort(h1)
        x, y = (order[np.searchsorted(h1[order], left[c].to_numpy())] if len(order) else np.zeros(0, np.int64) for c in ("x", "y"))
        some = np.flatnonzero(possible(sizes[x], [bits[i] for i in x], sizes[y], [bits[i] for i in y], t)) if len(x) else x
        x, y = x[some], y[some]
        common = np.array([_overlap(arrays[p], arrays[q]) for p, q in zip(x, y, strict=True)], np.int64)
        union = sizes[x] + sizes[y] - common
        hit = common >= np.ceil(t * union - 1e-9)
        x, y = x[hit], y[hit]
        return pa.table({"xh1": h1[x], "xh2": h2[x], "yh1": h1[y], "yh2": h2[y], "jaccard": (common / np.maximum(union, 1))[hit]}, schema=_NEAR)

    near = found.withColumn("bucket", bucket).groupBy("bucket").cogroup(present.groupBy("bucket")).applyInArrow(verify, "xh1 bigint, xh2 bigint, yh1 bigint, yh2 bigint, jaccard double")
    # each two blocks of a crowd meet in a task
    blocks = crowded.groupBy("crowd").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = crowded.join(blocks, "crowd").withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("h1", "h2", "first", "crowd", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(body, ["h1", "h2"])
    pair = "xh1 bigint, xh2 bigint, yh1 bigint, yh2 bigint, jaccard double"
    links = rows.groupBy("crowd", "i", "j").applyInArrow(lambda table: _block_links(table, t, each), pair if each else "h1 bigint, h2 bigint, first bigint, links bigint, root bigint")
    near = written(near.unionByName(links) if each else near)
    links = spark.createDataFrame([], "h1 bigint, h2 bigint, first bigint, links bigint, root bigint") if each else written(links)
    drop_written(found, body, members, popular)
    return sets, firsts, near, links


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _ends(firsts: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs of sets with their first documents x and y, but no document with itself."""
    side = lambda s: firsts.select(F.col("h1").alias(f"{s}h1"), F.col("h2").alias(f"{s}h2"), F.col("first").alias(s))
    return near.join(side("x"), ["xh1", "xh2"]).join(side("y"), ["yh1", "yh2"]).where("x <> y")


def _named(firsts: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs of sets as pairs of their first documents."""
    return _ends(firsts, near).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def _edges(sets: DataFrame, firsts: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """What joins first documents: links, and rows of one id with several texts."""
    several = sets.groupBy("doc_id").count().where("count > 1").select("doc_id")
    bound = sets.join(several, "doc_id", "left_semi").join(firsts, ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    return pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).union(bound).union(links.select("first", "root"))


def _copies(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """(first, doc_id) of documents whose set an earlier one has."""
    return sets.join(firsts.where("members > 1"), ["h1", "h2"]).where("doc_id <> first").select("first", "doc_id").distinct()


def linked(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, block: int = DENSE) -> DataFrame:
    """(doc_id, class_id, copies, links) of every document that resembles another, one row each.

    ``class_id`` is the lowest id of its group of near duplicates (all that links join),
    ``copies`` counts the other documents with its set, ``links`` the other sets with a
    Jaccard similarity of at least the threshold.  A document without either has no row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sets, firsts, near, links = set_pairs(docs, threshold, n, id_col, text_col, heavy, crowd, block)
    pairs = written(_ends(firsts, near))
    roots = components(_edges(sets, firsts, pairs, links))
    one = F.lit(1).cast("long").alias("links")
    ends = pairs.select(F.col("xh1").alias("h1"), F.col("xh2").alias("h2"), one).union(pairs.select("yh1", "yh2", one)).union(links.select("h1", "h2", "links"))
    own = firsts.join(ends.groupBy("h1", "h2").agg(F.sum("links").alias("links")), ["h1", "h2"], "left").where("links is not null or members > 1")
    rows = sets.join(own, ["h1", "h2"]).groupBy("doc_id").agg(F.min("first").alias("first"), F.sum(F.col("members") - 1).alias("copies"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    rows = rows.join(roots.select(F.col("node").alias("first"), "root"), "first", "left")
    out = rows.select("doc_id", F.coalesce("root", "first").alias("class_id"), "copies", "links")
    return finished(out, sets, firsts, near, pairs, links)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard), a < b, of similar documents; of equal sets each is paired with the first, which stands for all."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sets, firsts, near, _ = set_pairs(docs, threshold, n, id_col, text_col, heavy, each=True)
    same = _copies(sets, firsts).select(F.col("first").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    out = _named(firsts, near).unionByName(same).groupBy("doc_id_a", "doc_id_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))
    return finished(out, sets, firsts, near)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, from edges (u, v).

    Alternating large and small stars; each round is written, so that the plan
    stays short and lost executors cost no more than a round.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("w"), "m").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        edges = finished(small, edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def later_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept): every document of a group of near duplicates but the one of lowest id, which is kept."""
    sets, firsts, near, links = set_pairs(docs, threshold, n, id_col, text_col)
    pairs = written(_ends(firsts, near))
    roots = components(_edges(sets, firsts, pairs, links))
    members = _copies(sets, firsts).join(roots.select(F.col("node").alias("first"), "root"), "first", "left")
    members = members.select("doc_id", F.coalesce("root", "first").alias("kept"))
    out = members.union(roots).where("doc_id <> kept").groupBy("doc_id").agg(F.min("kept").alias("kept"))
    return finished(out, sets, firsts, near, pairs, links)
