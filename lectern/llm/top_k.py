"""Exact top-k search of vectors among all others, over a pivot-distance index.

Queries are the vectors whose id is divisible by ``every`` (1: all of them); every
vector is in the index.

Vectors are keyed by their nearest pivot and their distance to it; the vectors of
a pivot in order of distance are cut into annuli of at most ``annulus`` vectors.
By the triangle inequality a vector x of the annulus [lo, hi] of pivot p is at
least max(d(q, p) - hi, lo - d(q, p)) away from a query q.

Queries are handled in groups of neighbouring annuli.  Each group has all annuli
in order of their lower bound, and expands over them in rounds of at most
``width``; a round is one join that carries the annuli wanted to the groups that
want them.  An annulus is wanted if its bound for some query doesn't exceed the
distance of the k-th neighbour found so far; a group is through when no annulus
is.  Within an annulus, distances by matrix products only choose candidates
(with some slack); those are measured again from the differences.

The pivots are the means of a k-means of a sample of ``PIVOT_SAMPLE`` vectors for
each pivot; pivots number the square root of the vectors, divided by 4, and
``PIVOTS`` at most, so that the sample is bounded.  They decide how much is skipped,
never what is found.  Annuli hold ``annulus`` vectors, or the vectors divided by
``ANNULI`` where that is more, so that their table of bounds is bounded, too.

Defined results: rows without an id, and those whose vector is null, holds a null
or no finite number, or has not the most frequent dimension (the lower of two)
take no part; rows that repeat an id are one vector, the least in order; of
equal distances the lower id comes first; a table of n vectors gives at most
n - 1 neighbours each; an empty table or one vector gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, drop_written, finished, packed, written

K = 10
ANNULUS = 512
GROUP = 16  # annuli of queries in a group
WIDTH = 64
PIVOT_SAMPLE = 32
PIVOTS = 1024
ANNULI = 1 << 16
_STATE = "grp bigint, ids binary, vecs binary, best_d binary, best_id binary, cursor int, todo array<int>"


def means(sample: np.ndarray, many: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means, begun at evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, many).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(sample, centres).argmin(axis=1)
        size = np.bincount(near, minlength=many)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows, by a matrix product."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than rounding can do to a squared distance of these rows."""
    return 1e-11 * (1e-30 + float((a * a).sum(1).max(initial=0)) + float((b * b).sum(1).max(initial=0)))


class State:
    """The queries of a group and the neighbours that each has so far, in order."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, best_d: np.ndarray, best_id: np.ndarray) -> None:
        self.ids, self.vecs, self.best_d, self.best_id = ids, vecs, best_d, best_id

    def see(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Takes in the vectors of an annulus."""
        k = self.best_d.shape[1]
        slack = _slack(self.vecs, vecs)
        for at in range(0, len(self.ids), 2048):
            part = slice(at, at + 2048)
            squares = _squares(self.vecs[part], vecs)
            squares[self.ids[part][:, None] == ids[None, :]] = np.inf
            far = self.best_d[part, -1] ** 2
            if len(ids) > k:  # the k-th of this annulus bounds from above as well
                open_rows = np.flatnonzero(np.isinf(far))
                if len(open_rows):
                    far[open_rows] = np.partition(squares[open_rows], k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(squares <= (far * (1 + 1e-11) + 2 * slack)[:, None])
            some = np.isfinite(squares[row, col])
            row, col = row[some], col[some]
            if not len(row):
                continue
            exact = np.sqrt(((self.vecs[part][row] - vecs[col]) ** 2).sum(axis=1))
            touched = np.unique(row)
            rows = np.concatenate([np.repeat(touched, k), row])
            d = np.concatenate([self.best_d[part][touched].ravel(), exact])
            i = np.concatenate([self.best_id[part][touched].ravel(), ids[col]])
            order = np.lexsort((i, d, rows))
            rows, d, i = rows[order], d[order], i[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            first = rank < k
            self.best_d[at + touched] = d[first].reshape(len(touched), k)
            self.best_id[at + touched] = i[first].reshape(len(touched), k)


def bounds(vecs: np.ndarray, kth: np.ndarray, pivots: np.ndarray, where: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least lower bound of each annulus over the queries, and whether any query still wants it."""
    least, wanted = np.full(len(where), np.inf), np.zeros(len(where), bool)
    step = max(1, 4_000_000 // max(1, len(where)))
    for at in range(0, len(vecs), step):
        part = vecs[at : at + step]
        d = np.sqrt(_squares(part, pivots))[:, where]
        slack = math.sqrt(_slack(part, pivots))  # the root of a small difference is inexact
        low = np.maximum(d - hi, lo - d) - slack
        least = np.minimum(least, low.min(axis=0, initial=np.inf))
        wanted |= (low <= kth[at : at + step, None]).any(axis=0)
    return least, wanted


def _matrix(data: bytes, width: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).copy()


def top_k(vectors: DataFrame, k: int = K, annulus: int = ANNULUS, group: int = GROUP, width: int = WIDTH, every: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance), rank from 1 to k, by Euclidean distance."""
    if min(k, annulus, group, width, every) < 1:
        raise ValueError("k, annulus, group, width and every must be 1 at least")
    spark = vectors.sparkSession
    schema = "vec_id bigint, rank int, neighbor_id bigint, distance double"
    rows = columns(vectors, vec_id=(id_col, "long"), v=(vector_col, "array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    base = rows = written(rows.groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("n"), F.col("v").alias("v"))).alias("x")).select("vec_id", "x.n", "x.v"))
    sizes = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or sizes[0]["count"] < 2:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["n"], sizes[0]["count"]
    rows = rows.where(F.col("n") == dim)
    many = min(PIVOTS, max(1, math.ceil(math.sqrt(n) / 4)))
    annulus = max(annulus, math.ceil(n / ANNULI))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many * PIVOT_SAMPLE).collect()], np.float64)
    pivots = means(sample, min(many, len(sample)))
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS at most

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            squares = _squares(vecs, shared.value)
            near = squares.argmin(axis=1)
            r = np.sqrt(((vecs - shared.value[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(r), packed(vecs.ravel(), np.arange(len(vecs) + 1) * dim)], ["vec_id", "pivot", "r", "vec"])

    keyed = rows.select("vec_id", "v").mapInArrow(key, "vec_id bigint, pivot int, r double, vec binary")
    place = F.row_number().over(Window.partitionBy("pivot").orderBy("r", "vec_id")) - 1
    keyed = keyed.withColumn("part", F.floor(place / F.lit(annulus)).cast("int"))

    def ring(key: tuple, table: pa.Table) -> pa.Table:
        ids, r = table["vec_id"].to_numpy(), table["r"].to_numpy()
        return pa.table({"pivot": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "lo": [float(r.min())], "hi": [float(r.max())], "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vecs": pa.array([b"".join(table["vec"].to_pylist())], pa.binary())})

    rings = written(keyed.groupBy("pivot", "part").applyInArrow(ring, "pivot int, part int, lo double, hi double, ids binary, vecs binary"))
    # one row for each annulus: ANNULI and PIVOTS at most
    index = sorted((r["pivot"], r["part"], r["lo"], r["hi"]) for r in rings.select("pivot", "part", "lo", "hi").collect())
    number = spark.createDataFrame([(p, q, i) for i, (p, q, _, _) in enumerate(index)], "pivot int, part int, ring int")
    where, _, lo, hi = (np.array(c) for c in zip(*index, strict=True))
    plan = spark.sparkContext.broadcast((pivots, where, lo, hi))
    rings = finished(rings.join(number, ["pivot", "part"]).select("ring", "ids", "vecs"), rings)

    def todo(state: State, cursor: int) -> tuple[int, list[int]]:
        least, wanted = bounds(state.vecs, state.best_d[:, -1], *plan.value)
        order = np.lexsort((np.arange(len(least)), least))
        rest = cursor + np.flatnonzero(wanted[order[cursor:]])[:width]
        return (int(rest[-1]) + 1, order[rest].tolist()) if len(rest) else (cursor, [])

    def packed_state(grp: int, state: State, cursor: int) -> pa.Table:
        cursor, wants = todo(state, cursor)
        return pa.table({"grp": pa.array([grp], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", state.ids), ("vecs", state.vecs), ("best_d", state.best_d), ("best_id", state.best_id))}, "cursor": pa.array([cursor], pa.int32()), "todo": pa.array([wants], pa.list_(pa.int32()))})

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ring")
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        vecs = _matrix(b"".join(table["vecs"].to_pylist()), dim)
        ids, vecs = ids[ids % every == 0], vecs[ids % every == 0]
        return packed_state(key[0].as_py(), State(ids, vecs, np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)), 0)

    def expand(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        state = State(np.frombuffer(row["ids"], np.int64), _matrix(row["vecs"], dim), _matrix(row["best_d"], k), _matrix(row["best_id"], k, np.int64))
        seen = {r: i for i, r in enumerate(right["ring"].to_pylist())}
        for ring_no in row["todo"]:  # in order of the lower bound
            i = seen[ring_no]
            state.see(np.frombuffer(right["ids"][i].as_py(), np.int64), _matrix(right["vecs"][i].as_py(), dim))
        return packed_state(row["grp"], state, row["cursor"])

    drop_written(base)
    state = written(rings.withColumn("grp", F.floor(F.col("ring") / F.lit(group))).groupBy("grp").applyInArrow(begin, _STATE))
    states, done = [], []
    while True:
        states.append(state)
        done.append(state.where(F.size("todo") == 0).select("ids", "best_d", "best_id"))
        left = state.where(F.size("todo") > 0)
        if not left.limit(1).count():
            break
        again = spark.read.schema(state.schema).parquet(state.lectern_path)  # another reading, for a join with itself
        wants = again.select("grp", F.explode("todo").alias("ring")).join(rings, "ring")
        state = written(left.groupBy("grp").cogroup(wants.groupBy("grp")).applyInArrow(expand, _STATE))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, d, i = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["best_d"]), np.frombuffer(row["best_id"], np.int64)
                some = np.isfinite(d)
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[some]), pa.array(rank[some]), pa.array(i[some]), pa.array(d[some])], ["vec_id", "rank", "neighbor_id", "distance"])

    every = done[0]
    for part in done[1:]:
        every = every.union(part)
    found = every.mapInArrow(named, schema)
    return finished(found.withColumn("distance", F.round("distance", 6)), rings, *states)
