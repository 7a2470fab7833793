"""Approximate nearest neighbours by collision counting on single projections.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows.  In a shard, each of
``PROJECTIONS`` random lines (orthogonal by sets of as many as there are
dimensions) has an array of the vectors sorted by their projection.  A query
stands at a place of its own in each array.  Windows around that place, of half
width ``WIDTH`` standard deviations of the projected difference to a vector at
the radius, are read; a vector that lies in the windows of at least
``THRESHOLD`` of the lines collides, and colliding vectors are verified by their
exact distance.  Virtual rehashing widens the same windows by growing the
radius, without new arrays, until the ``k``-th verified distance lies within the
radius (then nothing nearer is likely to be missing) or all vectors collide.
The best of all shards are the result.  Every vector is indexed; there is no cap
on windows or candidates, and shards of any size are searched alike.

A shard's index is built once, and each query is sent to a shard once: rows of a
shard come to one task sorted, vectors before queries, and queries are answered
as they stream by, so a task holds one shard and one batch of queries.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; only vectors of the query's length are candidates;
fewer candidates than ``k`` are all returned; ties go to the smaller id; an id
that is a query in several rows is asked once, with the least of its vectors;
repeated rows are candidates each, but for the query's own id; no vectors give
no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

PROJECTIONS = 128
#: Half width of a window at radius 1, in deviations of the projection of a difference of that length.
WIDTH = 1.5
#: Lines that must agree.  A vector at the radius lies in 0.866 of the windows, one a quarter farther off in 0.77.
THRESHOLD = 107
GROWTH = 1.06
#: Radii whose window bounds are looked up at once.
RADII = 8
#: The first windows hold about this share of the vectors; nearly none of them is in enough windows yet.
FIRST_SHARE = 0.3
SHARD_ROWS = 8192
#: Queries whose windows are looked up together.
QUERY_BLOCK = 64


def random_lines(dim: int, seed: int = 11) -> np.ndarray:
    """``dim x PROJECTIONS``: unit columns, orthogonal within each set of ``dim``."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))] if dim <= PROJECTIONS else [rng.normal(size=(dim, PROJECTIONS))]
    lines = np.concatenate(sets, 1)[:, :PROJECTIONS]
    return lines / np.sqrt((lines**2).sum(0))


class CollisionIndex:
    """Sorted projections of the rows of one shard."""

    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        self.vectors, self.lines = vectors, lines
        self.scale = WIDTH / np.sqrt(vectors.shape[1])
        places = np.ascontiguousarray((vectors @ lines).T)
        self.order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, self.order, 1)

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))

    def search(self, queries: np.ndarray, k: int, skip: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and distances of its verified vectors; rows to ``skip`` are at no distance (infinite)."""
        n, at = len(self.vectors), queries @ self.lines
        start = np.stack([np.searchsorted(c, a) for c, a in zip(self.places, at.T, strict=True)], 1)
        reach, lines = int(FIRST_SHARE / 2 * n) + 1, np.arange(at.shape[1])
        ends = [self.places[lines, np.clip(start + step, 0, n - 1)] for step in (-reach, reach)]
        radius = np.maximum(np.median(np.maximum(*[np.abs(e - at) for e in ends]), axis=1) / self.scale, 1e-12)
        states = [_Search(n, s, own) for s, own in zip(start.tolist(), skip, strict=True)]
        open_ = np.arange(len(queries))
        while len(open_):
            radii = radius[open_, None] * GROWTH ** np.arange(RADII)
            widths = radii * self.scale
            los = np.stack([np.searchsorted(c, a[:, None] - widths, "left") for c, a in zip(self.places, at[open_].T, strict=True)], 2).tolist()
            his = np.stack([np.searchsorted(c, a[:, None] + widths, "right") for c, a in zip(self.places, at[open_].T, strict=True)], 2).tolist()
            done = [self._widen(states[q], queries[q], k, *bounds) for q, *bounds in zip(open_.tolist(), radii.tolist(), los, his, strict=True)]
            radius[open_] = radii[:, -1] * GROWTH
            open_ = open_[~np.array(done)]
        return [(s.rows, s.dists) for s in states]

    def _widen(self, s: _Search, query: np.ndarray, k: int, radii: list, los: list, his: list) -> bool:
        """Reads what one query's windows gain at each radius; whether it is answered."""
        for reach, lo, hi in zip(radii, los, his, strict=True):
            lo, hi = list(map(min, lo, s.left)), list(map(max, hi, s.right))
            fresh = [o[a:b] for o, a, b in zip(self.order, lo, s.left, strict=True) if a < b] + [o[a:b] for o, a, b in zip(self.order, s.right, hi, strict=True) if a < b]
            s.left, s.right = lo, hi
            if fresh:
                before = s.count >= THRESHOLD
                s.count += np.bincount(np.concatenate(fresh), minlength=len(s.count))
                found = np.flatnonzero((s.count >= THRESHOLD) & ~before)
                s.rows = np.concatenate([s.rows, found])
                s.dists = np.concatenate([s.dists, np.where(s.own[found], np.inf, self.distances(query, found))])
            if len(s.rows) == len(s.count) or len(s.rows) >= k and np.partition(s.dists, k - 1)[k - 1] <= reach:
                return True
        return False


class _Search:
    """How far one query has come: window ends on each line, collisions of each vector, and what is verified."""

    def __init__(self, n: int, start: list[int], skip: np.ndarray):
        self.left, self.right = start, list(start)
        self.count = np.zeros(n, np.int64)
        self.own = np.zeros(n, bool)
        self.own[skip] = True
        self.rows, self.dists = np.zeros(0, np.int64), np.zeros(0)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score`` for the rows whose id is divisible by ``every``."""
    bounded_batches(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    shards = max(1, -(-usable.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "id", "v"), F.lit(shards))
    data = usable.select(F.size("v").alias("dim"), shard.alias("shard"), F.lit(0).alias("part"), "id", "v")
    asked = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.select(F.size("v").alias("dim"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(1).alias("part"), "id", "v")

    def search(batches):
        import pyarrow as pa

        key, index, ids, held, lines, out = None, None, None, [], {}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, shard, part, id_of = (batch.column(i).to_numpy() for i in range(4))
            flat, ends = batch.column(4).flatten().to_numpy(), np.r_[0, np.cumsum(dim)]
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(dim)], strict=True):
                matrix = flat[ends[lo] : ends[hi]].reshape(hi - lo, int(dim[lo]))
                if key != (dim[lo], shard[lo]):
                    key, index, held = (dim[lo], shard[lo]), None, []
                if part[lo] == 0:
                    held.append((id_of[lo:hi], matrix))
                    continue
                if not held:
                    continue
                if index is None:
                    ids = np.concatenate([h[0] for h in held])
                    if key[0] not in lines:
                        lines = {key[0]: random_lines(int(key[0]))}
                    index = CollisionIndex(np.concatenate([h[1] for h in held]), lines[key[0]])
                for first in range(lo, hi, QUERY_BLOCK):
                    asked_ids = id_of[first : min(first + QUERY_BLOCK, hi)]
                    own = [np.arange(*np.searchsorted(ids, [q, q + 1])) for q in asked_ids.tolist()]  # rows come sorted by id
                    for query, (found, dists) in zip(asked_ids.tolist(), index.search(matrix[first - lo : first - lo + QUERY_BLOCK], k, own), strict=True):
                        other = ids[found] != query
                        found, dists = found[other], dists[other]
                        best = np.lexsort((ids[found], dists))[:k]
                        out += zip([query] * len(best), ids[found[best]].tolist(), dists[best].tolist(), strict=True)
            if out:
                q, i, s = zip(*out, strict=True)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "id", "score"])

    both = data.unionByName(queries).repartition(4 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "part", "id")
    near = both.mapInArrow(search, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
