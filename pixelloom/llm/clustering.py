"""Centroid clustering of integer vectors by Elkan's bounds, exact in every assignment.

A vector carries one upper bound on the distance to its own centroid and a lower bound to each of the ``k`` others.
After a round the bounds are widened by how far the centroids moved.  A centroid is left out for a vector only if its lower
bound, or half of its distance to the vector's own centroid, is strictly over the upper bound, so that it is strictly
farther; what is left is compared by integer squared distances, where the smaller number wins ties.  Bounds are
4-byte floats rounded away from the truth, so that no rounding can leave out a centroid wrongly.

The state (components, cluster, bounds) is a Parquet table a round in the shared folder; the ``k`` centroids, a parameter, travel with the
tasks, and sums come back as one row a cluster and component from partial sums.  Vectors are never shuffled or grouped, so that copies of
one vector, or one huge cluster, stay spread as they were read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_stored, stored, tidied

#: Components beyond this can't be told: squared distances of 64 of them would leave 8 bytes.
MAX_COMPONENT = 2**27
SCALE = 256
STATE = "vec_id long, v array<int>, cluster int, up float, low binary"
FINAL = "vec_id long, cluster int, d long"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer centroid."""
    diff = rows.astype(np.int64) - centre
    return np.einsum("ij,ij->i", diff, diff)


@dataclass
class Bounds:
    """Assignment of a block of vectors: cluster, its exact squared distance, and the bounds."""

    cluster: np.ndarray
    d: np.ndarray
    up: np.ndarray
    low: np.ndarray
    computed: int = 0  # distances that were calculated; for tests and tuning


def half_apart(centres: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down."""
    return _down(np.stack([np.sqrt(squared(centres, c).astype(np.float64)) for c in centres]) / 2)


def first_round(x: np.ndarray, centres: np.ndarray) -> Bounds:
    """Nearest centroids without earlier bounds; distances between centroids already leave some out."""
    n, k = len(x), len(centres)
    half = half_apart(centres)
    d = squared(x, centres[0])
    root = np.sqrt(d.astype(np.float64))
    cluster, up, low = np.zeros(n, np.int32), _up(root), np.zeros((n, k), np.float32)
    low[:, 0] = _down(root)
    computed = n
    for c in range(1, k):
        near = half[cluster, c] <= up
        # By the triangle inequality an unseen centroid is at least this far.
        low[:, c] = np.where(near, 0, _down(2.0 * half[cluster, c].astype(np.float64) - up.astype(np.float64)))
        at = np.flatnonzero(near)
        computed += len(at)
        dc = squared(x[at], centres[c])
        low[at, c] = _down(np.sqrt(dc.astype(np.float64)))
        better = dc < d[at]  # an equal one has the larger number
        won = at[better]
        cluster[won], d[won] = c, dc[better]
        up[won] = _up(np.sqrt(dc[better].astype(np.float64)))
    return Bounds(cluster, d, up, low, computed)


def next_round(x: np.ndarray, centres: np.ndarray, moved: np.ndarray, was: Bounds, exact: bool = True) -> Bounds:
    """Nearest centroids after centroid ``c`` has moved by at most ``moved[c]``, by the bounds of the round before.

    ``d`` is filled for all vectors if ``exact``, else only where a bound had to be tightened.
    """
    half = half_apart(centres)
    cluster = was.cluster.copy()
    up = _up(was.up.astype(np.float64) + moved[cluster])
    low = _down(was.low.astype(np.float64) - moved[None, :])
    n, k = low.shape
    nearest = np.where(np.eye(k, dtype=bool), np.float32(np.inf), half).min(axis=1)
    d, computed = np.full(n, -1, np.int64), 0
    open_ = up >= nearest[cluster]  # elsewhere no other centroid can be as near
    for c in range(k):
        at = np.flatnonzero((open_ | exact) & (was.cluster == c))
        if len(at):
            computed += len(at)
            d[at] = squared(x[at], centres[c])
            root = np.sqrt(d[at].astype(np.float64))
            up[at], low[at, c] = np.minimum(up[at], _up(root)), _down(root)
    for c in range(k):
        at = np.flatnonzero(open_ & (cluster != c) & (low[:, c] <= up) & (half[cluster, c] <= up))
        if not len(at):
            continue
        computed += len(at)
        dc = squared(x[at], centres[c])
        low[at, c] = _down(np.sqrt(dc.astype(np.float64)))
        better = (dc < d[at]) | ((dc == d[at]) & (c < cluster[at]))
        won = at[better]
        cluster[won], d[won] = c, dc[better]
        up[won] = _up(np.sqrt(dc[better].astype(np.float64)))
    return Bounds(cluster, d, up, low, computed)


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """vec_id, v: floor(256 x) of the vectors with exactly ``dims`` components, all finite and under ``MAX_COMPONENT``."""
    x = vectors.select(col(vectors, vec_id).cast("long").alias("vec_id"), col(vectors, vector).cast("array<double>").alias("x"))
    fits = lambda e: (e * SCALE > -MAX_COMPONENT) & (e * SCALE < MAX_COMPONENT)  # noqa: E731  false for NaN and infinities
    sized = x.where(F.size("x") == dims)
    return sized.where(F.forall("x", lambda e: F.coalesce(fits(e), F.lit(False)))).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("int")).alias("v"))


def starts(v: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least sha-256 of ``seed:vec_id``; a null id is an empty text, equal ids go by their vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = v.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    v = batch.column("v")
    width = len(v[0]) if len(v) else 0
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width), v


def _assigned(state: DataFrame, centres: np.ndarray, moved: np.ndarray | None, final: bool = False) -> DataFrame:
    """The state after one more assignment, or the exact distances of the last; ``moved`` is None in the first."""
    k = len(centres)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, v = _columns(batch)
            if moved is None:
                b = first_round(x, centres)
            else:
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float32).reshape(-1, k)
                was = Bounds(batch.column("cluster").to_numpy(), np.zeros(0, np.int64), batch.column("up").to_numpy(), low)
                b = next_round(x, centres, moved, was, final)
            if final:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(b.cluster, pa.int32()), pa.array(b.d)], names=["vec_id", "cluster", "d"])
                continue
            lows = pa.array([r.tobytes() for r in b.low], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(b.cluster, pa.int32()), pa.array(b.up), lows], names=["vec_id", "v", "cluster", "up", "low"])

    return state.mapInArrow(run, FINAL if final else STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors per cluster and exact sums per cluster and component, from one partial row a cluster and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = _columns(batch)
            own = batch.column("cluster").to_numpy()
            found = np.unique(own)
            total = np.stack([x[own == c].sum(axis=0, dtype=np.int64) for c in found])
            place = np.tile(np.arange(dims, dtype=np.int32), len(found))
            n = np.repeat(np.bincount(own, minlength=k)[found].astype(np.int64), dims)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found.astype(np.int32), dims)), pa.array(place), pa.array(total.ravel()), pa.array(n)], names=["cluster", "place", "total", "n"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, place int, total long, n long")
    # The sum of sums is a decimal: it stays exact beyond eight bytes.
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()  # at most k x dims
    n, total = np.zeros(k, object), [[0] * dims for _ in range(k)]
    for r in rows:
        n[r["cluster"]], total[r["cluster"]][r["place"]] = r["n"], int(r["total"])
    return n, total


def cluster_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid_sha256: a row per kept row of ``vectors``.

    ``rounds`` times every vector goes to its nearest centroid and every non-empty centroid becomes floor(sum / count) of its vectors; then
    vectors are assigned once more.  Distances are squared and Euclidean; ties go to the smaller number.

    Vectors that are null, have another number of components, a null, NaN or infinite component, or one of
    2^27 or more after scaling (its distances don't fit a long), aren't kept.  Repeated rows and ids are each a row of the result; a null id
    stays null.  Fewer than ``k`` kept vectors give as many centroids; none give an empty result.  Other columns,
    whatever their names, are not read.  A total beyond a long is null.
    """
    v = integer_vectors(vectors, vec_id, vector, dims)
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long, centroid_sha256 string"
    v = stored(v, "centroid-vectors")
    centres = starts(v, k, seed)
    if not len(centres):
        return spark.createDataFrame([], out)
    k = len(centres)
    state, moved = v, None
    for _ in range(rounds):
        now = stored(_assigned(state, centres, moved), "centroid-state")
        drop_stored(state)
        state = now
        n, total = _sums(state, k, dims)
        new = np.array([[t // n[c] for t in total[c]] if n[c] else centres[c] for c in range(k)], np.int64)
        step = new - centres
        moved = _up(np.sqrt(np.einsum("ij,ij->i", step, step).astype(np.float64))).astype(np.float64)
        moved[~step.any(axis=1)] = 0.0
        centres = new
    last = stored(_assigned(state, centres, moved, final=True), "centroid-final")
    drop_stored(state)
    per = last.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("decimal(20,0)")).alias("d")).collect()  # at most k rows
    whole = sum(int(r["d"]) for r in per)
    fits = lambda x: x if x < 2**63 else None
    facts = [(r["cluster"], r["n"], fits(int(r["d"])), fits(whole), hashlib.sha256(",".join(map(str, centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    about = spark.createDataFrame(facts, "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = last.join(F.broadcast(about), "cluster")  # at most k rows
    return joined.select("vec_id", "cluster", F.col("d").alias("distance"), "cluster_size", "cluster_inertia", "inertia", "centroid_sha256")
