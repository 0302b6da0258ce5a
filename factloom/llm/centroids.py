"""Centroid clustering: exact nearest centroids by the threshold algorithm, rounds of exact means.

Components become integers, floor(``scale`` * x). Each dimension has the centroids' values in order. From a vector's own
value each list is walked outward, the nearer neighbour first; a centroid that is met for the first time gets its exact
distance. The squared gaps of the places reached, added up over the dimensions, bound the distance of every centroid not
met yet: a vector is done when that sum strictly exceeds its best exact distance (so that none that is left can even tie)
or when all centroids are met. All vectors of a slice take a step together.

A round is one pass over the rows. What a task sends is the count and sums of each centroid, what the driver gets is
these added up: centroids x dimensions numbers, whatever the number of rows. No row is shuffled. Sums are exact: they
are sent in limbs of 48 bits where they don't fit.

Defined results: vectors of another length, null ones and those with null or non-finite components are left out; fewer
vectors than centroids give as many centroids; equal hashes of starting vectors are in the order of their components; a
null id counts as an empty one there; repeated rows count each; distances and sums beyond the range of a long are given
as its largest value, but compared exactly; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

K, ROUNDS, LENGTH, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Vectors that walk together; magnitudes whose distances fit 64 bits, for up to 512 dimensions; bits of a limb.
SLICE, NARROW, LIMB = 2048, 1 << 26, 48
MOST = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where one would be too large for exact distances in 64 bits."""
    if x.shape[1] <= 512 and (not x.size or np.abs(x).max() < NARROW / scale):
        return np.floor(x * scale).astype(np.int64)
    exact = lambda v: (lambda a, b: a * scale // b)(*v.as_integer_ratio())
    return np.array([[exact(float(v)) for v in row] for row in x], object).reshape(x.shape)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller on a tie; squared distance; exact distances computed)."""
    if q.dtype == object or centroids.dtype == object:
        q, centroids = q.astype(object), centroids.astype(object)
    (n, d), k = q.shape, len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.ascontiguousarray(np.take_along_axis(centroids, order, 0).T)
    order, dims = np.ascontiguousarray(order.T), np.arange(d)
    right = np.stack([np.searchsorted(lists[j], q[:, j]) for j in range(d)], 1)
    left = right - 1
    best, far, seen, met = np.full(n, k), np.full(n, MOST, q.dtype), np.zeros((n, k), bool), 0
    rows, first = np.arange(n), True
    while len(rows):
        x, l, r = q[rows], left[rows], right[rows]
        below, above = x - lists[dims, np.maximum(l, 0)], lists[dims, np.minimum(r, k - 1)] - x
        down = (r >= k) | ((l >= 0) & (below <= above))
        gap = np.where(down, below, above)
        found = np.zeros((len(rows), k), bool)
        found[np.arange(len(rows))[:, None], order[dims, np.where(down, l, r)]] = True
        left[rows], right[rows] = l - down, r + ~down
        i, j = np.nonzero(found & ~seen[rows])
        met += len(i)
        if len(i):
            dist = ((x[i] - centroids[j]) ** 2).sum(1)
            # By row, then distance, then number: the first of each row is its best of this step.
            o = np.lexsort((j, dist, i)) if dist.dtype != object else np.array(sorted(range(len(i)), key=lambda t: (i[t], dist[t], j[t])))
            o = o[np.concatenate([[True], i[o][1:] != i[o][:-1]])]
            at = rows[i[o]]
            better = (dist[o] < far[at]) | ((dist[o] == far[at]) & (j[o] < best[at])) | (best[at] == k)
            best[at[better]], far[at[better]] = j[o][better], dist[o][better]
        seen[rows] |= found
        over = np.asarray((gap**2).sum(1) > far[rows], bool)
        rows = rows[~(over | seen[rows].all(1))]
    return best, far, met


def _kept(docs: DataFrame, id_col: str, vector_col: str, length: int) -> DataFrame:
    """(id, v) of the vectors that count."""
    v = docs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.filter((F.size("v") == length) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _slices(batch: pa.RecordBatch, length: int, scale: int):
    """(ids, integers) of runs of a batch's rows."""
    for i in range(0, len(batch), SLICE):
        part = batch.slice(i, SLICE)
        x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
        yield part.column(0), whole(x, scale)


def _limbs(total: int):
    """(limb, signed part) with the sum of part << (48 * limb) the total; small totals are one part."""
    k = 0
    while not -(1 << 62) <= total < 1 << 62:
        yield k, total & ((1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1
    yield k, total


def _sums(rows: DataFrame, centroids: np.ndarray, length: int, scale: int) -> dict[tuple[int, int], int]:
    """By (centroid, dimension) the sum of the components of its vectors; by (centroid, -1) their count, by (centroid, -2) their distances."""

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, q in _slices(batch, length, scale):
                near, dist, _ = nearest(q, centroids)
                for j in np.unique(near):
                    own = near == j
                    # Sums of a slice fit 64 bits: its components are below 2**26 and its distances are added as Python's integers.
                    parts = [(-1, int(own.sum())), (-2, sum(map(int, dist[own]))), *enumerate(map(int, q[own].sum(0)))]
                    for dim, s in parts:
                        total[j, dim] = total.get((j, dim), 0) + s
        out = [(int(j), dim, limb, s) for (j, dim), t in total.items() for limb, s in _limbs(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c < 3 else pa.int64()) for c in range(4)], ["j", "dim", "limb", "s"])

    parts = rows.mapInArrow(run, "j int, dim int, limb int, s long").groupBy("j", "dim", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # centroids x dimensions
        out[r.j, r.dim] = out.get((r.j, r.dim), 0) + (int(r.s) << (LIMB * r.limb))
    return out


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(-NARROW < x < NARROW for row in rows for x in row)
    return np.array(rows, np.int64 if small else object)


def cluster(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row for each vector that counts: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``. ``k`` and ``length`` are the
    bound of what the driver and a task hold. ``docs`` is read ``rounds`` + 3 times, so pass a table, not a long job.
    """
    kept, kind = _kept(docs, id_col, vector_col, length), docs.schema[id_col].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(digest, "v").limit(k).select("v").collect()
    out = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())])
    if not start:
        return docs.sparkSession.createDataFrame([], out)
    centroids = _array(whole(np.array([r.v for r in start], float), scale).tolist())
    for _ in range(rounds):
        sums = _sums(kept, centroids, length, scale)
        centroids = _array([[sums[j, d] // n for d in range(length)] if (n := sums.get((j, -1))) else list(map(int, own)) for j, own in enumerate(centroids)])
    sums = _sums(kept, centroids, length, scale)
    inertia = [sums.get((j, -2), 0) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]
    clip = lambda x: min(int(x), MOST)
    every, own = clip(sum(inertia)), np.array(list(map(clip, inertia)))

    def run(batches):
        for batch in batches:
            for ids, q in _slices(batch, length, scale):
                near, dist, _ = nearest(q, centroids)
                cols = [ids, pa.array(near.astype(np.int32)), pa.array(list(map(clip, dist)), pa.int64()), pa.array(own[near]), pa.array(np.full(len(near), every)), pa.array([names[j] for j in near], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, out.names)

    return kept.mapInArrow(run, out)


def op11(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``embeddings``."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = K, rounds: int = ROUNDS) -> str:
    """SQL of the same rows, a round after the other."""
    near = "SELECT vec_id, k, dist FROM (SELECT vec_id, k, SUM((e.x - c.x) * (e.x - c.x)) AS dist FROM e JOIN c{0} c USING (d) GROUP BY 1, 2) y QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(q) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, d, x FROM (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v QUALIFY k < {k}) y JOIN e USING (vec_id))",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"c{i + 1} AS MATERIALIZED (SELECT k, d, (s - ((s % n) + n) % n) // n AS x FROM (SELECT k, d, SUM(x) AS s, COUNT(*) AS n FROM a{i} JOIN e USING (vec_id) GROUP BY 1, 2) y UNION ALL SELECT k, d, x FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))",
        ]
    steps += [f"a AS MATERIALIZED ({near.format(rounds)})", f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)"]
    body = "SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(SUM(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(SUM(dist) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a JOIN h USING (k)"
    return f"WITH {', '.join(steps)} {body}"
