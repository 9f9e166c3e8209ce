"""Centroid clustering of integer vectors with annulus search.

Vectors are put on an integer grid, so that distances, sums and ties are exact. A vector's distance to
its last centroid bounds the distance to its nearest one, and by the triangle inequality that one's norm
lies within this bound of the vector's own. So centroids are sorted by norm, the ends of this annulus
are found by binary search, and only centroids inside it are compared.

Vectors are packed once into blocks, dealt to buckets by block number. A round reads them in place
beside the last round's clusters, which lie in the same buckets, and gives the new clusters and one row
of sums a task; of these the driver gets one row for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Stash, binary, buckets_for

#: Vectors of a block.
BLOCK = 4096
#: Components have to stay below this, so that squared distances are exact in 64 bits.
LARGEST = 1 << 27
#: Spark's limit of buckets.
MOST_BUCKETS = 100_000


def on_grid(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``dims`` finite components, and floor(scale * x) of their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.large_list(column.type.value_type))
    column = column.cast(pa.large_list(pa.float64()))
    kept = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(kept)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # null components become NaN
    finite = np.isfinite(x).all(axis=1)
    kept[np.flatnonzero(kept)[~finite]] = False
    grid = np.floor(scale * x[finite])
    if grid.size and np.abs(grid).max() >= LARGEST:
        raise OverflowError(f"a component of {np.abs(grid).max():g} grid steps; squared distances are exact below {LARGEST}")
    return kept, grid.astype(np.int64)


def _pack(dims: int, scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            kept, grid = on_grid(batch.column(1), dims, scale)
            ids = batch.column(0).filter(pa.array(kept))
            for at in range(0, len(grid), BLOCK):
                part = grid[at : at + BLOCK]
                width = 2 if np.abs(part).max() < 1 << 15 else 4
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids[at : at + BLOCK].to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([binary(part.astype(f"<i{width}"))])], names=["block", "ids", "width", "grid"])
                number += 1

    return rows


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        squared = (centroids.astype(object) ** 2).sum(axis=1).astype(float)
        self.order = np.argsort(squared, kind="stable")
        self.norms = np.sqrt(squared[self.order])
        self.place = np.argsort(self.order)
        self.sorted = centroids[self.order]
        self.largest = int(np.abs(centroids).max(initial=0))

    def nearest(self, x: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, comparisons made) of each row; of equal distances the smaller number.

        ``last`` has the numbers of the centroids whose distance is the first bound; without it that
        is the centroid with the nearest norm.
        """
        # in doubles while every square and sum is a whole number below 2^53
        kind = float if 4 * x.shape[1] * max(self.largest, int(np.abs(x).max(initial=0))) ** 2 < 1 << 53 else np.int64
        x, c = x.astype(kind), self.sorted.astype(kind)
        norm = np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
        if last is None:
            right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(c) - 1))
            at = np.where((len(c) > 1) & (np.abs(self.norms[np.minimum(right, len(c) - 1)] - norm) < np.abs(self.norms[right - 1] - norm)), right, right - 1)
        else:
            at = self.place[last]
        apart = x - c[at]
        best, number = np.einsum("ij,ij->i", apart, apart), self.order[at]
        bound = np.sqrt(best.astype(float))
        slack = 1e-9 * (norm + bound + 1)  # rounding of the roots; it only lets more centroids in
        low = np.searchsorted(self.norms, norm - bound - slack, side="left")
        high = np.searchsorted(self.norms, norm + bound + slack, side="right")
        made = len(x)
        for j in range(int(low.min(initial=len(c))), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= j) & (j < high) & (at != j))
            if len(rows):
                apart = x[rows] - c[j]
                d = np.einsum("ij,ij->i", apart, apart)
                closer = (d < best[rows]) | ((d == best[rows]) & (self.order[j] < number[rows]))
                rows, d = rows[closer], d[closer]
                best[rows], number[rows] = d, self.order[j]
                made += len(closer)
        return number, best.astype(np.int64), made


def _round(centroids: np.ndarray, last: bool):
    """Clusters (and distances in the last round) of each block, then a row with the sums of the task.

    sums: for each cluster its components' sums and its vectors, or in the last round the distances' sum in two parts.
    """
    k, dims = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, block = Annuli(centroids), None
        sums = np.zeros((k, 2 if last else dims + 1), np.int64)
        names = ["block", "ids", "clusters", "distances", "sums"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for row in batch.to_pylist():
                block = row["block"]
                x = np.frombuffer(row["grid"], f"<i{row['width']}").reshape(-1, dims).astype(np.int64)
                was = row.get("clusters")
                number, distance, _ = annuli.nearest(x, None if was is None else np.array(was))
                if last:
                    np.add.at(sums, (number, 0), distance >> 31)
                    np.add.at(sums, (number, 1), distance & ((1 << 31) - 1))
                else:
                    order = np.argsort(number, kind="stable")
                    found, first = np.unique(number[order], return_index=True)
                    sums[found, :dims] += np.add.reduceat(x[order], first, axis=0)
                    sums[:, dims] += np.bincount(number, minlength=k)
                own = [block, row["ids"] if last else None, number, distance if last else None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(own, kinds)], names=names)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([block, None, None, None, sums.ravel()], kinds)], names=names)

    return rows


_STATE = "block long, ids array<long>, clusters array<int>, distances array<long>, sums array<long>"


def _totals(state: DataFrame, k: int) -> np.ndarray:
    """The tasks' sums added up, as exact integers: k rows."""
    places = state.where("sums is not null").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    got = {r["at"]: int(r["n"]) for r in places.collect()}
    return np.array([got[i] for i in range(len(got))], object).reshape(k, -1)


def starting_vectors(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """Grid components of the k vectors whose ``sha256(salt || vec_id)`` is least; rows without vec_id come last, equal ones by their components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where((F.size("embedding") == dims) & finite).select(
        F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("grid")
    )
    return np.array([r["grid"] for r in usable.orderBy(F.col("hash").asc_nulls_last(), "grid").limit(k).collect()], np.int64).reshape(-1, dims)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of ``vectors`` (vec_id, embedding).

    A row counts if its embedding has exactly ``dims`` components, all finite; component x becomes
    floor(scale * x). Others give no row. Centroids 0, 1, ... start as ``starting_vectors``; a round
    assigns every vector to its nearest centroid (equal distances: the smaller number) and then moves
    each centroid that has vectors to the floor of their mean. After ``rounds`` of them vectors are
    assigned once more; distances are squared, inertias are their sums over a cluster and over all.

    Repeated rows count each for itself; rows without vec_id are clustered too. An empty table, or one
    without a usable vector, gives no rows; fewer vectors than k give as many clusters. A grid
    component of 2^27 or more raises OverflowError, as its distances would not fit. To the driver go
    k x (dims + 1) numbers a round; no step depends on how many vectors a cluster has.
    """
    spark = vectors.sparkSession
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = starting_vectors(wide, k, dims, scale, salt)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stash, buckets = Stash(spark), min(MOST_BUCKETS, buckets_for(spark, 1))
    packed = wide.mapInArrow(_pack(dims, scale), "block long, ids array<long>, width int, grid binary")
    blocks = stash.put_bucketed(packed.repartition(buckets, "block"), "blocks", "block", buckets)
    state = None
    for n in range(rounds + 1):
        last = n == rounds
        beside = blocks if last else blocks.drop("ids")
        if state is not None:
            beside = beside.join(state.where("clusters is not null").select("block", "clusters").hint("shuffle_hash"), "block")
        before, state = state, stash.put_bucketed(beside.mapInArrow(_round(centroids, last), _STATE), f"round{n}", "block", buckets)
        totals = _totals(state, k)
        if before is not None:
            stash.drop(before)
        if not last:
            for c, (*sums, size) in enumerate(totals):
                if size:
                    centroids[c] = [s // size for s in sums]
    stash.drop(blocks)
    own = [(int(high) << 31) + int(low) for high, low in totals]
    about = [(c, own[c], sum(own), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    each = state.where("clusters is not null").select(F.inline(F.arrays_zip("ids", "clusters", "distances"))).toDF("vec_id", "cluster", "distance")
    return each.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same clustering in DuckDB, by comparing every vector with every centroid."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT i, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS b FROM (
  SELECT i, c, list_sum(list_transform(list_zip(v.g, m.g), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} m) GROUP BY i)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(g) AS x, generate_subscripts(g, 1) AS p FROM a{n} JOIN v USING (i)) GROUP BY c, p),
f{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS g FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(f{n}.g, c{n}.g) AS g FROM c{n} LEFT JOIN f{n} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS g
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, g) - 1)::INTEGER AS c, g FROM v QUALIFY c < {k}),{",".join(steps)},
o AS (SELECT vec_id, b.c AS cluster, b.d AS distance FROM a{rounds} JOIN v USING (i))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(g, ',')) AS centroid_sha256 FROM o JOIN c{rounds} ON c = cluster"""
