"""Centroid clustering of integer vectors by bit planes.

A vector of 64 whole numbers is held as planes of its two's complement: plane b packs bit b of
all components into one 64-bit word. With w_b = 2**b, and -2**b for the top plane, the dot
product of x and c is the sum over plane pairs of w_i * w_j * popcount(x_i AND c_j): exact in
64 bits, and so are the distances |x|^2 - 2 x.c + |c|^2.

The planes are written once and read in every round. A task adds up the members of each
centroid itself and returns one row a centroid, so a centroid that holds most vectors costs
no more than another; only centroids (k x 64 numbers) come to the driver.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite one are left out; repeated rows all count and are all returned; rows with a null id
are clustered but are no start. Starts are ordered by the hash of their id, then (repeated ids)
by planes; with fewer vectors than `k` there are as many centroids as vectors; no vectors, no
rows. Of equal distances the smaller centroid wins, and a centroid without members stays. A
component beyond +-2**27 is an error, as distances would not fit 64 bits. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.session import stage

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SALT = "2"
LARGEST = 2**27
ROWS = 2048


def pack(values: np.ndarray) -> np.ndarray:
    """int64 [n, 64] as planes, uint64 [n, planes]; the last plane is the sign."""
    most = int(np.max(values ^ (values >> 63), initial=0))
    planes = np.empty((len(values), most.bit_length() + 1), dtype=np.uint64)
    for b in range(planes.shape[1]):
        bits = ((values >> b) & 1).astype(np.uint8)
        planes[:, b] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    return planes


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpack(planes: np.ndarray) -> np.ndarray:
    n, count = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, count, 8), axis=2)
    return np.einsum("nbd,b->nd", bits.astype(np.int64), weights(count))


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All dot products of two sets of planes, int64 [len(x), len(c)]."""
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for i, wi in enumerate(weights(x.shape[1])):
        for j, wj in enumerate(weights(c.shape[1])):
            out += np.bitwise_count(x[:, i, None] & c[None, :, j]) * (wi * wj)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for i, wi in enumerate(weights(x.shape[1])):
        for j, wj in enumerate(weights(x.shape[1])):
            out += np.bitwise_count(x[:, i] & x[:, j]) * (wi * wj)
    return out


def nearest(x: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and the squared distance to it."""
    gap = own[:, None] - 2 * dots(x, c) + squares(c)[None, :]
    chosen = np.argmin(gap, axis=1)
    return chosen, gap[np.arange(len(x)), chosen]


def _fixed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold `DIMS` finite numbers, and these as an array of doubles."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == DIMS)
    flat = lists.take(pa.array(rows)).flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    good = (known & np.isfinite(values)).all(axis=1)
    return rows[good], values[good]


def _pack_task(batches):
    for batch in batches:
        rows, values = _fixed(batch.column(1))
        whole = np.floor(SCALE * values)
        if np.abs(whole).max(initial=0) > LARGEST:
            raise ValueError(f"A component is beyond +-{LARGEST} after scaling.")
        planes = pack(whole.astype(np.int64))
        yield pa.record_batch(
            [
                batch.column(0).take(pa.array(rows)),
                pa.ListArray.from_arrays(
                    np.arange(len(rows) + 1, dtype=np.int32) * planes.shape[1],
                    pa.array(planes.view(np.int64).ravel()),
                ),
                pa.array(squares(planes)),
            ],
            names=["id", "planes", "square"],
        )


def _planes(lists: pa.Array) -> np.ndarray:
    """Planes of a batch as one array: shorter rows repeat their sign plane."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    start = np.cumsum(size) - size
    place = np.minimum(np.arange(size.max(initial=1))[None, :], size[:, None] - 1)
    return flat[start[:, None] + place]


def _assigned(batches, centroids):
    c = pack(centroids)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = _planes(part.column(1))
            chosen, gap = nearest(x, part.column(2).to_numpy(zero_copy_only=False), c)
            yield part.column(0), x, chosen, gap


def _sum_task(centroids):
    def task(batches):
        sums = np.zeros((len(centroids), DIMS), dtype=np.int64)
        count = np.zeros(len(centroids), dtype=np.int64)
        for _, x, chosen, _ in _assigned(batches, centroids):
            order = np.argsort(chosen, kind="stable")
            found, first = np.unique(chosen[order], return_index=True)
            sums[found] += np.add.reduceat(unpack(x)[order], first, axis=0)
            count += np.bincount(chosen, minlength=len(centroids))
        held = np.flatnonzero(count)
        yield pa.record_batch(
            [
                pa.array(held.astype(np.int32)),
                pa.array(count[held]),
                pa.ListArray.from_arrays(
                    np.arange(len(held) + 1, dtype=np.int32) * DIMS, pa.array(sums[held].ravel())
                ),
            ],
            names=["cluster", "n", "sums"],
        )

    return task


def _assign_task(centroids):
    def task(batches):
        for ids, _, chosen, gap in _assigned(batches, centroids):
            yield pa.record_batch(
                [ids, pa.array(chosen.astype(np.int32)), pa.array(gap)], names=["id", "cluster", "distance"]
            )

    return task


def _moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the exact mean of their members."""
    sums = packed.mapInArrow(_sum_task(centroids), "cluster int, n long, sums array<long>")
    parts = sums.select("cluster", "n", F.posexplode("sums").alias("d", "part"))
    exact = parts.groupBy("cluster", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total")
    )
    moved = centroids.copy()
    for row in exact.collect():  # k x 64 rows
        moved[row["cluster"], row["d"]] = int(row["total"]) // row["n"]
    return moved


def cluster(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS,
    rounds: int = ROUNDS, salt: str = SALT,
) -> DataFrame:
    """One row per vector: `id`, `cluster`, `distance` (squared), `cluster_inertia`, `inertia`
    and the final `centroid` as whole numbers."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    id_type = kept.schema["id"].dataType.simpleString()
    packed = stage(kept.mapInArrow(_pack_task, f"id {id_type}, planes array<long>, square long"))
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = packed.orderBy(drawn.asc_nulls_last(), "planes").limit(k).collect()
    made = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], f"{id} {id_type}, cluster int, distance long, {made[13:]}")
    centroids = np.stack([unpack(np.array([r["planes"]], dtype=np.int64).view(np.uint64))[0] for r in first])
    for _ in range(rounds):
        centroids = _moved(packed, centroids)
    assigned = stage(packed.mapInArrow(_assign_task(centroids), f"id {id_type}, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    per = spark.createDataFrame(
        [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in sorted(inertia.items())], made
    )
    # At most k rows.
    return assigned.join(F.broadcast(per), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def op11_bit_plane_clusters(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")


def _oracle() -> str:
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS c, v FROM kept
  QUALIFY c < {CENTROIDS})"""
    ]
    for i in range(ROUNDS + 1):
        gap = (
            f"list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, c{i}.v) "
            f"+ list_inner_product(c{i}.v, c{i}.v)"
        )
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(kept.v) AS v, min({{'d': {gap}, 'c': c}}) AS best
  FROM kept, c{i} GROUP BY r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""
p{i} AS MATERIALIZED (
  SELECT c, d, floor(sum(x) / count(*)) AS m
  FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, {DIMS + 1})) AS d FROM a{i}) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(n.v, c{i}.v) AS v
  FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY d) AS v FROM p{i} GROUP BY c) n ON n.c = c{i}.c)"""
            )
    last = ROUNDS
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{last}.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.c = best.c"""


ORACLE = _oracle()
