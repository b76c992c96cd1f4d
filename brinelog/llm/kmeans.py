"""Clustering around centroids by Sort-means, in whole numbers, so that every run gives the same clusters.

For each centroid the others are put in order of their distance from it. A vector starts at its previous centroid, at distance d,
and looks at the others in that order until one is strictly more than 2 * d away: by the triangle inequality neither it nor any
behind it can be nearer than d, nor as near. All distances are squared integers, so "2 * d" is 4 * d there and nothing is rounded.

A round is one pass: each task assigns its vectors and writes them with their centroid, and as its last rows one sum per centroid.
These rows, k a task, are added up by Spark; what reaches the driver is k * dims numbers. Vectors are never shuffled, so big
clusters and copies don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

#: Vectors looked at together.
SLICE = 4096
#: Rows of a pass: vectors with their centroid, then a task's sums (n and sums set, the others null).
PASS = "id long, vector binary, cluster int, distance long, n long, sums array<long>"


class SortMeans:
    """Nearest centroids of integer vectors, ties by smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
        near = np.argsort(apart, axis=1, kind="stable")
        self.others = [row[row != k] for k, row in enumerate(near)]
        self.apart = [apart[k, row] for k, row in enumerate(self.others)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of x, looked for from its previous centroid on."""
        cluster, distance = before.copy(), np.zeros(len(x), np.int64)
        for start in np.unique(before):
            rows = np.flatnonzero(before == start)
            own = ((x[rows] - self.centroids[start]) ** 2).sum(1)
            to_see = np.searchsorted(self.apart[start], 4 * own, side="right")
            order = np.argsort(-to_see, kind="stable")
            rows, to_see = rows[order], to_see[order]
            here, best = x[rows], own[order]
            found = np.full(len(rows), start, before.dtype)
            for j, other in enumerate(self.others[start]):
                m = int(np.searchsorted(-to_see, -j, side="left"))  # rows that look at more than j others
                if not m:
                    break
                d = ((here[:m] - self.centroids[other]) ** 2).sum(1)
                better = (d < best[:m]) | ((d == best[:m]) & (other < found[:m]))
                best[:m][better], found[:m][better] = d[better], other
            cluster[rows], distance[rows] = found, best
        return cluster, distance


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow column, a list of ints or little-endian 32-bit bytes, as rows of 64-bit integers."""
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4") if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, dims)


def _pass(centroids: np.ndarray, last: bool):
    """A function for mapInArrow: rows of (id, vector, cluster) to PASS. The last pass keeps neither vectors nor sums."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = SortMeans(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        kinds = {"id": pa.int64(), "vector": pa.binary(), "cluster": pa.int32(), "distance": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.int64())}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = _numbers(part.column("vector"), dims)
                cluster, distance = search.assign(x, part.column("cluster").to_numpy().astype(np.int32))
                if not last:
                    np.add.at(sums, cluster, x)
                    n += np.bincount(cluster, minlength=k)
                packed = [None] * len(x) if last else [r.tobytes() for r in x.astype("<i4")]
                cells = [part.column("id"), packed, cluster, distance, [None] * len(x), [None] * len(x)]
                yield pa.record_batch([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(cells, kinds.values(), strict=True)], names=list(kinds))
        used = np.flatnonzero(n)
        if len(used):
            cells = [[None] * len(used), [None] * len(used), used.astype(np.int32), [None] * len(used), n[used], sums[used].tolist()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, kinds.values(), strict=True)], names=list(kinds))

    return run


def sort_means(df: DataFrame, k: int, rounds: int, dims: int, salt: str = "", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector of df after that many rounds.

    Kept are vectors with exactly dims components, none null, NaN or infinite; components are floor(256 * x), see vectors.whole.
    The first centroids are the k vectors with the smallest hex sha256 of salt and id (null id: salt alone), ties by id, then by
    components; with fewer vectors there are fewer centroids, with none no rows. Equal vectors may be several centroids: the
    smallest number gets all rows and the others stay as they are. Repeated rows and null ids are rows like any other. Sums that
    don't fit a long are held at its end. Other columns of df are left out, whatever their names.

    Every round writes the vectors with their assignment to the shared folder, in turn to one of two places, and reads them
    again, so lost executors lose nothing and two copies at most are kept.
    """
    if k < 1 or rounds < 0 or dims < 1:
        raise ValueError("k and dims must be at least 1, rounds at least 0")
    spark = df.sparkSession
    named = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("given"))
    kept = named.where((F.size("given") == dims) & vectors.finite("given")).select("id", vectors.whole("given", dims).alias("vector"))
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    seeds = hashed.orderBy("hash", F.col("id").asc_nulls_last(), "vector").limit(k).select("vector").collect()
    shown = f"{id} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], shown)
    centroids = np.array([r.vector for r in seeds], np.int64)
    folder = f"{common.shared_dir(spark)}/sort-means-{uuid.uuid4().hex}"
    now = kept.withColumn("cluster", F.lit(0))
    for r in range(rounds + 1):
        path = f"{folder}/{r % 2}"
        now.select("id", "vector", "cluster").mapInArrow(_pass(centroids, r == rounds), PASS).write.mode("overwrite").parquet(path)
        done = spark.read.schema(PASS).parquet(path)
        now = done.where("n IS NULL")
        if r < rounds:
            cells = done.where("n IS NOT NULL").select("cluster", F.col("n").cast("decimal(20,0)").alias("n"), F.posexplode("sums").alias("at", "part"))
            added = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
            for row in added.collect():  # k * dims rows at most
                centroids[row.cluster, row.at] = int(row.total) // int(row.n)
    most = (1 << 63) - 1
    own = {row.cluster: int(row.total) for row in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    figures = [(c, min(total, most), min(sum(own.values()), most), digests[c]) for c, total in own.items()]
    told = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.join(F.broadcast(told), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The contract's parameters.
K, ROUNDS, DIMS, SALT = 40, 5, 64, "2:"


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS, DIMS, SALT)


def _sql() -> str:
    """Lloyd's rounds one after another over (vec_id, place, component) rows, every vector against every centroid."""
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS p FROM kept)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS k, v FROM kept ORDER BY 1 LIMIT {K})",
        "c0 AS MATERIALIZED (SELECT k, unnest(v) AS c, generate_subscripts(v, 1) AS p FROM s)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT vec_id, k, CAST(sum((x.c - c{r}.c) * (x.c - c{r}.c)) AS BIGINT) AS d FROM x JOIN c{r} USING (p) GROUP BY vec_id, k)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM d{r} GROUP BY vec_id)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT a{r}.k, p, CAST(sum(c) AS BIGINT) AS t, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY a{r}.k, p)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, p, CASE WHEN n IS NULL THEN c ELSE CAST((t - ((t % n) + n) % n) // n AS BIGINT) END AS c FROM c{r} LEFT JOIN m{r} USING (k, p))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p)) AS digest FROM c{ROUNDS} GROUP BY k)")
    last = f"a{ROUNDS}"
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM {last} JOIN h USING (k)"


OP11_SQL = _sql()
