"""Centroid clustering by sort-means, in exact integers.

Every round sorts, for each centroid, all centroids by their distance from it. A vector starts at the centroid of the
round before, at distance d, and looks at the others in that order; a centroid farther than 2 d from the first cannot be
nearer to the vector, so the scan stops there. All comparisons are of squared integers: one centroid is beyond twice the
distance if its square is over four times the other's.

Only centroids leave the executors: k rows of sums per round. Each round's assignment is a written table, so a lost
executor repeats its own partitions of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import Scratch, written
from kithgraph.llm.vectors import matrix, whole_vectors

K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Order:
    """The centroids of a round: from each, all others by distance (equal ones by number), with their squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.others = [[j for j in np.argsort(row, kind="stable").tolist() if j != c] for c, row in enumerate(gaps)]
        self.gaps = gaps

    def nearest(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances it took."""
        best, distance, looked = before.copy(), np.zeros(len(vectors), np.int64), 0
        for c in np.unique(before).tolist():
            rows = np.flatnonzero(before == c)
            own = vectors[rows]
            first = ((own - self.centroids[c]) ** 2).sum(1)
            least, label = first.copy(), np.full(len(rows), c, before.dtype)
            at, looked = np.arange(len(rows)), looked + len(rows)
            for j in self.others[c]:
                at = at[self.gaps[c, j] <= 4 * first[at]]
                if not len(at):
                    break
                looked += len(at)
                d = ((own[at] - self.centroids[j]) ** 2).sum(1)
                nearer = (d < least[at]) | ((d == least[at]) & (j < label[at]))
                least[at[nearer]], label[at[nearer]] = d[nearer], j
            best[rows], distance[rows] = label, least
        return best, distance, looked


def assigned(rows: DataFrame, centroids: np.ndarray, last: bool = False) -> DataFrame:
    """Vectors (vec_id, v, cluster) with the cluster of this round; in the last, (vec_id, cluster, distance)."""
    order = rows.sparkSession.sparkContext.broadcast(centroids)  # k vectors, whatever the table's size
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = Order(order.value)
        for batch in batches:
            if not len(batch):
                continue
            found, distance, _ = ordered.nearest(matrix(batch.column("v"), size), batch.column("cluster").to_numpy(zero_copy_only=False))
            more = [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(more if last else [more[0], batch.column("v"), more[1]], names=names)

    names = ["vec_id", "cluster", "distance"] if last else ["vec_id", "v", "cluster"]
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long" if last else "vec_id long, v array<int>, cluster int")


def sums(rows: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """The count and the componentwise sum of each cluster: summed by batch, then by cluster and position; k * size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors, labels = matrix(batch.column("v"), size), batch.column("cluster").to_numpy(zero_copy_only=False)
            for c in np.unique(labels).tolist():
                own = vectors[labels == c]
                total[c] = total.get(c, 0) + np.concatenate([[len(own)], own.sum(0)])
        at = [(c, i, int(x)) for c, row in total.items() for i, x in enumerate(row)]
        columns = list(zip(*at, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "at", "x"])

    found = rows.select("v", "cluster").mapInArrow(run, "cluster int, at int, x long").groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, list[int]] = {}
    for r in found.collect():
        out.setdefault(r.cluster, [0] * (size + 1))[r.at] = int(r.x)
    return {c: (x[0], x[1:]) for c, x in out.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose sha256 of `seed:vec_id` is least, in that order; a null id is the empty text, equal ids go by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of vectors (vec_id, embedding), and the final centroids.

    Vectors that are null, of another size, or hold a null or non-finite component are left out. Repeated rows are vectors
    of their own; equal distances go to the smaller number; a cluster that loses all its vectors keeps its centroid. Fewer
    than k vectors give fewer centroids; an empty table gives no row and no centroid. Null ids are kept. Other columns are
    ignored. A component beyond 2^24 after scaling fails the job.
    """
    spark = rows.sparkSession
    with Scratch(spark) as first, Scratch(spark) as odd, Scratch(spark) as even:
        vectors = first(whole_vectors(rows, scale, size), "vectors")
        centroids = first_centroids(vectors, k, seed)
        if not centroids:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
        now, turns = vectors.withColumn("cluster", F.lit(0)), [odd, even]
        for i in range(rounds):
            now = turns[i % 2](assigned(now, np.array(centroids, np.int64)), f"round-{i}")
            (first if not i else turns[(i + 1) % 2]).clear()  # the table before is spent
            for c, (n, total) in sums(now, size).items():
                centroids[c] = [x // n for x in total]
        return written(assigned(now, np.array(centroids, np.int64), last=True), "clusters"), centroids


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the embeddings after three rounds, with inertias and digests of the centroids."""
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    told = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, d, sum(told.values()), digest[c]) for c, d in sorted(told.items())]  # one of each centroid
    kinds = T._parse_datatype_string("cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(spark.createDataFrame(rows, kinds)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds written out one after the other."""
    whole = f"len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {whole})",
        "p AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        f"f AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v QUALIFY c < {K})",
        "c0 AS (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM f)",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"d{n} AS (SELECT r, c, sum((x - y) * (x - y)) AS d FROM p JOIN c{n} USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM a{n} JOIN p USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS (SELECT c, i, coalesce(m{n}.y, c{n}.y) AS y FROM c{n} LEFT JOIN m{n} USING (c, i))")
    parts.append(f"s AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{ROUNDS} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN s USING (c)"
    )


OP12_SQL = _sql()
