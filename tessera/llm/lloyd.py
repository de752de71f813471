"""Plain Lloyd clustering in whole numbers.

Centroids travel to the tasks; ``mapInPandas`` computes whole squared differences
per centroid in NumPy, where ``argmin`` takes the lowest number among equals. A task
returns one row per centroid it has vectors of, with their count and componentwise
sums, and ``groupBy`` merges these; the driver receives k rows a round, whatever the
size of the table. A round reads the table anew: nothing is shuffled or kept but
these sums, and a lost executor costs its own tasks.

Sums, squares and floors are exact, so results depend neither on the partitioning nor
on the order of rows. Every row is a vector, so that rows which repeat an id or a vector
all count. Vectors that are null, of another length, or that hold a null or a non-finite
component take no part. A null id is a vector like others; as a start it has the text
"". Starts of one hash (rows of one id) go by their components. With fewer vectors than
centroids there are as many centroids as vectors; an empty table has no rows. Components
of 2**26 or more after scaling raise an error, since their squared distance may not fit a
long. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
#: Components stay below this, so that 64 squared differences add up to less than 2**62.
LARGEST = 1 << 26
#: Rows of a batch whose differences are computed at once.
CHUNK = 4096


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and vector (floor(scale * x) of every component) of the rows that take part."""
    x = F.col(vector_col)
    valid = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    small = F.forall(x, lambda v: F.abs(F.lit(float(scale)) * v.cast("double")) < F.lit(float(LARGEST)))
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")).cast("array<bigint>"))
    return rows.where(F.coalesce(valid, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("vector"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the lowest among equals, and the squared distance."""
    label, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for at in range(0, len(vectors), CHUNK):
        part = vectors[at : at + CHUNK]
        squares = np.stack([np.square(part - c).sum(axis=1) for c in centroids], axis=1)
        label[at : at + CHUNK] = squares.argmin(axis=1)
        distance[at : at + CHUNK] = squares.min(axis=1)
    return label, distance


def _sums(centroids):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(centroids.value), np.zeros(len(centroids.value), np.int64)
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["vector"])
                label, _ = nearest(vectors, centroids.value)
                for c in np.unique(label).tolist():
                    mine = vectors[label == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "sums": list(total[some])})

    return sums


def _assigned(centroids):
    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                label, distance = nearest(_matrix(batch["vector"]), centroids.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": label.astype(np.int32), "distance": distance})

    return assigned


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.array([r["vector"] for r in first], dtype=np.int64)


def lloyd_rounds(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds; stops early where they repeat, since all further rounds would."""
    context = vectors.sparkSession.sparkContext
    merged = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(centroids.shape[1])]
    for _ in range(rounds):
        sent = context.broadcast(centroids)
        parts = vectors.select("vector").mapInPandas(_sums(sent), "cluster int, n long, sums array<long>")
        moved = centroids.copy()
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *merged).collect():
            moved[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(centroids.shape[1])]
        sent.unpersist()
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def lloyd_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, dimensions, scale)
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lloyd_rounds(vectors, centroids, rounds)
    assigned = vectors.mapInPandas(_assigned(spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    of_cluster = [inertia.get(c, 0) for c in range(len(centroids))]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster(of_cluster, "long").alias("cluster_inertia"),
        F.lit(sum(of_cluster)).cast("long").alias("inertia"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )


def op13_lloyd_clusters(spark, sf_dir: str) -> DataFrame:
    return lloyd_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    """One round: every vector's nearest centroid, then floors of the means."""
    return f"""
, a{i} AS (SELECT r, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, v.x, k.c, CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, k{i} k) GROUP BY r, x)
, m{i} AS (SELECT c, list(m ORDER BY j) AS x FROM (
    SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT c, j, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY c, j)) GROUP BY c)
, k{i + 1} AS (SELECT k{i}.c, coalesce(m{i}.x, k{i}.x) AS x FROM k{i} LEFT JOIN m{i} ON k{i}.c = m{i}.c)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
, k0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v) ORDER BY h, x LIMIT {CLUSTERS})
{"".join(_round_sql(i) for i in range(ROUNDS))}
, last AS (SELECT r, c, d FROM (
    SELECT v.r, k.c, CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, k{ROUNDS} k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)
SELECT v.vec_id, CAST(last.c AS INTEGER) AS cluster, last.d AS distance,
  CAST(sum(last.d) OVER (PARTITION BY last.c) AS BIGINT) AS cluster_inertia, CAST(sum(last.d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(list_transform(k{ROUNDS}.x, lambda e: CAST(e AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM last JOIN v ON v.r = last.r JOIN k{ROUNDS} ON k{ROUNDS}.c = last.c
"""
