"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Candidates are dealt by a hash of the row to groups of about ``group`` rows and
queries to blocks of about ``query_block``; a task gets one of each. It halves the
group along principal axes into blocks of up to ``block`` rows of like vectors, and turns each
block to its own principal axes, so that a few dimensions hold most of what differs. Every
dimension is sorted once. A query begins with the block of the highest bound. It reads the lists from the end its sign favours; rows met
for the first time are scored in full, and reading stops at the depth where the bound, the
score of a row with every component at the lists' present depth, is below the k-th score. An
equal bound reads on, since a tie may have a smaller id. The k-th score is carried
from block to block, so that later blocks stop earlier or are not read at all; queries that
the bound stops late or not at all in a block are scored against it together. A row is scored
once for a query at most, so no more rows are than in a full scan. The best k of each group
are merged by query.

Scores are whole numbers of the vectors as they are given; turned components only bound
them, with a margin for rounding. Groups have a bounded number of rows, whatever ids or values
repeat. Every query meets every group once; nothing is sampled. Vectors that are null or empty,
or hold a null or a non-finite component, and rows with a null id take no part;
vectors of different lengths are not compared. Repeated rows count once. An id with
several vectors is one query and one candidate: each pair of ids has its best
score. Rows of a query's own id are none of its candidates. Components so large that a score
may not fit a long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 1024
GROUP = 32_768
QUERY_BLOCK = 16_384
#: Rows read from each list by a query that has no k-th score yet.
FIRST_DEPTH = 8
#: Share of the product of lengths by which a turned score may be off.
SLACK = 1e-10
#: Queries scored together against a block.
CHUNK = 256
EXACT = 2.0**53
LARGEST = 2.0**63


class Best:
    """The k best candidates of each query so far, by falling score, then id; empty places hold the lowest score."""

    def __init__(self, query_ids: np.ndarray, k: int, dtype):
        self.query_ids, self.k = query_ids, k
        self.lowest = -np.inf if dtype == np.float64 else np.iinfo(dtype).min
        self.scores = np.full((len(query_ids), k), self.lowest, dtype=dtype)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes scores (queries x ids) of ids that none of the queries holds yet."""
        scores = np.where(ids == self.query_ids[queries][:, None], self.lowest, scores)
        scores = np.concatenate([self.scores[queries], scores], axis=1)
        ids = np.concatenate([self.ids[queries], np.broadcast_to(ids, (len(queries), len(ids)))], axis=1)
        least = np.partition(scores, -self.k, axis=1)[:, -self.k]
        row, at = np.nonzero((scores >= least[:, None]) & (scores > self.lowest))
        score, ident = scores[row, at], ids[row, at]
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.scores[queries[row[top]], rank[top]] = score[top]
        self.ids[queries[row[top]], rank[top]] = ident[top]


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal axes, one a column, along which the vectors' squares add up most, least or in between."""
    x = vectors.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1]


class SortedLists:
    """A block's vectors with one list per principal axis, ascending by component; rows ascend by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors = vectors
        self.ids, self.starts = np.unique(ids, return_index=True)
        self.of = np.searchsorted(self.ids, ids)
        self.axes = principal_axes(vectors)
        turned = vectors.astype(np.float64) @ self.axes
        self.longest = float(np.sqrt(np.square(turned).sum(axis=1)).max())
        self.order = np.argsort(turned, axis=0, kind="stable").T.copy()  # axis x rank -> row
        self.values = np.take_along_axis(turned, self.order.T, axis=0).T.copy()
        self.falling, self.falling_values = self.order[:, ::-1], self.values[:, ::-1]

    def _met(self, turned: np.ndarray, depth: int) -> np.ndarray:
        """The ids that a query's lists hold down to ``depth``."""
        met = np.zeros(len(self.ids), dtype=bool)
        met[self.of[self.falling[turned > 0, :depth].ravel()]] = True
        met[self.of[self.order[turned < 0, :depth].ravel()]] = True
        return met

    def _score(self, q: int, query: np.ndarray, met: np.ndarray, best: Best) -> int:
        """Takes the scores of ids into ``best``: of all vectors of each; returns how many these are."""
        rows = np.flatnonzero(met[self.of])
        if len(rows):
            of = self.of[rows]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best.add(np.array([q]), self.ids[of[first]], np.maximum.reduceat(self.vectors[rows] @ query, first)[None, :])
        return len(rows)

    def bounds(self, queries: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The turned queries, and for each and each depth a score that no row first met below it can reach."""
        turned = queries.astype(np.float64) @ self.axes
        bounds = np.maximum(turned, 0) @ self.falling_values[:, depths - 1] + np.minimum(turned, 0) @ self.values[:, depths - 1]
        return turned, bounds + SLACK * (1 + np.sqrt(np.square(turned).sum(axis=1)) * self.longest)[:, None]

    def improve(self, queries: np.ndarray, best: Best, some: np.ndarray | None = None) -> np.ndarray:
        """Takes the block's candidates into ``best`` for some of the queries; returns how many rows each query scored."""
        n = len(self.vectors)
        some = np.arange(len(queries)) if some is None else some
        depths = np.unique(np.minimum(1 << np.arange(max(n, 1).bit_length()), n))
        turned, bounds = self.bounds(queries[some], depths)
        read = np.zeros(len(queries), np.int64)
        # without a k-th score: the lists' first rows give one to begin with
        begun = {}
        for i in np.flatnonzero(best.scores[some, -1] == best.lowest).tolist() if n > FIRST_DEPTH else ():
            begun[i] = self._met(turned[i], FIRST_DEPTH)
            read[some[i]] += self._score(some[i], queries[some[i]], begun[i], best)
        stops = bounds < best.scores[some, -1:]
        # the bound at depth 1 is that of every row: nothing need be read where it is too low
        done = np.where(stops.any(axis=1), np.where(stops[:, 0], 0, depths[stops.argmax(axis=1)]), n)
        for i, met in begun.items():
            rest = (self._met(turned[i], int(done[i])) if done[i] < n else np.ones(len(self.ids), dtype=bool)) & ~met
            read[some[i]] += self._score(some[i], queries[some[i]], rest, best)
        others = np.setdiff1d(np.arange(len(some)), np.fromiter(begun, np.int64, len(begun)), assume_unique=True)
        for i in others[(done[others] > 0) & (done[others] <= n // 16)].tolist():
            read[some[i]] += self._score(some[i], queries[some[i]], self._met(turned[i], int(done[i])), best)
        rest = some[others[done[others] > n // 16]]
        read[rest] += n
        for at in range(0, len(rest), CHUNK):
            part = rest[at : at + CHUNK]
            scores = queries[part] @ self.vectors.T
            best.add(part, self.ids, scores if len(self.ids) == n else np.maximum.reduceat(scores, self.starts, axis=1))
        return read


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    values = table.column("vector").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def like_blocks(ids: np.ndarray, vectors: np.ndarray, block: int) -> list[np.ndarray]:
    """Rows in blocks of like vectors, by id: halves along the axis of greatest variance, until ``block`` ids are left. All vectors of an id lie in one block."""
    known, first = np.unique(ids, return_index=True)
    open_, done = [np.arange(len(known))], []
    while open_:
        part = open_.pop()
        if len(part) <= block:
            done.append(part)
            continue
        x = vectors[first[part]].astype(np.float64)
        along = (x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], -1))[1][:, -1]
        order = np.argsort(along, kind="stable")
        open_ += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    of = np.empty(len(known), np.int64)
    for b, part in enumerate(done):
        of[part] = b
    row = of[np.searchsorted(known, ids)]
    order = np.lexsort((ids, row))
    return np.split(order, np.flatnonzero(np.diff(row[order])) + 1)


def search_blocks(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, best: Best, block: int) -> np.ndarray:
    """Takes all candidates into ``best``, for each query the block with the highest bound first; returns how many rows each query scored."""
    lists = [SortedLists(ids[rows], vectors[rows]) for rows in like_blocks(ids, vectors, block)]
    first = np.argmax([x.bounds(queries, np.array([1]))[1][:, 0] for x in lists], axis=0)
    read = np.zeros(len(queries), np.int64)
    for chosen in (True, False):
        for number, x in enumerate(lists):
            some = np.flatnonzero((first == number) == chosen)
            if len(some):
                read += x.improve(queries, best, some)
    return read


def search_groups(k: int, block: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, vectors = _matrix(candidates)
        query_ids, wanted = _matrix(queries)
        # whole numbers in doubles are exact, and faster, while sums stay below 2**53
        large = float(np.abs(vectors).max()) * float(np.abs(wanted).max()) * vectors.shape[1]
        if large >= LARGEST:
            raise ValueError("scores of these vectors may not fit a long")
        if large < EXACT:
            vectors, wanted = vectors.astype(np.float64), wanted.astype(np.float64)
        best = Best(query_ids, k, vectors.dtype)
        search_blocks(ids, vectors, wanted, best, block)
        row, rank = np.nonzero(best.scores > best.lowest)
        return pa.table([query_ids[row], best.ids[row, rank], best.scores[row, rank].astype(np.int64)], schema=schema)

    return search


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & whole, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def threshold_topk(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, group: int = GROUP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query; both sides have id (long) and vector (array<long>), null vectors take no part."""
    candidates, queries = (df.select("id", "vector").where(F.col("id").isNotNull() & F.col("vector").isNotNull()) for df in (candidates, queries))
    many, asked = (max(1, df.count()) for df in (candidates, queries))
    query_blocks = -(-asked // query_block)
    # small tables are dealt to all cores, in groups of a block or more
    groups = max(-(-many // group), min(-(-many // block), 2 * candidates.sparkSession.sparkContext.defaultParallelism))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id", "vector", F.lit(own)), F.lit(n)).cast("int")
        return df.dropDuplicates().select("id", "vector", F.size("vector").alias("dims"), at.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(candidates, "group", groups, "query_block", query_blocks).groupBy("group", "query_block", "dims")
    right = dealt(queries, "query_block", query_blocks, "group", groups).select("id", "vector", "dims", "group", "query_block").groupBy("group", "query_block", "dims")
    found = left.cogroup(right).applyInArrow(search_groups(k, block), "query_id long, vec_id long, score long")
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    return threshold_topk(rows, rows.where(F.col("id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), best AS (SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY query_id, vec_id
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM best)
SELECT * FROM ranked WHERE rank <= 5
"""
