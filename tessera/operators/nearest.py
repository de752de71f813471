"""The best classes of each query by cosine, exactly, for any number of classes.

Prototypes are grouped around centers, of which there are at most as many as the square root of
their number, and each group knows the greatest angle between its center and a member. No member of
a group is nearer to the query than the angle to the center less the group's greatest angle
(triangle inequality on the sphere), so a group that cannot beat the ``k``-th score so far is skipped.

Groups lie in slabs of bounded size, and queries in parts of bounded size; a task scores one part
against one slab, group by group, and holds a bounded number of scores at a time. A query meets the
slabs in two rounds: first those of the groups where the best score is to be expected, until
they hold ``k`` classes, then, with its k-th score there as a floor, the others with a group that may still beat it.
A query is sent to a slab at most once, so where nothing can be skipped the rows sent are queries times slabs and classes times parts.

Scores are sums of products in the order of components, whatever the slabs, so that results
depend neither on the grouping nor on the partitioning. Ties go to the smaller label.
Queries without a vector, or with one of another length, have no row; classes without a prototype,
or with one shorter than the longest, are none. Null components count as zero. Rows that repeat a key and a vector are one query, and rows that
repeat a label and a prototype one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_normalized

#: Least mean size of a group, classes of a slab and queries of a part.
BLOCK = 1024
SLAB = 32_768
QUERY_BLOCK = 16_384
#: Rows whose bounds, and scores, are held at a time; candidates gathered before they are cut to the best.
ROWS = 1024
SCORES = 1 << 20
GATHERED = 1 << 17
#: Slack for rounding, in cosines and angles.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _nearest_center(centers):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            cosine = _matrix(batch.column("unit")) @ centers.value.T
            at = cosine.argmax(axis=1)
            yield batch.append_column("center", pa.array(at.astype(np.int32))).append_column("angle", pa.array(angles(cosine[np.arange(len(at)), at])))

    return nearest


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass(frozen=True)
class Cells:
    """Groups, or parts of a group that is larger than a slab: centers, greatest angles, sizes and slabs by number."""

    centers: np.ndarray
    angle: np.ndarray
    size: np.ndarray
    slab: np.ndarray

    def bounds(self, units: np.ndarray, at=slice(None)) -> np.ndarray:
        """The greatest cosine that any member of a cell may have."""
        return np.cos(np.maximum(angles(units @ self.centers[at].T) - self.angle[at] - SLACK, 0))

    def first(self, bounds: np.ndarray, k: int, at=slice(None)) -> np.ndarray:
        """Which cells, from the highest bound down, hold ``k`` classes."""
        size, out = self.size[at], np.zeros(bounds.shape, dtype=bool)
        order = np.argsort(-bounds, axis=1, kind="stable")
        np.put_along_axis(out, order, np.cumsum(size[order], axis=1) - size[order] < k, axis=1)
        return out


def grouped(protos: DataFrame, label: str, block: int = BLOCK, slab: int = SLAB) -> tuple[DataFrame, Cells | None]:
    """Prototypes (label, unit, cell, slab) and the cells, a list of bounded length; None without a prototype.

    Centers are the prototypes whose labels have the smallest hashes.
    """
    spark = protos.sparkSession
    rows = protos.where("prototype is not null").select(F.col(label).alias("label"), l2_normalized(F.transform("prototype", lambda x: F.coalesce(x, F.lit(0.0)))).alias("unit"))
    many, dims = rows.agg(F.count("*"), F.max(F.size("unit"))).first()
    if not many:
        return rows.select("label", "unit", F.lit(0).alias("cell"), F.lit(0).alias("slab")), None
    rows = rows.where(F.size("unit") == dims)
    groups = -(-many // max(block, int(many**0.5)))
    if groups < 2:  # there is nothing to skip
        centers = np.ones((1, dims))
        placed = rows.select("label", "unit", F.lit(0).alias("center"), F.lit(float(np.pi)).alias("angle"))
    else:
        picked = rows.select("unit", F.xxhash64("label").alias("h"), "label").orderBy("h", "label").limit(groups).select("unit").collect()
        centers = np.array([r["unit"] for r in picked], dtype=np.float64)
        placed = rows.mapInArrow(_nearest_center(spark.sparkContext.broadcast(centers)), f"label {rows.schema['label'].dataType.simpleString()}, unit array<double>, center int, angle double")
    sizes = placed.groupBy("center").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).orderBy("center").collect()
    cells, lookup, filled, now = [], [], 0, 0
    for r in sizes:
        parts = -(-r["n"] // slab)
        first = len(cells)
        for _ in range(parts):
            if filled and filled + r["n"] / parts > slab:
                filled, now = 0, now + 1
            filled += r["n"] / parts
            cells.append((r["center"], r["angle"], r["n"] / parts, now))
        lookup.append((r["center"], first, [c[3] for c in cells[first:]]))
    part = F.pmod(F.xxhash64("label"), F.size("slabs")).cast("int")
    members = placed.join(F.broadcast(spark.createDataFrame(lookup, "center int, first int, slabs array<int>")), "center")
    center, angle, size, slabs = (np.array(x) for x in zip(*cells, strict=True))
    return members.select("label", "unit", (F.col("first") + part).alias("cell"), F.get("slabs", part).alias("slab")), Cells(centers[center], angle, size, slabs)


def _to_slabs(batch: pa.RecordBatch, chosen: np.ndarray, cells: Cells, met: list | None = None) -> pa.RecordBatch:
    """The rows once for each slab of a chosen cell, but for those that they met."""
    slabs = np.zeros((len(chosen), int(cells.slab.max()) + 1), dtype=bool)
    row, at = np.nonzero(chosen)
    slabs[row, cells.slab[at]] = True
    for r, numbers in enumerate(met or []):
        slabs[r, numbers] = False
    row, slab = np.nonzero(slabs)
    return batch.take(pa.array(row)).append_column("slab", pa.array(slab.astype(np.int32)))


def _first_slabs(sent, k: int):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            yield _to_slabs(batch, sent.value.first(sent.value.bounds(_matrix(batch.column("unit"))), k), sent.value)

    return first


def _other_slabs(sent):
    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            may = sent.value.bounds(_matrix(batch.column("unit"))) >= floor[:, None] - SLACK
            yield _to_slabs(batch.select(["key", "unit", "part", "floor"]), may, sent.value, batch.column("met").to_pylist())

    return others


def _ranks(labels: pa.ChunkedArray) -> np.ndarray:
    """Labels as numbers in their order."""
    coded = labels.combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, dtype=np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    rank[-1] = len(coded.dictionary)
    return rank[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]


def _best(found: list[tuple], k: int) -> tuple:
    """The ``k`` best (row, rank, score, column) of each row, each label and score once."""
    row, rank, score, column = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((rank, -score, row))
    row, rank, score, column = (x[order] for x in (row, rank, score, column))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (rank[1:] != rank[:-1]) | (score[1:] != score[:-1])
    row, rank, score, column = (x[new] for x in (row, rank, score, column))
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return tuple(x[top] for x in (row, rank, score, column))


def _best_of_rows(units: np.ndarray, floor: np.ndarray, protos: np.ndarray, rank: np.ndarray, cells: Cells, numbers: np.ndarray, edges: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
    """``_best`` of some queries among the classes of a slab, no worse than the floors, and how many each was scored against.

    ``protos`` (by dimension) and ``rank`` lie in order of cells; those of cell numbers[i] begin at edges[i].
    """
    floor, many, by_dimension = floor.copy(), np.zeros(len(units), dtype=np.int64), np.ascontiguousarray(units.T)
    none = np.zeros(0, dtype=np.int64)
    found, gathered = [(none, none, np.zeros(0), none)], 0
    bounds = cells.bounds(units, numbers)
    first = cells.first(bounds, k, numbers)

    def cut() -> None:
        nonlocal found, gathered
        found, gathered = [_best(found, k)], 0
        row, _, score, _ = found[0]
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
        floor[row[last]] = np.maximum(floor[row[last]], score[last])

    for turn in (first, ~first):
        for c, (begin, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            asked, step = np.flatnonzero(turn[:, c] & (bounds[:, c] >= floor - SLACK)), max(1, SCORES // (end - begin))
            for at in range(0, len(asked), step):
                rows = asked[at : at + step]
                cosine, least, n = units[rows] @ protos[:, begin:end], floor[rows], end - begin
                open_ = np.flatnonzero(np.isneginf(least)) if n > k else none
                if len(open_):
                    least[open_] = np.partition(cosine[open_], n - k, axis=1)[:, n - k]
                flat = np.flatnonzero(cosine >= least[:, None] - SLACK)
                row, column = rows[flat // n], begin + flat % n
                exact = np.zeros(len(row))
                for d in range(len(protos)):
                    exact += by_dimension[d][row] * protos[d][column]
                many[rows] += n
                found.append((row, rank[column], exact, column))
                gathered += len(row)
                if gathered > GATHERED:
                    cut()
        cut()
    return found[0], many


def _score(sent, k: int):
    def score(queries: pa.Table, protos: pa.Table) -> pa.Table:
        kinds = pa.schema([queries.schema.field("key"), queries.schema.field("slab"), pa.field("n", pa.int64()), protos.schema.field("label"), pa.field("score", pa.float64())])
        if not queries.num_rows or not protos.num_rows:
            return kinds.empty_table()
        units, floor = _matrix(queries.column("unit")), queries.column("floor").to_numpy()
        rank, cell, p = _ranks(protos.column("label")), protos.column("cell").to_numpy(), _matrix(protos.column("unit"))
        order = np.lexsort((rank, cell))
        rank, cell, p = rank[order], cell[order], p[order]
        new = np.ones(len(cell), dtype=bool)  # a repeated class would take the place of another
        new[1:] = (rank[1:] != rank[:-1]) | (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]).any(axis=1)
        order, rank, cell, p = order[new], rank[new], cell[new], np.ascontiguousarray(p[new].T)
        numbers, edges = np.unique(cell, return_index=True)
        edges = np.append(edges, len(cell))
        out = []
        for at in range(0, len(units), ROWS):
            (row, _, exact, column), many = _best_of_rows(units[at : at + ROWS], floor[at : at + ROWS], p, rank, sent.value, numbers, edges, k)
            bare = np.setdiff1d(np.arange(len(many)), row)  # scored, but below the floor
            taken = queries.select(["key", "slab"]).take(pa.array(np.concatenate([row, bare]) + at))
            label = protos.column("label").take(pa.array(np.append(order[column], np.zeros(len(bare), dtype=np.int64)), mask=np.arange(len(row) + len(bare)) >= len(row)))
            scores = pa.array(np.append(exact, np.zeros(len(bare))), mask=np.arange(len(row) + len(bare)) >= len(row))
            out.append(pa.table([taken["key"], taken["slab"], pa.array(np.append(many[row], many[bare])), label, scores], names=kinds.names))
        return pa.concat_tables(out)

    return score


def top_classes(queries: DataFrame, protos: DataFrame, key: str, label: str, vector: str, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, slab: int = SLAB) -> DataFrame:
    """key, ranked (the ``k`` best classes as array<struct<score, label>>, fewer if there are) and classes_scored of each query.

    ``protos`` has ``label`` and ``prototype``; vectors need not be of unit length.
    """
    spark = queries.sparkSession
    members, cells = grouped(protos, label, block, slab)
    label_type, key_type = members.schema["label"].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    dims = cells.centers.shape[1] if cells else 0
    asked = queries.where(F.size(vector) == dims).select(F.col(key).alias("key"), l2_normalized(F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).alias("unit"))
    if not cells:
        return asked.limit(0).select(F.col("key").alias(key), F.expr(f"cast(array() as array<struct<score: double, label: {label_type}>>)").alias("ranked"), F.lit(0).cast("long").alias("classes_scored"))
    sent, slabs = spark.sparkContext.broadcast(cells), int(cells.slab.max()) + 1
    # small tables are dealt to all cores
    many = queries.count()
    spread = max(1, -(-many // query_block), min(-(-2 * spark.sparkContext.defaultParallelism // slabs), -(-many // 256)))
    lowest = F.lit(float("-inf"))
    asked = asked.select("key", "unit", F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int").alias("part"))
    held = members.select("label", "unit", "cell", "slab", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    query_row = f"key {key_type}, unit array<double>, part int, floor double, slab int"
    scored_row = f"key {key_type}, slab int, n long, label {label_type}, score double"

    def scores(chosen: DataFrame) -> DataFrame:
        return chosen.groupBy("slab", "part").cogroup(held.groupBy("slab", "part")).applyInArrow(_score(sent, k), scored_row)

    entry = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("minus"), "label"))
    unbound = asked.withColumn("floor", lowest)
    first = scores(unbound.mapInArrow(_first_slabs(sent, k), query_row) if slabs > 1 else unbound.withColumn("slab", F.lit(0)))
    if slabs > 1:
        so_far = first.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("best"), F.collect_set("slab").alias("met"))
        # fewer than k classes so far: nothing is ruled out
        floor = F.when(F.size("best") == k, -F.element_at("best", k)["minus"]).otherwise(lowest)
        open_ = asked.join(so_far.select("key", floor.alias("floor"), "met"), "key").select("key", "unit", "part", "floor", "met")
        first = first.unionByName(scores(open_.mapInArrow(_other_slabs(sent), query_row)))
    scored = first.groupBy("key", "slab").agg(F.max("n").alias("n"), F.collect_set(entry).alias("some"))
    best = scored.groupBy("key").agg(F.sum("n").alias("classes_scored"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k).alias("best"))
    return best.select(F.col("key").alias(key), F.transform("best", lambda s: F.struct((-s["minus"]).alias("score"), s["label"].alias("label"))).alias("ranked"), "classes_scored")
