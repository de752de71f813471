"""Deterministic samples: order by a stable hash, take prefixes; the same on any partitioning."""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.hashing import salted_hash, stable_hash


def _rank(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def with_repeats(rows: DataFrame, repeats: int) -> DataFrame:
    """Each row once per repeat: episodes are a column, not a loop."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def support_sample(rows: DataFrame, keys: list[str], item: str, shot: int, seed: str) -> DataFrame:
    """First ``shot`` items of each group by hash of (seed, keys, item), with their rank.

    The rank limit is pushed below the shuffle, so a hot group sends few rows.
    """
    h = stable_hash(F.lit(seed), *[F.col(k) for k in keys], F.col(item))
    return rows.withColumn("rank", _rank(keys, h, F.col(item))).where(F.col("rank") <= shot)


def registered_vocabulary(rows: DataFrame, keys: list[str], label: str, size: int, seed: str) -> DataFrame:
    """First ``size`` labels of each group of keys by hash."""
    labels = rows.select(*keys, label).distinct()
    h = stable_hash(F.lit(seed), *[F.col(k) for k in keys], F.col(label))
    return labels.withColumn("rank", _rank(keys, h, F.col(label))).where(F.col("rank") <= size)


def calibration_split(rows: DataFrame, label: str, item: str, salt: str, separator: str = "\0") -> DataFrame:
    """Per label in salted-hash order, the first half (rounded down) calibrates, the rest scores.

    The hash's first three signs part a label into ranges; a row's rank is what lies in the ranges before
    its own, from counts, and its rank within its range. So a label of any size is ranked by many tasks.
    """
    keyed = rows.withColumn("__h", salted_hash(salt, F.col(label), F.col(item), separator=separator))
    keyed = keyed.withColumn("__range", F.coalesce(F.substring("__h", 1, 3), F.lit("")))
    counts = keyed.groupBy(F.col(label).alias("__label"), F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    ranges = Window.partitionBy("__label").orderBy("__of")
    before = F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__label", "__of", before.alias("__before"), F.sum("__n").over(Window.partitionBy("__label")).alias("__all"))
    placed = keyed.join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__of")))
    rank = F.col("__before") + _rank([label, "__range"], F.col("__h"), F.col(item))
    return placed.withColumn("part", F.when(rank <= F.floor(F.col("__all") / 2), "cal").otherwise("score")).select(*rows.columns, "part")


def nested_shots(rows: DataFrame, keys: list[str], item: str, shots: list[int], seed: str) -> DataFrame:
    """Prefixes of one order, so that fewer shots are a subset of more: one row per shot that holds the item."""
    ranked = support_sample(rows, keys, item, max(shots), seed)
    return ranked.select("*", F.explode(F.filter(F.array(*[F.lit(s) for s in sorted(shots)]), lambda s: F.col("rank") <= s)).alias("shot"))


def subset_check(nested: DataFrame, item: list[str], shots: list[int]) -> DataFrame:
    """One row: items, and those that fewer shots hold but some greater number of shots lacks."""
    wanted = F.filter(F.array(*[F.lit(s) for s in sorted(shots)]), lambda s: s >= F.col("least"))
    held = nested.groupBy(*item).agg(F.min("shot").alias("least"), F.count_distinct("shot").alias("n"))
    return held.agg(F.count("*").alias("items"), F.count_if(F.col("n") != F.size(wanted)).alias("n_broken"))


def support_query_split(rows: DataFrame, keys: list[str], item: str, shot: int, seed: str) -> DataFrame:
    """Every row as 'support' (first ``shot`` of its group) or 'query'."""
    h = stable_hash(F.lit(seed), *[F.col(k) for k in keys], F.col(item))
    return rows.withColumn("part", F.when(_rank(keys, h, F.col(item)) <= shot, "support").otherwise("query"))


class _LeastExposed:
    """Deals classes (label, name) to batches: each takes the classes that were taken least often, ties by a draw of class and exposure."""

    def __init__(self):
        self.classes = []

    def eval(self, row, ways: int, batches: int, seed: str):
        self.classes.append((row["label"], row["name"]))
        self.asked = (ways, batches, seed)

    def terminate(self):
        if not self.classes:
            return
        ways, batches, seed = self.asked

        def entry(exposure: int, at: int) -> tuple:
            draw = hashlib.sha256("".join(f"{x}\0" for x in (seed, self.classes[at][1], exposure)).encode()).hexdigest()
            return exposure, draw, self.classes[at][1], at

        heap = [entry(0, at) for at in range(len(self.classes))]
        heapq.heapify(heap)
        for batch in range(batches):
            taken = [heapq.heappop(heap) for _ in range(min(ways, len(heap)))]
            for exposure, _, _, at in taken:
                yield self.classes[at][0], batch, exposure
                heapq.heappush(heap, entry(exposure + 1, at))


def class_turns(classes: DataFrame, label: str, ways: int, batches: int, seed: str) -> DataFrame:
    """label, batch, visit: ``ways`` classes in each of ``batches`` batches (all, if there are fewer), none ahead of another by more than one.

    A user-defined table function over the table of classes keeps them in a priority queue by exposure and then by a draw
    of seed, class and exposure, so that ties vary from round to round and rows or partitions make no difference.
    Its work grows with the batches that are asked for, not with the rows of the classes.
    """
    kind = classes.schema[label].dataType.simpleString()
    deal = F.udtf(_LeastExposed, returnType=f"label {kind}, batch int, visit int")
    table = classes.select(F.col(label).alias("label"), F.col(label).cast("string").alias("name")).where("label is not null").distinct()
    return deal(table.asTable().withSinglePartition(), F.lit(ways), F.lit(batches), F.lit(seed)).withColumnRenamed("label", label)


def balanced_batches(rows: DataFrame, label: str, item: str, ways: int, shots: int, seed: str, batches: int | None = None) -> DataFrame:
    """Class-balanced batches: each has ``ways`` least exposed classes with ``shots`` items.

    Within a class, items are dealt in hash order and cycle when they run out. Without ``batches`` there are as many
    as the rows fill. Rows without a label are in none.
    """
    known = rows.where(F.col(label).isNotNull())
    items = known.withColumn("r", _rank([label], stable_hash(F.lit(seed), F.col(label), F.col(item)), F.col(item)) - 1)
    sizes = known.groupBy(label).agg(F.count("*").alias("n"))
    many = -(-known.count() // (ways * shots)) if batches is None else batches
    turns = class_turns(sizes, label, ways, many, seed).join(sizes, label)
    slots = turns.select(label, "batch", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shots - 1)), lambda s: F.pmod(F.col("visit") * shots + s, F.col("n")))).alias("r"))
    return slots.join(items.select(label, item, "r"), [label, "r"]).select("batch", label, item)
