"""Choosing among runs: best configurations, checkpoints, medians, rankings, leave-one-out."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def best_per_group(rows: DataFrame, group: str, score: str, index: str) -> DataFrame:
    """Row of the greatest score in each group; ties go to the smaller index."""
    rest = [c for c in rows.columns if c != group]
    chosen = F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(index)).alias("__minus")))
    return rows.groupBy(group).agg(chosen.alias("b")).select(group, "b.*")


def selected_checkpoint(rows: DataFrame, run: str, score: str, epoch: str) -> DataFrame:
    """Greatest development score of each run, exact ties to the earliest epoch."""
    return best_per_group(rows, run, score, epoch)


def median_seed(rows: DataFrame, group: str, score: str, seed: str) -> DataFrame:
    """The representative run of each group: the lower median by (score, seed), never the best."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("__r", F.row_number().over(w.orderBy(score, seed))).withColumn("__n", F.count("*").over(w))
    return ranked.where(F.col("__r") == F.floor((F.col("__n") + 1) / 2)).drop("__r", "__n")


def ranked_winners(winners: DataFrame, score: str, name: str) -> DataFrame:
    """Winners, one per configuration family, with their rank and whether the first place is tied."""
    w = Window.partitionBy().orderBy(F.desc(score))
    ranked = winners.withColumn("rank", F.rank().over(w))
    return ranked.withColumn("tied", F.count_if(F.col("rank") == 1).over(Window.partitionBy()) > 1).orderBy("rank", name)


def final_epochs(rows: DataFrame, seed: str, epoch: str) -> DataFrame:
    """Last row of each seed."""
    rest = [c for c in rows.columns if c != seed]
    return rows.groupBy(seed).agg(F.max_by(F.struct(*rest), F.col(epoch)).alias("b")).select(seed, "b.*")


def first_per_status(rows: DataFrame, status: str, *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != status]
    return rows.groupBy(status).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(status, "b.*")


def leave_one_out_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the mean over all other groups: totals minus the group's own, so no group meets another."""
    own = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.avg(value).alias("own_mean"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.join(F.broadcast(total), how="cross").select(group, "n", "own_mean", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("others_mean"))


def paired_delta(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Differences a - b of runs with the same key."""
    other = b.select(key, *[F.col(m).alias(f"__{m}") for m in metrics])
    return a.join(other, key).select(key, *[(F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics])


def parity(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """One row: pairs, exact matches, matches within the tolerance, greatest difference."""
    other = b.select(key, F.col(value).alias("__v"))
    gap = F.abs(F.col(value) - F.col("__v"))
    return a.join(other, key).agg(F.count("*").alias("pairs"), F.count_if(F.col(value) == F.col("__v")).alias("exact"), F.count_if(gap <= tolerance).alias("close"), F.max(gap).alias("max_gap"))


def inventories(rows: DataFrame, value: str, named: dict[str, Column]) -> DataFrame:
    """Distinct values that meet each named predicate, for all predicates in one scan."""
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())
    each = rows.select(F.col(value).alias("value"), F.explode(hits).alias("inventory")).distinct()
    return each.groupBy("inventory").agg(F.count("*").alias("n_values"), F.min("value").alias("first"), F.max("value").alias("last"))


def most_common(rows: DataFrame, key: str, n: int, first_seen: str) -> DataFrame:
    """The n most frequent values; ties by first occurrence, then by value."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", key).limit(n)


def bounded_examples(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """First n distinct values of each group in order."""
    w = Window.partitionBy(group).orderBy(value)
    top = rows.select(group, value).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ",").alias("examples"))


def pareto_cells(cells: DataFrame, keys: list[str], gain: str, guard: str, least_guard: float, least_gain: float) -> DataFrame:
    """The cells themselves: 'best_gain' (subject to the guard), 'best_guard' (subject to the gain) and 'nearest' (least miss of both limits).

    Ties go to the other value, then to the smaller keys. A limit that no cell meets has no row.
    """
    g, r = F.col(gain), F.col(guard)
    miss = F.greatest(F.lit(0.0), F.lit(least_gain) - g) + F.greatest(F.lit(0.0), F.lit(least_guard) - r)
    cell = F.struct(*keys, gain, guard, miss.alias("miss"))
    kinds = {"best_gain": (r >= least_guard, [-g, -r]), "best_guard": (g >= least_gain, [-r, -g]), "nearest": (F.lit(True), [miss, -g, -r])}
    first = [F.min_by(F.when(ok, cell), F.when(ok, F.struct(*[k.alias(f"o{i}") for i, k in enumerate(order)], *keys))).alias(n) for n, (ok, order) in kinds.items()]
    rows = cells.agg(*first).select(F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("cell")) for n in kinds])))
    return rows.where(F.col("cell").isNotNull()).select("kind", "cell.*")


def pareto_limits(cells: DataFrame, gain: str, guard: str, least_guard: float, least_gain: float) -> DataFrame:
    """Best gain subject to the guard, best guard subject to the gain, and the least miss of both; ``pareto_cells`` returns the cells."""
    g, r = F.col(gain), F.col(guard)
    miss = F.greatest(F.lit(0.0), F.lit(least_gain) - g) + F.greatest(F.lit(0.0), F.lit(least_guard) - r)
    return cells.agg(F.max(F.when(r >= least_guard, g)).alias("best_gain"), F.max(F.when(g >= least_gain, r)).alias("best_guard"), F.min(miss).alias("least_miss"))


def running_offsets(rows: DataFrame, shard: str, order: list[str], size: str) -> DataFrame:
    """Start and end of each row in its shard, by running sums; shards have a bounded number of rows."""
    end = F.sum(size).over(Window.partitionBy(shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_frame", end).withColumn("start_frame", F.col("end_frame") - F.col(size))


def length_bucketed(rows: DataFrame, length: str, key: str, partitions: int) -> DataFrame:
    """Rows sorted by length then key within ranges of length, for batches of like length."""
    return rows.repartitionByRange(partitions, length, key).sortWithinPartitions(length, key)


#: Rows of a range that one task sorts.
RANGE_ROWS = 1_000_000


def length_batches(rows: DataFrame, length: str, key: str, size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``batch``: rows in order of length, then key, in batches of ``size``; rows without a length have none.

    Approximate quantiles part the lengths into ranges; a row's place is its place in its range after the rows of the
    ranges below, which are counted first. So batches go across ranges, and no task sorts all rows.
    """
    known = rows.where(F.col(length).isNotNull())
    ranges = max(1, -(-known.count() // range_rows))
    bounds = sorted(set(known.agg(F.percentile_approx(length, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or [])) if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(length))) if bounds else F.lit(0)
    held = known.withColumn("__range", place)
    counts = {r["__range"]: r["n"] for r in held.groupBy("__range").agg(F.count("*").alias("n")).collect()} if bounds else {}
    below = list(itertools.accumulate([counts.get(i, 0) for i in range(len(bounds))], initial=0))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(length, key)) - 1
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in below]), F.col("__range") + 1)
    batched = held.withColumn("batch", F.floor((start + nth) / size)).drop("__range")
    return batched.unionByName(rows.where(F.col(length).isNull()).withColumn("batch", F.lit(None).cast("long")))
