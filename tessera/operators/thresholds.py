"""Exact threshold search by cumulative counts over distinct scores.

Scores are rounded before grouping, so the cumulative window sees at most one row per
rounded value of the score's range whatever the input's size; everything before it is a
partially aggregated count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tessera.operators.metrics import ratio

EPS = 1e-12


def threshold_table(rows: DataFrame, score: str, counted: dict[str, Column], by: list[str] = (), gate: Column | None = None, digits: int = 6) -> DataFrame:
    """For each candidate threshold t (distinct scores and both infinities): counts of rows with score >= t (and gate).

    ``counted`` names conditions; each gives <name> (accepted) and total_<name>.
    """
    gate = F.lit(True) if gate is None else gate
    value = F.round(F.col(score), digits).alias("t")
    per = rows.groupBy(*by, value).agg(*[F.count_if(c & gate).alias(n) for n, c in counted.items()], *[F.count_if(c).alias(f"all_{n}") for n, c in counted.items()])
    falling = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    table = per.select(*by, "t", *[F.sum(n).over(falling).alias(n) for n in counted], *[F.sum(f"all_{n}").over(whole).alias(f"total_{n}") for n in counted])
    ends = table.groupBy(*by).agg(*[F.max(n).alias(n) for n in counted], *[F.max(f"total_{n}").alias(f"total_{n}") for n in counted])
    everything = ends.select(*by, F.lit(float("-inf")).alias("t"), *counted, *[f"total_{n}" for n in counted])
    nothing = ends.select(*by, F.lit(float("inf")).alias("t"), *[F.lit(0).cast("long").alias(n) for n in counted], *[f"total_{n}" for n in counted])
    return table.unionByName(everything).unionByName(nothing)


def best_threshold(table: DataFrame, feasible: Column, key: list[Column], out: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """The feasible candidate with the greatest key."""
    chosen = F.max_by(F.struct(F.col("t").alias("threshold"), *[c.alias(n) for n, c in out.items()]), F.struct(*key))
    return table.where(feasible).groupBy(*by).agg(chosen.alias("best")).select(*by, "best.*")


def at_false_accepts(rows: DataFrame, score: str, known: Column, right: Column, limit: float = 0.1, by: list[str] = (), gate: Column | None = None, prefer: str = "wrong") -> DataFrame:
    """Most correct accepts with false accepts of unknown rows within the limit.

    Ties: fewer wrong accepts (or, with ``prefer='accepted'``, fewer false and then more known accepts), fewer false accepts, greater t.
    """
    t = threshold_table(rows, score, {"correct": known & right, "wrong": known & ~right, "unknown": ~known}, by, gate)
    n_known = F.col("total_correct") + F.col("total_wrong")
    ca, wi, far = ratio(F.col("correct"), n_known), ratio(F.col("wrong"), n_known), ratio(F.col("unknown"), F.col("total_unknown"))
    key = [ca, -wi, -far, F.col("t")] if prefer == "wrong" else [ca, -far, ca + wi, F.col("t")]
    return best_threshold(t, far <= limit + EPS, key, {"correct_accept": ca, "wrong_intent": wi, "false_accept": far}, by)


def at_known_rejects(rows: DataFrame, score: str, known: Column, limit: float = 0.05, by: list[str] = (), gate: Column | None = None) -> DataFrame:
    """Most rejected unknown rows with rejected known rows within the limit; ties: fewer known rejects, greater t."""
    t = threshold_table(rows, score, {"known": known, "unknown": ~known}, by, gate)
    kr, ur = ratio(F.col("known"), F.col("total_known")), ratio(F.col("unknown"), F.col("total_unknown"))
    return best_threshold(t, kr <= limit + EPS, [ur, -kr, F.col("t")], {"known_reject": kr, "unknown_reject": ur}, by)


def held_out_thresholds(rows: DataFrame, group: str, score: str, known: Column, right: Column, limit: float = 0.1, digits: int = 3) -> DataFrame:
    """For each group a threshold calibrated on all other groups (as ``at_false_accepts``), and the group's own rates at it.

    Counts of the others are the whole table's less the group's own, cumulated over rounded scores. So a group has as
    many rows as there are rounded scores, which ``digits`` bounds, whatever the number of rows or other groups.
    """
    kinds = {"correct": known & right, "wrong": known & ~right, "unknown": ~known}
    per = rows.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(group, F.round(F.col(score), digits).alias("t")).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    whole = per.groupBy("t").agg(*[F.sum(n).alias(n) for n in kinds])
    line = whole.agg(F.collect_list(F.struct("t", *kinds)).alias("line"))  # one row of rounded scores
    entry = lambda t, *counts: F.struct(t.alias("t"), *[c.alias(n) for c, n in zip(counts, kinds, strict=True)])
    zero = [F.lit(0).cast("long")] * len(kinds)
    ends = F.array(*[entry(F.lit(float(x)), *zero) for x in ("-inf", "inf")])
    groups = per.select(group).distinct().join(line, how="cross").select(group, F.inline(F.concat("line", ends)))
    own = per.select(group, "t", *[F.col(n).alias(f"own_{n}") for n in kinds])
    grid = groups.join(own, [group, "t"], "left").na.fill(0, [f"own_{n}" for n in kinds])
    falling = Window.partitionBy(group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    sums = {}
    for n in kinds:
        rest = F.col(n) - F.col(f"own_{n}")
        sums |= {f"c_{n}": F.sum(rest).over(falling), f"all_{n}": F.sum(rest).over(every), f"h_{n}": F.sum(f"own_{n}").over(falling), f"held_{n}": F.sum(f"own_{n}").over(every)}
    table = grid.select(group, "t", *[c.alias(n) for n, c in sums.items()])

    def rates(now: str, total: str) -> list[Column]:
        n = F.col(f"{total}_correct") + F.col(f"{total}_wrong")
        return [ratio(F.col(f"{now}_correct"), n), ratio(F.col(f"{now}_wrong"), n), ratio(F.col(f"{now}_unknown"), F.col(f"{total}_unknown"))]

    ca, wi, far = rates("c", "all")
    names = ("correct_accept", "wrong_intent", "false_accept")
    out = dict(zip(names, (ca, wi, far), strict=True)) | {f"held_{n}": c for n, c in zip(names, rates("h", "held"), strict=True)}
    return best_threshold(table, far <= limit + EPS, [ca, -wi, -far, F.col("t")], out, [group])


def quantile_grid(rows: DataFrame, column: str, steps: int, digits: int = 6, margin: float = 1e-6) -> list[float]:
    """Distinct quantiles of a column and a value beyond either end: a list of bounded length."""
    q = rows.agg(F.percentile(F.round(column, digits), F.array(*[F.lit(i / steps) for i in range(steps + 1)]))).first()[0]
    return sorted({q[0] - margin, *q, q[-1] + margin})


def grid_table(rows: DataFrame, score: str, margin: str, scores: list[float], margins: list[float], counted: dict[str, Column], digits: int = 6) -> DataFrame:
    """Counts accepted at every cell of a grid of two thresholds (score >= s and margin >= m).

    Rows are counted by the cell they reach, then summed along both axes: the work grows
    with rows plus cells, not with their product.
    """
    place = lambda c, grid: F.aggregate(F.array(*[F.lit(g) for g in grid]), F.lit(0), lambda n, g: n + (F.round(c, digits) >= g).cast("int"))
    reached = rows.groupBy(place(F.col(score), scores).alias("i"), place(F.col(margin), margins).alias("j")).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    axis = lambda n: F.sequence(F.lit(0), F.lit(n))
    dense = rows.sparkSession.range(1).select(F.explode(axis(len(scores))).alias("i")).select("i", F.explode(axis(len(margins))).alias("j"))
    full = dense.join(reached, ["i", "j"], "left").na.fill(0)
    along_i = Window.partitionBy("j").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    along_j = Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    for w in (along_i, along_j):
        full = full.select("i", "j", *[F.sum(n).over(w).alias(n) for n in counted])
    pick = lambda grid, at: F.element_at(F.array(*[F.lit(g) for g in grid]), F.col(at))
    return full.where("i > 0 and j > 0").select(pick(scores, "i").alias("s"), pick(margins, "j").alias("m"), *counted)


#: Cells of a range of scores, if there are no more margins than that.
RANGE_CELLS = 1 << 18


def exact_2d(rows: DataFrame, min_unknown_reject: float = 0.85, digits: int = 6, range_cells: int = RANGE_CELLS) -> DataFrame:
    """All pairs of observed thresholds: the one with most correct accepts whose unknown rejects reach the limit.

    ``rows``: known, right (booleans), score, margin. Rows are counted by rounded score and margin, and these cells are
    dealt to as many ranges of scores as their number asks for. A range starts from the counts per margin of all higher
    ranges; it has no fewer cells than there are margins, so what is carried is no more than the cells themselves.

    For a score, the least margin that rejects enough unknown rows is a quantile of the margins from there up, and the best
    margin is the least one of a right row from it on, for which no right row is lost. Both come from a descent through
    the bits of margin ranks, of all scores of a range at once: logarithmic work per cell.

    Ties: fewer wrong accepts, fewer unknown accepts, greater score, greater margin (infinity without right rows). Rows
    without a score are accepted nowhere, rows without a margin by no margin; both count in the rates. No rows with a
    score, or a limit that nothing reaches, give no row.
    """
    kinds = {"right": F.col("known") & F.col("right"), "wrong": F.col("known") & ~F.col("right"), "unknown": ~F.col("known")}
    score, margin = F.round("score", digits).alias("s"), F.coalesce(F.round("margin", digits), F.lit(float("nan"))).alias("m")
    cells = rows.where(F.col("score").isNotNull()).groupBy(score, margin).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    known, unknown = rows.agg(F.count_if(F.col("known")), F.count_if(~F.col("known"))).first()
    n_known, n_unknown = max(known, 1), max(unknown, 1)
    most = most_accepted(n_unknown, min_unknown_reject)
    many, margins = cells.agg(F.count("*"), F.approx_count_distinct("m")).first()
    ranges = max(1, -(-many // max(range_cells, margins)))
    bounds = sorted(set(cells.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or [])) if ranges > 1 else []
    # range 0 has the highest scores
    place = F.lit(len(bounds)) - F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("s"))) if bounds else F.lit(0)
    cells = cells.withColumn("range", place)
    per = cells.where(~F.isnan("m")).groupBy("m", "range").agg(*[F.sum(n).alias(n) for n in kinds])
    held = per.groupBy("m").agg(F.collect_list(F.struct("range", *kinds)).alias("held"), F.min("range").alias("first"))
    held = held.where(F.col("first") < len(bounds)).select("m", "held", F.explode(F.sequence(F.col("first") + 1, F.lit(len(bounds)))).alias("range"))
    above = lambda n: F.aggregate("held", F.lit(0).cast("long"), lambda t, x: t + F.when(x["range"] < F.col("range"), x[n]).otherwise(0)).alias(n)
    carried = held.select(F.lit(None).cast("double").alias("s"), "m", *[above(n) for n in kinds], "range")
    dealt = carried.unionByName(cells) if bounds else cells

    def search(table: pa.Table) -> pa.Table:
        names = ["right", "wrong", "unknown", "s", "m"]
        best = best_of_range(*(table.column(n).to_numpy() for n in (*names[3:], *names[:3])), most)
        return pa.table({n: pa.array([best[i]] if best else [], pa.int64() if i < 3 else pa.float64()) for i, n in enumerate(names)})

    found = dealt.groupBy("range").applyInArrow(search, "right long, wrong long, unknown long, s double, m double")
    key = F.struct("right", (-F.col("wrong")).alias("w"), (-F.col("unknown")).alias("u"), "s", "m")
    best = found.agg(F.max_by(F.struct("right", "wrong", "unknown", "s", "m"), key).alias("b")).where("b is not null").select("b.*")
    share = lambda n, of: F.col(n) / F.lit(float(of))
    return best.select(share("right", n_known).alias("correct_accept"), share("wrong", n_known).alias("wrong_intent"), (1 - share("unknown", n_unknown)).alias("unknown_reject"), F.col("s").alias("score_threshold"), F.col("m").alias("margin_threshold"))


def most_accepted(n_unknown: int, min_unknown_reject: float) -> int:
    """The greatest number of accepted unknown rows that keeps the rejects at the limit; -1 if none does."""
    n = min(n_unknown, int((1 - min_unknown_reject) * n_unknown) + 1)
    while n >= 0 and 1 - n / n_unknown < min_unknown_reject - EPS:
        n -= 1
    return n


def _levels(rank: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From the highest bit of the ranks down: its weight, which elements have it, and the order of the elements (by the bits before)."""
    order = np.arange(len(rank))
    for bit in range(bits - 1, -1, -1):
        ones = (rank[order] >> bit) & 1 == 1
        yield 1 << bit, ones, order
        order = np.concatenate([order[~ones], order[ones]])


class _Prefixes:
    """The elements before ``end`` (one number per query), halved by the bits of their ranks."""

    def __init__(self, rank: np.ndarray, end: np.ndarray, many: int):
        self.rank, self.end, self.bits = rank, end, max(1, int(many).bit_length())

    def _walk(self, weights: tuple[np.ndarray, ...], upper):
        """Goes to the upper half where ``upper(bit, weights of that half)`` says so, else to the lower one; returns the weights of the last."""
        low, high = np.zeros(len(self.end), np.int64), self.end.copy()
        for bit, ones, order in _levels(self.rank, self.bits):
            before = np.concatenate([[0], np.cumsum(ones)])
            zeros = len(ones) - before[-1]
            sums = [np.concatenate([[0], np.cumsum(np.where(ones, w[order], 0))]) for w in weights]
            go = upper(bit, [s[high] - s[low] for s in sums])
            low, high = (np.where(go, zeros + before[x], x - before[x]) for x in (low, high))
        last = np.concatenate([order[~ones], order[ones]])
        sums = [np.concatenate([[0], np.cumsum(w[last])]) for w in weights]
        return [s[high] - s[low] for s in sums]

    def last_above(self, weight: np.ndarray, quota: np.ndarray) -> np.ndarray:
        """The greatest rank from which on the weights exceed the quota; -1 without."""
        rank, left = np.zeros(len(self.end), np.int64), quota.astype(np.int64)

        def upper(bit, sums):
            nonlocal rank, left
            go = sums[0] > left
            rank, left = rank + np.where(go, bit, 0), left - np.where(go, 0, sums[0])
            return go

        (rest,) = self._walk((weight,), upper)
        return np.where(rest > left, rank, -1)

    def sums_from(self, rank: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
        """The weights from ``rank`` on, which is less than the number of ranks."""
        total = [np.zeros(len(self.end), np.int64) for _ in weights]

        def upper(bit, sums):
            go = rank & bit != 0
            for t, s in zip(total, sums, strict=True):
                t += np.where(go, 0, s)
            return go

        return [t + s for t, s in zip(total, self._walk(weights, upper), strict=True)]


def best_of_range(s: np.ndarray, m: np.ndarray, right: np.ndarray, wrong: np.ndarray, unknown: np.ndarray, most: int) -> tuple | None:
    """right, wrong, unknown, score and margin of the best pair of thresholds among a range's scores; rows without a score are carried from above."""
    own = ~np.isnan(s)
    if most < 0 or not own.any():
        return None
    order = np.lexsort((-s, own))
    s, m, right, wrong, unknown = (x[order] for x in (s, m, right, wrong, unknown))
    none = np.isnan(m)
    right, wrong, unknown = (np.where(none, 0, x) for x in (right, wrong, unknown))
    margins = np.unique(m[~none])
    rank = np.where(none, 0, np.searchsorted(margins, np.where(none, 0, m)))
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True) & ~np.isnan(s))
    prefixes = _Prefixes(rank, last + 1, len(margins))
    least = prefixes.last_above(unknown, np.full(len(last), most)) + 1
    (r,) = prefixes.sums_from(np.minimum(least, max(len(margins) - 1, 0)), right)
    r = np.where(least < len(margins), r, 0)
    at = np.clip(prefixes.last_above(right, r - 1), 0, max(len(margins) - 1, 0))
    w, u = prefixes.sums_from(at, wrong, unknown)
    w, u = np.where(r > 0, w, 0), np.where(r > 0, u, 0)
    threshold = np.where(r > 0, margins[at] if len(margins) else np.inf, np.inf)
    best = np.lexsort((threshold, s[last], -u, -w, r))[-1]
    return int(r[best]), int(w[best]), int(u[best]), float(s[last[best]]), float(threshold[best])


def gated_threshold(rows: DataFrame, score: str, true: str, pred: str, classes: list, limits: dict[str, float], by: list[str] = ()) -> DataFrame:
    """One-dimensional search under five constraints with macro-F1: the best passing threshold, else the least violation.

    Per-class counts are cumulated with the others, so every candidate's F1 comes from the same window.
    """
    from tessera.operators.metrics import gate_pass, gate_violation

    known = F.col(true).isNotNull()
    right = known & (F.col(true) == F.col(pred))
    counted = {"correct": right, "wrong": known & ~right, "unknown": ~known}
    for i, c in enumerate(classes):
        counted |= {f"tp{i}": right & (F.col(true) == c), f"pp{i}": known & (F.col(pred) == c), f"ap{i}": known & (F.col(true) == c)}
    t = threshold_table(rows, score, {k: F.coalesce(v, F.lit(False)) for k, v in counted.items()}, by)
    f1 = F.lit(0.0)
    for i in range(len(classes)):
        f1 = f1 + ratio(2.0 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col(f"total_ap{i}"))
    n = F.col("total_correct") + F.col("total_wrong")
    rates = t.select(
        *by,
        F.col("t").alias("threshold"),
        (f1 / F.lit(float(len(classes)))).alias("macro_f1"),
        ratio(F.col("correct"), n).alias("correct_accept"),
        ratio(F.col("wrong"), n).alias("wrong_intent"),
        (1 - ratio(F.col("correct") + F.col("wrong"), n)).alias("known_reject"),
        (1 - ratio(F.col("unknown"), F.col("total_unknown"))).alias("unknown_reject"),
    )
    judged = rates.withColumn("passed", gate_pass(limits)).withColumn("violation", gate_violation(limits))
    rest = [c for c in judged.columns if c not in by]
    key = F.struct("passed", F.when(F.col("passed"), F.col("macro_f1")).otherwise(-F.col("violation")).alias("k"), "correct_accept", "threshold")
    return judged.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("b")).select(*by, "b.*")


@F.pandas_udf(T.DoubleType())
def next_after(x: pd.Series, toward: pd.Series) -> pd.Series:
    """The next double in a direction: sentinel candidates just beyond observed scores."""
    return pd.Series(np.nextafter(x.to_numpy(np.float64), toward.to_numpy(np.float64)))
