"""Evaluation metrics as aggregates: counts first, ratios last, zero denominators defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided 95 % quantile of Student's t with two degrees of freedom.
T_95_DF2 = 4.302652729911275


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def share(hit: Column, base: Column | None = None) -> Column:
    """Share of rows with ``hit`` among those with ``base``; 0 where there are none."""
    base = F.lit(True) if base is None else base
    return ratio(F.count_if(hit & base), F.count_if(base))


def macro_f1(rows: DataFrame, true: str, pred: str, classes: list, by: list[str] = ()) -> DataFrame:
    """Macro-F1 over a fixed list of classes; a null prediction (rejected) is a false negative, an empty class scores 0.

    One row per class is counted as truth, prediction and hit in a single grouping.
    """
    pairs = F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("ap"), F.lit(0).alias("pp"), F.lit(0).alias("tp")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("ap"), F.lit(1).alias("pp"), F.coalesce((F.col(true) == F.col(pred)).cast("int"), F.lit(0)).alias("tp")))
    counts = rows.select(*by, F.inline(pairs)).where(F.col("c").isin(*classes)).groupBy(*by, "c").agg(F.sum("ap").alias("ap"), F.sum("pp").alias("pp"), F.sum("tp").alias("tp"))
    f1 = ratio(2.0 * F.col("tp"), F.col("pp") + F.col("ap"))
    return counts.groupBy(*by).agg((F.sum(f1) / F.lit(float(len(classes)))).alias("macro_f1"))


def open_set_rates(known: Column, accepted: Column, right: Column) -> list[Column]:
    """Correct accept, wrong intent and known reject over known rows, unknown reject over unknown rows."""
    return [
        share(accepted & right, known).alias("correct_accept"),
        share(accepted & ~right, known).alias("wrong_intent"),
        share(~accepted, known).alias("known_reject"),
        share(~accepted, ~known).alias("unknown_reject"),
    ]


def three_state_rates(known: Column, status: Column, right: Column) -> list[Column]:
    """Rates of a three-state policy; here a known reject is an explicit REJECT, CONFIRM is its own rate."""
    accept, confirm, reject = status == "ACCEPT", status == "CONFIRM", status == "REJECT"
    return [
        share(accept & right, known).alias("correct_accept"),
        share(accept & ~right, known).alias("wrong_accept"),
        share(confirm, known).alias("known_confirm"),
        share(reject, known).alias("known_reject"),
        share(accept, ~known).alias("unknown_accept"),
        share(confirm, ~known).alias("unknown_confirm"),
        share(reject, ~known).alias("unknown_reject"),
        share(accept).alias("coverage"),
        ratio(F.count_if(accept & ~(known & right)), F.count_if(accept)).alias("selective_risk"),
    ]


# The limits of the five-constraint gate.
GATE = {"macro_f1": 0.80, "correct_accept": 0.80, "wrong_intent": 0.10, "known_reject": 0.20, "unknown_reject": 0.85}
AT_MOST = ("wrong_intent", "known_reject")


def gate_parts(limits: dict[str, float] = GATE) -> dict[str, Column]:
    return {k: (F.col(k) <= v if k in AT_MOST else F.col(k) >= v) for k, v in limits.items()}


def gate_pass(limits: dict[str, float] = GATE) -> Column:
    out = F.lit(True)
    for c in gate_parts(limits).values():
        out = out & c
    return out


def gate_violation(limits: dict[str, float] = GATE) -> Column:
    """Sum of hinge violations, each relative to its limit."""
    out = F.lit(0.0)
    for k, v in limits.items():
        over = F.col(k) - v if k in AT_MOST else v - F.col(k)
        out = out + F.greatest(F.lit(0.0), over) / F.lit(v)
    return out


def seed_interval(x: Column) -> list[Column]:
    """Mean, sample deviation, standard error and 95 % interval of three seeds."""
    se = F.stddev_samp(x) / F.sqrt(F.count(x))
    half = F.lit(T_95_DF2) * se
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), se.alias("se"), (F.avg(x) - half).alias("low"), (F.avg(x) + half).alias("high")]


def repeat_summary(x: Column, digits: int = 6) -> list[Column]:
    """Mean, sample deviation and quantiles over repeats."""
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    parts = [F.avg(x), F.stddev_samp(x), F.min(x), *[F.element_at(q, i) for i in range(1, 6)], F.max(x)]
    return [F.round(p, digits).alias(n) for p, n in zip(parts, ("mean", "std", "min", "p10", "p25", "median", "p75", "p90", "max"), strict=True)]


def compared(a: Column, b: Column, tolerance: float = 1e-12) -> list[Column]:
    """How often a is better than, equal to or worse than b."""
    return [F.count_if(a > b + tolerance).alias("better"), F.count_if(F.abs(a - b) <= tolerance).alias("equal"), F.count_if(a < b - tolerance).alias("worse")]


def weighted_mean(x: Column, n: Column) -> Column:
    return ratio(F.sum(x * n), F.sum(n))


def roc(rows: DataFrame, score: str, positive: str, digits: int = 6) -> DataFrame:
    """Distinct scores (rounded, so their number is bounded) with shares of positives and negatives at or above each."""
    from pyspark.sql import Window

    at = rows.groupBy(F.round(score, digits).alias("score")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return at.select("score", (F.sum("p").over(w) / F.sum("p").over(total)).alias("tpr"), (F.sum("n").over(w) / F.sum("n").over(total)).alias("far"), "p", "n")


def auc(rows: DataFrame, score: str, positive: str, digits: int = 6) -> DataFrame:
    """Area under the ROC curve: the chance that a positive outscores a negative, ties counting half."""
    from pyspark.sql import Window

    at = rows.groupBy(F.round(score, digits).alias("score")).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return at.withColumn("below", below).agg(ratio(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))), F.sum("p") * F.sum("n")).alias("auc"))
