"""Cached features to a gated decision: prototypes, calibration on one half, metrics on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics, nearest, retrieval, thresholds


def qualify(support: DataFrame, cal: DataFrame, score: DataFrame, classes: list, limit: float = 0.1, limits: dict[str, float] = metrics.GATE) -> DataFrame:
    """One row: threshold from ``cal``, rates and macro-F1 on ``score``, gate. Tables have id, label (null: unknown) and vec."""
    protos = retrieval.prototypes(support, ["label"], "vec")

    def rows(df: DataFrame) -> DataFrame:
        best = nearest.top_classes(df, protos, "id", "label", "vec", 2).select("id", *retrieval.top1(F.col("ranked")))
        top = df.select("id", "label").join(best, "id")
        return top.withColumn("known", F.col("label").isNotNull()).withColumn("right", F.coalesce(F.col("label") == F.col("pred"), F.lit(False)))

    t = thresholds.at_false_accepts(rows(cal), "score", F.col("known"), F.col("right"), limit).select("threshold").first()[0]
    held = rows(score).withColumn("accepted", F.round("score", 6) >= F.lit(t))
    rates = held.agg(*metrics.open_set_rates(F.col("known"), F.col("accepted"), F.col("right")), F.lit(t).alias("threshold"))
    known = held.where("known").withColumn("accepted_pred", F.when(F.col("accepted"), F.col("pred")))
    f1 = metrics.macro_f1(known, "label", "accepted_pred", classes)
    return rates.join(f1, how="cross").select("*", metrics.gate_pass(limits).alias("passed"), metrics.gate_violation(limits).alias("violation"))
