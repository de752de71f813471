"""Enrollment and recognition: memories, evidence, decisions, for any number of users at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import distance_to_similarity, log_ratio
from tessera.functions.vectors import dot, l2_normalized
from tessera.operators.retrieval import EVIDENCE, decide, decision_evidence, head_scores, prototypes, rerank
from tessera.operators.sequences import dtw_distance


@dataclass(frozen=True)
class Head:
    """A linear three-class head over the evidence, with its standardizer and thresholds by shot."""

    weight: list[list[float]]
    bias: list[float]
    mean: list[float]
    std: list[float]
    accept: float
    reject: float


def checked_enrollment(examples: DataFrame, dims: int, shots: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Examples unchanged; running it fails where a vector has other dimensions or a user's intents differ in shots."""
    bad_dims = F.size("global") != dims
    intents = examples.groupBy("user_id", "intent_id").agg(F.count("*").alias("n"))
    uneven = intents.groupBy("user_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    held = examples.join(uneven, "user_id")
    ok = ~bad_dims & (F.col("lo") == F.col("hi")) & F.col("lo").isin(*shots)
    return held.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("invalid enrollment of "), F.col("user_id"))).cast("boolean"))).drop("lo", "hi")


def recognize(queries: DataFrame, examples: DataFrame, head: Head, top_k: int = 3, fusion: float = 0.75) -> DataFrame:
    """Predictions of queries (query_id, user_id, global, temporal) from their user's memory.

    A user's prototypes are gathered in one row (few by design) and joined on the user; alignment
    runs only for the examples of the top candidates.
    """
    protos = prototypes(examples, ["user_id", "intent_id"], "global")
    per_user = protos.groupBy("user_id").agg(F.collect_list(F.struct(F.col("intent_id").alias("label"), "prototype")).alias("protos"))
    unit = queries.select("query_id", "user_id", "temporal", l2_normalized(F.col("global")).alias("q"))
    scored = F.transform("protos", lambda p: F.struct((-dot(F.col("q"), p["prototype"])).alias("minus"), p["label"].alias("label")))
    top = F.transform(F.slice(F.array_sort(scored), 1, top_k), lambda s: F.struct((-s["minus"]).alias("score"), s["label"].alias("label")))
    near = unit.join(per_user, "user_id").select("query_id", "user_id", "temporal", "q", top.alias("candidates"))
    ex = examples.select("user_id", F.col("intent_id").alias("label"), "canonical_text", F.col("temporal").alias("et"), l2_normalized(F.col("global")).alias("eg"))
    pairs = near.select("query_id", "user_id", "temporal", "q", F.posexplode("candidates").alias("at", "c")).withColumn("label", F.col("c.label")).join(ex, ["user_id", "label"])
    aligned = pairs.select("query_id", "user_id", "at", "label", "canonical_text", F.col("c.score").alias("score"), distance_to_similarity(dtw_distance("temporal", "et")).alias("sim"), dot(F.col("q"), F.col("eg")).alias("cos"), F.size("et").cast("double").alias("frames"), F.size("temporal").cast("double").alias("own_frames"))
    per = aligned.groupBy("query_id", "user_id", "at", "label").agg(F.max("sim").alias("sim"), F.first("score").alias("score"), F.first("canonical_text").alias("text"), F.collect_list("cos").alias("support"), F.percentile("frames", F.lit(0.5)).alias("median"), F.first("own_frames").alias("own"), F.count("*").alias("shot"))
    lists = per.groupBy("query_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("at", "label", "score", "sim", "text", "support", "median", "own", "shot"))).alias("c"))
    ranked = rerank(F.transform("c", lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label"))), fusion, F.transform("c", lambda x: x["sim"]))
    best = lists.select("query_id", "user_id", "c", ranked.alias("r"))
    best = best.withColumn("winner", F.element_at(F.filter("c", lambda x: x["label"] == F.element_at("r", 1)["label"]), 1))
    rows = best.select("query_id", "user_id", "r", "winner", *decision_evidence(F.col("r"), log_ratio(F.col("winner.own"), F.col("winner.median")), F.col("winner.shot"), F.col("winner.support")))
    scores = rows.select("query_id", "user_id", "r", "winner", *head_scores([F.col(e) for e in EVIDENCE], head.weight, head.bias, head.mean, head.std))
    status = decide(F.col("C"), F.col("W"), F.col("U"), head.accept, head.reject)
    return scores.withColumn("status", status).select("query_id", "user_id", "status", F.when(F.col("status") != "REJECT", F.element_at("r", 1)["label"]).alias("intent_id"), F.when(F.col("status") != "REJECT", F.col("winner.text")).alias("canonical_text"), F.col("winner.shot").alias("shot"), F.struct("C", "W", "U").alias("decision_scores"), F.col("r").alias("candidates"))
