"""Prototypes, scores of every class, evidence, fusion and decision policies.

The best classes of a query come from ``nearest.top_classes``, for any number of classes. ``scored``
gives the scores of all of them, as many per query as there are classes, and is for reports
that list every class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import linear, softmax
from tessera.functions.vectors import as_doubles, at_quantile, bound, cosine, dot, l2_normalized

def class_means(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector per group; components are averaged with partial sums before the shuffle."""
    parts = rows.select(*keys, F.posexplode(as_doubles(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def prototypes(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Unit class means."""
    return class_means(rows, keys, vector).select(*keys, l2_normalized(F.col("mean")).alias("prototype"))


#: Classes that one row may hold.
MOST_CLASSES = 100_000


def gathered(protos: DataFrame, label: str) -> DataFrame:
    """One row: array of (label, prototype) by label. More than ``MOST_CLASSES`` fail; ``nearest.top_classes`` takes any number."""
    few = F.when(F.count("*") > MOST_CLASSES, F.raise_error(F.lit(f"more than {MOST_CLASSES} classes in one row")).cast("int")).otherwise(0)
    held = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "prototype"))).alias("protos")
    return protos.agg(held, few.alias("few")).where("few = 0").select("protos")


def second_scores(rows: DataFrame, protos: DataFrame, key: str, label: str, candidates: str, score) -> DataFrame:
    """key and ``second``: a score of each candidate (in their order) from its prototype, looked up by label.

    ``score`` gives it from the columns of ``rows`` and ``prototype``.
    """
    each = rows.select("*", F.posexplode(candidates).alias("__at", "__c"))
    held = each.join(protos.select(F.col(label).alias("__label"), "prototype"), F.col("__c.label") == F.col("__label"))
    found = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", score.alias("s")))).alias("second"))
    return found.select(key, F.transform("second", lambda x: x["s"]).alias("second"))


def mean_pair_cosine(protos: DataFrame) -> DataFrame:
    """Mean cosine of all pairs of unit prototypes, from their sum: no pair is made."""
    parts = protos.select(F.posexplode("prototype").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    n = F.max("n")
    return parts.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (n * (n - 1))).alias("prototype_cosine"))


def scored(queries: DataFrame, protos: DataFrame, label: str, vector: str, out: str = "ranked") -> DataFrame:
    """Adds all classes by falling cosine as array<struct<score, label>>; ties go to the smaller label."""
    unit = queries.withColumn("__unit", l2_normalized(F.col(vector))).join(gathered(protos, label), how="cross")
    minus = F.transform("protos", lambda p: F.struct((-dot(F.col("__unit"), p["prototype"])).alias("minus"), p["label"].alias("label")))
    ranked = F.transform(F.array_sort(minus), lambda s: F.struct((-s["minus"]).alias("score"), s["label"].alias("label")))
    return unit.withColumn(out, ranked).drop("__unit", "protos")


def top1(ranked: Column) -> list[Column]:
    """pred, score and margin to the second; the margin of a single class is 0."""
    first = F.element_at(ranked, 1)
    second = F.element_at(ranked, F.least(F.lit(2), F.size(ranked)))
    return [first["label"].alias("pred"), first["score"].alias("score"), (first["score"] - second["score"]).alias("margin")]


def top_k(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, k)


def rerank(candidates: Column, weight: float, second: Column) -> Column:
    """Candidates by falling fused score of their own and a second score (same order), with both kept."""
    both = F.zip_with(candidates, second, lambda c, s: F.struct((-(F.lit(weight) * c["score"] + F.lit(1 - weight) * s)).alias("minus"), c["label"].alias("label"), c["score"].alias("first"), s.alias("second")))
    return F.transform(F.array_sort(both), lambda x: F.struct((-x["minus"]).alias("fused"), x["label"].alias("label"), x["first"].alias("first"), x["second"].alias("second")))


def consistency_features(similarities: Column, score: Column, margin: Column) -> list[Column]:
    """Fourteen features of a query's similarities to the enrollment of its predicted class."""
    s = F.array_sort(similarities)
    n = F.size(s)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(s) / n
    std = F.sqrt(total(F.transform(s, lambda x: (x - mean) * (x - mean))) / n)
    tail = lambda k: total(F.slice(s, F.greatest(n - k + 1, F.lit(1)), F.lit(k))) / F.least(F.lit(k), n)
    head = total(F.slice(s, 1, 3)) / F.least(F.lit(3), n)
    low, high = F.element_at(s, 1), F.element_at(s, -1)
    names = ["top1", "margin", "mean", "std", "min", "q25", "median", "q75", "max", "top3_mean", "top5_mean", "bottom3_mean", "top1_minus_mean", "range"]
    values = [score, margin, mean, std, low, at_quantile(s, 0.25), at_quantile(s, 0.5), at_quantile(s, 0.75), high, tail(3), tail(5), head, score - mean, high - low]
    return [v.alias(k) for k, v in zip(names, values, strict=True)]


#: Names of the decision evidence, in the order of a linear head's weights.
EVIDENCE = ("fused_top1", "fused_margin", "global_top1", "global_margin", "aligned_top1", "aligned_margin", "winners_agree", "duration_log_ratio", "log_shot", "support_mean", "support_min")


def decision_evidence(reranked: Column, duration_log_ratio: Column, shot: Column, support: Column) -> list[Column]:
    """Eleven features of a reranked candidate list; ``support`` holds the query's cosines to the winner's enrollment."""
    a = F.element_at(reranked, 1)
    b = F.element_at(reranked, F.least(F.lit(2), F.size(reranked)))
    best = lambda f: F.element_at(F.array_sort(F.transform(reranked, lambda x: F.struct((-x[f]).alias("m"), x["label"].alias("label")))), 1)["label"]
    mean = F.aggregate(support, F.lit(0.0), lambda s, x: s + x) / F.size(support)
    values = [a["fused"], a["fused"] - b["fused"], a["first"], a["first"] - b["first"], a["second"], a["second"] - b["second"], F.when(best("first") == best("second"), 1.0).otherwise(0.0), duration_log_ratio, F.log(shot.cast("double")), mean, F.array_min(support)]
    return [v.alias(k) for k, v in zip(EVIDENCE, values, strict=True)]


def head_scores(features: list[Column], weight: list[list[float]], bias: list[float], mean: list[float], std: list[float]) -> list[Column]:
    """Softmax scores C, W, U of a linear head over standardized features."""
    z = [(f - F.lit(m)) / F.lit(s) for f, m, s in zip(features, mean, std, strict=True)]
    return [s.alias(n) for n, s in zip("CWU", softmax(*[linear(w, b, z) for w, b in zip(weight, bias, strict=True)]), strict=True)]


def decide(c: Column, w: Column, u: Column, accept: float, reject: float) -> Column:
    """ACCEPT, REJECT or CONFIRM; the first of equal scores leads, in the order C, W, U."""
    top = F.greatest(c, w, u)
    leader = F.when(c == top, "C").when(w == top, "W").otherwise("U")
    return F.when((leader == "C") & (c >= accept), "ACCEPT").when((leader == "U") & (u >= reject), "REJECT").otherwise("CONFIRM")


def contributions(features: dict[str, Column], weights: list[float], bias: float, keep: list[str]) -> list[Column]:
    """Columns for a long-form decomposition of a linear score: kept columns, feature name, contribution; one row for the bias."""
    parts = [F.struct(F.lit(n).alias("feature"), (F.lit(w) * c).alias("contribution")) for (n, c), w in zip(features.items(), weights, strict=True)]
    return [*[F.col(k) for k in keep], F.inline(F.array(*parts, F.struct(F.lit("bias").alias("feature"), F.lit(bias).alias("contribution"))))]


def subcenter_logits(vector: Column, centers: Column, scale: float = 1.0) -> Column:
    """Per class the greatest cosine to its sub-centers, scaled, without margin."""
    return bound(l2_normalized(vector), lambda unit: F.transform(centers, lambda c: F.lit(scale) * F.array_max(F.transform(c, lambda s: dot(unit, l2_normalized(s))))))


def attention_pooled(frames: Column, scores: Column) -> Column:
    """Softmax-weighted sum of frames, given a score for each."""

    def pooled(shares: Column) -> Column:
        parts = F.zip_with(frames, shares, lambda f, w: F.transform(as_doubles(f), lambda x: x * w))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))

    powers = lambda s: bound(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    return bound(scores, lambda s: bound(powers(s), lambda e: bound(shares(e), pooled)))


def margins_to_others(ranked: Column) -> Column:
    """For each candidate its score less the best other candidate's, from the first two of the ranking."""
    first, second = F.element_at(ranked, 1), F.element_at(ranked, F.least(F.lit(2), F.size(ranked)))
    return F.transform(ranked, lambda c: F.struct(c["label"].alias("label"), (c["score"] - F.when(c["label"] == first["label"], second["score"]).otherwise(first["score"])).alias("margin")))


def candidate_evidence(reranked: Column, support_mean: Column, log_shot: Column) -> Column:
    """Seven features of every candidate: fused, first and second scores, their margins to the best other, support and shot."""

    def best_other(f: str, label: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(reranked, lambda o: o["label"] != label), lambda o: o[f])), F.lit(0.0))

    return F.transform(
        reranked,
        lambda c: F.struct(c["label"].alias("label"), F.array(c["fused"], c["first"], c["second"], c["fused"] - best_other("fused", c["label"]), c["first"] - best_other("first", c["label"]), support_mean, log_shot).alias("features")),
    )


def formatted_candidates(reranked: Column, digits: int = 4) -> Column:
    """Candidates as one line of text, best first."""
    return F.array_join(F.transform(reranked, lambda c: F.concat(c["label"].cast("string"), F.lit("="), F.format_number(c["fused"], digits))), "; ")


def cluster_members(clusters: DataFrame, segments: DataFrame, label: str, member: str, order: str) -> DataFrame:
    """Label clusters -> members -> segment rows; a segment listed twice stays with the label that comes first."""
    each = clusters.select(label, F.col(order).alias("__o"), F.explode("members").alias(member))
    first = each.groupBy(member).agg(F.min_by(F.col(label), F.struct("__o", label)).alias(label))
    return first.join(segments, member)


def frame_parity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per pair of frame sequences: mean, least and 5th percentile cosine and greatest difference; other shapes give NaN and infinity."""
    same = (F.size(a) == F.size(b)) & (F.size(F.element_at(a, 1)) == F.size(F.element_at(b, 1)))
    zipped = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    frames = pairs.where(same).select(key, F.explode(zipped).alias("f")).select(key, cosine(F.col("f.x"), F.col("f.y")).alias("c"), F.array_max(F.zip_with(as_doubles(F.col("f.x")), as_doubles(F.col("f.y")), lambda x, y: F.abs(x - y))).alias("d"))
    found = frames.groupBy(key).agg(F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.percentile("c", F.lit(0.05)).alias("p05_cosine"), F.max("d").alias("max_abs"))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    other = pairs.where(~F.coalesce(same, F.lit(False))).select(key, nan.alias("mean_cosine"), nan.alias("min_cosine"), nan.alias("p05_cosine"), inf.alias("max_abs"))
    return found.unionByName(other)
