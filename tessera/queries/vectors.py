"""Retrieval, decisions, metrics and thresholds on embeddings, and samples on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scoring import quadratic_features, sigmoid, softmax, z_score
from tessera.functions.vectors import dot, l2_normalized
from tessera.operators import metrics, nearest, retrieval, sampling, thresholds
from tessera.operators.sequences import frames_of
from tessera.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
REGISTERED = 7  # labels below are known, the others unknown
CLASSES = list(range(10))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def enrollment(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0")


def trials(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1")


def ranked(spark, sf_dir, registered_only: bool = False, k: int = 3):
    """Trials with their ``k`` best classes."""
    support = enrollment(spark, sf_dir)
    if registered_only:
        support = support.where(F.col("label") < REGISTERED)
    top = nearest.top_classes(trials(spark, sf_dir), retrieval.prototypes(support, ["label"], "embedding"), "vec_id", "label", "embedding", k)
    return trials(spark, sf_dir).join(top.select("vec_id", "ranked"), "vec_id")


def score_table(spark, sf_dir):
    """Trials with prediction, rounded score and margin; right means known and predicted so."""
    part = F.when(F.substring(F.sha2(F.concat(F.lit("cal:"), F.col("vec_id").cast("string")).cast("binary"), 256), 1, 1) < "8", "cal").otherwise("score")
    rows = ranked(spark, sf_dir, True).select("vec_id", "label", *retrieval.top1(F.col("ranked")), part.alias("part"))
    known = F.col("label") < REGISTERED
    return rows.select("vec_id", "label", "part", "pred", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), known.alias("known"), (known & (F.col("label") == F.col("pred"))).alias("right"))


def _protos_sql(where: str = "vec_id % 2 = 0") -> str:
    return f"""
means AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE {where} GROUP BY ALL),
lists AS (SELECT label, list(m ORDER BY i) AS v FROM means GROUP BY label),
protos AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM lists)"""


UNIT_SQL = """
units AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS u FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def _ranked_sql(registered_only: bool = False) -> str:
    where = "vec_id % 2 = 0" + (f" AND label < {REGISTERED}" if registered_only else "")
    return f"""WITH {_protos_sql(where).strip()}, {UNIT_SQL.strip()},
pairs AS (SELECT vec_id, units.label, protos.label AS pred, list_inner_product(u, v) AS score FROM units, protos WHERE vec_id % 2 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pred) AS rank, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, pred) AS next FROM pairs)"""


RANKED_SQL = _ranked_sql()
SCORES_SQL = _ranked_sql(True) + f""",
scores AS (SELECT vec_id, label, CASE WHEN substr(sha256('cal:' || vec_id), 1, 1) < '8' THEN 'cal' ELSE 'score' END AS part, pred, round(score, 6) AS score, round(score - next, 6) AS margin, label < {REGISTERED} AS known, label < {REGISTERED} AND label = pred AS "right" FROM ranked WHERE rank = 1)"""


@query(f"WITH {_protos_sql().strip()} SELECT label, CAST(i AS INTEGER) AS pos, round(v[i + 1], 6) AS value FROM protos, unnest(range(0, 64)) AS t(i)")
def class_prototypes(spark, sf_dir):
    protos = retrieval.prototypes(enrollment(spark, sf_dir), ["label"], "embedding")
    return protos.select("label", F.posexplode("prototype").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("value"))


@query(_ranked_sql() + " SELECT vec_id, label, pred, round(score, 6) AS score, round(score - next, 6) AS margin FROM ranked WHERE rank = 1")
def prototype_predict(spark, sf_dir):
    out = ranked(spark, sf_dir).select("vec_id", "label", *retrieval.top1(F.col("ranked")))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query(_ranked_sql() + """, top AS (SELECT * FROM ranked WHERE rank = 1), per AS (SELECT c, (SELECT count(*) FROM top WHERE label = c AND pred = c) AS tp, (SELECT count(*) FROM top WHERE pred = c) AS pp, (SELECT count(*) FROM top WHERE label = c) AS ap FROM unnest(range(0, 10)) AS t(c))
SELECT round(avg(CASE WHEN pp + ap > 0 THEN 2.0::DOUBLE * tp / (pp + ap) ELSE 0 END), 6) AS macro_f1, (SELECT round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END), 6) FROM top) AS accuracy, (SELECT round(count(*) FILTER (rank <= 3 AND label = pred)::DOUBLE / count(DISTINCT vec_id), 6) FROM ranked) AS recall_at_3 FROM per""")
def prototype_macro_f1(spark, sf_dir):
    rows = ranked(spark, sf_dir).select("label", F.element_at("ranked", 1)["label"].alias("pred"), F.exists(retrieval.top_k(F.col("ranked"), 3), lambda c: c["label"] == F.col("label")).alias("in3"))
    f1 = metrics.macro_f1(rows, "label", "pred", CLASSES)
    rest = rows.agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("in3").cast("double")), 6).alias("recall_at_3"))
    return f1.select(F.round("macro_f1", 6).alias("macro_f1")).join(rest, how="cross")


@query(_ranked_sql() + " SELECT vec_id, CAST(rank AS INTEGER) AS rank, pred AS label, round(score, 6) AS score FROM ranked WHERE rank <= 3")
def topk_margin(spark, sf_dir):
    top = ranked(spark, sf_dir).select("vec_id", F.posexplode(retrieval.top_k(F.col("ranked"), 3)).alias("at", "c"))
    return top.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("c.label").alias("label"), F.round("c.score", 6).alias("score"))


@query(_ranked_sql() + """, own AS (SELECT avg(score) AS own FROM pairs WHERE label = pred), wrong AS (SELECT avg(s) AS best_wrong FROM (SELECT vec_id, max(score) AS s FROM pairs WHERE label <> pred GROUP BY vec_id)), inter AS (SELECT avg(list_inner_product(a.v, b.v)) AS inter FROM protos a JOIN protos b ON a.label < b.label),
dims AS (SELECT avg(s) AS spread FROM (SELECT i, stddev_pop(u[i]) AS s FROM units, unnest(range(1, 65)) AS t(i) WHERE vec_id % 2 = 1 GROUP BY i))
SELECT round(own, 6) AS own_cosine, round(best_wrong, 6) AS best_wrong_cosine, round(inter, 6) AS prototype_cosine, round(spread, 6) AS dimension_std, spread < 1e-3 AS collapsed FROM own, wrong, inter, dims""")
def embedding_diagnostics(spark, sf_dir):
    protos = retrieval.prototypes(enrollment(spark, sf_dir), ["label"], "embedding")
    # the best wrong class is one of the two best
    wrong = F.array_max(F.transform(F.filter("ranked", lambda c: c["label"] != F.col("label")), lambda c: c["score"]))
    own = dot(l2_normalized(F.col("embedding")), F.col("prototype"))
    rows = ranked(spark, sf_dir, k=2).join(protos, "label", "left")
    cosines = rows.agg(F.round(F.avg(own), 6).alias("own_cosine"), F.round(F.avg(wrong), 6).alias("best_wrong_cosine"))
    inter = retrieval.mean_pair_cosine(protos).select(F.round("prototype_cosine", 6).alias("prototype_cosine"))
    dims = trials(spark, sf_dir).select(F.posexplode(l2_normalized(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).agg(F.round(F.avg("s"), 6).alias("dimension_std"), (F.avg("s") < 1e-3).alias("collapsed"))
    return cosines.join(inter, how="cross").join(dims, how="cross")


@query(_ranked_sql() + """, shots AS (SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('enroll' || chr(0) || label || chr(0) || vec_id || chr(0)), vec_id) AS k FROM embeddings WHERE vec_id % 2 = 0) WHERE k <= 15), sims AS (SELECT r.vec_id, r.score, r.score - r.next AS margin, list(list_inner_product(q.u, e.u) ORDER BY list_inner_product(q.u, e.u)) AS s FROM ranked r JOIN units q ON q.vec_id = r.vec_id JOIN shots ON shots.label = r.pred JOIN units e ON e.vec_id = shots.vec_id WHERE r.rank = 1 GROUP BY ALL)
SELECT vec_id, round(score, 6) AS top1, round(margin, 6) AS margin, round(list_avg(s), 6) AS mean, round(list_stddev_pop(s), 6) AS std, round(s[1], 6) AS min, round(list_aggregate(s, 'quantile_cont', 0.25), 6) AS q25, round(list_median(s), 6) AS median, round(list_aggregate(s, 'quantile_cont', 0.75), 6) AS q75, round(s[-1], 6) AS max,
round(list_avg(s[-3:]), 6) AS top3_mean, round(list_avg(s[-5:]), 6) AS top5_mean, round(list_avg(s[:3]), 6) AS bottom3_mean, round(score - list_avg(s), 6) AS top1_minus_mean, round(s[-1] - s[1], 6) AS range FROM sims""")
def enrollment_consistency(spark, sf_dir):
    """Similarities of trials to the 15 shots of their predicted class, which are one row a class."""
    shots = sampling.support_sample(enrollment(spark, sf_dir).select("label", "vec_id", "embedding"), ["label"], "vec_id", 15, "enroll")
    support = shots.groupBy(F.col("label").alias("pred")).agg(F.collect_list(l2_normalized(F.col("embedding"))).alias("e"))
    top = ranked(spark, sf_dir).select("vec_id", l2_normalized(F.col("embedding")).alias("q"), *retrieval.top1(F.col("ranked")))
    sims = top.join(support, "pred").withColumn("sims", F.transform("e", lambda e: dot(F.col("q"), e)))
    features = F.array_sort("sims")  # sorted once
    out = sims.withColumn("sims", features).select("vec_id", *retrieval.consistency_features(F.col("sims"), F.col("score"), F.col("margin")))
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "vec_id"])


def _with_second(spark, sf_dir):
    """Trials with their three best classes and the scores of these from the first half of the components."""
    rows = ranked(spark, sf_dir)
    protos = retrieval.prototypes(enrollment(spark, sf_dir), ["label"], "embedding")
    half = dot(F.slice(l2_normalized(F.col("embedding")), 1, 32), F.slice("prototype", 1, 32))
    return rows.join(retrieval.second_scores(rows, protos, "vec_id", "label", "ranked", half), "vec_id")


@query(_ranked_sql() + """, two AS (SELECT r.vec_id, r.pred AS label, r.score AS first, list_inner_product(q.u[1:32], p.v[1:32]) AS second FROM ranked r JOIN units q USING (vec_id) JOIN protos p ON p.label = r.pred WHERE rank <= 3)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY 0.75::DOUBLE * first + 0.25::DOUBLE * second DESC, label) AS INTEGER) AS rank, label, round(first, 6) AS first, round(second, 6) AS second, round(0.75::DOUBLE * first + 0.25::DOUBLE * second, 6) AS fused FROM two""")
def fused_rerank(spark, sf_dir):
    rows = _with_second(spark, sf_dir)
    out = rows.select("vec_id", F.posexplode(retrieval.rerank(F.col("ranked"), 0.75, F.col("second"))).alias("at", "r"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("r.label").alias("label"), *[F.round(f"r.{n}", 6).alias(n) for n in ("first", "second", "fused")])


@query(SCORES_SQL + """ SELECT round(count(*) FILTER (known AND score >= 0.2 AND "right")::DOUBLE / count(*) FILTER (known), 6) AS correct_accept, round(count(*) FILTER (known AND score >= 0.2 AND NOT "right")::DOUBLE / count(*) FILTER (known), 6) AS wrong_intent, round(count(*) FILTER (known AND score < 0.2)::DOUBLE / count(*) FILTER (known), 6) AS known_reject, round(count(*) FILTER (NOT known AND score < 0.2)::DOUBLE / count(*) FILTER (NOT known), 6) AS unknown_reject FROM scores""")
def open_set_rates(spark, sf_dir):
    rates = score_table(spark, sf_dir).agg(*metrics.open_set_rates(F.col("known"), F.col("score") >= 0.2, F.col("right")))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


_STATE = "CASE WHEN margin >= 0.03 AND score >= 0.2 THEN 'ACCEPT' WHEN score < 0.15 THEN 'REJECT' ELSE 'CONFIRM' END"


def _share(cond: str, base: str) -> str:
    return f"round(count(*) FILTER (({base}) AND ({cond}))::DOUBLE / count(*) FILTER ({base}), 6)"


@query(SCORES_SQL + f""", s AS (SELECT *, {_STATE} AS status FROM scores) SELECT {_share("status = 'ACCEPT' AND \"right\"", 'known')} AS correct_accept, {_share("status = 'ACCEPT' AND NOT \"right\"", 'known')} AS wrong_accept, {_share("status = 'CONFIRM'", 'known')} AS known_confirm, {_share("status = 'REJECT'", 'known')} AS known_reject,
{_share("status = 'ACCEPT'", 'NOT known')} AS unknown_accept, {_share("status = 'CONFIRM'", 'NOT known')} AS unknown_confirm, {_share("status = 'REJECT'", 'NOT known')} AS unknown_reject, {_share("status = 'ACCEPT'", 'true')} AS coverage, {_share('NOT (known AND "right")', "status = 'ACCEPT'")} AS selective_risk FROM s""")
def three_state_policy(spark, sf_dir):
    rows = _with_status(score_table(spark, sf_dir))
    rates = rows.agg(*metrics.three_state_rates(F.col("known"), F.col("status"), F.col("right")))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


def _with_status(rows):
    status = F.when((F.col("margin") >= 0.03) & (F.col("score") >= 0.2), "ACCEPT").when(F.col("score") < 0.15, "REJECT").otherwise("CONFIRM")
    return rows.withColumn("status", status)


@query(SCORES_SQL + f""", s AS (SELECT *, {_STATE} AS status FROM scores), acc AS (SELECT label, string_agg(pred || '=' || n, ',' ORDER BY pred) AS accepted_as FROM (SELECT label, pred, count(*) AS n FROM s WHERE status = 'ACCEPT' GROUP BY ALL) GROUP BY label)
SELECT s.label, count(*) AS n, round(avg(CASE WHEN status = 'ACCEPT' THEN 1.0::DOUBLE ELSE 0 END), 6) AS accept, round(avg(CASE WHEN status = 'CONFIRM' THEN 1.0::DOUBLE ELSE 0 END), 6) AS confirm, round(avg(CASE WHEN status = 'REJECT' THEN 1.0::DOUBLE ELSE 0 END), 6) AS reject, coalesce(any_value(accepted_as), '') AS accepted_as FROM s LEFT JOIN acc USING (label) GROUP BY s.label""")
def per_intent_rates(spark, sf_dir):
    rows = _with_status(score_table(spark, sf_dir))
    is_ = lambda s: F.round(F.avg((F.col("status") == s).cast("double")), 6)
    rates = rows.groupBy("label").agg(F.count("*").alias("n"), is_("ACCEPT").alias("accept"), is_("CONFIRM").alias("confirm"), is_("REJECT").alias("reject"))
    counts = rows.where("status = 'ACCEPT'").groupBy("label", "pred").agg(F.count("*").alias("n"))
    named = counts.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred", "n"))), lambda x: F.concat_ws("=", x["pred"].cast("string"), x["n"].cast("string"))), ",").alias("accepted_as"))
    return rates.join(named, "label", "left").withColumn("accepted_as", F.coalesce("accepted_as", F.lit("")))


@query(SCORES_SQL + f""", s AS (SELECT *, {_STATE} AS status FROM scores) SELECT CASE WHEN known AND status = 'ACCEPT' AND pred = label THEN 'known_correct_accept' WHEN known AND status = 'ACCEPT' THEN 'known_wrong_accept' WHEN known AND status = 'CONFIRM' THEN 'known_confirm' WHEN known THEN 'known_reject' WHEN status = 'ACCEPT' THEN 'unknown_accept' WHEN status = 'CONFIRM' THEN 'unknown_confirm' ELSE 'unknown_reject' END AS outcome,
count(*) AS n, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 8) AS q25, round(median(score), 8) AS median, round(quantile_cont(score, 0.75), 8) AS q75, round(max(score), 6) AS max FROM s GROUP BY 1""")
def outcome_group_summary(spark, sf_dir):
    from tessera.operators.views import outcome_group

    rows = _with_status(score_table(spark, sf_dir))
    q = F.percentile("score", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    out = rows.groupBy(outcome_group(F.col("known"), F.col("status"), F.col("pred"), F.col("label")).alias("outcome")).agg(F.count("*").alias("n"), F.min("score").alias("min"), q.alias("q"), F.max("score").alias("max"))
    return out.select("outcome", "n", F.round("min", 6).alias("min"), *[F.round(F.element_at("q", i + 1), 8).alias(n) for i, n in enumerate(("q25", "median", "q75"))], F.round("max", 6).alias("max"))


def _candidates_sql(score: str, accept: str, key: str, feasible: str, extra: str = "") -> str:
    return SCORES_SQL + f""", cal AS (SELECT * {extra} FROM scores WHERE part = 'cal'), cand AS (SELECT DISTINCT {score} AS t FROM cal UNION SELECT 'infinity'::DOUBLE UNION SELECT '-infinity'::DOUBLE),
evals AS (SELECT t, count(*) FILTER (known AND "right" AND {accept})::DOUBLE / count(*) FILTER (known) AS ca, count(*) FILTER (known AND NOT "right" AND {accept})::DOUBLE / count(*) FILTER (known) AS wi, count(*) FILTER (NOT known AND {accept})::DOUBLE / count(*) FILTER (NOT known) AS far, count(*) FILTER (known AND {accept})::DOUBLE / count(*) FILTER (known) AS kr FROM cand, cal GROUP BY t)
SELECT {key} WHERE {feasible}"""


def _cal(spark, sf_dir):
    return score_table(spark, sf_dir).where("part = 'cal'")


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


_FAR_COLUMNS = "round(t, 6) AS threshold, round(ca, 6) AS correct_accept, round(wi, 6) AS wrong_intent, round(far, 6) AS false_accept FROM evals"


@query(_candidates_sql("score", "score >= t", _FAR_COLUMNS, "far <= 0.1 + 1e-12 ORDER BY ca DESC, wi, far, t DESC LIMIT 1"))
def threshold_at_far(spark, sf_dir):
    return _rounded(thresholds.at_false_accepts(_cal(spark, sf_dir), "score", F.col("known"), F.col("right")))


@query(_candidates_sql("score", "score >= t AND margin >= 0.02", _FAR_COLUMNS, "far <= 0.1 + 1e-12 ORDER BY ca DESC, wi, far, t DESC LIMIT 1"))
def threshold_gated(spark, sf_dir):
    return _rounded(thresholds.at_false_accepts(_cal(spark, sf_dir), "score", F.col("known"), F.col("right"), gate=F.col("margin") >= 0.02))


@query(_candidates_sql("score", "score >= t", _FAR_COLUMNS, "far <= 0.05 + 1e-12 ORDER BY ca DESC, far, kr DESC, t DESC LIMIT 1"))
def threshold_known_accepts(spark, sf_dir):
    return _rounded(thresholds.at_false_accepts(_cal(spark, sf_dir), "score", F.col("known"), F.col("right"), limit=0.05, prefer="accepted"))


@query(_candidates_sql("reject", "reject >= t", "round(t, 6) AS threshold, round(kr, 6) AS known_reject, round(far, 6) AS unknown_reject FROM evals", "kr <= 0.05 + 1e-12 ORDER BY far DESC, kr, t DESC LIMIT 1", ", round(1 - score, 6) AS reject"))
def threshold_known_rejects(spark, sf_dir):
    rows = _cal(spark, sf_dir).withColumn("reject", F.round(1 - F.col("score"), 6))
    return _rounded(thresholds.at_known_rejects(rows, "reject", F.col("known")))


_SG = [0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35]
_MG = [0.0, 0.01, 0.02, 0.04, 0.08]
_GATED = {"correct_accept": 0.05, "wrong_intent": 0.5, "known_reject": 0.7, "unknown_reject": 0.3}


@query(SCORES_SQL + f""", cells AS (SELECT s, m, count(*) FILTER (known AND "right" AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (known) AS correct_accept, count(*) FILTER (known AND NOT "right" AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (known) AS wrong_intent, 1 - count(*) FILTER (known AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (known) AS known_reject, 1 - count(*) FILTER (NOT known AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (NOT known) AS unknown_reject
FROM scores, unnest({_SG}::DOUBLE[]) AS x(s), unnest({_MG}::DOUBLE[]) AS y(m) GROUP BY ALL)
SELECT s, m, round(correct_accept, 6) AS correct_accept, round(wrong_intent, 6) AS wrong_intent, round(known_reject, 6) AS known_reject, round(unknown_reject, 6) AS unknown_reject, round(correct_accept, 6) >= 0.05 AND round(wrong_intent, 6) <= 0.5 AND round(known_reject, 6) <= 0.7 AND round(unknown_reject, 6) >= 0.3 AS passed,
round(greatest(0, 0.05 - round(correct_accept, 6)) / 0.05 + greatest(0, round(wrong_intent, 6) - 0.5) / 0.5 + greatest(0, round(known_reject, 6) - 0.7) / 0.7 + greatest(0, 0.3 - round(unknown_reject, 6)) / 0.3, 5) AS violation FROM cells""")
def threshold_grid_gate(spark, sf_dir):
    k, r = F.col("known"), F.col("right")
    rows = score_table(spark, sf_dir)
    cells = thresholds.grid_table(rows, "score", "margin", _SG, _MG, {"c": k & r, "w": k & ~r, "u": ~k})
    totals = rows.agg(F.count_if(k).alias("nk"), F.count_if(~k).alias("nu"))
    c = F.col
    rates = cells.join(F.broadcast(totals), how="cross").select("s", "m", F.round(c("c") / c("nk"), 6).alias("correct_accept"), F.round(c("w") / c("nk"), 6).alias("wrong_intent"), F.round(1 - (c("c") + c("w")) / c("nk"), 6).alias("known_reject"), F.round(1 - c("u") / c("nu"), 6).alias("unknown_reject"))
    return rates.select("*", metrics.gate_pass(_GATED).alias("passed"), F.round(metrics.gate_violation(_GATED), 5).alias("violation"))


@query(SCORES_SQL + """, cal AS (SELECT * FROM scores WHERE part = 'cal'), cells AS (SELECT s, m, count(*) FILTER (known AND "right" AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (known) AS ca, count(*) FILTER (known AND NOT "right" AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (known) AS wi, count(*) FILTER (NOT known AND score >= s AND margin >= m)::DOUBLE / count(*) FILTER (NOT known) AS far
FROM cal, (SELECT DISTINCT score AS s FROM cal), (SELECT DISTINCT margin AS m FROM cal UNION SELECT 'infinity'::DOUBLE UNION SELECT '-infinity'::DOUBLE) GROUP BY ALL)
SELECT round(ca, 6) AS correct_accept, round(wi, 6) AS wrong_intent, round(1 - far, 6) AS unknown_reject, s AS score_threshold, m AS margin_threshold FROM cells WHERE 1 - far >= 0.85 - 1e-12 ORDER BY ca DESC, wi, far, s DESC, m DESC LIMIT 1""")
def threshold_exact_2d(spark, sf_dir):
    return _rounded(thresholds.exact_2d(_cal(spark, sf_dir)))


_REPEATS = SCORES_SQL + """, parts AS (SELECT r, scores.* EXCLUDE (part), CASE WHEN substr(sha256('split' || chr(0) || r || chr(0) || vec_id || chr(0)), 1, 1) < '8' THEN 'cal' ELSE 'score' END AS part FROM scores, unnest(range(0, 20)) AS t(r)),
cand AS (SELECT DISTINCT r, score AS t FROM parts WHERE part = 'cal' UNION SELECT r, 'infinity'::DOUBLE FROM range(0, 20) AS t(r) UNION SELECT r, '-infinity'::DOUBLE FROM range(0, 20) AS t(r)),
evals AS (SELECT cand.r, t, count(*) FILTER (known AND "right" AND score >= t)::DOUBLE / count(*) FILTER (known) AS ca, count(*) FILTER (known AND NOT "right" AND score >= t)::DOUBLE / count(*) FILTER (known) AS wi, count(*) FILTER (NOT known AND score >= t)::DOUBLE / count(*) FILTER (NOT known) AS far FROM cand JOIN parts ON parts.r = cand.r AND part = 'cal' GROUP BY ALL),
chosen AS (SELECT r, t FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ca DESC, wi, far, t DESC) AS k FROM evals WHERE far <= 0.1 + 1e-12) WHERE k = 1),
results AS (SELECT r, count(*) FILTER (known AND "right" AND score >= t)::DOUBLE / count(*) FILTER (known) AS correct_accept, count(*) FILTER (NOT known AND score < t)::DOUBLE / count(*) FILTER (NOT known) AS unknown_reject FROM chosen JOIN parts USING (r) WHERE part = 'score' GROUP BY r)"""


def _repeated(spark, sf_dir):
    from tessera.functions.hashing import stable_hash

    rows = sampling.with_repeats(score_table(spark, sf_dir).drop("part"), 20)
    rows = rows.withColumn("part", F.when(F.substring(stable_hash(F.lit("split"), F.col("repeat"), F.col("vec_id")), 1, 1) < "8", "cal").otherwise("score"))
    k, r = F.col("known"), F.col("right")
    chosen = thresholds.at_false_accepts(rows.where("part = 'cal'"), "score", k, r, by=["repeat"]).select("repeat", "threshold")
    scored = rows.where("part = 'score'").join(F.broadcast(chosen), "repeat")
    return scored.groupBy("repeat").agg(*metrics.open_set_rates(k, F.col("score") >= F.col("threshold"), r))


@query(_REPEATS + ", long AS (SELECT 'correct_accept' AS metric, correct_accept AS x FROM results UNION ALL SELECT 'unknown_reject', unknown_reject FROM results) SELECT metric, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS max FROM long GROUP BY metric")
def repeated_split_summary(spark, sf_dir):
    long = _repeated(spark, sf_dir).unpivot("repeat", ["correct_accept", "unknown_reject"], "metric", "x")
    return long.groupBy("metric").agg(*metrics.repeat_summary(F.col("x")))


@query(_REPEATS + " SELECT count(*) AS repeats, count(*) FILTER (correct_accept >= 0.02 AND unknown_reject >= 0.88) AS passes, round(avg(CASE WHEN correct_accept >= 0.02 THEN 1.0::DOUBLE ELSE 0 END), 6) AS correct_accept_rate, round(avg(CASE WHEN unknown_reject >= 0.88 THEN 1.0::DOUBLE ELSE 0 END), 6) AS unknown_reject_rate, count(*) FILTER (correct_accept > 0.02 + 1e-12) AS better, count(*) FILTER (abs(correct_accept - 0.02) <= 1e-12) AS equal, count(*) FILTER (correct_accept < 0.02 - 1e-12) AS worse FROM results")
def gate_rates(spark, sf_dir):
    limits = {"correct_accept": 0.02, "unknown_reject": 0.88}
    parts = [F.round(F.avg(c.cast("double")), 6).alias(f"{n}_rate") for n, c in metrics.gate_parts(limits).items()]
    return _repeated(spark, sf_dir).agg(F.count("*").alias("repeats"), F.count_if(metrics.gate_pass(limits)).alias("passes"), *parts, *metrics.compared(F.col("correct_accept"), F.lit(0.02)))


@query(SCORES_SQL + """, p AS (SELECT score FROM scores WHERE "right"), n AS (SELECT score FROM scores WHERE NOT known) SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END), 6) AS auc FROM p, n""")
def auc_known_unknown(spark, sf_dir):
    rows = score_table(spark, sf_dir).where("right or not known")
    return _rounded(metrics.auc(rows, "score", "known"))


@query(SCORES_SQL + """, n AS (SELECT count(*) FILTER (known) AS nk, count(*) FILTER (NOT known) AS nu FROM scores), evals AS (SELECT t, count(*) FILTER (known AND scores.score >= t)::DOUBLE / any_value(nk) AS det, count(*) FILTER ("right" AND scores.score >= t)::DOUBLE / any_value(nk) AS acc, count(*) FILTER (NOT known AND scores.score >= t)::DOUBLE / any_value(nu) AS far FROM scores, n, (SELECT DISTINCT score AS t FROM scores) GROUP BY t)
SELECT f AS far_limit, round(max(det) FILTER (far <= f), 6) AS detected, round(max(acc) FILTER (far <= f), 6) AS accurate FROM evals, unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS x(f) GROUP BY f""")
def detection_at_far(spark, sf_dir):
    k, r = F.col("known"), F.col("right")
    t = thresholds.threshold_table(score_table(spark, sf_dir), "score", {"right": r, "wrong": k & ~r, "unknown": ~k}).where(F.abs("t") < float("inf"))
    nk = F.col("total_right") + F.col("total_wrong")
    cells = t.select(((F.col("right") + F.col("wrong")) / nk).alias("det"), (F.col("right") / nk).alias("acc"), (F.col("unknown") / F.col("total_unknown")).alias("far"), F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1))).alias("far_limit"))
    ok = F.col("far") <= F.col("far_limit")
    return cells.groupBy("far_limit").agg(F.round(F.max(F.when(ok, F.col("det"))), 6).alias("detected"), F.round(F.max(F.when(ok, F.col("acc"))), 6).alias("accurate"))


_TWO = """, two AS (SELECT r.vec_id, r.label AS true_label, r.pred AS label, r.score AS first, list_inner_product(q.u[1:32], p.v[1:32]) AS second FROM ranked r JOIN units q USING (vec_id) JOIN protos p ON p.label = r.pred WHERE rank <= 3),
best AS (SELECT w, vec_id, true_label, label, row_number() OVER (PARTITION BY w, vec_id ORDER BY w * first + (1 - w) * second DESC, label) AS k FROM two, unnest([0.5, 0.75, 1.0]::DOUBLE[]) AS x(w))"""


@query(_ranked_sql() + _TWO + """, per AS (SELECT w, c, count(*) FILTER (true_label = c AND label = c) AS tp, count(*) FILTER (label = c) AS pp, count(*) FILTER (true_label = c) AS ap FROM best, unnest(range(0, 10)) AS t(c) WHERE k = 1 GROUP BY ALL)
SELECT w AS weight, round(avg(CASE WHEN pp + ap > 0 THEN 2.0::DOUBLE * tp / (pp + ap) ELSE 0 END), 6) AS macro_f1 FROM per GROUP BY w ORDER BY macro_f1 DESC, w DESC LIMIT 1""")
def fusion_weight_search(spark, sf_dir):
    c = _with_second(spark, sf_dir).select("label", F.col("ranked").alias("c"), F.col("second").alias("s"))
    picks = F.array(*[F.struct(F.lit(w).alias("weight"), F.element_at(retrieval.rerank(F.col("c"), w, F.col("s")), 1)["label"].alias("pred")) for w in (0.5, 0.75, 1.0)])
    each = c.select("label", F.inline(picks))
    f1 = metrics.macro_f1(each, "label", "pred", CLASSES, ["weight"]).withColumn("macro_f1", F.round("macro_f1", 6))
    return f1.agg(F.max(F.struct("macro_f1", "weight")).alias("b")).select("b.weight", "b.macro_f1")


@query(SCORES_SQL + """, st AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scores) SELECT vec_id, round((score - m) / s, 5) AS z, round(1 / (1 + exp(-(score - m) / s)), 5) AS p, round(exp(score) / (exp(score) + exp(margin) + 1), 5) AS softmax_c, round(score * margin, 6) AS cross_term FROM scores, st""")
def score_transforms(spark, sf_dir):
    rows = score_table(spark, sf_dir)
    stats = F.broadcast(rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")))
    z = z_score(F.col("score"), F.col("m"), F.col("s"))
    return rows.join(stats, how="cross").select("vec_id", F.round(z, 5).alias("z"), F.round(sigmoid(z), 5).alias("p"), F.round(softmax(F.col("score"), F.col("margin"), F.lit(0.0))[0], 5).alias("softmax_c"), F.round(F.element_at(quadratic_features(F.col("score"), F.col("margin")), 5), 6).alias("cross_term"))


@query(SCORES_SQL + """, f AS (SELECT vec_id, score, margin FROM scores) SELECT vec_id, 'score' AS feature, round(2.0::DOUBLE * score, 6) AS contribution FROM f UNION ALL SELECT vec_id, 'margin', round(-1.0::DOUBLE * margin, 6) FROM f UNION ALL SELECT vec_id, 'bias', 0.5::DOUBLE FROM f""")
def head_contributions(spark, sf_dir):
    rows = score_table(spark, sf_dir)
    out = rows.select(*retrieval.contributions({"score": F.col("score"), "margin": F.col("margin")}, [2.0, -1.0], 0.5, ["vec_id"]))
    return out.withColumn("contribution", F.round("contribution", 6))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha256('s1' || chr(0) || user_id || chr(0) || event_type || chr(0) || event_id || chr(0)), event_id) AS k FROM events) SELECT user_id, event_type, event_id, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 2""")
def support_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return sampling.support_sample(rows, ["user_id", "event_type"], "event_id", 2, "s1")


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256('v' || chr(0) || user_id || chr(0) || event_type || chr(0)), event_type) AS k FROM d) SELECT user_id, event_type, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""")
def registered_vocab(spark, sf_dir):
    return sampling.registered_vocabulary(table(spark, sf_dir, "events"), ["user_id"], "event_type", 3, "v")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt' || chr(0) || lang || chr(0) || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= n // 2 THEN 'cal' ELSE 'score' END AS part FROM r""")
def cal_score_split(spark, sf_dir):
    return sampling.calibration_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "salt")


@query(r"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt' || '\0' || lang || '\0' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= n // 2 THEN 'cal' ELSE 'score' END AS part FROM r""")
def cal_score_split_backslash(spark, sf_dir):
    return sampling.calibration_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "salt", separator="\\0")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('n' || chr(0) || lang || chr(0) || doc_id || chr(0)), doc_id) AS k FROM documents) SELECT lang, doc_id, CAST(k AS INTEGER) AS rank, CAST(s AS INTEGER) AS shot FROM r, unnest([10, 15]) AS t(s) WHERE k <= s""")
def nested_shots(spark, sf_dir):
    return sampling.nested_shots(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", [10, 15], "n")


#: The queue of classes by recursion over batches: exposures by class, and the least exposed of them.
BATCH_SQL = """WITH RECURSIVE r AS (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY sha256('b' || chr(0) || label || chr(0) || vec_id || chr(0)), vec_id) - 1 AS BIGINT) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL),
o AS (SELECT label, any_value(n) AS n FROM r GROUP BY label), t AS (SELECT ceil(sum(n) / 12.0)::BIGINT AS batches, list(label ORDER BY label) AS labels FROM o),
deal AS (SELECT -1 AS batch, list_transform(labels, lambda x: 0) AS seen, []::INTEGER[] AS taken FROM t
  UNION ALL SELECT batch + 1, list_transform(labels, lambda x, i: seen[i] + CASE WHEN list_contains(taken, i) THEN 1 ELSE 0 END),
    list_transform(list_slice(list_sort(list_transform(labels, lambda x, i: {'e': seen[i] + CASE WHEN list_contains(taken, i) THEN 1 ELSE 0 END, 'd': sha256('b' || chr(0) || x || chr(0) || (seen[i] + CASE WHEN list_contains(taken, i) THEN 1 ELSE 0 END) || chr(0)), 'i': i})), 1, 3), lambda s: s['i'])
  FROM deal, t WHERE batch + 1 < batches),
turns AS (SELECT batch, labels[i] AS label, seen[i] AS visit FROM deal, t, unnest(taken) AS x(i))
SELECT CAST(batch AS INTEGER) AS batch, o.label, vec_id FROM turns JOIN o USING (label), unnest(range(0, 4)) AS x(s) JOIN r ON r.label = o.label AND r.r = (visit * 4 + s) % o.n"""


@query(BATCH_SQL)
def balanced_batches(spark, sf_dir):
    return sampling.balanced_batches(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 3, 4, "b")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha256('s1' || chr(0) || user_id || chr(0) || event_type || chr(0) || event_id || chr(0)), event_id) AS k FROM events) SELECT user_id, event_type, event_id, CASE WHEN k <= 2 THEN 'support' ELSE 'query' END AS part FROM r""")
def support_query_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return sampling.support_query_split(rows, ["user_id", "event_type"], "event_id", 2, "s1")


@query("SELECT count(*) AS items, CAST(0 AS BIGINT) AS n_broken FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha256('s1' || chr(0) || user_id || chr(0) || event_type || chr(0) || event_id || chr(0)), event_id) AS k FROM events) WHERE k <= 5")
def nested_shots_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    nested = sampling.nested_shots(rows, ["user_id", "event_type"], "event_id", [1, 2, 5], "s1")
    return sampling.subset_check(nested, ["user_id", "event_type", "event_id"], [1, 2, 5])


@query("""WITH f AS (SELECT vec_id, i, CAST(embedding[i * 8 + 1 : i * 8 + 8] AS DOUBLE[]) AS x FROM embeddings, unnest(range(0, 8)) AS t(i)), g AS (SELECT vec_id, x, list_transform(x, lambda v: round(v, 1)) AS y FROM f),
c AS (SELECT vec_id, list_inner_product(x, y) / (greatest(sqrt(list_inner_product(x, x)), 1e-12) * greatest(sqrt(list_inner_product(y, y)), 1e-12)) AS c, list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS d FROM g)
SELECT vec_id, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, round(quantile_cont(c, 0.05), 6) AS p05_cosine, round(max(d), 6) AS max_abs FROM c GROUP BY vec_id""")
def frame_parity(spark, sf_dir):
    """Frames against themselves rounded to one digit."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", frames_of(F.col("embedding"), 8).alias("a"), frames_of(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 1)), 8).alias("b"))
    out = retrieval.frame_parity(rows, "vec_id", "a", "b")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "vec_id"])


@query(f"""WITH {UNIT_SQL.strip()}, pairs AS (SELECT q.vec_id, e.vec_id AS enrolled, list_inner_product(q.u, e.u) AS score FROM units q, units e WHERE q.vec_id % 2 = 1 AND e.vec_id % 2 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, enrolled) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, enrolled, round(score, 6) AS score FROM top WHERE rank <= 3""")
def nearest_enrolled(spark, sf_dir):
    """The three nearest enrolled vectors of each trial: as many classes as the enrollment has rows."""
    classes = enrollment(spark, sf_dir).select(F.col("vec_id").alias("enrolled"), F.col("embedding").cast("array<double>").alias("prototype"))
    top = nearest.top_classes(trials(spark, sf_dir), classes, "vec_id", "enrolled", "embedding", 3, block=64)
    out = top.select("vec_id", F.posexplode("ranked").alias("at", "c"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("c.label").alias("enrolled"), F.round("c.score", 6).alias("score"))
