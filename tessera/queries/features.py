"""Evidence, heads, signals, hashes and mergeable counts, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import audio
from tessera.functions.hashing import canonical_json_hash, fingerprint
from tessera.functions.scoring import log_ratio
from tessera.functions.text import dataset_of
from tessera.functions.vectors import as_doubles, bound, dot, l2_normalized
from tessera.operators import inventory, retrieval, sampling, selection, sequences, thresholds, views
from tessera.plans import recognition
from tessera.queries import manifest as m
from tessera.queries import vectors
from tessera.queries.sequences import ALIGN_SQL, FRAMES
from tessera.session import table
from tessera.sources import binary

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Fixed values of the example: a head over the eleven features, C, W and U, and the two limits of a decision.
WEIGHT = [[0.8, 0.5, 1.2, 0.3, 0.1, 0.2, 0.4, -0.3, 0.05, 0.6, 0.2], [0.1, -0.4, 0.2, -0.2, 0.3, -0.1, -0.5, 0.2, 0.0, 0.1, -0.1], [-0.9, -0.1, -1.4, 0.1, 0.2, 0.3, 0.1, 0.4, -0.05, -0.7, 0.1]]
BIAS, MEAN, STD = [0.1, 0.0, -0.1], [0.1 * i for i in range(11)], [1.0 + 0.1 * i for i in range(11)]
ACCEPT, REJECT = 0.3, 0.35

#: Three best classes with a second score from half of the components, fused 0.75 to 0.25, and the winner's support.
EVIDENCE_SQL = (
    vectors._ranked_sql()
    + """, two AS (SELECT r.vec_id, r.label AS truth, r.pred AS label, r.score AS first, list_inner_product(q.u[1:32], p.v[1:32]) AS second FROM ranked r JOIN units q USING (vec_id) JOIN protos p ON p.label = r.pred WHERE rank <= 3),
f AS (SELECT *, 0.75::DOUBLE * first + (1 - 0.75::DOUBLE) * second AS fused FROM two),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY fused DESC, label) AS k, row_number() OVER (PARTITION BY vec_id ORDER BY first DESC, label) AS k1, row_number() OVER (PARTITION BY vec_id ORDER BY second DESC, label) AS k2 FROM f),
shots AS (SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('enroll' || chr(0) || label || chr(0) || vec_id || chr(0)), vec_id) AS k FROM embeddings WHERE vec_id % 2 = 0) WHERE k <= 15),
held AS (SELECT o.vec_id, avg(list_inner_product(q.u, e.u)) AS mean, min(list_inner_product(q.u, e.u)) AS least, count(*) AS shot FROM o JOIN shots USING (label) JOIN units q ON q.vec_id = o.vec_id JOIN units e ON e.vec_id = shots.vec_id WHERE o.k = 1 GROUP BY o.vec_id),
ev AS (SELECT a.vec_id, a.label, a.fused AS fused_top1, a.fused - b.fused AS fused_margin, a.first AS global_top1, a.first - b.first AS global_margin, a.second AS aligned_top1, a.second - b.second AS aligned_margin,
  CASE WHEN x.label = y.label THEN 1.0::DOUBLE ELSE 0 END AS winners_agree, abs(ln((a.vec_id % 5 + 1)::DOUBLE / (a.label % 3 + 1))) AS duration_log_ratio, ln(shot) AS log_shot, mean AS support_mean, least AS support_min
  FROM o a JOIN o b ON b.vec_id = a.vec_id AND b.k = 2 JOIN o x ON x.vec_id = a.vec_id AND x.k1 = 1 JOIN o y ON y.vec_id = a.vec_id AND y.k2 = 1 JOIN held ON held.vec_id = a.vec_id WHERE a.k = 1)"""
)


def _reranked(spark, sf_dir):
    """Trials with reranked candidates ``r`` and the cosines to the 15 shots of the winner."""
    rows = vectors._with_second(spark, sf_dir).withColumn("r", retrieval.rerank(F.col("ranked"), 0.75, F.col("second")))
    shots = sampling.support_sample(vectors.enrollment(spark, sf_dir).select("label", "vec_id", "embedding"), ["label"], "vec_id", 15, "enroll")
    support = shots.groupBy(F.col("label").alias("winner")).agg(F.collect_list(l2_normalized(F.col("embedding"))).alias("shots"))
    held = rows.withColumn("winner", F.element_at("r", 1)["label"]).join(support, "winner")
    support = bound(l2_normalized(F.col("embedding")), lambda unit: F.transform("shots", lambda e: dot(unit, e)))
    return held.select("vec_id", "label", "winner", "r", F.size("shots").alias("shot"), support.alias("support"))


def _evidence(spark, sf_dir):
    frames, own = (F.col("vec_id") % 5 + 1).cast("double"), (F.col("winner") % 3 + 1).cast("double")
    return _reranked(spark, sf_dir).select("vec_id", "winner", *retrieval.decision_evidence(F.col("r"), log_ratio(frames, own), F.col("shot"), F.col("support")))


@query(EVIDENCE_SQL + f" SELECT vec_id, label AS winner, {', '.join(f'round({e}, 6) AS {e}' for e in retrieval.EVIDENCE)} FROM ev")
def decision_evidence(spark, sf_dir):
    """Eleven features of each trial's reranked candidates."""
    out = _evidence(spark, sf_dir)
    return out.select("vec_id", "winner", *[F.round(c, 6).alias(c) for c in retrieval.EVIDENCE])


def _logit_sql(i: int) -> str:
    return f"{BIAS[i]}::DOUBLE + " + " + ".join(f"({w}::DOUBLE) * (({e} - {mu}::DOUBLE) / {s}::DOUBLE)" for w, e, mu, s in zip(WEIGHT[i], retrieval.EVIDENCE, MEAN, STD, strict=True))


DECISION_SQL = (
    EVIDENCE_SQL
    + f""", z AS (SELECT vec_id, label, exp({_logit_sql(0)}) AS c, exp({_logit_sql(1)}) AS w, exp({_logit_sql(2)}) AS u FROM ev),
p AS (SELECT vec_id, label, c / (c + w + u) AS c, w / (c + w + u) AS w, u / (c + w + u) AS u FROM z)
SELECT vec_id, round(c, 6) AS "C", round(w, 6) AS "W", round(u, 6) AS "U", CASE WHEN c >= w AND c >= u AND c >= {ACCEPT} THEN 'ACCEPT' WHEN u > c AND u > w AND u >= {REJECT} THEN 'REJECT' ELSE 'CONFIRM' END AS status FROM p"""
)


@query(DECISION_SQL)
def head_decisions(spark, sf_dir):
    """Scores of a linear head over the evidence, and what is decided by them."""
    rows = _evidence(spark, sf_dir)
    scores = rows.select("vec_id", *retrieval.head_scores([F.col(e) for e in retrieval.EVIDENCE], WEIGHT, BIAS, MEAN, STD))
    status = retrieval.decide(F.col("C"), F.col("W"), F.col("U"), ACCEPT, REJECT).alias("status")
    return scores.select("vec_id", *[F.round(c, 6).alias(c) for c in "CWU"], status)


@query(
    EVIDENCE_SQL
    + """, c AS (SELECT o.vec_id, o.label, o.fused, o.first, o.second, o.fused - max(p.fused) AS mf, o.first - max(p.first) AS ms FROM o JOIN o p ON p.vec_id = o.vec_id AND p.label <> o.label GROUP BY o.vec_id, o.label, o.fused, o.first, o.second)
SELECT vec_id, label, CAST(i AS INTEGER) AS feature, round([c.fused, c.first, c.second, c.mf, c.ms, mean, ln(shot)][i], 6) AS value FROM c JOIN held USING (vec_id), unnest(range(1, 8)) AS t(i)"""
)
def candidate_evidence(spark, sf_dir):
    """Seven features of every candidate, one row each."""
    mean = F.aggregate("support", F.lit(0.0), lambda s, x: s + x) / F.size("support")
    rows = _reranked(spark, sf_dir).select("vec_id", F.inline(retrieval.candidate_evidence(F.col("r"), mean, F.log(F.col("shot").cast("double")))))
    return rows.select("vec_id", "label", F.posexplode("features").alias("at", "x")).select("vec_id", "label", (F.col("at") + 1).alias("feature"), F.round("x", 6).alias("value"))


@query(EVIDENCE_SQL + " SELECT vec_id, string_agg(label || '=' || format('{:.4f}', fused), '; ' ORDER BY k) AS candidates FROM o GROUP BY vec_id")
def formatted_candidates(spark, sf_dir):
    return _reranked(spark, sf_dir).select("vec_id", retrieval.formatted_candidates(F.col("r")).alias("candidates"))


@query(
    "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, 1 + vec_id % 8 AS n FROM embeddings) SELECT vec_id, CAST(d AS INTEGER) AS dim, round(list_avg(list_transform(range(0, n), lambda i: e[8 * i + d + 1])), 6) AS value FROM x, unnest(range(0, 8)) AS t(d)"
)
def masked_frame_mean(spark, sf_dir):
    """Mean over the frames of a sequence that count: a vector as 8 frames, of which the first few are no padding."""
    frames = F.slice(sequences.frames_of(F.col("embedding"), 8), F.lit(1), (F.col("vec_id") % 8 + 1).cast("int"))
    total = F.aggregate(F.slice(frames, F.lit(2), F.size(frames)), as_doubles(F.element_at(frames, 1)), lambda s, v: F.zip_with(s, as_doubles(v), lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(frames))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mean).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("value"))


@query(
    """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT vec_id, i, exp(e[8 * i + 1]) AS w FROM x, unnest(range(0, 8)) AS t(i)), s AS (SELECT vec_id, sum(w) AS s FROM w GROUP BY vec_id)
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(sum(w * e[8 * i + d + 1] / s), 6) AS value FROM w JOIN s USING (vec_id) JOIN x USING (vec_id), unnest(range(0, 8)) AS t(d) GROUP BY ALL"""
)
def attention_pooled(spark, sf_dir):
    """Frames pooled by the softmax of their first components."""
    frames = sequences.frames_of(as_doubles(F.col("embedding")), 8)
    pooled = retrieval.attention_pooled(frames, F.transform(frames, lambda f: f[0]))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pooled).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("value"))


@query(vectors.SCORES_SQL + " SELECT pred, nextafter(min(score), '-infinity'::DOUBLE) = min(score) AS same_below, nextafter(min(score), '-infinity'::DOUBLE) AS below, nextafter(max(score), 'infinity'::DOUBLE) AS above FROM scores GROUP BY pred")
def boundary_candidates(spark, sf_dir):
    """The doubles next to the least and greatest score of each predicted class: thresholds that accept all or none."""
    ends = vectors.score_table(spark, sf_dir).groupBy("pred").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    below, above = thresholds.next_after(F.col("lo"), F.lit(float("-inf"))), thresholds.next_after(F.col("hi"), F.lit(float("inf")))
    return ends.select("pred", below.alias("below"), above.alias("above"), "lo").select("pred", (F.col("below") == F.col("lo")).alias("same_below"), "below", "above")


@query(
    """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (vec_id % 40) / 10.0::DOUBLE AS a FROM embeddings), s AS (SELECT vec_id, e, greatest(CAST(round((a - 0.02) * 16) AS INTEGER), 0) AS lo, least(CAST(round((a + 1.5 + 0.02) * 16) AS INTEGER), 64) AS hi FROM x)
SELECT vec_id, CAST(greatest(hi - lo, 0) AS INTEGER) AS n, round(coalesce(list_sum(e[lo + 1 : hi]), 0), 6) AS total FROM s"""
)
def padded_slices(spark, sf_dir):
    """Samples of a span of a second and a half with padding, cut to the signal, at 16 samples a second."""
    start = (F.col("vec_id") % 40) / F.lit(10.0)
    part = sequences.padded_slice(as_doubles(F.col("embedding")), F.lit(16), start, start + 1.5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", part.alias("p"))
    return rows.select("vec_id", F.size("p").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(20 * log10(greatest(list_max(list_transform(e, lambda v: abs(v))), 1e-8)), 6) AS peak, round(20 * log10(greatest(sqrt(list_sum(list_transform(e, lambda v: v * v)) / 64), 1e-8)), 6) AS rms FROM x"""
)
def signal_levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.peak_db(F.col("embedding")), 6).alias("peak"), F.round(audio.rms_db(F.col("embedding")), 6).alias("rms"))


@query("WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS bin, round(list_max(list_transform(e[(i * 64) // 12 + 1 : greatest(((i + 1) * 64) // 12, (i * 64) // 12 + 1)], lambda v: abs(v))), 6) AS level FROM x, unnest(range(0, 12)) AS t(i)")
def signal_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(audio.envelope(F.col("embedding"), 12)).alias("bin", "x"))
    return rows.select("vec_id", "bin", F.round("x", 6).alias("level"))


@query(
    """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), w AS (SELECT vec_id, f, j, e[8 * f + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS v FROM x, unnest(range(0, 7)) AS t(f), unnest(range(0, 16)) AS s(j))
SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(b AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * b * j / 16)), 2) + pow(sum(v * sin(2 * pi() * b * j / 16)), 2)), 5) + 0 AS magnitude FROM w, unnest(range(0, 9)) AS u(b) GROUP BY ALL"""
)
def signal_spectrum(spark, sf_dir):
    """Magnitudes of Hann-windowed frames of 16 samples, 8 apart."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(audio.spectrum(16, 8)("embedding")).alias("frame", "s"))
    return frames.select("vec_id", "frame", F.posexplode("s").alias("bin", "x")).select("vec_id", "frame", "bin", (F.round("x", 5) + 0).alias("magnitude"))


@query(m.with_manifest(f"SELECT utt_id, 'exact_phrases' AS task_view, {m._canon_sql('label', m.PHRASES)} AS task_label, label AS raw_transcript, {m._canon_sql('label', m.PHRASES[:3])} IS NOT NULL AS is_wake_word, false AS is_open_set, {m._VIEW} WHERE {m._canon_sql('label', m.PHRASES)} IS NOT NULL"))
def task_view_exact(spark, sf_dir):
    """All phrases by transcript, wake words among them and marked."""
    return views.exact_phrases(m.manifest(spark, sf_dir), m.PHRASES, m.PHRASES[:3])


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 2 = 0 THEN lang END) AS dataset FROM documents")
def dataset_from_id(spark, sf_dir):
    """The dataset field, or else what qualifies the id."""
    field = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" ")
    ident = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(":"))).otherwise(""), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", dataset_of(field, ident).alias("dataset"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", binary.file_digest(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT event_id, sha256('{"event":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user":' || user_id || '}') AS digest FROM events""")
def canonical_json_digests(spark, sf_dir):
    """Hashes of JSON texts whose keys come in another order and with blanks."""
    text = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "props" :'), F.col("props"), F.lit(',  "event":"'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", canonical_json_hash(text).alias("digest"))


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || '}') AS signature FROM part""")
def configuration_signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("signature"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY o_orderpriority")
def merged_distinct_customers(spark, sf_dir):
    """Distinct customers per priority from bitmaps per priority and year: parts' states, merged."""
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    yearly = inventory.distinct_state(rows, ["o_orderpriority", "year"], "o_custkey")
    return inventory.distinct_of_state(inventory.merged_state(yearly, ["o_orderpriority"]), ["o_orderpriority"])


_USER = "CAST(floor(vec_id / 2) % 2 AS BIGINT)"
_LOGITS = [_logit_sql(i) for i in range(3)]

#: Two examples of each intent per user; the query meets its own user's prototypes, then the examples of the three best.
RECOGNITION_SQL = f"""WITH RECURSIVE u AS (SELECT vec_id, label, {_USER} AS user_id, embedding, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS q FROM embeddings),
drawn AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY sha256('memory' || chr(0) || user_id || chr(0) || label || chr(0) || vec_id || chr(0)), vec_id) AS k, count(*) OVER (PARTITION BY user_id, label) AS n FROM u WHERE vec_id % 2 = 0),
ex AS (SELECT * FROM drawn WHERE k <= 2 AND n >= 2),
means AS (SELECT user_id, label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM ex, unnest(range(1, 65)) AS t(i) GROUP BY ALL),
lists AS (SELECT user_id, label, list(m ORDER BY i) AS v FROM means GROUP BY user_id, label),
pairs AS (SELECT u.vec_id, u.user_id, lists.label, list_inner_product(u.q, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))) AS score FROM u JOIN lists USING (user_id) WHERE vec_id % 2 = 1),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) <= 3),
both_sides AS MATERIALIZED (SELECT row_number() OVER (ORDER BY top.vec_id, top.label, ex.vec_id) AS pid, top.*, list_inner_product(u.q, ex.q) AS cos, {FRAMES.format("u.embedding")} AS fa, {FRAMES.format("ex.embedding")} AS fb FROM top JOIN u ON u.vec_id = top.vec_id JOIN ex ON ex.user_id = top.user_id AND ex.label = top.label),
{ALIGN_SQL},
per AS (SELECT vec_id, user_id, label, score AS first, max(1 - 0.5::DOUBLE * distance) AS second, avg(cos) AS mean, min(cos) AS least, count(*) AS shot FROM both_sides JOIN aligned USING (pid) GROUP BY vec_id, user_id, label, score),
f AS (SELECT *, 0.75::DOUBLE * first + (1 - 0.75::DOUBLE) * second AS fused FROM per),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY fused DESC, label) AS k, row_number() OVER (PARTITION BY vec_id ORDER BY first DESC, label) AS k1, row_number() OVER (PARTITION BY vec_id ORDER BY second DESC, label) AS k2 FROM f),
ev AS (SELECT a.vec_id, a.user_id, a.label, a.shot, a.fused AS fused_top1, a.fused - b.fused AS fused_margin, a.first AS global_top1, a.first - b.first AS global_margin, a.second AS aligned_top1, a.second - b.second AS aligned_margin,
  CASE WHEN x.label = y.label THEN 1.0::DOUBLE ELSE 0 END AS winners_agree, 0.0::DOUBLE AS duration_log_ratio, ln(a.shot) AS log_shot, a.mean AS support_mean, a.least AS support_min
  FROM o a JOIN o b ON b.vec_id = a.vec_id AND b.k = 2 JOIN o x ON x.vec_id = a.vec_id AND x.k1 = 1 JOIN o y ON y.vec_id = a.vec_id AND y.k2 = 1 WHERE a.k = 1),
z AS (SELECT *, exp({_LOGITS[0]}) AS c, exp({_LOGITS[1]}) AS w, exp({_LOGITS[2]}) AS r FROM ev),
p AS (SELECT vec_id, user_id, label, shot, c / (c + w + r) AS c, w / (c + w + r) AS w, r / (c + w + r) AS r FROM z),
s AS (SELECT *, CASE WHEN c >= w AND c >= r AND c >= {ACCEPT} THEN 'ACCEPT' WHEN r > c AND r > w AND r >= {REJECT} THEN 'REJECT' ELSE 'CONFIRM' END AS status FROM p)
SELECT vec_id AS query_id, user_id, status, CASE WHEN status <> 'REJECT' THEN label END AS intent_id, CASE WHEN status <> 'REJECT' THEN 'intent ' || label END AS canonical_text, shot, round(c, 6) AS "C", round(w, 6) AS "W", round(r, 6) AS "U" FROM s"""


@query(RECOGNITION_SQL)
def recognized_trials(spark, sf_dir):
    """From enrollment to a decision: two examples of each intent are a user's memory, and every trial is recognised by its user's."""
    rows = table(spark, sf_dir, "embeddings").withColumn("user_id", (F.floor(F.col("vec_id") / 2) % 2).cast("long"))
    enrolled = rows.where("vec_id % 2 = 0")
    shots = sampling.support_sample(enrolled.select("user_id", "label", "vec_id", "embedding"), ["user_id", "label"], "vec_id", 2, "memory")
    enough = shots.groupBy("user_id", "label").count().where("count = 2").select("user_id", "label")
    frames = sequences.frames_of(as_doubles(F.col("embedding")), 8)
    examples = shots.join(enough, ["user_id", "label"]).select("user_id", F.col("label").alias("intent_id"), F.concat(F.lit("intent "), F.col("label").cast("string")).alias("canonical_text"), as_doubles(F.col("embedding")).alias("global"), frames.alias("temporal"))
    trials = rows.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "user_id", as_doubles(F.col("embedding")).alias("global"), frames.alias("temporal"))
    head = recognition.Head(WEIGHT, BIAS, MEAN, STD, ACCEPT, REJECT)
    out = recognition.recognize(trials, recognition.checked_enrollment(examples, 64), head)
    return out.select("query_id", "user_id", "status", "intent_id", "canonical_text", "shot", *[F.round(f"decision_scores.{c}", 6).alias(c) for c in "CWU"])


@query("SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM documents")
def length_batches(spark, sf_dir):
    """Documents of like length in batches of 16."""
    return selection.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16)
