"""Coverage checks, readiness, failures, held-out calibration and evidence, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import first_present_or_meta, flattened_keys
from tessera.operators import inventory, metrics, retrieval, selection, thresholds, views
from tessera.queries import vectors
from tessera.session import table
from tessera.sources import trees

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


HELD_OUT_SQL = vectors.SCORES_SQL + """,
b AS (SELECT vec_id % 7 AS speaker, floor(score * 1000) AS t, known, "right" FROM scores),
c AS (SELECT DISTINCT t FROM b UNION ALL SELECT 'inf'::DOUBLE UNION ALL SELECT '-inf'::DOUBLE),
m AS (SELECT g.speaker, c.t,
  count(*) FILTER (b.speaker <> g.speaker AND known) AS n, count(*) FILTER (b.speaker <> g.speaker AND NOT known) AS u,
  count(*) FILTER (b.speaker <> g.speaker AND "right" AND b.t >= c.t) AS ca, count(*) FILTER (b.speaker <> g.speaker AND known AND NOT "right" AND b.t >= c.t) AS wi, count(*) FILTER (b.speaker <> g.speaker AND NOT known AND b.t >= c.t) AS fa,
  count(*) FILTER (b.speaker = g.speaker AND known) AS hn, count(*) FILTER (b.speaker = g.speaker AND NOT known) AS hu,
  count(*) FILTER (b.speaker = g.speaker AND "right" AND b.t >= c.t) AS hca, count(*) FILTER (b.speaker = g.speaker AND known AND NOT "right" AND b.t >= c.t) AS hwi, count(*) FILTER (b.speaker = g.speaker AND NOT known AND b.t >= c.t) AS hfa
  FROM (SELECT DISTINCT speaker FROM b) g, c, b GROUP BY ALL),
r AS (SELECT speaker, t, coalesce(ca / nullif(n, 0)::DOUBLE, 0) AS ca, coalesce(wi / nullif(n, 0)::DOUBLE, 0) AS wi, coalesce(fa / nullif(u, 0)::DOUBLE, 0) AS fa, coalesce(hca / nullif(hn, 0)::DOUBLE, 0) AS hca, coalesce(hwi / nullif(hn, 0)::DOUBLE, 0) AS hwi, coalesce(hfa / nullif(hu, 0)::DOUBLE, 0) AS hfa FROM m)
SELECT speaker, t AS threshold, round(ca, 6) AS correct_accept, round(wi, 6) AS wrong_intent, round(fa, 6) AS false_accept, round(hca, 6) AS held_correct_accept, round(hwi, 6) AS held_wrong_intent, round(hfa, 6) AS held_false_accept
FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY ca DESC, wi, fa, t DESC) AS k FROM r WHERE fa <= 0.1 + 1e-12) WHERE k = 1"""


@query(HELD_OUT_SQL)
def held_out_calibration(spark, sf_dir):
    """A threshold from all other groups, judged on the group left out."""
    rows = vectors.score_table(spark, sf_dir).select((F.col("vec_id") % 7).alias("speaker"), F.floor(F.col("score") * 1000).cast("double").alias("bin"), "known", "right")
    out = thresholds.held_out_thresholds(rows, "speaker", "bin", F.col("known"), F.col("right"), digits=0)
    return out.select("speaker", "threshold", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


GATE_SQL = vectors.SCORES_SQL + """,
b AS (SELECT *, CASE WHEN known THEN label END AS truth FROM scores),
c AS (SELECT DISTINCT score AS t FROM b UNION ALL SELECT 'inf'::DOUBLE UNION ALL SELECT '-inf'::DOUBLE),
per AS (SELECT c.t, k, count(*) FILTER (truth = k AND pred = k AND score >= t) AS tp, count(*) FILTER (truth IS NOT NULL AND pred = k AND score >= t) AS pp, count(*) FILTER (truth = k) AS ap FROM c, unnest(range(0, 7)) AS u(k), b GROUP BY ALL),
f AS (SELECT t, round(sum(CASE WHEN pp + ap > 0 THEN 2.0::DOUBLE * tp / (pp + ap) ELSE 0 END) / 7, 12) AS f1 FROM per GROUP BY t),
r AS (SELECT c.t, count(*) FILTER ("right" AND score >= t)::DOUBLE / count(*) FILTER (known) AS ca, count(*) FILTER (known AND NOT "right" AND score >= t)::DOUBLE / count(*) FILTER (known) AS wi, 1 - count(*) FILTER (known AND score >= t)::DOUBLE / count(*) FILTER (known) AS kr, 1 - count(*) FILTER (NOT known AND score >= t)::DOUBLE / count(*) FILTER (NOT known) AS ur FROM c, b GROUP BY c.t)
SELECT round(f1, 6) AS macro_f1, round(ca, 6) AS correct_accept, round(wi, 6) AS wrong_intent, round(kr, 6) AS known_reject, round(ur, 6) AS unknown_reject, threshold FROM (
SELECT *, t AS threshold, row_number() OVER (ORDER BY f1 DESC, ca DESC, t DESC) AS k FROM r JOIN f USING (t) WHERE wi <= 0.5 AND ur >= 0.3) WHERE k = 1"""


@query(GATE_SQL)
def gated_threshold(spark, sf_dir):
    """The threshold of the greatest macro-F1 among those within two limits."""
    rows = vectors.score_table(spark, sf_dir).withColumn("truth", F.when(F.col("known"), F.col("label")))
    out = thresholds.gated_threshold(rows, "score", "truth", "pred", list(range(vectors.REGISTERED)), {"wrong_intent": 0.5, "unknown_reject": 0.3})
    return out.where("passed").select("threshold", *[F.round(c, 6).alias(c) for c in ("macro_f1", "correct_accept", "wrong_intent", "known_reject", "unknown_reject")])


@query("""WITH c AS (SELECT p_brand, avg(CASE WHEN p_size < 25 THEN 1.0::DOUBLE ELSE 0 END) AS gain, avg(CASE WHEN p_retailprice > 1400 THEN 1.0::DOUBLE ELSE 0 END) AS guard FROM part GROUP BY p_brand),
m AS (SELECT *, greatest(0, 0.5 - gain) + greatest(0, 0.5 - guard) AS miss FROM c)
SELECT kind, p_brand, round(gain, 6) AS gain, round(guard, 6) AS guard, round(miss, 6) AS miss FROM (
SELECT 'best_gain' AS kind, *, row_number() OVER (ORDER BY gain DESC, guard DESC, p_brand) AS k FROM m WHERE guard >= 0.5
UNION ALL SELECT 'best_guard', *, row_number() OVER (ORDER BY guard DESC, gain DESC, p_brand) FROM m WHERE gain >= 0.5
UNION ALL SELECT 'nearest', *, row_number() OVER (ORDER BY miss, gain DESC, guard DESC, p_brand) FROM m) WHERE k = 1""")
def pareto_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") < 25).cast("double")).alias("gain"), F.avg((F.col("p_retailprice") > 1400).cast("double")).alias("guard"))
    out = selection.pareto_cells(cells, ["p_brand"], "gain", "guard", 0.5, 0.5)
    return out.select("kind", "p_brand", *[F.round(c, 6).alias(c) for c in ("gain", "guard", "miss")])


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT shot, user_id, count(*) FILTER (n >= shot + 1) AS labels FROM p, unnest([1, 2, 5, 10, 15]) AS t(shot) GROUP BY ALL)
SELECT CAST(shot AS INTEGER) AS shot, count(*) FILTER (labels >= 2) AS episode_speakers, count(*) FILTER (labels = 5) AS full_speakers, CAST(sum(CASE WHEN labels >= 2 THEN labels ELSE 0 END) AS BIGINT) AS eligible_pairs, count(*) * 5 AS all_pairs, round(sum(CASE WHEN labels >= 2 THEN labels ELSE 0 END) / (count(*) * 5.0::DOUBLE), 6) AS eligible_fraction FROM s GROUP BY shot""")
def shot_readiness(spark, sf_dir):
    out = inventory.shot_readiness(table(spark, sf_dir, "events"), "user_id", "event_type", [1, 2, 5, 10, 15], 5)
    return out.withColumn("eligible_fraction", F.round("eligible_fraction", 6))


@query(vectors.SCORES_SQL + """, s AS (SELECT *, CASE WHEN score >= 0.3 THEN 'ACCEPT' WHEN score >= 0.2 THEN 'CONFIRM' ELSE 'REJECT' END AS status FROM scores)
SELECT * FROM (SELECT vec_id, status, CASE WHEN known AND status = 'ACCEPT' AND NOT "right" THEN 'KNOWN_WRONG_ACCEPT' WHEN known AND status = 'CONFIRM' THEN 'KNOWN_CONFIRM' WHEN known AND status = 'REJECT' THEN 'KNOWN_REJECT' WHEN NOT known AND status = 'ACCEPT' THEN 'UNKNOWN_FALSE_ACCEPT' END AS failure, "right" AS ranking_correct FROM s) WHERE failure IS NOT NULL""")
def failure_rows(spark, sf_dir):
    status = F.when(F.col("score") >= 0.3, "ACCEPT").when(F.col("score") >= 0.2, "CONFIRM").otherwise("REJECT")
    rows = vectors.score_table(spark, sf_dir).withColumn("status", status)
    return views.failure_rows(rows, F.col("known"), F.col("status"), F.col("pred"), F.col("label")).select("vec_id", "status", "failure", "ranking_correct")


@query("""WITH j AS (SELECT '{"event":{"session_id":1,"props":' || props || '},"path":[{"kind":2}],"' || event_type || '":0}' AS j FROM events)
SELECT key, count(*) AS n FROM (SELECT replace(replace(substr(fullkey, 3), '[0]', ''), '"', '') AS key, type FROM j, json_tree(j) WHERE fullkey <> '$' AND NOT ends_with(fullkey, ']')) WHERE regexp_matches(key, '(?i)session|k') GROUP BY key""")
def flattened_session_keys(spark, sf_dir):
    """Nested keys of metadata that name a session, by how many rows hold them."""
    text = F.concat(F.lit('{"event":{"session_id":1,"props":'), F.col("props"), F.lit('},"path":[{"kind":2}],"'), F.col("event_type"), F.lit('":0}'))
    keys = table(spark, sf_dir, "events").select(F.explode(flattened_keys(text)).alias("key"))
    return keys.where(F.col("key").rlike("(?i)session|k")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END, CAST(o_orderkey AS VARCHAR)) AS phrase FROM orders")
def nested_field_fallback(spark, sf_dir):
    """A row's own field first, then what its nested map has, in the order of the keys."""
    own = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("  ")
    meta = F.create_map(F.lit("transcript"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")), F.lit("text"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", own.alias("transcript"), meta.alias("source_meta"))
    return rows.select("o_orderkey", first_present_or_meta(["transcript"], "source_meta", ("transcript", "text")).alias("phrase"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def covered_customers(spark, sf_dir):
    """Metadata of the wanted ids; an id without exactly one row would fail the query."""
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return inventory.covered(wanted, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", unique=True)


@query(vectors._ranked_sql() + " SELECT a.vec_id, a.pred AS label, round(a.score - max(b.score), 6) AS margin FROM ranked a JOIN ranked b ON b.vec_id = a.vec_id AND b.pred <> a.pred GROUP BY a.vec_id, a.pred, a.score")
def margins_to_others(spark, sf_dir):
    protos = retrieval.prototypes(vectors.enrollment(spark, sf_dir), ["label"], "embedding")
    rows = retrieval.scored(vectors.trials(spark, sf_dir), protos, "label", "embedding").select("vec_id", F.inline(retrieval.margins_to_others(F.col("ranked"))))
    return rows.withColumn("margin", F.round("margin", 6))


@query("SELECT l_partkey, p_brand, label FROM (SELECT l_partkey, min(l_orderkey) AS label FROM lineitem GROUP BY l_partkey) JOIN part ON p_partkey = l_partkey")
def cluster_members(spark, sf_dir):
    """Orders as clusters of parts: a part stays with the first order that lists it."""
    clusters = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.collect_set("l_partkey").alias("members")).withColumn("at", F.col("label"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return retrieval.cluster_members(clusters, parts, "label", "l_partkey", "at")


@query("""SELECT utt_id, CASE WHEN lang = 'fr' THEN 'unresolved' WHEN n_chars > 3000 THEN 'split_mismatch' END AS problem, CASE WHEN lang <> 'fr' AND n_chars <= 3000 THEN '/data/' || lang || '/' || doc_id || '.txt' END AS audio
FROM (SELECT *, 'doc:' || lang || '/' || doc_id || '.txt' AS utt_id FROM documents)""")
def audio_sources(spark, sf_dir):
    """Files of all languages but one, and rows that claim another split for long documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel"))
    files = docs.where("lang <> 'fr'").select(F.concat(F.lit("/data/"), "rel").alias("path"), F.col("rel").alias("relpath"), F.split("rel", "/").alias("parts"), F.col("doc_id").cast("string").alias("stem"))
    rows = docs.select(F.concat(F.lit("doc:"), "rel").alias("utt_id"), F.lit(None).cast("string").alias("audio_relpath"), F.when(F.col("n_chars") > 3000, "long").otherwise(F.col("lang")).alias("split"))
    return trees.audio_sources(rows, files).select("utt_id", "problem", "audio")


@query(vectors.SCORES_SQL + """ SELECT part, round(count(*) FILTER (known AND score >= 0.25 AND "right") / count(*) FILTER (known)::DOUBLE, 6) AS correct_accept, round(count(*) FILTER (NOT known AND score < 0.25) / count(*) FILTER (NOT known)::DOUBLE, 6) AS unknown_reject FROM scores GROUP BY part""")
def rates_by_part(spark, sf_dir):
    rates = metrics.open_set_rates(F.col("known"), F.col("score") >= 0.25, F.col("right"))
    return vectors.score_table(spark, sf_dir).groupBy("part").agg(*rates).select("part", F.round("correct_accept", 6).alias("correct_accept"), F.round("unknown_reject", 6).alias("unknown_reject"))
