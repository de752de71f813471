"""Runs, sessions, spans, alignment and streaming equivalents on events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.scoring import distance_to_similarity, fused, log_ratio
from tessera.functions.times import epoch_seconds
from tessera.functions.vectors import chunk_means, cosine, l2_normalized, standardized
from tessera.operators import retrieval, sequences
from tessera.queries.vectors import RANKED_SQL, enrollment, ranked, trials
from tessera.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


RUNS_SQL = """
o AS (SELECT user_id, value > 50 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
c AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY user_id ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS new FROM o),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT user_id, run, any_value(flag) AS flag, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS length FROM n GROUP BY ALL)"""


def _runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return sequences.runs(events, ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query(f'WITH {RUNS_SQL.strip()} SELECT user_id, CAST(run AS BIGINT) AS run, flag, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", length FROM runs')
def activity_islands(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"""WITH {RUNS_SQL.strip()}, g AS (SELECT *, sum(CASE WHEN flag AND length >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS span FROM runs)
SELECT user_id, CAST(span AS BIGINT) AS span, CAST(min("start") AS INTEGER) AS "start", CAST(max("end") AS INTEGER) AS "end" FROM g WHERE NOT (flag AND length >= 2) GROUP BY user_id, span HAVING max("end") - min("start") >= 3""")
def spans_between_runs(spark, sf_dir):
    return sequences.spans_between(_runs(spark, sf_dir), ["user_id"], 2, 3)


SESSIONS_SQL = """
t AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec FROM events), c AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= {gap} OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS session FROM c),
sessions AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(sec) AS "start", max(sec) AS "end", count(*) AS n FROM n GROUP BY ALL)"""


@query(f"WITH {SESSIONS_SQL.strip().format(gap=1800)} SELECT user_id, session, round(\"start\", 3) AS \"start\", round(\"end\", 3) AS \"end\", n FROM sessions")
def session_spans(spark, sf_dir):
    out = sequences.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 1800)
    return out.withColumns({c: F.round(c, 3) for c in ("start", "end")})


@query(f"WITH {SESSIONS_SQL.strip().format(gap=1800)} SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM sessions GROUP BY user_id")
def session_counts(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


MERGED_SQL = SESSIONS_SQL.strip().format(gap=7200) + """,
l AS (SELECT user_id, "start", "end", lead("start") OVER w AS s1, lead("end") OVER w AS e1, lead("start", 2) OVER w AS s2, lead("end", 2) OVER w AS e2 FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")),
spans AS (SELECT user_id, CAST(1 AS INTEGER) AS atoms, "start", "end" FROM l UNION ALL SELECT user_id, 2, "start", e1 FROM l WHERE s1 - "end" <= 14400 UNION ALL SELECT user_id, 3, "start", e2 FROM l WHERE s1 - "end" <= 14400 AND s2 - e1 <= 14400)"""


def _merged(spark, sf_dir):
    atoms = sequences.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 7200)
    return sequences.candidate_spans(atoms, ["user_id"], 3, 14400)


@query(f'WITH {MERGED_SQL} SELECT user_id, atoms, round("start", 3) AS "start", round("end", 3) AS "end" FROM spans')
def merged_spans(spark, sf_dir):
    return _merged(spark, sf_dir).withColumns({c: F.round(c, 3) for c in ("start", "end")})


#: The dynamic program of each user by recursion over spans in order of end, then the way back through it.
SCHEDULE_SQL = f"""WITH RECURSIVE {MERGED_SQL},
scored AS (SELECT *, atoms / 3.0::DOUBLE + 0.2::DOUBLE * (("end" - "start") / 86400.0::DOUBLE) AS score FROM spans),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end", "start") AS i FROM scored),
fits AS (SELECT a.user_id, a.i, least(a.i - 1, count(b.i)) AS fits FROM o a LEFT JOIN o b ON a.user_id = b.user_id AND b."end" <= a."start" + 0.08::DOUBLE GROUP BY a.user_id, a.i),
users AS MATERIALIZED (SELECT user_id, list(greatest(score, 0) ORDER BY i) AS w, list(fits ORDER BY i) AS f, count(*) AS n FROM o JOIN fits USING (user_id, i) GROUP BY user_id),
forth AS (SELECT user_id, 0 AS i, [0.0::DOUBLE] AS best FROM users UNION ALL SELECT user_id, i + 1, list_append(best, greatest(w[i + 1] + best[f[i + 1] + 1], best[i + 1])) FROM forth JOIN users USING (user_id) WHERE i < n),
done AS MATERIALIZED (SELECT user_id, best, w, f, n FROM forth JOIN users USING (user_id) WHERE i = n),
back AS (SELECT user_id, n AS i, 0::BIGINT AS chosen FROM done UNION ALL SELECT user_id, CASE WHEN w[i] + best[f[i] + 1] > best[i] THEN f[i] ELSE i - 1 END, CASE WHEN w[i] + best[f[i] + 1] > best[i] THEN i ELSE 0 END FROM back JOIN done USING (user_id) WHERE i >= 1)
SELECT o.user_id, atoms, round("start", 3) AS "start", round("end", 3) AS "end", round(score, 6) AS score FROM back JOIN o ON back.user_id = o.user_id AND chosen = o.i"""


@query(SCHEDULE_SQL)
def best_nonoverlapping_spans(spark, sf_dir):
    scored = _merged(spark, sf_dir).withColumn("score", sequences.ranking_score(F.col("atoms") / 3.0, (F.col("end") - F.col("start")) / 86400.0, F.lit(0.0)))
    return sequences.best_nonoverlapping(scored, ["user_id"], "score").withColumns({"start": F.round("start", 3), "end": F.round("end", 3), "score": F.round("score", 6)})


#: At 100 samples a second: silences of 5 zeros or more; frames of 2 samples, one apart; quiet runs of up to 2 frames are filled.
SPEECH_SQL = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN abs(v::DOUBLE) < 0.05::DOUBLE THEN 0 ELSE v::DOUBLE END) AS x FROM embeddings),
zeros AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM (SELECT vec_id, i FROM x, unnest(range(0, 64)) AS t(i) WHERE x[i + 1] = 0)),
cuts AS (SELECT vec_id, min(i) AS a, max(i) + 1 AS z FROM zeros GROUP BY vec_id, g HAVING count(*) >= 5),
edges AS (SELECT vec_id, coalesce(lag(z) OVER (PARTITION BY vec_id ORDER BY a), 0) AS a, a AS z FROM cuts UNION ALL SELECT vec_id, max(z), 64 FROM cuts GROUP BY vec_id),
by_zero AS (SELECT * FROM edges WHERE z > a AND z / 100.0::DOUBLE - a / 100.0::DOUBLE >= 0.02::DOUBLE QUALIFY count(*) OVER (PARTITION BY vec_id) >= 2),
loud AS (SELECT vec_id, list_transform(range(1, 64), lambda i: 20 * log10(greatest(sqrt((x[i] * x[i] + x[i + 1] * x[i + 1]) / 2 + 1e-12), 1e-8))) AS db FROM x),
levels AS (SELECT vec_id, db, greatest(s[13] + (s[14] - s[13]) * (0.2::DOUBLE * 62 - 12) + 10, s[59] + (s[60] - s[59]) * (0.95::DOUBLE * 62 - 58) - 36) AS level FROM (SELECT *, list_sort(db) AS s FROM loud)),
flags AS (SELECT vec_id, i, db[i + 1] > level AS "on", i - row_number() OVER (PARTITION BY vec_id, db[i + 1] > level ORDER BY i) AS g FROM levels, unnest(range(0, 63)) AS t(i)),
pieces AS (SELECT vec_id, "on", min(i) AS a, max(i) + 1 AS z FROM flags GROUP BY vec_id, "on", g),
filled AS (SELECT vec_id, a, z FROM pieces WHERE "on" OR (a > 0 AND z < 63 AND z - a <= 2)),
turns AS (SELECT *, sum(CASE WHEN a = before THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY a) AS g FROM (SELECT *, lag(z) OVER (PARTITION BY vec_id ORDER BY a) AS before FROM filled)),
by_energy AS (SELECT vec_id, min(a) AS a, least(64, max(z) + 1) AS z FROM turns WHERE vec_id NOT IN (SELECT vec_id FROM by_zero) GROUP BY vec_id, g HAVING max(z) - min(a) >= 2),
both_ AS (SELECT vec_id, 'zero' AS mode, a, z FROM by_zero UNION ALL SELECT vec_id, 'energy', a, z FROM by_energy)
SELECT vec_id, mode, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY a) - 1 AS INTEGER) AS "at", round(a / 100.0::DOUBLE, 4) AS "start", round(z / 100.0::DOUBLE, 4) AS "end" FROM both_"""


@query(SPEECH_SQL)
def speech_like_spans(spark, sf_dir):
    cfg = sequences.SpotterConfig(min_boundary_sec=0.05, min_phrase_sec=0.02, fill_gap_ms=20.0, min_speech_ms=20.0)
    signal = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.05, 0.0).otherwise(x))
    found = table(spark, sf_dir, "embeddings").select("vec_id", sequences.speech_spans(signal, F.lit(100), cfg).alias("f"))
    return found.select("vec_id", "f.mode", F.posexplode("f.spans").alias("at", "s")).select("vec_id", "mode", "at", F.round("s.start", 4).alias("start"), F.round("s.end", 4).alias("end"))


FRAMES = "list_transform(range(0, 8), lambda i: CAST({}[i * 8 + 1 : i * 8 + 8] AS DOUBLE[]))"

TEMPLATES_SQL = """means_ AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE vec_id % 2 = 0 GROUP BY ALL), lists_ AS (SELECT label, list(m ORDER BY i) AS v FROM means_ GROUP BY label),
near_ AS (SELECT label, vec_id, e, list_inner_product(e, v) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v))) AS cos FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 0) JOIN lists_ USING (label)),
temp AS (SELECT label, vec_id AS template, e, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS k FROM near_)"""

#: Alignment of ``both_sides`` (pid, fa, fb; as many frames on both sides) over anti-diagonals: each cell takes the least of the
#: cell above, the one before and the one across, in this order; c are costs and n path lengths, of the last diagonal and the one before.
ALIGN_SQL = """units_ AS (SELECT pid, list_transform(fa, lambda f: list_transform(f, lambda x: x / greatest(sqrt(list_inner_product(f, f)), 1e-12))) AS a, list_transform(fb, lambda f: list_transform(f, lambda x: x / greatest(sqrt(list_inner_product(f, f)), 1e-12))) AS b FROM both_sides),
local_ AS MATERIALIZED (SELECT pid, len(a) AS n, CAST(ceil(0.25 * len(a)) AS BIGINT) AS band, list_transform(a, lambda f: list_transform(b, lambda g: 1 - greatest(-1, least(1, list_inner_product(f, g))))) AS l FROM units_),
sweep AS (SELECT pid, 1::BIGINT AS k, list_transform(range(0, n + 1), lambda i: 'inf'::DOUBLE) AS pc, list_transform(range(0, n + 1), lambda i: 0::BIGINT) AS pn, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 'inf'::DOUBLE END) AS qc, list_transform(range(0, n + 1), lambda i: 0::BIGINT) AS qn FROM local_
  UNION ALL SELECT pid, k + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i >= 1 AND k + 1 - i BETWEEN 1 AND n AND abs(2 * i - k - 1) <= band THEN l[i][k + 1 - i] + least(pc[i], pc[i + 1], qc[i]) ELSE 'inf'::DOUBLE END),
    list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 WHEN pc[i] <= pc[i + 1] AND pc[i] <= qc[i] THEN pn[i] + 1 WHEN pc[i + 1] <= qc[i] THEN pn[i + 1] + 1 ELSE qn[i] + 1 END), pc, pn
  FROM sweep JOIN local_ USING (pid) WHERE k < 2 * n),
aligned AS MATERIALIZED (SELECT pid, pc[n + 1] / greatest(pn[n + 1], 1) AS distance FROM sweep JOIN local_ USING (pid) WHERE k = 2 * n)"""

RERANK_SQL = RANKED_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", {TEMPLATES_SQL},
both_sides AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r.vec_id, r.pred, template) AS pid, r.vec_id, r.pred AS label, r.score, {FRAMES.format("q.embedding")} AS fa, {FRAMES.format("temp.e")} AS fb FROM ranked r JOIN embeddings q ON q.vec_id = r.vec_id JOIN temp ON temp.label = r.pred AND k <= 2 WHERE rank <= 3),
{ALIGN_SQL},
best AS (SELECT vec_id, label, score, min(distance) AS distance, 0.75::DOUBLE * score + 0.25::DOUBLE * (1 - 0.5::DOUBLE * min(distance)) AS fused FROM both_sides JOIN aligned USING (pid) GROUP BY vec_id, label, score)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY fused DESC, label) AS INTEGER) AS rank, label, round(score, 6) AS global_score, round(distance, 6) AS distance, round(fused, 6) AS fused FROM best"""

PAIR_TABLE_SQL = f"""WITH RECURSIVE f AS (SELECT CAST(floor(vec_id / 50) AS BIGINT) AS speaker, vec_id, {FRAMES.format("embedding")} AS f FROM embeddings),
both_sides AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.vec_id, b.vec_id) AS pid, a.speaker, a.vec_id AS a, b.vec_id AS b, a.f AS fa, b.f AS fb FROM f a JOIN f b ON a.speaker = b.speaker AND a.vec_id < b.vec_id),
{ALIGN_SQL}
SELECT speaker, a, b, round(distance, 6) AS distance FROM both_sides JOIN aligned USING (pid)"""

PARTS_SQL = f"""WITH RECURSIVE {TEMPLATES_SQL},
both_ AS (SELECT q.vec_id, {FRAMES.format("q.embedding")} AS fq, {FRAMES.format("temp.e")} AS ft FROM embeddings q JOIN temp ON temp.label = q.label AND k = 1 WHERE q.vec_id % 2 = 1),
parts AS (SELECT vec_id, 0 AS part, fq AS fa, ft AS fb FROM both_ UNION ALL SELECT vec_id, 1, fq[1:4], ft[1:4] FROM both_ UNION ALL SELECT vec_id, 2, fq[5:8], ft[5:8] FROM both_),
both_sides AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, part) AS pid, * FROM parts),
{ALIGN_SQL}
SELECT vec_id, round(max(distance) FILTER (part = 0), 6) AS "whole", round(max(distance) FILTER (part = 1), 6) AS "prefix", round(max(distance) FILTER (part = 2), 6) AS "suffix" FROM both_sides JOIN aligned USING (pid) GROUP BY vec_id"""


def _templates(spark, sf_dir, k: int = 2):
    """The ``k`` enrollment rows nearest their class prototype."""
    rows = enrollment(spark, sf_dir)
    near = rows.join(retrieval.prototypes(rows, ["label"], "embedding"), "label").select("label", "vec_id", "embedding", cosine(F.col("embedding"), F.col("prototype")).alias("cos"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cos"), "vec_id"))).where(F.col("rank") <= k)


@query("""WITH means AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS t(i) WHERE vec_id % 2 = 0 GROUP BY ALL), lists AS (SELECT label, list(m ORDER BY i) AS v FROM means GROUP BY label),
c AS (SELECT label, vec_id, list_inner_product(e, v) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v))) AS cos FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 0) JOIN lists USING (label))
SELECT label, vec_id, round(cos, 6) AS cos, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS k FROM c) WHERE k <= 2""")
def representative_templates(spark, sf_dir):
    return _templates(spark, sf_dir).select("label", "vec_id", F.round("cos", 6).alias("cos"), "rank")


@query(RERANK_SQL)
def dtw_rerank(spark, sf_dir):
    """Top 3 by cosine first, alignment only for those and their two templates."""
    top = ranked(spark, sf_dir).select("vec_id", sequences.frames_of(F.col("embedding"), 8).alias("fq"), F.explode("ranked").alias("c"))
    temp = _templates(spark, sf_dir).select("label", sequences.frames_of(F.col("embedding"), 8).alias("f"))
    candidates = top.select("vec_id", F.col("c.label").alias("label"), F.col("c.score").alias("global_score"), F.col("fq").alias("f"))
    near = sequences.best_templates(candidates, temp, "vec_id", "label", "f").select("vec_id", "label", "distance")
    both = candidates.drop("f").join(near, ["vec_id", "label"]).withColumn("fused", fused(0.75, F.col("global_score"), distance_to_similarity(F.col("distance"))))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("fused"), "label"))
    return both.select("vec_id", rank.alias("rank"), "label", F.round("global_score", 6).alias("global_score"), F.round("distance", 6).alias("distance"), F.round("fused", 6).alias("fused"))


@query(PAIR_TABLE_SQL)
def dtw_pair_table(spark, sf_dir):
    """Distances within a speaker; 50 consecutive rows are one speaker's, so that no group grows with the table."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("speaker"), "vec_id", sequences.frames_of(F.col("embedding"), 8).alias("f"))
    return sequences.pair_distances(rows, "speaker", "vec_id", "f").withColumn("distance", F.round("distance", 6))


@query(PARTS_SQL)
def dtw_prefix_suffix(spark, sf_dir):
    """Distances of whole sequences, prefixes and suffixes between each trial and its class's first template."""
    temp = _templates(spark, sf_dir, 1).select("label", sequences.frames_of(F.col("embedding"), 8).alias("ft"))
    rows = trials(spark, sf_dir).select("vec_id", "label", sequences.frames_of(F.col("embedding"), 8).alias("fq")).join(temp, "label")
    d = lambda a, b: F.round(sequences.dtw_distance(a, b), 6)
    return rows.select("vec_id", d("fq", "ft").alias("whole"), d(F.slice("fq", 1, 4), F.slice("ft", 1, 4)).alias("prefix"), d(F.slice("fq", -4, 4), F.slice("ft", -4, 4)).alias("suffix"))


@query("""WITH f AS (SELECT vec_id, list_transform(range(0, 8), lambda i: CAST(embedding[i * 8 + 1 : i * 8 + 8] AS DOUBLE[])) AS f FROM embeddings), c AS (SELECT vec_id, i, list_transform(range(1, 9), lambda d: list_avg(list_transform(f[i * 3 + 1 : i * 3 + 3], lambda x: x[d]))) AS m FROM f, unnest(range(0, 3)) AS t(i))
SELECT vec_id, CAST(i AS INTEGER) AS chunk, round(list_sum(m), 6) AS total FROM c""")
def temporal_downsample(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(chunk_means(sequences.frames_of(F.col("embedding"), 8), 3)).alias("chunk", "m"))
    return chunks.select("vec_id", "chunk", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_inner_product(e[1:8], e[57:64]) / (greatest(sqrt(list_inner_product(e[1:8], e[1:8])), 1e-12) * greatest(sqrt(list_inner_product(e[57:64], e[57:64])), 1e-12)), 6) AS start_end_cosine, round(list_avg(e[1:8]) - list_avg(e), 6) AS head_offset FROM e""")
def start_end_cosine(spark, sf_dir):
    from tessera.functions.vectors import array_mean

    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.slice(e, 1, 8), F.slice(e, -8, 8)), 6).alias("start_end_cosine"), F.round(array_mean(F.slice(e, 1, 8)) - array_mean(e), 6).alias("head_offset"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round((list_max(e) - list_avg(e)) / sqrt(list_var_pop(e) + 1e-7), 6) AS top, round(list_inner_product(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))), list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 6) AS unit FROM e""")
def signal_standardized(spark, sf_dir):
    from tessera.functions.vectors import dot

    z, u = standardized(F.col("embedding")), l2_normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(z), 6).alias("top"), F.round(dot(u, u), 6).alias("unit"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, value FROM events), d AS (SELECT user_id, max(sec) - min(sec) AS span FROM s GROUP BY user_id), m AS (SELECT median(span) AS m FROM d) SELECT user_id, round(abs(ln(greatest(span, 1) / greatest(m, 1))), 6) AS log_ratio, round(ln(greatest(span, 1) / greatest(m, 1)), 6) AS signed FROM d, m""")
def duration_log_ratio(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg((epoch_seconds(F.max("ts")) - epoch_seconds(F.min("ts"))).alias("span"))
    m = F.broadcast(spans.agg(F.percentile("span", F.lit(0.5)).alias("m")))
    return spans.join(m, how="cross").select("user_id", F.round(log_ratio(F.col("span"), F.col("m")), 6).alias("log_ratio"), F.round(log_ratio(F.col("span"), F.col("m"), signed=True), 6).alias("signed"))
