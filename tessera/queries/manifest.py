"""Manifest contracts, task views, inventories and audits, on documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import compatibility_phrase, delimiter_of, first_present, normalized_phrase
from tessera.operators import contracts, inventory, views
from tessera.session import table

DRIVER_VOCABULARY = contracts.Vocabulary(datasets=("docs",), languages=("en", "de", "fr"), record_types=("speech",))
PHRASES = ("The", "Of", "And", "Is", "In", "De", "La", "Der", "Die", "To")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows; split, role and domain follow from hashes, never from id modulo n."""
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    split = F.when(F.substring(h, 64, 1) <= "9", "train").when(F.substring(h, 64, 1) <= "c", "dev").otherwise("test")
    role = F.when(split == "train", "train").when(F.substring(h, 63, 1) < "8", "enrollment").otherwise("eval")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("utt_id"),
        F.lit("docs").alias("dataset"),
        F.concat(F.when(F.col("doc_id") % 97 == 0, "../").otherwise(""), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("audio_relpath"),
        F.when(F.col("doc_id") % 89 != 0, F.col("source")).alias("speaker_id"),
        F.element_at(F.split("text", r"[ \n]"), 1).alias("label"),
        F.lit(None).cast("string").alias("transcript"),
        F.col("lang").alias("language"),
        split.alias("split"),
        F.when(F.col("lang") == "en", "control").otherwise("dysarthria").alias("domain"),
        role.alias("role"),
        F.lit("speech").alias("record_type"),
        F.lit(16000).alias("sample_rate_hz"),
        F.lit(1).alias("num_channels"),
        F.col("n_chars").alias("num_frames"),
        (F.col("n_chars") / 100.0).alias("duration_sec"),
        F.lit(contracts.SCHEMA_VERSION).alias("schema_version"),
    )


MANIFEST_SQL = r"""
h AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT *, CASE WHEN substr(h, 64, 1) <= '9' THEN 'train' WHEN substr(h, 64, 1) <= 'c' THEN 'dev' ELSE 'test' END AS split FROM h),
manifest AS (
  SELECT doc_id, 'doc:' || doc_id AS utt_id, CASE WHEN doc_id % 97 = 0 THEN '../' ELSE '' END || source || '/' || lang || '/' || doc_id || '.txt' AS audio_relpath,
    CASE WHEN doc_id % 89 <> 0 THEN source END AS speaker_id, regexp_extract(text, '^[^ \n]*') AS label, lang AS language, split,
    CASE WHEN lang = 'en' THEN 'control' ELSE 'dysarthria' END AS domain,
    CASE WHEN split = 'train' THEN 'train' WHEN substr(h, 63, 1) < '8' THEN 'enrollment' ELSE 'eval' END AS role, n_chars, n_chars / 100.0::DOUBLE AS duration_sec, text
  FROM s
)"""

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm_sql(column: str) -> str:
    return f"replace(lower(regexp_replace(replace({column}, '<p>', ''), '{SPACE}', '', 'g')), 'ß', 'ss')"



def _canon_sql(column: str, phrases: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{views._fold(p)}' THEN '{p}'" for p in phrases)
    return f"CASE {norm_sql(column)} {cases} END"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def with_manifest(select: str) -> str:
    return f"WITH {MANIFEST_SQL.strip()}, {select.strip()}" if select.lstrip()[:6].upper() != "SELECT" else f"WITH {MANIFEST_SQL.strip()} {select.strip()}"


@query(with_manifest("""
SELECT utt_id, concat_ws(',', CASE WHEN doc_id % 97 = 0 THEN 'escaping_path' END, CASE WHEN language = 'es' THEN 'language' END, CASE WHEN speaker_id IS NULL THEN 'speech_speaker' END) AS violations
FROM manifest WHERE doc_id % 97 = 0 OR language = 'es' OR speaker_id IS NULL"""))
def manifest_rule_violations(spark, sf_dir):
    checked = contracts.with_violations(manifest(spark, sf_dir), contracts.manifest_rules(DRIVER_VOCABULARY))
    return checked.where(F.size("violations") > 0).select("utt_id", F.array_join("violations", ",").alias("violations"))


@query(f"""SELECT phrase, count(*) AS n, count(DISTINCT word) AS n_variants FROM (SELECT word, {norm_sql('word')} AS phrase FROM documents, unnest(string_split(text, ' ')) AS t(word)) GROUP BY phrase HAVING count(DISTINCT word) > 1""")
def normalized_text_variants(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))  # each distinct word is normalized once
    return counts.groupBy(normalized_phrase(F.col("word")).alias("phrase")).agg(F.sum("n").alias("n"), F.count("*").alias("n_variants")).where("n_variants > 1")


@query(f"""SELECT doc_id, sha256({norm_sql('text')}) AS folded, CAST(length({norm_sql('text')}) AS INTEGER) AS n FROM documents""")
def casefold_text(spark, sf_dir):
    folded = compatibility_phrase(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", folded.alias("t"))
    return rows.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("folded"), F.length("t").alias("n"))


_VIEW = "split, domain, role, speaker_id FROM manifest"


@query(with_manifest(f"SELECT utt_id, 'closed_set' AS task_view, label AS task_label, true AS is_target, label AS canonical_target, {_VIEW} WHERE label IN {PHRASES}"))
def task_view_closed(spark, sf_dir):
    return views.closed_set(manifest(spark, sf_dir), PHRASES, strict=False)


@query(with_manifest(f"SELECT utt_id, 'personalized_wake' AS task_view, coalesce({_canon_sql('label', PHRASES)}, '__NON_WAKE__') AS task_label, {_canon_sql('label', PHRASES)} IS NOT NULL AS is_target, {_canon_sql('label', PHRASES)} AS canonical_target, {_VIEW} WHERE domain = 'dysarthria' AND split IN ('dev', 'test')"))
def task_view_personalized(spark, sf_dir):
    return views.personalized_wake(manifest(spark, sf_dir), PHRASES)


@query(with_manifest(f"SELECT utt_id, 'exact_phrases' AS task_view, {_canon_sql('label', PHRASES[3:])} AS task_label, label AS raw_transcript, false AS is_wake_word, false AS is_open_set, {_VIEW} WHERE {_canon_sql('label', PHRASES[3:])} IS NOT NULL"))
def task_view_commands(spark, sf_dir):
    return views.exact_phrases(manifest(spark, sf_dir), PHRASES, PHRASES[:3], without_wake=True)


@query(with_manifest(f"SELECT utt_id, 'common_phrases' AS task_view, coalesce({_canon_sql('label', PHRASES[:3])}, label) AS task_label, {_canon_sql('label', PHRASES[:3])} IS NOT NULL AS is_target, {_canon_sql('label', PHRASES[:3])} AS canonical_target, {_VIEW} WHERE coalesce({_canon_sql('label', PHRASES[:3])}, label) IN {PHRASES}"))
def task_view_common(spark, sf_dir):
    return views.common_phrases(manifest(spark, sf_dir), PHRASES, PHRASES[:3])


@query(with_manifest(f"SELECT utt_id, 'open_set' AS task_view, '__OPEN_SET__' AS task_label, trim(label) AS raw_transcript, false AS is_wake_word, true AS is_open_set, {_VIEW} WHERE split IN ('dev', 'test') AND trim(label) <> '' AND {_canon_sql('label', PHRASES)} IS NULL"))
def task_view_open(spark, sf_dir):
    return views.open_set(manifest(spark, sf_dir), PHRASES)


@query(with_manifest("""SELECT label, count(*) AS n, count(DISTINCT speaker_id) AS speakers, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'enrollment') AS n_enrollment, count(*) FILTER (role = 'eval') AS n_eval, count(*) FILTER (domain = 'control') AS n_control, count(*) FILTER (domain = 'dysarthria') AS n_dysarthria,
count(DISTINCT speaker_id) FILTER (role = 'enrollment') AS enrollment_speakers, count(DISTINCT speaker_id) FILTER (role = 'eval') AS eval_speakers FROM manifest GROUP BY label"""))
def label_stats(spark, sf_dir):
    return inventory.label_stats(manifest(spark, sf_dir))


_INVENTORY = f"""
base AS (SELECT {norm_sql('label')} AS phrase, label AS raw, speaker_id, domain, split FROM manifest),
vars AS (SELECT phrase, count(*) AS n_variants, string_agg(raw || ':' || n, ';' ORDER BY n DESC, raw) AS variants FROM (SELECT phrase, raw, count(*) AS n FROM base GROUP BY ALL) GROUP BY phrase),
inv AS (SELECT phrase, count(*) AS n, count(DISTINCT speaker_id) AS speakers, count(*) FILTER (domain = 'control') AS n_control, count(*) FILTER (domain = 'dysarthria') AS n_dysarthria, count(*) FILTER (domain = 'control' AND split = 'train') AS control_train, count(*) FILTER (domain = 'dysarthria' AND split = 'train') AS dysarthria_train,
count(DISTINCT speaker_id) FILTER (domain = 'control') AS control_speakers, count(DISTINCT speaker_id) FILTER (domain = 'dysarthria') AS dysarthria_speakers FROM base GROUP BY phrase)"""


def _inventory(spark, sf_dir):
    return inventory.phrase_inventory(manifest(spark, sf_dir), normalized_phrase(F.col("label")), F.col("label"))


@query(with_manifest(_INVENTORY + " SELECT inv.*, CAST(n_variants AS INTEGER) AS n_variants, variants FROM inv JOIN vars USING (phrase)"))
def phrase_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).withColumn("variants", F.array_join("variants", ";"))


@query(with_manifest(_INVENTORY + """ SELECT CAST(a AS INTEGER) AS min_control, CAST(b AS INTEGER) AS min_dysarthria, count(*) FILTER (control_speakers >= a AND dysarthria_speakers >= b) AS phrases, CAST(coalesce(sum(n) FILTER (control_speakers >= a AND dysarthria_speakers >= b), 0) AS BIGINT) AS rows
FROM inv, unnest([1, 3, 5]) AS x(a), unnest([1, 3, 5]) AS y(b) GROUP BY a, b"""))
def support_threshold_sweep(spark, sf_dir):
    return inventory.support_sweep(_inventory(spark, sf_dir), [1, 3, 5], [1, 3, 5])


@query(with_manifest(_INVENTORY + " SELECT phrase, n, n_control, n_dysarthria FROM inv ORDER BY least(n_control, n_dysarthria) DESC, speakers DESC, n DESC, phrase LIMIT 20"))
def best_supported_phrases(spark, sf_dir):
    c = F.col
    return _inventory(spark, sf_dir).orderBy(F.least("n_control", "n_dysarthria").desc(), c("speakers").desc(), c("n").desc(), "phrase").limit(20).select("phrase", "n", "n_control", "n_dysarthria")


@query(with_manifest("SELECT split, role, domain, count(*) AS n, CAST(grouping(split, role, domain) AS BIGINT) AS \"grouping\" FROM manifest GROUP BY GROUPING SETS ((split), (role), (domain), (split, domain), ())"))
def cross_tabs(spark, sf_dir):
    return inventory.cross_tabs(manifest(spark, sf_dir), [("split",), ("role",), ("domain",), ("split", "domain"), ()])


@query("""SELECT CASE WHEN d = 1 THEN '=1s' WHEN d <= 0.5 THEN '<=0.5s' WHEN d < 1 THEN '<1s' WHEN d <= 2 THEN '<=2s' WHEN d <= 5 THEN '<=5s' WHEN d <= 10 THEN '<=10s' ELSE '>10s' END AS bucket, count(*) AS n FROM (SELECT n_chars / 100.0::DOUBLE AS d FROM documents) GROUP BY 1""")
def duration_histogram(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy(views.duration_bucket(F.col("duration_sec")).alias("bucket")).agg(F.count("*").alias("n"))


@query(with_manifest("SELECT frequency, count(*) AS n_keys FROM (SELECT label, count(*) AS frequency FROM manifest GROUP BY label) GROUP BY frequency"))
def frequency_of_frequencies(spark, sf_dir):
    return inventory.frequency_of_frequencies(manifest(spark, sf_dir), "label")


@query("SELECT lang, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return inventory.duplicate_keys(docs, "lang", "digest")


@query(with_manifest("held AS (SELECT DISTINCT label, split FROM manifest) SELECT x.split AS a, y.split AS b, count(*) AS n_shared FROM held x JOIN held y ON x.label = y.label AND x.split <= y.split GROUP BY ALL"))
def split_label_overlap(spark, sf_dir):
    return inventory.inventory_overlap(manifest(spark, sf_dir), "label", "split")


@query(with_manifest("SELECT speaker_id, string_agg(DISTINCT split, '+' ORDER BY split) AS splits, count(*) AS n FROM manifest WHERE speaker_id IS NOT NULL GROUP BY speaker_id HAVING count(DISTINCT split) > 1"))
def speaker_leakage(spark, sf_dir):
    return inventory.leaking_keys(manifest(spark, sf_dir), "speaker_id")


_TARGETS = ["De", "Der", "Die", "La"]


@query(with_manifest(f"""rows_ AS (SELECT * FROM manifest WHERE domain = 'dysarthria' AND split IN ('dev', 'test') AND speaker_id IS NOT NULL),
held AS (SELECT speaker_id, count(DISTINCT label) FILTER (label IN {tuple(_TARGETS)} AND role = 'enrollment') AS enrolled, count(DISTINCT label) FILTER (label IN {tuple(_TARGETS)} AND role = 'eval') AS evaluated,
count(*) FILTER (label NOT IN {tuple(_TARGETS)} AND role = 'eval') AS negatives, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM rows_ GROUP BY speaker_id),
gaps AS (SELECT speaker_id, r, string_agg(t, ',' ORDER BY t) AS missing FROM held, unnest({_TARGETS}) AS x(t), unnest(['enrollment', 'eval']) AS y(r) WHERE NOT EXISTS (SELECT 1 FROM rows_ WHERE rows_.speaker_id = held.speaker_id AND label = t AND role = r) GROUP BY ALL)
SELECT held.speaker_id, CAST(enrolled AS INTEGER) AS enrolled, CAST(evaluated AS INTEGER) AS evaluated, coalesce(a.missing, '') AS missing_enrollment, coalesce(b.missing, '') AS missing_eval, negatives, splits
FROM held LEFT JOIN gaps a ON a.speaker_id = held.speaker_id AND a.r = 'enrollment' LEFT JOIN gaps b ON b.speaker_id = held.speaker_id AND b.r = 'eval'"""))
def personalized_protocol_stats(spark, sf_dir):
    rows = manifest(spark, sf_dir).where((F.col("domain") == "dysarthria") & F.col("split").isin("dev", "test") & F.col("speaker_id").isNotNull())
    return inventory.personalized_stats(rows, _TARGETS)


@query("SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS repetitions FROM (SELECT DISTINCT count(*) AS n FROM events GROUP BY user_id, event_type)")
def repetition_values(spark, sf_dir):
    return inventory.repetition_values(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(with_manifest("""ranked AS (SELECT audio_relpath AS p, len(string_split(audio_relpath, '/')) AS depth, row_number() OVER (PARTITION BY len(string_split(audio_relpath, '/')) ORDER BY audio_relpath) AS r FROM manifest)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, string_agg(p, ',' ORDER BY p) FILTER (r <= 3) AS examples FROM ranked GROUP BY depth"""))
def path_depths(spark, sf_dir):
    return inventory.path_depths(manifest(spark, sf_dir), "audio_relpath")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'only_left' WHEN d.doc_id IS NULL THEN 'only_right' ELSE 'matched' END AS state, count(*) AS n FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def label_file_reconcile(spark, sf_dir):
    return inventory.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) AS n_left, count(l.doc_id) AS n_matched, count(*) - count(l.doc_id) AS n_missing, count(*) FILTER (l.doc_id IS NOT NULL AND l.quality <> CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END) AS n_different FROM documents d LEFT JOIN labels l USING (doc_id)")
def task_cache_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("quality"))
    return inventory.match_report(docs, table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])


@query("""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' WHEN doc_id IN (SELECT doc_id FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents) WHERE trim(s) IN (SELECT trim(s) FROM (SELECT unnest(string_split(text, '.')) AS s FROM benchmark) WHERE trim(s) <> '')) THEN 'benchmark' END AS reason FROM documents) GROUP BY 1""")
def exposure_exclusion_reasons(spark, sf_dir):
    """A document goes if any sentence of it is one of a sealed text."""
    sentence = lambda rows, *keep: rows.select(*keep, F.explode(F.split("text", r"\.")).alias("s")).select(*keep, F.trim("s").alias("s")).where("s <> ''")
    documents = table(spark, sf_dir, "documents")
    held = sentence(documents, "doc_id").join(sentence(table(spark, sf_dir, "benchmark")).distinct(), "s", "left_semi")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    out = inventory.exclusion_reasons(documents.select("doc_id", F.trim("text").alias("t")), {"empty": F.col("t") == "", "toxic": toxic, "benchmark": held}, "doc_id")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), bw AS (SELECT w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM bw, unnest(range(1, len(w) - k + 2)) AS t(i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
held AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k), unnest(range(1, len(w) - k + 2)) AS t(i)) JOIN grams USING (k, gram))
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' WHEN doc_id IN (SELECT doc_id FROM held) THEN 'benchmark' END AS reason FROM documents) GROUP BY 1""")
def exposure_phrase_reasons(spark, sf_dir):
    """``exposure_exclusion_reasons`` by windows of 13 words, wherever sentences begin and end."""
    docs = table(spark, sf_dir, "documents")
    held = inventory.holding_phrases(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    out = inventory.exclusion_reasons(docs.select("doc_id", F.trim("text").alias("t")), {"empty": F.col("t") == "", "toxic": toxic, "benchmark": held}, "doc_id")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL) USING (user_id, event_type) WHERE user_id IN (SELECT user_id FROM events WHERE value > 50) AND event_type IN (SELECT event_type FROM events WHERE value > 50)")
def dense_user_type_grid(spark, sf_dir):
    return inventory.dense_grid(table(spark, sf_dir, "events").where("value > 50"), "user_id", "event_type")


@query("""SELECT * FROM (SELECT lang, s.source, CASE WHEN d.source IS NULL THEN 'missing' END AS state FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 8000) d USING (lang, source)) WHERE state IS NOT NULL""")
def missing_grid_cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    keys = docs.groupBy("source").agg(F.lit(1)).select("source", F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])).alias("lang"))
    return inventory.missing_cells(keys, docs.where("n_chars > 8000"), ["lang", "source"])


@query("SELECT source, CAST(sum(n) AS BIGINT) AS n, string_agg(coalesce(lang, 'null') || '=' || n, ',' ORDER BY lang) AS by_inner FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def nested_domain_counts(spark, sf_dir):
    return inventory.nested_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT median(n) AS median, quantile_cont(n, 0.9) AS p90, max(n) AS max, count(*) FILTER (n >= 2) AS at_least_2, count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n >= 10) AS at_least_10, count(*) FILTER (n >= 15) AS at_least_15 FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def phrase_support_summary(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return pairs.agg(*inventory.phrase_support_summary(F.col("n")))


@query("""SELECT shot, CAST(sum(labels) AS BIGINT) AS eligible_pairs, count(*) FILTER (labels >= 2) AS episode_speakers, CAST(sum(queries) AS BIGINT) AS queries, median(labels) AS median_labels FROM (
SELECT CAST(shot AS INTEGER) AS shot, user_id, count(*) AS labels, sum(n - shot) AS queries FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), unnest([1, 2, 5, 10, 15]) AS t(shot) WHERE n >= shot + 1 GROUP BY ALL) GROUP BY shot""")
def shot_feasibility(spark, sf_dir):
    return inventory.shot_feasibility(table(spark, sf_dir, "events"), "user_id", "event_type", [1, 2, 5, 10, 15])


@query(with_manifest("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id FROM (SELECT DISTINCT label FROM manifest WHERE split = 'train')"))
def class_map(spark, sf_dir):
    return views.class_map(manifest(spark, sf_dir), "label")


@query("SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '^[^|]*')), ''), lang) AS value, CASE WHEN contains(text, chr(9)) THEN 'tab' WHEN contains(text, '|') THEN 'pipe' WHEN contains(text, ',') THEN 'comma' WHEN contains(text, ';') THEN 'semicolon' WHEN contains(text, ' ') THEN 'space' ELSE 'none' END AS delimiter FROM documents")
def field_fallback_and_delimiter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", first_present(F.substring_index("text", "|", 1), F.col("lang")).alias("value"), delimiter_of(F.col("text")).alias("delimiter"))


LINES_SQL = "lines AS (SELECT doc_id, lang, CAST(i AS INTEGER) AS line_no, parts[i] AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i))"


def text_lines(spark, sf_dir):
    """Every line of every document, numbered from 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return docs.select("doc_id", "lang", (F.col("at") + 1).alias("line_no"), "line")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(nullif(trim(regexp_extract(line, '^[^|]*')), ''), lang) AS value, CASE WHEN contains(line, chr(9)) THEN 'tab' WHEN contains(line, '|') THEN 'pipe' WHEN contains(line, ',') THEN 'comma' WHEN contains(line, ';') THEN 'semicolon' WHEN contains(line, ' ') THEN 'space' ELSE 'none' END AS delimiter FROM lines")
def line_fields_and_delimiters(spark, sf_dir):
    """``field_fallback_and_delimiter`` line by line."""
    return text_lines(spark, sf_dir).select("doc_id", "line_no", first_present(F.substring_index("line", "|", 1), F.col("lang")).alias("value"), delimiter_of(F.col("line")).alias("delimiter"))


@query(with_manifest("SELECT true AS contiguous, count(DISTINCT label) AS classes FROM manifest WHERE split = 'train'"))
def contiguous_class_ids(spark, sf_dir):
    return views.class_map(manifest(spark, sf_dir), "label").agg(*views.contiguous(F.col("class_id")))


@query("SELECT k AS key, count(*) AS n FROM events, unnest(json_keys(props)) AS t(k) WHERE regexp_matches(k, '(?i)k|session') GROUP BY k")
def session_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.where(F.col("key").rlike("(?i)k|session")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS min, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag")
def price_summary(spark, sf_dir):
    out = inventory.group_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", "n", "min", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "max")


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS orders, round(sum(value), 2) AS value FROM (
SELECT o_orderkey, o_custkey, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL) JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def order_value_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return orders.join(lines, "o_orderkey").join(customers, "o_custkey").groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("value"), 2).alias("value"))


@query(with_manifest("""SELECT count(DISTINCT label) AS labels, count(DISTINCT label) FILTER (split = 'train') AS train_labels, count(DISTINCT split) = 3 AS all_splits, bool_and(role <> 'none') AS roles_set, min(n) >= 1 AS supported FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM manifest)"""))
def policy_gate(spark, sf_dir):
    rows = manifest(spark, sf_dir)
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_and(F.col("role") != "none").alias("r"), F.collect_set("split").alias("s"))
    return per.agg(F.count("*").alias("labels"), F.count_if("in_train").alias("train_labels"), (F.bool_or(F.array_contains("s", "train")) & F.bool_or(F.array_contains("s", "dev")) & F.bool_or(F.array_contains("s", "test"))).alias("all_splits"), F.bool_and("r").alias("roles_set"), (F.min("n") >= 1).alias("supported"))
