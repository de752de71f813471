"""Selection among runs, set algebra, grouped summaries and formatting, on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import file_stem, label_line, markdown_row, percent
from tessera.operators import metrics, selection
from tessera.queries.manifest import LINES_SQL, text_lines
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


def _runs(spark, sf_dir):
    """Scores by family (return flag), configuration (line number) and seed (discount step)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("config"), (F.col("l_suppkey") % 3).alias("seed"), F.round(F.col("l_quantity")).cast("long").alias("q"))
    return lines.groupBy("family", "config", "seed").agg(F.round(F.avg("q"), 6).alias("score"), F.sum("q").alias("total"))


RUNS = """runs AS (SELECT l_returnflag AS family, l_linenumber AS config, l_suppkey % 3 AS seed, round(avg(CAST(round(l_quantity) AS BIGINT)), 6) AS score, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT family, config, count(*) AS n, round(avg(score), 5) AS mean, round(stddev_samp(score), 5) AS std, round(stddev_samp(score) / sqrt(count(*)), 5) AS se, round(avg(score) - 4.302652729911275 * stddev_samp(score) / sqrt(count(*)), 4) AS low, round(avg(score) + 4.302652729911275 * stddev_samp(score) / sqrt(count(*)), 4) AS high FROM runs GROUP BY ALL")
def multi_seed_interval(spark, sf_dir):
    out = _runs(spark, sf_dir).groupBy("family", "config").agg(*metrics.seed_interval(F.col("score")))
    return out.select("family", "config", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "se")], *[F.round(c, 4).alias(c) for c in ("low", "high")])


@query(f"WITH {RUNS}, m AS (SELECT family, config, CAST(sum(total) AS BIGINT) AS total FROM runs GROUP BY ALL) SELECT family, config, total FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, config) AS k FROM m) WHERE k = 1")
def best_config_per_group(spark, sf_dir):
    sums = _runs(spark, sf_dir).groupBy("family", "config").agg(F.sum("total").alias("total"))
    return selection.best_per_group(sums, "family", "total", "config")


@query(f"WITH {RUNS} SELECT family, config, seed, total FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, config * 10 + seed) AS k FROM runs) WHERE k = 1")
def checkpoint_selection(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("epoch", F.col("config") * 10 + F.col("seed"))
    return selection.selected_checkpoint(rows, "family", "total", "epoch").select("family", "config", "seed", "total")


@query(f"WITH {RUNS} SELECT family, config, seed, total FROM (SELECT *, row_number() OVER (PARTITION BY family || config ORDER BY total, seed) AS k, count(*) OVER (PARTITION BY family || config) AS n FROM runs) WHERE k = (n + 1) // 2")
def representative_seed(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("g", F.concat("family", F.col("config").cast("string")))
    return selection.median_seed(rows, "g", "total", "seed").select("family", "config", "seed", "total")


@query(f"WITH {RUNS}, w AS (SELECT family, CAST(max(total) AS BIGINT) AS total FROM runs GROUP BY family) SELECT family, total, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank, (SELECT count(*) FROM w WHERE total = (SELECT max(total) FROM w)) > 1 AS tied FROM w")
def ranked_winners(spark, sf_dir):
    winners = _runs(spark, sf_dir).groupBy("family").agg(F.max("total").alias("total"))
    return selection.ranked_winners(winners, "total", "family")


@query(f"WITH {RUNS} SELECT family, config, seed, total FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY config DESC, seed DESC) AS k FROM runs) WHERE k = 1")
def final_epoch_rows(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("epoch", F.col("config") * 10 + F.col("seed"))
    return selection.final_epochs(rows, "family", "epoch").select("family", "config", "seed", "total")


@query("SELECT o_orderstatus, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_row_per_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderdate")
    return selection.first_per_status(rows, "o_orderstatus", "o_orderdate", "o_orderkey").select("o_orderstatus", "o_orderkey", "o_custkey")


@query("WITH g AS (SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY user_id) SELECT user_id, n, round(s / n::DOUBLE, 5) AS own_mean, round(((SELECT sum(s) FROM g) - s)::DOUBLE / ((SELECT sum(n) FROM g) - n)::DOUBLE, 5) AS others_mean FROM g")
def leave_one_group_out(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.round("value").cast("long").alias("v"))
    return selection.leave_one_out_means(rows, "user_id", "v").withColumns({c: F.round(c, 5) for c in ("own_mean", "others_mean")})


@query(f"WITH {RUNS}, a AS (SELECT config * 10 + seed AS k, total FROM runs WHERE family = 'A'), r AS (SELECT config * 10 + seed AS k, total FROM runs WHERE family = 'R') SELECT a.k, a.total - r.total AS delta_total FROM a JOIN r USING (k)")
def paired_run_delta(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("k", F.col("config") * 10 + F.col("seed"))
    return selection.paired_delta(rows.where("family = 'A'"), rows.where("family = 'R'"), "k", ["total"])


@query("SELECT count(*) AS pairs, count(*) FILTER (v = w) AS exact, count(*) FILTER (abs(v - w) <= 0.01) AS close, max(abs(v - w)) AS max_gap FROM (SELECT l_orderkey * 10 + l_linenumber AS k, round(l_extendedprice, 2) AS v, round(l_extendedprice, 1) AS w FROM lineitem)")
def parity_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.round("l_extendedprice", 2).alias("v"), F.round("l_extendedprice", 1).alias("w"))
    gap = F.abs(F.col("v") - F.col("w"))
    return rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("v") == F.col("w")).alias("exact"), F.count_if(gap <= 0.01).alias("close"), F.max(gap).alias("max_gap"))


@query("SELECT count(*) AS pairs, count(*) FILTER (v = w) AS exact, count(*) FILTER (abs(v - w) <= 0.01) AS close, round(max(abs(v - w)), 6) AS max_gap FROM (SELECT round(o_totalprice, 2) AS v, round(o_totalprice, 1) AS w FROM orders)")
def parity_of_orders(spark, sf_dir):
    """Two versions of a value, matched by their unique key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    a, b = (rows.select("k", F.round("o_totalprice", d).alias("v")) for d in (2, 1))
    out = selection.parity(a, b, "k", "v", 0.01)
    return out.withColumn("max_gap", F.round("max_gap", 6))


@query("""SELECT inventory, count(*) AS n_values, min(value) AS first, max(value) AS last FROM (SELECT DISTINCT p_brand AS value, i AS inventory FROM part, unnest(['all', 'small', 'large', 'costly']) AS t(i) WHERE i = 'all' OR (i = 'small' AND p_size < 3) OR (i = 'large' AND p_size > 48) OR (i = 'costly' AND p_retailprice > 1900)) GROUP BY inventory""")
def label_inventories(spark, sf_dir):
    named = {"all": F.lit(True), "small": F.col("p_size") < 3, "large": F.col("p_size") > 48, "costly": F.col("p_retailprice") > 1900}
    return selection.inventories(table(spark, sf_dir, "part"), "p_brand", named)


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen, event_type LIMIT 3")
def most_common_types(spark, sf_dir):
    return selection.most_common(table(spark, sf_dir, "events"), "event_type", 3, "event_id")


@query("SELECT o_orderpriority, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS r FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)) WHERE r <= 5 GROUP BY o_orderpriority")
def bounded_examples(spark, sf_dir):
    return selection.bounded_examples(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", 5)


@query("WITH s AS (SELECT doc_id, doc_id // 100 AS shard, n_chars FROM documents) SELECT doc_id, shard, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start_frame, CAST(sum(n_chars) OVER w AS BIGINT) AS end_frame FROM s WINDOW w AS (PARTITION BY shard ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def packed_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("shard"), "n_chars")
    return selection.running_offsets(rows, "shard", ["doc_id"], "n_chars").select("doc_id", "shard", "start_frame", "end_frame")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT * FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def shared_customers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("O").intersect(of("F"))


@query("SELECT 'known' AS kind, vec_id, label FROM embeddings WHERE label < 7 UNION ALL SELECT 'unknown', vec_id, NULL FROM embeddings WHERE label >= 7")
def evaluation_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    known = rows.where("label < 7").select(F.lit("known").alias("kind"), "vec_id", "label")
    return known.unionByName(rows.where("label >= 7").select(F.lit("unknown").alias("kind"), "vec_id"), allowMissingColumns=True)


@query("SELECT l_shipmonth, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS loss FROM (SELECT date_trunc('month', l_shipdate) AS m, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS l_shipmonth, l_discount, l_quantity FROM lineitem) GROUP BY l_shipmonth")
def weighted_epoch_loss(spark, sf_dir):
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("l_shipmonth")
    return table(spark, sf_dir, "lineitem").groupBy(month).agg(F.round(metrics.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("loss"))


@query("WITH c AS (SELECT p_brand, avg(CASE WHEN p_size < 25 THEN 1.0::DOUBLE ELSE 0 END) AS gain, avg(CASE WHEN p_retailprice > 1400 THEN 1.0::DOUBLE ELSE 0 END) AS guard FROM part GROUP BY p_brand) SELECT round(max(gain) FILTER (guard >= 0.5), 6) AS best_gain, round(max(guard) FILTER (gain >= 0.5), 6) AS best_guard, round(min(greatest(0, 0.5 - gain) + greatest(0, 0.5 - guard)), 6) AS least_miss FROM c")
def pareto_limits(spark, sf_dir):
    cells = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") < 25).cast("double")).alias("gain"), F.avg((F.col("p_retailprice") > 1400).cast("double")).alias("guard"))
    out = selection.pareto_limits(cells, "gain", "guard", 0.5, 0.5)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT n_name, '| ' || n_name || ' | ' || count(*) || ' |' AS row, CAST(CAST(round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 2) AS DECIMAL(10, 2)) AS VARCHAR) || '%' AS negative FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def formatted_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    out = rows.groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    return out.select("n_name", markdown_row(F.col("n_name"), F.col("n")).alias("row"), percent(F.round(F.col("k") / F.col("n"), 4)).alias("negative"))


@query(rf"WITH {LINES_SQL}, wrapped AS (SELECT doc_id, line_no, regexp_replace(line, '^(\S+)(\s)', 'dir/\1.wav\2') AS line FROM lines), found AS (SELECT doc_id, line_no, regexp_extract(line, '^\s*(\S+)\s+(.*?)\s*$', 1) AS key, regexp_extract(line, '^\s*(\S+)\s+(.*?)\s*$', 2) AS rest FROM wrapped) SELECT doc_id, line_no, regexp_replace(regexp_extract(key, '[^/]*$'), '\.[^.]+$', '') AS key, rest FROM found")
def label_lines(spark, sf_dir):
    """Label lines of paths: the first word of every line stands for a file in a folder."""
    lines = text_lines(spark, sf_dir).select("doc_id", "line_no", F.regexp_replace("line", r"^(\S+)(\s)", r"dir/$1.wav$2").alias("line"))
    return lines.select("doc_id", "line_no", label_line(F.col("line")).alias("x")).select("doc_id", "line_no", F.col("x.key").alias("key"), F.col("x.text").alias("rest"))


@query(rf"WITH {LINES_SQL}, found AS (SELECT doc_id, line_no, regexp_extract(line, '^\s*(\S+)\s+(.*?)\s*$', 1) AS key, regexp_extract(line, '^\s*(\S+)\s+(.*?)\s*$', 2) AS rest FROM lines) SELECT doc_id, line_no, regexp_replace(regexp_extract(key, '[^/]*$'), '\.[^.]+$', '') AS key, rest FROM found")
def document_label_lines(spark, sf_dir):
    """Every line of a text as it is."""
    return text_lines(spark, sf_dir).select("doc_id", "line_no", label_line(F.col("line")).alias("x")).select("doc_id", "line_no", F.col("x.key").alias("key"), F.col("x.text").alias("rest"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]+$', '') AS stem FROM pages")
def url_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", file_stem(F.col("url")).alias("stem"))


@query("SELECT r_name, n_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY suppliers DESC, n_name) AS INTEGER) AS rank, suppliers FROM (SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)")
def top_by_coverage(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    counts = n.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
    return counts.select("r_name", "n_name", F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("suppliers"), "n_name")).alias("rank"), "suppliers")
