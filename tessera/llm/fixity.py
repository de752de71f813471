"""Merkle fixity audit of WARC replicas.

Each replica's records are hashed once. Hashes of records whose offsets fall in
one range of ``LEAF_BYTES`` make a leaf, in offset order; ``FANOUT`` neighbours
make the node above, up to one root for each archive, and the same over
archives up to one root for the replica. The audit compares the two roots and
then only the children of nodes that differ, level by level, down to records.

A range has at most ``LEAF_BYTES`` offsets and an inner node ``FANOUT`` children,
so no group that is gathered grows with the input. Rows of one offset are summed,
not gathered: a count and sums of two hashes. Only hashes are shuffled. The hash
tables are kept in the shared folder, so descending reads them again instead of
the records.

A null payload or url counts as empty; null archives and offsets are values like
others, and rows without one have roots of their own. Records found in one replica only are reported as missing or extra. Rows
of one offset are compared as a multiset, in any order: a digest that one replica
holds more often is reported once, beside one that the other holds more often if
there is such. Empty replicas have no roots and do not differ; if one is empty,
all records of the other are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.checkpoints import cut

LEAF_BYTES = 1 << 15
FANOUT = 16
#: Records of an archive file.
ARCHIVE_RECORDS = 1000


def warc_record(url: Column, payload: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def record_hashes(records: DataFrame) -> DataFrame:
    """archive, offset, length and digest of rows of archive, offset and record bytes."""
    return records.select("archive", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def _node(children: Column) -> Column:
    """Hash over (position, digest) pairs in order of position."""
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])), ",").cast("binary"), 256)


def _up(nodes: DataFrame, archive: Column, at: Column, position: Column) -> DataFrame:
    child = F.struct(position.alias("at"), F.col("digest"))
    return nodes.groupBy("replica", archive.alias("archive"), at.alias("at")).agg(_node(F.collect_list(child)).alias("digest"))


def _by_offset(hashes: DataFrame) -> DataFrame:
    """One digest for each archive and offset: the row's own, or one of all rows there, whatever their order."""
    total = lambda seed: F.sum(F.xxhash64("digest", "length", F.lit(seed)).cast("decimal(20,0)")).cast("string")
    sums = hashes.groupBy("replica", "archive", "offset").agg(F.count("*").alias("n"), F.max("digest").alias("own"), total(1).alias("x"), total(2).alias("y"))
    return sums.select("replica", "archive", "offset", F.when(F.col("n") == 1, F.col("own")).otherwise(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "x", "y").cast("binary"), 256)).alias("digest"))


def merkle_levels(hashes: DataFrame, height: int, archive_height: int) -> list[DataFrame]:
    """Node tables (replica, archive, at, digest) from the leaves up to each replica's root, kept in the shared folder."""
    levels = [cut(_up(_by_offset(hashes), F.col("archive"), F.floor(F.col("offset") / LEAF_BYTES), F.col("offset")))]
    for _ in range(height):
        levels.append(cut(_up(levels[-1], F.col("archive"), F.floor(F.col("at") / FANOUT), F.col("at"))))
    for _ in range(archive_height):
        levels.append(cut(_up(levels[-1], F.floor(F.col("archive") / FANOUT), F.col("at"), F.col("archive"))))
    return levels


def _height(count: int) -> int:
    """Levels above ``count`` positions until one is left."""
    h = 0
    while count > 1:
        count, h = -(-count // FANOUT), h + 1
    return h


def audit_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """As audit_hashes, for replicas that have archive, offset and record (bytes)."""
    return audit_hashes(record_hashes(a), record_hashes(b))


def audit_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replicas differ: archive, offset, length_a, length_b, digest_a, digest_b, finding.

    ``a`` and ``b`` have archive (whole numbers from 0), offset, length and digest.
    """
    columns = ["archive", "offset", "length", "digest"]
    hashes = cut(a.select(F.lit(0).alias("replica"), *columns).unionByName(b.select(F.lit(1).alias("replica"), *columns)))
    top = hashes.agg(F.max("offset"), F.max("archive")).first()
    height = _height((top[0] or 0) // LEAF_BYTES + 1)
    levels = merkle_levels(hashes, height, _height((top[1] or 0) + 1))
    differing = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        if differing is not None:
            over = F.col("archive") if k <= height - 1 else F.floor(F.col("archive") / FANOUT)
            up = F.floor(F.col("at") / FANOUT) if k <= height - 1 else F.col("at")
            parents = differing.select(F.col("archive").alias("up_archive"), F.col("at").alias("up_at"))
            nodes = nodes.join(parents, over.eqNullSafe(F.col("up_archive")) & up.eqNullSafe(F.col("up_at")), "left_semi")
        differing = _side_by_side(nodes, ["archive", "at"], "digest").where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("archive", "at")
    bad = differing.select(F.col("archive").alias("bad_archive"), F.col("at").alias("bad_leaf"))
    leaf = F.floor(F.col("offset") / LEAF_BYTES)
    within = F.col("archive").eqNullSafe(F.col("bad_archive")) & leaf.eqNullSafe(F.col("bad_leaf"))
    sign = F.when(F.col("replica") == 0, 1).otherwise(-1)
    surplus = hashes.join(bad, within, "left_semi").groupBy(*columns).agg(F.sum(sign).alias("more")).where("more <> 0")
    nth = F.row_number().over(Window.partitionBy("archive", "offset", F.col("more") > 0).orderBy("digest", "length"))
    of = lambda c, mine: F.max(F.when((F.col("more") > 0) == mine, F.col(c)))
    both = surplus.withColumn("nth", nth).groupBy("archive", "offset", "nth").agg(of("length", True).alias("length_a"), of("length", False).alias("length_b"), of("digest", True).alias("digest_a"), of("digest", False).alias("digest_b"), F.max("more").alias("high"), F.min("more").alias("low"))
    finding = F.when(F.col("low") > 0, "missing").when(F.col("high") < 0, "extra").otherwise("changed")
    return both.select("archive", "offset", "length_a", "length_b", "digest_a", "digest_b", finding.alias("finding"))


def _side_by_side(nodes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both replicas' values of a key, null keys included: value_a and value_b."""
    return nodes.groupBy(*keys).agg(*[F.max(F.when(F.col("replica") == k, F.col(value))).alias(f"{value}_{n}") for k, n in enumerate("ab")])


def page_hashes(pages: DataFrame, html: Column | None = None, lost: Column | None = None) -> DataFrame:
    """Hashes of pages as records of archives of ARCHIVE_RECORDS consecutive page ids.

    Offsets are those of the sound archive, in order of page id; ``html`` is what this
    replica holds and ``lost`` marks records that it lacks.
    """
    return page_replicas(pages, [(html, lost)])[0]


def page_replicas(pages: DataFrame, damage: list[tuple[Column | None, Column | None]]) -> list[DataFrame]:
    """``page_hashes`` of several replicas of the same pages, whose places are found once and kept in the shared folder.

    Rows of one id follow one another by the digest of the sound record, then in any order,
    since they are equal: they are counted, and their places follow from the count.
    Rows without an id lie in archives of their own, below 0, by that digest. Payloads are
    hashed where they lie. Offsets are summed in two steps, over groups of an id and the
    first signs of the digest and within them, so that an id may have any number of rows.
    """
    sound = warc_record(F.col("url"), F.col("html"))
    nameless = -1 - F.conv(F.substring(F.sha2(sound, 256), 1, 5), 16, 10).cast("long")
    held, names = [], []
    for k, (html, lost) in enumerate(damage):
        record = sound if html is None else warc_record(F.col("url"), html)
        held += [F.octet_length(record).cast("long").alias(f"length_{k}"), F.sha2(record, 256).alias(f"digest_{k}"), (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias(f"lost_{k}")]
        names += [f"length_{k}", f"digest_{k}", f"lost_{k}"]
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE_RECORDS), nameless).alias("archive")
    sized = pages.select(archive, "page_id", F.octet_length(sound).cast("long").alias("size"), F.sha2(sound, 256).alias("key"), *held).withColumn("part", F.substring("key", 1, 3))
    group = ["archive", "page_id", "part"]
    alike = sized.groupBy(*group, "key", "size", *names).agg(F.count("*").alias("n")).withColumn("all", F.col("size") * F.col("n"))
    before = lambda w: F.coalesce(F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = alike.withColumn("within", before(Window.partitionBy(*group).orderBy("key", *names)))
    starts = sized.groupBy(*group).agg(F.sum("size").alias("all")).withColumn("base", before(Window.partitionBy("archive").orderBy("page_id", "part")))
    starts = starts.select(*[F.col(c).alias(f"of_{c}") for c in group], "base")
    placed = within.join(starts, (F.col("archive") == F.col("of_archive")) & F.col("page_id").eqNullSafe(F.col("of_page_id")) & (F.col("part") == F.col("of_part")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
    placed = cut(placed.select("archive", "base", "within", "size", *names, each).select("archive", (F.col("base") + F.col("within") + F.col("nth") * F.col("size")).alias("offset"), *names))
    return [placed.where(~F.col(f"lost_{k}")).select("archive", "offset", F.col(f"length_{k}").alias("length"), F.col(f"digest_{k}").alias("digest")) for k in range(len(damage))]


def op4_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """Audits a sound replica of pages against one with deterministic damage: by a hash of its id, a page is lost or its first sign is changed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    draw = F.substring(F.sha2(F.col("page_id").cast("string").cast("binary"), 256), 1, 2)
    bad = F.when(draw == "07", F.concat(F.lit("#"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html"))
    return audit_hashes(*page_replicas(pages, [(None, None), (bad, draw == "5e")]))


OP4_SQL = r"""
WITH heads AS (
  SELECT page_id, page_id // 1000 AS archive, coalesce(html, '') AS html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) AS draw
  FROM pages
), replicas AS (
  SELECT *, head || CAST(strlen(html) AS VARCHAR) || gap || html || gap AS a,
    head || CAST(strlen(bad) AS VARCHAR) || gap || bad || gap AS b
  FROM (SELECT *, CASE WHEN draw = '07' THEN '#' || substr(html, 2) ELSE html END AS bad FROM heads)
), placed AS (
  SELECT archive, coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset", a, b, draw FROM replicas
)
SELECT archive, CAST("offset" AS BIGINT) AS "offset", CAST(strlen(a) AS BIGINT) AS length_a,
  CASE WHEN draw = '07' THEN CAST(strlen(b) AS BIGINT) END AS length_b, sha256(a) AS digest_a,
  CASE WHEN draw = '07' THEN sha256(b) END AS digest_b, CASE WHEN draw = '07' THEN 'changed' ELSE 'missing' END AS finding
FROM placed WHERE draw = '5e' OR (draw = '07' AND a <> b)
"""
