"""Near-duplicate groups by b-bit MinHash, with every link confirmed on full sets.

Documents are sets of distinct five-word shingles. Equal sets form one class, so
exact copies cost nothing further. Each class has ``BANDS * ROWS`` minima: bands
of them make bucket keys, and the low ``BITS`` bits of each, packed into whole
numbers, estimate similarity by bit counts, corrected for chance agreement.

Links are looked for in two rounds, both without pairing all members of a bucket:

1. In each bucket every class is paired with the bucket's most central class,
   the one whose buckets are largest in sum: a text from which copies were
   edited shares more bands with them than they with each other. Pairs that the
   estimate leaves are confirmed on full sets and joined to components.
2. Buckets that still hold several components are compared block by block in
   tasks of a bounded size, by estimate and then on sets of 31-bit hashes; blocks
   of the largest component meet only those of the others.
   Components that a task has found linked are not compared again, so it returns
   at most a spanning set of links, and these are confirmed on full sets too.

At a similarity of 0.75 two classes share no band with a chance of 5e-6, and the
estimate's floor of 0.5 lies over five standard deviations lower. Nothing is
capped: a bucket of any size is cut into blocks.

Words are runs of anything but ASCII white space, A-Z in lower case. Fewer than
five words make one shingle. A text without words has an empty set and is linked
with nothing.

Rows get numbers of their own when they are fingerprinted, and classes and links
go by these, so rows that repeat an id, or have none, keep all their links. A
component's id is the least id of its rows, null if none has one; ``kept`` marks
its rows with that id, which may be several; ``stays`` marks exactly one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.checkpoints import cut, unused
from tessera.llm.components import least_members
from tessera.llm.textbytes import U64, RollingHash, Words, byte_class, mixed, slices, small_batches

SHINGLE = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
#: Estimates below this are not confirmed.
ESTIMATE_FLOOR = 0.5
#: Classes of a bucket that a task compares at once with as many others.
BLOCK = 256
#: Bits of the bitmap that spares most texts a shuffle; its size is fixed, ids that it lets through in error are dropped later.
BITMAP_BITS = 1 << 25

#: What equal sets agree in.
SAME = ["set_a", "set_b", "n_shingles"]

IS_SOLID = byte_class((0x09, 0x0D), (0x20, 0x20), negate=True)
_rng = np.random.default_rng(2024)
_FLIPS = _rng.integers(1, 2**63, MINIMA, dtype=U64)
_FACTORS = _rng.integers(1, 2**62, MINIMA, dtype=U64) * U64(2) + U64(1)
WORD_BASE = 0xD1342543DE82EF95
LOW_BITS = 0x5555555555555555


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, grouped by row, and each row's bounds among them."""
    words = Words(data, offsets, IS_SOLID)
    n = np.diff(words.bounds)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    start = words.bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n[row], SHINGLE)
    h = mixed(RollingHash(words.hash, WORD_BASE).ranges(start, start + size) + size.astype(U64))
    _, first = np.unique(h + row.astype(U64) * U64(0x9FB21C651E98DF25), return_index=True)
    first.sort()
    return h[first], np.searchsorted(row[first], np.arange(len(n) + 1))


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MINIMA x rows; rows with empty sets hold zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((MINIMA, len(bounds) - 1), dtype=U64)
    if len(full):
        at = bounds[:-1][full]
        buffer = np.empty_like(h)
        for i in range(MINIMA):
            np.bitwise_xor(h, _FLIPS[i], out=buffer)
            np.multiply(buffer, _FACTORS[i], out=buffer)
            out[i, full] = np.minimum.reduceat(buffer, at)
    return out


def set_sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums over each row's shingles, equal for equal sets."""
    sums = np.zeros((2, len(bounds) - 1), dtype=U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums[0, full] = np.add.reduceat(mixed(h), bounds[:-1][full])
        sums[1, full] = np.add.reduceat(mixed(h ^ U64(0xA5A5A5A5A5A5A5A5)), bounds[:-1][full])
    return sums


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text"):
        h, bounds = shingle_sets(data, offsets)
        low = minima(h, bounds)
        n = rows.num_rows
        count = np.diff(bounds)
        keys = np.zeros((n, BANDS), dtype=U64)
        for b in range(BANDS):
            k = np.full(n, b + 1, dtype=U64)
            for r in range(ROWS):
                k = mixed(k ^ low[b * ROWS + r])
            keys[:, b] = k
        # minima differ in their high bits first; bits from the middle are as good as random
        bits = (mixed(low) & U64((1 << BITS) - 1)).T
        per = 64 // BITS
        packed = np.zeros((n, MINIMA // per), dtype=U64)
        for i in range(MINIMA):
            packed[:, i // per] |= bits[:, i] << U64(BITS * (i % per))
        sums = set_sums(h, bounds)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, packed)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(count.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), *lists], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"])


def _sets(bitmap):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for batch in batches:
            slot = batch.column(1).to_numpy()
            some = pa.array((held[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1)
            for _, data, offsets in slices([batch.filter(some)], "text"):
                h, bounds = shingle_sets(data, offsets)
                sums = (pa.array(s.view(np.int64)) for s in set_sums(h, bounds))
                yield pa.RecordBatch.from_arrays([*sums, pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], [*SAME, "shingles"])

    return sets


def _bitmap(slots: DataFrame):
    """A broadcast bitmap of fixed size with the ``slot`` of some rows."""
    words = slots.select(F.col("slot").alias("s")).groupBy(F.floor(F.col("s") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    held = np.zeros(BITMAP_BITS // 64, dtype=U64)
    part = words.toArrow()
    held[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(U64)
    return slots.sparkSession.sparkContext.broadcast(held)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the agreement beyond what chance gives."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(LOW_BITS))))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach PERCENT."""
    held = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return held.where(100 * common >= PERCENT * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


class _Merged:
    """Components that a task knows to be linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Links between components in one pair of blocks, none that follows from others found here."""
    low, high = key[1].as_py(), key[2].as_py()
    ids, label, block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(U64).reshape(len(ids), -1)
    small = table.column("small").combine_chunks()
    at, flat = small.offsets.to_numpy(), small.values.to_numpy()
    left = np.flatnonzero(block == low)
    right = np.flatnonzero(block == high) if high != low else left
    merged, found = _Merged(), []
    size = np.diff(at)
    for i in left.tolist():
        others = right[(right > i) | (high != low)]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        x = sketch[others] ^ sketch[i]
        differ = np.bitwise_count((x | (x >> U64(1))) & U64(LOW_BITS)).sum(axis=1)
        chance = 2.0**-BITS
        bound = np.minimum(size[others], size[i]) / np.maximum(size[others], size[i])
        others = others[(((1 - differ / MINIMA) - chance) / (1 - chance) >= ESTIMATE_FLOOR) & (bound >= PERCENT / 100 - 0.01)]
        mine = np.sort(flat[at[i] : at[i + 1]])
        for j in others.tolist():
            if merged.top(int(label[i])) == merged.top(int(label[j])):
                continue
            theirs = flat[at[j] : at[j + 1]]
            spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = int((mine[spot] == theirs).sum())
            share = common / (len(mine) + len(theirs) - common)
            if share >= PERCENT / 100 - 0.005:
                found.append((int(ids[i]), int(ids[j])))
                if share >= PERCENT / 100 + 0.005:
                    merged.join(int(label[i]), int(label[j]))
    return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id of its group), kept, stays, text_hash."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = texts.mapInArrow(_fingerprints, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")
    prints = cut(prints.withColumn("row", F.monotonically_increasing_id()))
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BITMAP_BITS))
    some = prints.where("n_shingles > 0")
    least = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    firsts = F.min(F.struct("row", slot.alias("slot"))).alias("first"), F.min(least).alias("least")
    classes = cut(some.groupBy(*SAME).agg(*firsts, F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("id", F.col("first.row")))

    rows = classes.select("id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(sizes, "key"), narrow=True)
    central = members.groupBy("id").agg(F.sum("n").alias("weight"))
    weighted = members.join(central, "id")
    leaders = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("lead")).select("key", (-F.col("lead.minus")).alias("a"))
    stars = weighted.join(leaders, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    sketches = classes.select("id", "sketch")
    near = stars.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    # kept by itself: the driver holds all stages of a plan at once
    pairs = cut(near.where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= ESTIMATE_FLOOR).select("a", "b"), narrow=True)

    wanted = classes.select(*SAME, "id", "first.slot").join(members.select("id").distinct(), "id")
    held = texts.select("text", slot.alias("slot")).mapInArrow(_sets(_bitmap(wanted)), "set_a long, set_b long, n_shingles long, shingles array<long>")
    # rows that a bitmap lets through, or that repeat a class's first row, are equal sets: any of them will do
    sets = cut(held.join(wanted.select(*SAME, "id"), SAME).dropDuplicates(["id"]).select("id", "shingles"))
    links = cut(_confirmed(pairs, sets))
    labels = least_members(links)

    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    # the bucket's largest component is linked within itself: its blocks meet only those of the rest
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_ = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("lead")).where("n > lead.n")
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed_ = cut(mixed_.select("key", F.col("lead.component").alias("largest"), blocks_of(F.col("n") - F.col("lead.n")).alias("rest"), blocks_of(F.col("lead.n")).alias("more")), narrow=True)
    slot = F.xxhash64("id")
    in_rest = F.col("component") != F.col("largest")
    left = labelled.join(mixed_, "key").withColumn("block", F.when(in_rest, F.pmod(slot, F.col("rest"))).otherwise(F.col("rest") + F.pmod(slot, F.col("more"))).cast("int"))
    meets = F.sequence(F.lit(0), F.col("rest") - 1 + F.when(in_rest, F.col("more")).otherwise(0))
    dealt = left.select("key", "id", "component", "block", F.explode(meets).alias("other"))
    dealt = dealt.select("key", "id", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    small = sets.join(sketches, "id").select("id", "sketch", F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("small"))
    more = dealt.join(small, "id").groupBy("key", "low", "high").applyInArrow(_compare, "a long, b long")
    # both directions of a link are read from it, and blocks are to be compared once
    found = cut(_confirmed(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), narrow=True)
    labels = least_members(links.unionByName(found))

    named = classes.select(*SAME, "id", "least").join(labels, "id", "left")
    together = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("of_all"))
    groups = named.join(together, "component", "left").select(*SAME, F.coalesce("of_all", "least").alias("least"))
    grouped = some.select("doc_id", "row", "text_hash", *SAME).join(groups, SAME, "left")
    grouped = grouped.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("stays"), "text_hash")
    alone = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"), "text_hash")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept, "stays", "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, one with the least id; of rows equal in id and text too, one stays."""
    own_id, own_hash = unused("id", docs.columns), unused("hash", docs.columns)
    found = near_duplicates(docs, id_col, text_col)
    rows = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    rows = cut(rows.agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), narrow=True)
    key = docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col]) == F.col(own_hash))
    out = docs.join(rows.select(own_id, own_hash), key, "left_anti")
    again = rows.where("stays").select(own_id, own_hash)
    if again.limit(1).count():
        # rows alike in id and text, one of which stays
        alike = docs.join(again, key).dropDuplicates([own_id, own_hash])
        out = out.unionByName(alike.select(docs.columns))
    return out


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair that shares a shingle, so only for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(w[i : i + 4]) AS h FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_ LEFT JOIN n USING (doc_id)
"""
