"""Inventories, audits and leakage checks over manifests: grouped counts, set algebra, joins that must match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.session import kept


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def distinct_if(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def label_stats(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per label: rows, speakers, rows by role and domain, speakers by role.

    Rows are counted per label and speaker first. A label's speakers are then the rows of that table, which
    adds up: no row is copied for any of the distinct counts.
    """
    c = F.col
    counted = {
        "n": F.count("*"),
        "n_train": n_if(c("role") == "train"),
        "n_enrollment": n_if(c("role") == "enrollment"),
        "n_eval": n_if(c("role") == "eval"),
        "n_control": n_if(c("domain") == "control"),
        "n_dysarthria": n_if(c("domain") == "dysarthria"),
    }
    per = rows.groupBy(label, "speaker_id").agg(*[v.alias(n) for n, v in counted.items()])
    named = c("speaker_id").isNotNull()
    out = per.groupBy(label).agg(*[F.sum(n).alias(n) for n in counted], n_if(named).alias("speakers"), n_if(named & (c("n_enrollment") > 0)).alias("enrollment_speakers"), n_if(named & (c("n_eval") > 0)).alias("eval_speakers"))
    return out.select(label, "n", "speakers", *[n for n in counted if n != "n"], "enrollment_speakers", "eval_speakers")


def phrase_inventory(rows: DataFrame, phrase: Column, raw: Column) -> DataFrame:
    """Per normalized phrase: support by domain and split, and raw variants by falling count.

    Two levels: counts by (phrase, raw text) and by (phrase, speaker) first, so that only distinct variants
    and speakers meet in a group.
    """
    c = F.col
    base = rows.select(phrase.alias("phrase"), raw.alias("raw"), "speaker_id", "domain", "split")
    counts = base.groupBy("phrase", "raw").agg(F.count("*").alias("n"))
    variants = counts.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("minus"), "raw"))).alias("v"))
    control, other = c("domain") == "control", c("domain") == "dysarthria"
    counted = {
        "n": F.count("*"),
        "n_control": n_if(control),
        "n_dysarthria": n_if(other),
        "control_train": n_if(control & (c("split") == "train")),
        "dysarthria_train": n_if(other & (c("split") == "train")),
    }
    per = base.groupBy("phrase", "speaker_id").agg(*[v.alias(n) for n, v in counted.items()])
    named = c("speaker_id").isNotNull()
    support = per.groupBy("phrase").agg(*[F.sum(n).alias(n) for n in counted], n_if(named).alias("speakers"), n_if(named & (c("n_control") > 0)).alias("control_speakers"), n_if(named & (c("n_dysarthria") > 0)).alias("dysarthria_speakers"))
    support = support.select("phrase", "n", "speakers", *[n for n in counted if n != "n"], "control_speakers", "dysarthria_speakers")
    return support.join(variants, "phrase").select("*", F.size("v").alias("n_variants"), F.transform("v", lambda x: F.concat_ws(":", x["raw"], (-x["minus"]).cast("string"))).alias("variants")).drop("v")


def distinct_state(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, bucket, held: which whole-number ids occur per key, as exact bitmaps of 32,768 ids a bucket.

    A state of a part of the rows (a day, a shard) can be kept and joined with others by ``merged_state``: distinct counts
    of parts do not add up, their bitmaps do. It pays off where ids lie close together; a bucket has 4 KB.
    """
    known = rows.where(F.col(ident).isNotNull())
    return known.groupBy(*keys, F.bitmap_bucket_number(F.col(ident)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ident))).alias("held"))


def merged_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state of coarser keys, or of several parts' states together."""
    return states.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("held").alias("held"))


def distinct_of_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how many distinct ids they hold; ``states`` has one row for a key and bucket."""
    return states.groupBy(*keys).agg(F.sum(F.bitmap_count("held")).alias("n_distinct"))


def support_sweep(inventory: DataFrame, control: list[int], dysarthria: list[int]) -> DataFrame:
    """For each pair of least speaker counts, phrases that reach both and their rows. The grid is a literal array."""
    grid = F.array(*[F.struct(F.lit(a).alias("min_control"), F.lit(b).alias("min_dysarthria")) for a in control for b in dysarthria])
    cells = inventory.select("control_speakers", "dysarthria_speakers", "n", F.explode(grid).alias("g")).select("*", "g.*")
    ok = (F.col("control_speakers") >= F.col("min_control")) & (F.col("dysarthria_speakers") >= F.col("min_dysarthria"))
    return cells.groupBy("min_control", "min_dysarthria").agg(n_if(ok).alias("phrases"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("rows"))


def cross_tabs(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts for several groupings in one pass; absent keys are null and ``grouping`` tells the sets apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("grouping"))


def numeric_summary(x: Column) -> list[Column]:
    """Count, least, mean, median, 95th percentile (linear) and greatest; null when empty."""
    return [F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("max")]


def value_counts(rows: DataFrame, by: str, x: str) -> DataFrame:
    """g, x and n: how often each value occurs per group; kept, for what is computed from it."""
    return kept(rows.groupBy(F.col(by).alias("g"), F.col(x).alias("x")).agg(F.count("*").alias("n")))


def quantiles(rows: DataFrame, by: str, x: str, at: dict[str, float], slices: int = 64) -> DataFrame:
    """by and exact quantiles with linear interpolation, by name; null values do not count."""
    return quantiles_of(value_counts(rows, by, x), at, slices).withColumnRenamed("g", by)


def quantiles_of(counts: DataFrame, at: dict[str, float], slices: int = 64) -> DataFrame:
    """g and exact quantiles of value counts (g, x, n).

    Approximate quantiles part a group's distinct values into slices, and ranks within a slice start from the
    counts of the slices below, so no task holds a whole group.
    """
    cells = counts.where("x is not null")
    bounds = cells.groupBy(F.col("g").alias("bg")).agg(F.percentile_approx("x", [i / slices for i in range(1, slices)], 1000).alias("bounds"))
    cells = cells.join(bounds, F.col("g").eqNullSafe(F.col("bg"))).select("g", "x", "n", F.size(F.filter("bounds", lambda b: b < F.col("x"))).alias("slice"))
    below = Window.partitionBy("tg").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(F.col("g").alias("tg"), F.col("slice").alias("of")).agg(F.sum("n").alias("m"))
    totals = totals.select("tg", "of", F.coalesce(F.sum("m").over(below), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("tg")).alias("all"))
    upto = F.sum("n").over(Window.partitionBy("g", "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", upto).join(totals, F.col("g").eqNullSafe(F.col("tg")) & (F.col("slice") == F.col("of")))
    end = F.col("before") + F.col("upto")

    def of_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= end - F.col("n")) & (rank < end), F.col("x")))

    spot = {name: F.lit(q) * (F.col("all") - 1) for name, q in at.items()}
    found = ranked.groupBy("g").agg(F.max("all").alias("all"), *[c for n, s in spot.items() for c in (of_rank(F.floor(s)).alias(f"low_{n}"), of_rank(F.ceil(s)).alias(f"high_{n}"))])
    return found.select("g", *[(F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * (s - F.floor(s))).alias(n) for n, s in spot.items()])


def group_summary(rows: DataFrame, by: str, x: str) -> DataFrame:
    """``numeric_summary`` per group, for groups of any size, from one table of value counts: the rows are read once."""
    counts = value_counts(rows, by, x)
    some = F.col("x").isNotNull()
    times = F.sum(F.col("x") * F.col("n")) / F.sum(F.when(some, F.col("n")))
    plain = counts.groupBy("g").agg(F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0).cast("long")).alias("n"), F.min("x").alias("min"), times.alias("mean"), F.max("x").alias("max"))
    q = quantiles_of(counts, {"median": 0.5, "p95": 0.95}).withColumnRenamed("g", "__g")
    joined = plain.join(q, F.col("g").eqNullSafe(F.col("__g")), "left")
    return joined.select(F.col("g").alias(by), "n", "min", "mean", "median", "p95", "max")


def frequency_of_frequencies(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("frequency")).groupBy("frequency").agg(F.count("*").alias("n_keys"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def inventory_overlap(rows: DataFrame, value: str, group: str) -> DataFrame:
    """For each ordered pair of groups, how many values both hold: one flag row per value, no join of inventories."""
    held = rows.groupBy(value).agg(F.array_sort(F.collect_set(group)).alias("g"))
    pairs = held.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def leaking_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with the splits joined by '+'; never one split per key."""
    held = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s"), F.count("*").alias("n"))
    return held.where(F.size("s") > 1).select(key, F.array_join("s", "+").alias("splits"), "n")


def personalized_stats(rows: DataFrame, targets: list[str], label: str = "label") -> DataFrame:
    """Per speaker: enrollment and evaluation coverage of the targets, what is missing, other rows and splits."""
    c = F.col
    wanted = F.array(*[F.lit(t) for t in targets])
    hit = c(label).isin(*targets)
    enrolled = F.collect_set(F.when(hit & (c("role") == "enrollment"), c(label)))
    evaluated = F.collect_set(F.when(hit & (c("role") == "eval"), c(label)))
    return rows.groupBy("speaker_id").agg(
        F.size(enrolled).alias("enrolled"),
        F.size(evaluated).alias("evaluated"),
        F.array_join(F.array_sort(F.array_except(wanted, enrolled)), ",").alias("missing_enrollment"),
        F.array_join(F.array_sort(F.array_except(wanted, evaluated)), ",").alias("missing_eval"),
        n_if(~hit & (c("role") == "eval")).alias("negatives"),
        F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"),
    )


def repetition_values(rows: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct sizes of the groups, as one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("n")), lambda x: x.cast("string")), ",").alias("repetitions"))


def path_depths(paths: DataFrame, path: str, examples: int = 3) -> DataFrame:
    """Rows by number of path components, with the first paths in order."""
    each = paths.groupBy(F.size(F.split(path, "/")).alias("depth"), F.col(path).alias("p")).agg(F.count("*").alias("n"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("depth").orderBy("p"))).where(F.col("r") <= examples)
    shown = first.groupBy("depth").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("examples"))
    return each.groupBy("depth").agg(F.sum("n").alias("n")).join(shown, "depth")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer reconciliation of distinct keys: matched, only left, only right."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("matched")
    return a.join(b, key, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def must_match(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str] = ()) -> DataFrame:
    """Left rows with their right row; running it fails where one is missing or an ``equal`` column differs."""
    marked = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in equal], *[c for c in right.columns if c not in {*keys, *equal}], F.lit(True).alias("__found"))
    joined = left.join(marked, keys, "left")
    ok = F.coalesce("__found", F.lit(False))
    for c in equal:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__{c}"))
    checked = joined.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("no matching row for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean")))
    return checked.drop("__found", *[f"__{c}" for c in equal])


def covered(wanted: DataFrame, rows: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Rows of the wanted keys; running it fails where a wanted key has no row or, with ``unique``, more than one."""
    ids = wanted.where(F.col(key).isNotNull()).select(key).distinct()
    held = ids.join(rows.withColumn("__found", F.lit(True)), key, "left")
    bad, why = F.col("__found").isNull(), F.lit("no row for ")
    if unique:
        held = held.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
        bad, why = bad | (F.col("__n") > 1), F.when(F.col("__found").isNull(), "no row for ").otherwise("several rows for ")
    ok = F.when(~bad, True).otherwise(F.raise_error(F.concat(why, F.col(key).cast("string"))).cast("boolean"))
    return held.where(ok).select(*rows.columns)


def match_report(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """One row: left rows, matched, missing, and matched rows whose columns differ."""
    marked = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in equal], F.lit(True).alias("__found"))
    joined = left.join(marked, keys, "left")
    same = F.lit(True)
    for c in equal:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = F.coalesce("__found", F.lit(False))
    return joined.agg(F.count("*").alias("n_left"), n_if(found).alias("n_matched"), n_if(~found).alias("n_missing"), n_if(found & ~same).alias("n_different"))


def exclusion_reasons(candidates: DataFrame, ordered: dict[str, DataFrame | Column], key: str) -> DataFrame:
    """Candidates with the first reason, in order, for which they go (null: kept).

    A reason is a condition, or a table of keys; tables are left-joined on distinct keys.
    """
    out, reason = candidates, F.lit(None).cast("string")
    for i, (name, by) in enumerate(ordered.items()):
        if isinstance(by, DataFrame):
            out = out.join(by.select(key).distinct().withColumn(f"__{i}", F.lit(True)), key, "left")
    for i, (name, by) in reversed(list(enumerate(ordered.items()))):
        hit = F.coalesce(f"__{i}", F.lit(False)) if isinstance(by, DataFrame) else by
        reason = F.when(hit, name).otherwise(reason)
    return out.withColumn("reason", reason).drop(*[f"__{i}" for i in range(len(ordered))])


#: Words of a phrase window.
PHRASE_WORDS = 13


def phrase_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Bits of the filter of window hashes, whose size does not grow with the sealed texts.
FILTER_BITS = 24


def _hash_filter(hashes: DataFrame):
    """Broadcast bitmap of the first bits of column ``h``."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros((1 << FILTER_BITS) // 64, dtype=np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _held_places(sent):
    """For each row's array of hashes, the places of those that the filter holds."""

    @F.pandas_udf("array<int>")
    def places(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            slot = np.asarray([] if h is None else h, dtype=np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            out.append(np.flatnonzero((sent.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(np.int32))
        return pd.Series(out)

    return places


def holding_phrases(docs: DataFrame, sealed: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keys of documents that hold a window of ``PHRASE_WORDS`` words of a sealed text, or the whole of a shorter one.

    Windows of a document are hashed within its row and tested against a filter of fixed size; only those that pass
    become rows, with their words, which the join compares with the sealed ones.
    """
    windows = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))
    hashes = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k)))
    width = F.least(F.size("w"), F.lit(PHRASE_WORDS))
    items = sealed.select(phrase_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    grams = items.select(width.alias("k"), F.explode(windows(width)).alias("gram")).distinct()
    grams = grams.withColumn("h", F.xxhash64("gram"))
    widths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most PHRASE_WORDS
    if not widths:
        return docs.select(key).limit(0)
    places = _held_places(_hash_filter(grams.select("h")))
    words = docs.where(F.col(key).isNotNull()).select(key, phrase_words(F.col(text)).alias("w"))
    hits = words.select(key, "w", *[places(F.when(F.size("w") >= k, hashes(F.lit(k)))).alias(f"at_{k}") for k in widths])
    words_at = lambda k: F.transform(f"at_{k}", lambda i: F.slice("w", i + 1, k))
    found = F.flatten(F.array(*[F.coalesce(words_at(k), F.array()) for k in widths]))
    each = hits.select(key, F.explode(F.array_distinct(found)).alias("gram")).withColumn("h", F.xxhash64("gram"))
    return each.join(grams.select("h", "gram"), ["h", "gram"], "left_semi").select(key).distinct()


def dense_grid(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Every combination of the two keys' values with its count, zero where none occurs.

    Each ``a`` is given the array of all ``b`` (a vocabulary), so nothing is cross-joined.
    """
    held = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    counts = held.groupBy(a).agg(F.map_from_entries(F.collect_list(F.struct(b, "n"))).alias("m"))
    vocabulary = held.agg(F.collect_set(b).alias("all"))
    # one row, so its broadcast has the vocabulary's size
    grid = counts.join(vocabulary, how="cross").select(a, "m", F.explode("all").alias(b))
    return grid.select(a, b, F.coalesce(F.try_element_at("m", F.col(b)), F.lit(0)).cast("long").alias("n"))


def missing_cells(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric difference of key grids: cells expected but absent, or present but not expected."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    o = observed.select(*keys).distinct().withColumn("__o", F.lit(True))
    both = e.join(o, keys, "full_outer").where(F.col("__e").isNull() | F.col("__o").isNull())
    return both.select(*keys, F.when(F.col("__o").isNull(), "missing").otherwise("unexpected").alias("state"))


def assert_empty(df: DataFrame, what: str) -> None:
    """Fails with an example row; runs the query now, since a lazy guard would guard nothing."""
    found = df.limit(1).collect()
    if found:
        raise AssertionError(f"{what}: {found[0].asDict()}")


def assert_disjoint(a: DataFrame, b: DataFrame, what: str) -> None:
    assert_empty(a.intersect(b), what)


def phrase_support_summary(counts: Column) -> list[Column]:
    """Median, 90th percentile, greatest, and how many groups have at least 2, 5, 10 and 15."""
    return [F.percentile(counts, F.lit(0.5)).alias("median"), F.percentile(counts, F.lit(0.9)).alias("p90"), F.max(counts).alias("max"), *[n_if(counts >= k).alias(f"at_least_{k}") for k in (2, 5, 10, 15)]]


def nested_counts(rows: DataFrame, key: str, inner: str) -> DataFrame:
    """Per key its rows and a text 'inner=count,...' in order of inner: counted twice, never gathered raw."""
    counts = rows.groupBy(key, inner).agg(F.count("*").alias("n"))
    pair = F.struct(F.coalesce(F.col(inner), F.lit("null")).alias("k"), "n")
    return counts.groupBy(key).agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat_ws("=", p["k"], p["n"].cast("string"))), ",").alias("by_inner"))


def shot_readiness(rows: DataFrame, speaker: str, label: str, shots: list[int], classes: int) -> DataFrame:
    """Per shot: speakers with two labels that leave a query, speakers for whom all ``classes`` labels do, pairs of the
    former and their share of all pairs of speaker and class. Shots that no pair reaches have zeros."""
    pairs = rows.where(F.col(speaker).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(speaker).alias("s"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    each = pairs.select("s", "n", F.explode(F.array(*[F.lit(k) for k in shots])).alias("shot"))
    by_speaker = each.groupBy("shot", "s").agg(n_if(F.col("n") >= F.col("shot") + 1).alias("labels"))
    two = F.col("labels") >= 2
    out = by_speaker.groupBy("shot").agg(n_if(two).alias("episode_speakers"), n_if(F.col("labels") == classes).alias("full_speakers"), F.sum(F.when(two, F.col("labels")).otherwise(0)).alias("eligible_pairs"), (F.count("*") * classes).alias("all_pairs"))
    return out.select("*", F.coalesce(F.try_divide("eligible_pairs", "all_pairs"), F.lit(0.0)).alias("eligible_fraction"))


def shot_feasibility(rows: DataFrame, speaker: str, label: str, shots: list[int]) -> DataFrame:
    """Per shot: pairs with a query left over, speakers with two such labels, queries left, medians."""
    pairs = rows.groupBy(speaker, label).agg(F.count("*").alias("n"))
    each = pairs.select(F.col(speaker).alias("s"), "n", F.explode(F.array(*[F.lit(k) for k in shots])).alias("shot")).where("n >= shot + 1")
    by_speaker = each.groupBy("shot", "s").agg(F.count("*").alias("labels"), F.sum(F.col("n") - F.col("shot")).alias("queries"))
    return by_speaker.groupBy("shot").agg(F.sum("labels").alias("eligible_pairs"), n_if(F.col("labels") >= 2).alias("episode_speakers"), F.sum("queries").alias("queries"), F.percentile("labels", F.lit(0.5)).alias("median_labels"))
