"""Corpora in directory trees: listings as tables, split lists, label files, path precedence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import blank_to_null, file_stem, label_line
from tessera.operators.inventory import assert_disjoint, assert_empty, duplicate_keys


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, root: str, pattern: str = "*.wav", hidden: tuple[str, ...] = ()) -> DataFrame:
    """(path, relpath, parts, stem, length) of files below a root; contents are not read.

    Spark's listing passes over folders whose names begin with '_' or '.'; name them in ``hidden``.
    """
    roots = [root, *[p for h in hidden if _exists(spark, p := f"{root.rstrip('/')}/{h}")]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots).select("path", "length")
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    return files.select("path", "length", rel.alias("relpath"), F.split(rel, "/").alias("parts"), file_stem(F.col("path")).alias("stem"))


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Relative paths of a split list, trimmed, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("relpath")).where(F.col("relpath") != "").distinct()


def keyword_corpus(spark: SparkSession, root: str, validation: str, testing: str) -> DataFrame:
    """Rows of a tree of <label>/<speaker>_nohash_<n>.wav: label and speaker from the path, split from the official lists."""
    dev, test = split_list(spark, validation), split_list(spark, testing)
    assert_disjoint(dev, test, "a path in both split lists")
    files = listing(spark, root, hidden=("_background_noise_",))
    marked = files.join(dev.withColumn("__dev", F.lit(True)), "relpath", "left").join(test.withColumn("__test", F.lit(True)), "relpath", "left")
    noise = F.element_at("parts", 1) == "_background_noise_"
    return marked.select(
        "path",
        "relpath",
        F.when(~noise, F.element_at("parts", 1)).alias("label"),
        F.when(~noise, F.substring_index("stem", "_nohash_", 1)).alias("speaker_id"),
        F.when(F.col("__test"), "test").when(F.col("__dev"), "dev").otherwise("train").alias("split"),
        F.when(noise, "noise").otherwise("speech").alias("record_type"),
        F.when(noise, "none").otherwise("train").alias("role"),
    )


def path_semantics(parts: Column) -> list[Column]:
    """Domain, split and role from path components, in a fixed order of precedence."""
    low = F.transform(parts, lambda p: F.lower(p))
    has = lambda *names: F.arrays_overlap(low, F.array(*[F.lit(n) for n in names]))
    domain = F.when(has("control", "controls"), "control").when(has("dysarthria", "dysarthric", "uncontrol"), "dysarthria")
    split = F.when(has("train"), "train").when(has("dev", "validation"), "dev").when(has("test"), "test")
    role = F.when(has("enrollment", "enrolment"), "enrollment").when(has("eval", "evaluation"), "eval").otherwise("train")
    return [domain.alias("domain"), split.alias("split"), role.alias("role")]


def transcripts(spark: SparkSession, root: str, name: str = "label.txt") -> DataFrame:
    """(folder, key, transcript) of every label file below a root; a key that occurs twice in a folder is an error."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select("folder", label_line(F.col("value")).alias("x")).select("folder", F.col("x.key").alias("key"), F.col("x.text").alias("transcript"))
    assert_empty(duplicate_keys(parsed, "folder", "key"), "a key with two label lines")
    return parsed


def resolved_audio(labels: DataFrame, files: DataFrame, candidates: tuple[str, ...] = ("", "/wav", "/audio")) -> DataFrame:
    """Label rows with the path of their audio: the first candidate folder that holds the stem wins.

    One join on the stem; candidates are told apart by rank instead of a join for each.
    """
    have = files.select(F.col("stem").alias("key"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("__at"))
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(candidates))):
        rank = F.when(F.col("__at") == F.concat("folder", F.lit(candidates[i])), i).otherwise(rank)
    joined = labels.join(have, "key", "left").withColumn("__rank", rank)
    return joined.groupBy("folder", "key", "transcript").agg(F.min_by(F.when(F.col("__rank").isNotNull(), F.col("path")), F.col("__rank")).alias("path"))


def reconciliation(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels without audio and audio without a label, by key."""
    a, b = labels.select("key").distinct().withColumn("l", F.lit(1)), files.select(F.col("stem").alias("key")).distinct().withColumn("f", F.lit(1))
    return a.join(b, "key", "full_outer").select("key", F.when(F.col("f").isNull(), "no_audio").when(F.col("l").isNull(), "no_label").otherwise("matched").alias("state"))


def audio_catalog(files: DataFrame) -> DataFrame:
    """stem -> path; fails now where two files share a stem."""
    assert_empty(duplicate_keys(files, "stem"), "two files of one stem")
    return files.select("stem", "path")


def audio_paths(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with their audio: an explicit path first, then the qualified id's path, then the catalog; null where none is found."""
    from_id = F.when(F.col("utt_id").contains(":"), F.regexp_replace("utt_id", "^[^:]*:", ""))
    stems = rows.withColumn("__stem", file_stem(F.coalesce("audio_relpath", from_id, "utt_id")))
    found = stems.join(catalog.select(F.col("stem").alias("__stem"), F.col("path").alias("__path")), "__stem", "left")
    return found.select(*rows.columns, F.coalesce("audio_relpath", from_id, "__path").alias("audio"), F.col("__path").isNotNull().alias("in_catalog"))


def audio_sources(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with ``audio`` (an existing file, or null), ``resolution`` and ``problem``.

    ``rows`` have utt_id, audio_relpath and split; ``files`` is a listing. An explicit path comes first, then a
    qualified id's path, then the stem of a plain id. What is found must lie in a folder named after the row's split.
    ``problem`` is null, 'no_audio_field' (no path and no id), 'unresolved', 'ambiguous_stem' or 'split_mismatch'.
    """
    explicit = blank_to_null(F.col("audio_relpath"))
    qualified = F.when(F.col("utt_id").contains(":"), F.regexp_replace("utt_id", "^[^:]*:", ""))
    relative = F.replace(F.coalesce(explicit, qualified), F.lit("\\"), F.lit("/"))
    kind = F.when(explicit.isNotNull(), "explicit_path").when(qualified.isNotNull(), "qualified_id").when(blank_to_null(F.col("utt_id")).isNotNull(), "catalog")
    keyed = rows.withColumn("resolution", kind).withColumn("__rel", relative).withColumn("__stem", F.when(relative.isNull(), file_stem(F.col("utt_id"))))
    by_path = files.select(F.col("relpath").alias("__rel"), F.col("path").alias("__at_path"), F.col("parts").alias("__path_parts"))
    by_stem = files.groupBy(F.col("stem").alias("__stem")).agg(F.count("*").alias("__n"), F.min_by(F.struct("path", "parts"), F.col("path")).alias("__one"))
    found = keyed.join(by_path, "__rel", "left").join(by_stem, "__stem", "left")
    path, parts = F.coalesce("__at_path", "__one.path"), F.coalesce("__path_parts", "__one.parts")
    in_split = F.exists(parts, lambda p: F.lower(p) == F.lower("split"))
    problem = (
        F.when(F.col("resolution").isNull(), "no_audio_field")
        .when(path.isNull(), "unresolved")
        .when(F.col("__at_path").isNull() & (F.col("__n") > 1), "ambiguous_stem")
        .when(~F.coalesce(in_split, F.lit(False)), "split_mismatch")
    )
    return found.withColumn("problem", problem).select(*rows.columns, "resolution", F.when(F.col("problem").isNull(), path).alias("audio"), "problem")


def checked_audio(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``audio_sources`` of which running any row fails that has a problem."""
    found = audio_sources(rows, files)
    message = F.concat_ws(" ", F.lit("audio of"), "utt_id", "problem")
    return found.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))).drop("problem")


def unresolved_audio(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The side output of ``audio_sources``: rows without usable audio, and why."""
    return audio_sources(rows, files).where(F.col("problem").isNotNull()).drop("audio")


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return re.sub("^file:/+", "file:/", uri)


def plausible_manifest(spark: SparkSession, paths: list[str], required: tuple[str, ...], min_rows: int = 1) -> str:
    """The one manifest file or folder that has the required fields and the most rows; a tie is refused rather than guessed.

    All candidates are read in one job; a file has a field if any of its lines has that key.
    """
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    candidate = F.lit(None).cast("int")
    for i, p in enumerate(paths):
        uri = _qualified(spark, p).rstrip("/")
        candidate = F.when((at == uri) | at.startswith(f"{uri}/"), i).otherwise(candidate)
    lines = spark.read.text(paths).select(candidate.alias("i"), "value").where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    has = [F.bool_or(F.coalesce(F.array_contains(keys, k), F.lit(False))).alias(f"has_{n}") for n, k in enumerate(required)]
    counts = lines.groupBy("i").agg(F.count("*").alias("n"), *has).collect()  # one row a candidate
    scored = sorted(((r["n"], paths[r["i"]]) for r in counts if r["n"] >= min_rows and all(r[2:])), reverse=True)
    if not scored:
        raise FileNotFoundError("no plausible manifest")
    if len(scored) > 1 and scored[0][0] == scored[1][0]:
        raise ValueError(f"tie between {scored[0][1]} and {scored[1][1]}")
    return scored[0][1]
