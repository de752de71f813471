"""Readers and writers of manifests, task rows, indexes, metrics and reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import blank_to_null, dataset_of, first_present
from tessera.operators.contracts import MANIFEST, fail_closed, manifest_rules, refuse_sealed
from tessera.operators.inventory import assert_empty, duplicate_keys


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped. With ``strict``, running it fails at a bad line, naming its file and text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), "value").where(F.trim("value") != "")
    kept = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in kept.fields])
    rows = lines.select("__file", F.from_json("value", nullable, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), "value")
    if not strict:
        return rows.select("r.*", F.col("r.__bad").isNotNull().alias("is_bad")).drop("__bad")
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    ok = F.when(~bad, True).otherwise(F.raise_error(F.concat("__file", F.lit(": "), F.substring("value", 1, 200))).cast("boolean"))
    return rows.where(ok).select("r.*").drop("__bad")


def read_manifest(spark: SparkSession, path: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """A manifest of which running any row fails that is malformed or violates the contract."""
    return fail_closed(read_jsonl(spark, path, MANIFEST), manifest_rules() if rules is None else rules)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """JSON lines with keys in order and non-ASCII kept; returns the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.select(*sorted(rows.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


TASK = T.StructType([T.StructField(n, T.StringType()) for n in ("utt_id", "dataset", "task_label", "label", "transcript", "split", "speaker_id", "sample_hash")])


def read_task_rows(spark: SparkSession, path: str, label_order: tuple[str, ...] = ("task_label", "label", "transcript"), splits: tuple[str, ...] = ("train", "dev")) -> DataFrame:
    """Task rows with the first field that is present as label, and the dataset from a qualified id where it is missing.

    A request for the test split is refused. Frame caches take ``label`` first, feature caches ``task_label``.
    """
    if "test" in splits:
        raise ValueError("the test split is sealed")
    rows = read_jsonl(spark, path, TASK).where(F.col("split").isin(*splits))
    return rows.select("utt_id", dataset_of(F.col("dataset"), F.col("utt_id")).alias("dataset"), first_present(*[F.col(c) for c in label_order]).alias("label"), "split", blank_to_null(F.col("speaker_id")).alias("speaker_id"), blank_to_null(F.col("sample_hash")).alias("sample_hash"))


def read_unique_task_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """``read_task_rows``; fails now if a (dataset, utt_id) occurs twice."""
    rows = read_task_rows(spark, path, **options)
    assert_empty(duplicate_keys(rows, "dataset", "utt_id"), "duplicate task rows")
    return rows


INDEX = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset", "utt_id", "split", "sample_hash", "shard")] + [T.StructField(n, T.LongType()) for n in ("row_in_shard", "start_frame", "end_frame", "frame_count", "hidden_dim")])


def read_cache_index(spark: SparkSession, path: str) -> DataFrame:
    """A feature cache's index; fails now if a (dataset, utt_id) occurs twice."""
    rows = read_jsonl(spark, path, INDEX)
    assert_empty(duplicate_keys(rows, "dataset", "utt_id"), "duplicate index keys")
    return rows


TEMPORAL = T.StructType([T.StructField("utt_id", T.StringType()), T.StructField("cache_relpath", T.StringType()), T.StructField("frames", T.LongType())])


def read_temporal_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a temporal cache, with the path of each entry's file; fails now if an utt_id occurs twice."""
    base = f"{folder.rstrip('/')}/temporal"
    rows = read_jsonl(spark, f"{base}/index.jsonl", TEMPORAL)
    assert_empty(duplicate_keys(rows, "utt_id"), "duplicate index keys")
    return rows.withColumn("path", F.concat(F.lit(f"{base}/"), "cache_relpath"))


#: Frames of a block: a shard's frames are joined, stored and read by blocks, so that no shard is one key.
FRAME_BLOCK = 4096
#: Folders and buckets in a folder of stored frames.
FRAME_PARTS, FRAME_BUCKETS = 64, 16


def _block_of(frame: Column, width: int) -> Column:
    return F.floor(frame / width)


def _index_blocks(index: DataFrame, width: int) -> DataFrame:
    """One row for each block that an utterance's range touches; an empty range touches none."""
    i = index.select("utt_id", "shard", "start_frame", "end_frame").where(F.col("end_frame") > F.col("start_frame"))
    return i.select("*", F.explode(F.sequence(_block_of(F.col("start_frame"), width), _block_of(F.col("end_frame") - 1, width))).alias("block"))


def _in_range(joined: DataFrame) -> DataFrame:
    inside = (F.col("frame_idx") >= F.col("start_frame")) & (F.col("frame_idx") < F.col("end_frame"))
    return joined.where(inside).select("utt_id", (F.col("frame_idx") - F.col("start_frame")).alias("frame"), "vec")


def utterance_frames(frames: DataFrame, index: DataFrame, width: int = FRAME_BLOCK) -> DataFrame:
    """Frame rows (shard, frame_idx, vec) of each indexed utterance: an equi-join on blocks of a shard, then the range."""
    return _in_range(frames.withColumn("block", _block_of(F.col("frame_idx"), width)).join(_index_blocks(index, width), ["shard", "block"]))


def _part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("shard", "block"), F.lit(parts)).cast("int")


def store_frames(frames: DataFrame, table: str, width: int = FRAME_BLOCK, parts: int = FRAME_PARTS, buckets: int = FRAME_BUCKETS) -> None:
    """Frames (shard, frame_idx, vec) as a table in folders by a hash of (shard, block), bucketed and sorted by them; refuses to overwrite."""
    rows = frames.withColumn("block", _block_of(F.col("frame_idx"), width)).withColumn("part", _part_of(parts))
    dealt = rows.repartition("part").sortWithinPartitions("part", "shard", "block", "frame_idx")
    dealt.write.partitionBy("part").bucketBy(buckets, "shard", "block").sortBy("shard", "block", "frame_idx").format("parquet").mode("errorifexists").saveAsTable(table)


def stored_frames(spark: SparkSession, table: str, index: DataFrame, width: int = FRAME_BLOCK, parts: int = FRAME_PARTS) -> DataFrame:
    """As ``utterance_frames``, from a stored table: only folders that the index touches are read, and stored rows are not exchanged.

    ``width`` and ``parts`` are those that the table was stored with.
    """
    blocks = _index_blocks(index, width)
    touched = sorted(r[0] for r in blocks.select(_part_of(parts)).distinct().collect())  # at most ``parts``
    frames = spark.table(table).where(F.col("part").isin(touched)) if touched else spark.table(table).where(F.lit(False))
    return _in_range(frames.drop("part").join(blocks, ["shard", "block"]))


METRICS = T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("train_loss", T.DoubleType()), T.StructField("train_examples", T.DoubleType()), T.StructField("dev", T.StructType([T.StructField("generic_dev_score", T.DoubleType()), T.StructField("generic_dev_score_name", T.StringType())])), T.StructField("checkpoint", T.StringType()), T.StructField("checkpoint_sha256", T.StringType())])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Epoch metrics; refuses fields of sealed splits that the lines hold, nested ones included."""
    refuse_sealed(spark.read.json(path))
    return read_jsonl(spark, path, METRICS)


def append_metrics(rows: DataFrame, path: str, batch: int | str | None = None) -> bool:
    """Adds a batch of rows to a log of JSON lines; False if the log has the batch already.

    A batch is written aside and then renamed to its folder, which is its commit: a batch that was sent twice, or begun by a
    driver that was lost, is there once and whole. Without a name a batch is new.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex if batch is None else str(batch)
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"a batch's name may hold letters, digits, _ and -: {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    done, aside = place(f"{path}/batches/{name}"), f"{path}/_aside/{name}-{uuid.uuid4().hex}"
    store = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(done):
        return False
    rows.write.json(aside)
    store.mkdirs(done.getParent())
    if not store.rename(place(aside), done):
        raise OSError(f"batch {name} could not be committed")
    return True


def metric_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: a batch that a restarted query sends again is not added again."""

    def add(rows: DataFrame, batch: int) -> None:
        append_metrics(rows, path, batch)

    return add


def read_metric_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All committed batches."""
    return spark.read.schema(schema).json(f"{path}/batches/*")


def stream_metric_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Committed batches as a stream; what is written aside is never seen."""
    return spark.readStream.schema(schema).json(f"{path}/batches/*")


# Kinds of backbones that a sweep may name.
BACKBONES = ("wav2vec2", "wavlm", "w2v_bert2")


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else text.strip("'\"")


def sweep_of_text(text: str) -> dict:
    """A sweep written as JSON, or in block form: a key, and below it a list of entries of one field a line.

    Lists are written in brackets or as items of their own lines; comments and blank lines are skipped. Anything else is refused.
    """
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    entries = field = None
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        found = re.fullmatch(r"(\s*)(- )?\s*(?:([A-Za-z_]\w*):(?:\s+(.*))?|(\S.*))", line)
        if not line:
            continue
        if found is None:
            raise ValueError(f"not understood: {line}")
        indent, item, key, value, bare = found.groups()
        if key and not indent and not item:
            entries = out[key] = [] if value is None else _scalar(value)
        elif key and isinstance(entries, list):
            if item:
                entries.append({})
            if not entries:
                raise ValueError(f"a field of no entry: {line}")
            field = entries[-1][key] = [] if value is None else _scalar(value)
        elif item and bare and isinstance(field, list):
            field.append(_scalar(bare))
        else:
            raise ValueError(f"not understood: {line}")
    return out


def expand_sweep(spark: SparkSession, config: str | dict) -> DataFrame:
    """Unique (backbone, base_config, hidden_layer) candidates of a sweep configuration, a mapping or its text.

    Unknown kinds, missing or absolute base configurations, layers that are no whole numbers from 0, repeated
    candidates and sweeps without any are refused.
    """
    payload = sweep_of_text(config) if isinstance(config, str) else config
    entries = payload.get("backbones") if isinstance(payload, dict) else None
    if not isinstance(entries, list):
        raise ValueError("backbones must be a list")
    rows = []
    for entry in entries:
        kind, base, layers = str(entry.get("kind", "")).strip().lower(), str(entry.get("base_config", "")).strip(), entry.get("hidden_layers")
        if kind not in BACKBONES:
            raise ValueError(f"unknown kind: {kind}")
        if not base or base.startswith("/"):
            raise ValueError(f"base_config must be a relative path: {base}")
        if not isinstance(layers, list) or any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in layers):
            raise ValueError(f"hidden_layers must be whole numbers from 0: {layers}")
        rows += [(kind, base, n) for n in layers]
    if not rows or len({(k, n) for k, _, n in rows}) != len(rows):
        raise ValueError("no candidates" if not rows else "duplicate candidates")
    return spark.createDataFrame(rows, "backbone string, base_config string, hidden_layer int")


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of a sweep file."""
    text = spark.read.text(path, wholetext=True).first()
    return expand_sweep(spark, text["value"] if text else "")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, whose first name may carry a byte order mark."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def write_csv_with_mark(rows: DataFrame, path: str) -> None:
    """CSV with a header whose first name begins with a byte order mark, in every part."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"﻿{first}").write.option("header", True).mode("errorifexists").csv(path)


def write_report(spark: SparkSession, path: str, one_row: DataFrame) -> None:
    """A nested report of one row as JSON; refuses to overwrite."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_views(manifest: DataFrame, views: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> dict[str, int]:
    """Several task views of one manifest, which is scanned once and kept while they are written."""
    held = manifest.persist()
    try:
        return {name: write_jsonl(view(held), f"{folder}/{name}") for name, view in views.items()}
    finally:
        held.unpersist()


#: Folders of saved memories; a user's rows lie in one of them.
MEMORY_BUCKETS = 256


def _memory_bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user_id.cast("string")), F.lit(buckets)).cast("int")


def save_memory(memory: DataFrame, path: str, buckets: int = MEMORY_BUCKETS) -> None:
    """User memories (user_id, intent_id, canonical_text, example_no, global, temporal), in folders by a hash of the user.

    The number of folders is fixed, so millions of users do not make as many; within a file rows are sorted by user.
    """
    rows = memory.withColumn("user_bucket", _memory_bucket(F.col("user_id"), buckets))
    rows.repartition("user_bucket").sortWithinPartitions("user_bucket", "user_id").write.partitionBy("user_bucket").mode("errorifexists").parquet(path)


def load_memory(spark: SparkSession, path: str, dims: int, user: str | None = None, buckets: int = MEMORY_BUCKETS) -> DataFrame:
    """Saved memories, checked again as when they were enrolled; with ``user``, only that user's folder is read."""
    from tessera.plans.recognition import checked_enrollment

    rows = spark.read.parquet(path).withColumn("user_id", F.col("user_id").cast("string"))
    if user is not None:
        rows = rows.where((F.col("user_bucket") == _memory_bucket(F.lit(user), buckets)) & (F.col("user_id") == user))
    return checked_enrollment(rows.drop("user_bucket"), dims)
