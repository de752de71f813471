"""Binary formats as tables: audio headers and samples, array archives, container members, texts of unknown encoding.

Whole files are read by Spark's binaryFile source and decoded batch by batch in tasks; headers,
members of archives and rows of arrays are read by seeking (``archives``). What cannot be
decoded becomes an error column.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import archives


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def paths(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths of the files alone: a scan that does not read their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def decode_wav(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Mono float32 samples in [-1, 1] by the mean of channels, rate, channels."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, dtype=f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1, dtype=np.float32), rate, channels


HEADER = T.StructType([T.StructField("path", T.StringType()), T.StructField("sample_rate_hz", T.IntegerType()), T.StructField("num_channels", T.IntegerType()), T.StructField("num_frames", T.LongType()), T.StructField("duration_sec", T.DoubleType()), T.StructField("error", T.StringType())])


def audio_headers(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Header facts of every file, or the error that reading it gave; of a file, only what precedes its samples is read."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path in part["path"]:
                try:
                    with archives.open_file(path) as f, wave.open(f) as w:
                        rows.append((path, w.getframerate(), w.getnchannels(), w.getnframes(), w.getnframes() / w.getframerate(), None))
                except (wave.Error, EOFError, ZeroDivisionError, OSError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=HEADER.names)
            yield out.astype({"sample_rate_hz": "Int32", "num_channels": "Int32", "num_frames": "Int64"})

    return paths(spark, root, pattern).mapInPandas(scan, HEADER)


SAMPLES = T.StructType([T.StructField("path", T.StringType()), T.StructField("signal", T.ArrayType(T.FloatType())), T.StructField("sample_rate_hz", T.IntegerType())])


def audio_signals(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, raw in zip(part["path"], part["content"], strict=True):
                x, rate, _ = decode_wav(raw)
                yield pd.DataFrame({"path": [path], "signal": [x], "sample_rate_hz": [rate]})

    return files(spark, root, pattern).mapInPandas(read, SAMPLES)


def header_mismatches(headers: DataFrame, manifest: DataFrame, on: str) -> DataFrame:
    """Manifest rows whose header facts differ from their file's."""
    facts = ("sample_rate_hz", "num_channels", "num_frames")
    h = headers.select(on, *[F.col(f).alias(f"file_{f}") for f in facts])
    joined = manifest.join(h, on)
    wrong = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"file_{f}").cast("long")), F.lit(f)) for f in facts]), lambda x: x.isNotNull())
    return joined.select(on, wrong.alias("wrong")).where(F.size("wrong") > 0)


def array_archives(spark: SparkSession, root: str) -> DataFrame:
    """Every row of every array of the array archives under ``root``: numbers as values, text as text, faults as errors."""
    return archives.array_rows(archives.array_index(spark, root))


def array_coverage(arrays: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Per text array its rows and how many of the wanted ids it holds: which arrays look like ids."""
    wanted = ids.select(F.col(id_col).alias("text")).distinct().withColumn("__w", F.lit(True))
    texts = arrays.where(F.col("text").isNotNull()).join(wanted, "text", "left")
    return texts.groupBy("path", "array").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("__w"), F.col("text"))).alias("covered"))


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """path, member, size and error of the members of the zip and tar archives under ``root``; contents are not read."""
    return archives.archive_index(spark, root).select("path", "member", "size", "error")


#: Suffixes of audio files, in lower case.
AUDIO = (".wav", ".flac", ".ogg", ".aiff", ".aif")


def archive_summary(members: DataFrame) -> DataFrame:
    """Per archive its members, how many of them are audio, and the error that ended its reading, if any."""
    audio = F.lower(F.concat(F.lit("."), F.substring_index("member", ".", -1))).isin(*AUDIO)
    return members.groupBy("path").agg(F.count("member").alias("members"), F.count(F.when(audio & F.col("member").contains("."), 1)).alias("audio_members"), F.max("error").alias("error"))


def top_prefixes(members: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent first path components of members."""
    return members.groupBy(F.substring_index("member", "/", 1).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(n)


#: Encodings tried in order; the last accepts any bytes.
ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text of bytes by the first encoding that accepts them."""

    def one(b):
        if b is None:
            return None
        for e in ENCODINGS:
            try:
                return bytes(b).decode(e)
            except UnicodeDecodeError:
                continue
        return None

    return raw.map(one)


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def verified(rows: DataFrame, digests: DataFrame, path: str, expected: str) -> DataFrame:
    """Rows whose file is missing or has another digest than expected."""
    d = digests.select(F.col("path").alias(path), file_digest(F.col("content")).alias("__d"))
    return rows.join(d, path, "left").where(~F.col(expected).eqNullSafe(F.col("__d"))).select(*rows.columns, F.col("__d").alias("found_sha256"))
