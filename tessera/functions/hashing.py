"""Stable hashes, for samples that do not depend on partitions or engines."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\0"


def _bytes(c: Column) -> Column:
    return c.cast("string").cast("binary")


def stable_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a NUL."""
    ended = [x for p in parts for x in (_bytes(p), F.lit(NUL).cast("binary"))]
    return F.sha2(F.concat(*ended), 256)


def salted_hash(salt: str, *parts: Column, separator: str = NUL) -> Column:
    """SHA-256 over a salt and parts, each led by the separator; another separator draws another sample."""
    led = [x for p in parts for x in (F.lit(separator).cast("binary"), _bytes(p))]
    return F.sha2(F.concat(F.lit(salt).cast("binary"), *led), 256)


@F.pandas_udf(T.StringType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys and no blanks; null for what is no JSON."""

    def one(t):
        try:
            value = json.loads(t)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return texts.map(one)


@F.pandas_udf(T.StringType())
def waveform_hash(signals: pd.Series, rates: pd.Series) -> pd.Series:
    """SHA-256 of the rate, the length and the float32 samples."""

    def one(x, rate):
        raw = np.asarray(x, dtype="<f4")
        return hashlib.sha256(f"sr={int(rate)};n={len(raw)};".encode() + raw.tobytes()).hexdigest()

    return pd.Series([None if x is None else one(x, r) for x, r in zip(signals, rates, strict=True)])


def fingerprint(*columns: Column) -> Column:
    """A signature of a configuration row."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def unit_draw(*parts: Column) -> Column:
    """A stable number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(stable_hash(*parts), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
