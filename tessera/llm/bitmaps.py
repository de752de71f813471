"""Bitmaps of fixed size over hashes, which spare rows a shuffle and never drop one that counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import U64

#: Bits of the bitmap of rows.
ROW_BITS = 26


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a bitmap of ``2**bits``; all bits of a hash have to be as good as random."""
    return (hashes >> U64(64 - bits)).astype(np.int64)


def held(some: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether slots are in a bitmap, or in an ascending list of slots."""
    if some.dtype != U64:
        at = np.minimum(np.searchsorted(some, slot), max(len(some) - 1, 0))
        return some[at] == slot if len(some) else np.zeros(len(slot), dtype=bool)
    return (some[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1


#: Slots that are sent as a list; more of them are sent as a bitmap.
FEW = 1 << 16


def listed(bitmap: np.ndarray) -> np.ndarray:
    """The slots of a bitmap that holds a few, ascending; else the bitmap."""
    words = np.flatnonzero(bitmap)
    if int(np.bitwise_count(bitmap[words]).sum()) > FEW:
        return bitmap
    bits = (bitmap[words][:, None] >> np.arange(64, dtype=U64)) & U64(1) == 1
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def recurring(slots: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Of counts (slot, n): a bitmap of the slots that occur more than once, those that do more than ``hot`` times (``listed``; None without any), and the sum of all counts over one."""
    total = slots.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = total.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("twice"), F.bit_or(F.when(F.col("n") > hot, bit).otherwise(F.lit(0))).alias("often"), F.sum("n").alias("n")).toArrow()
    at, out = words.column("word").to_numpy(), []
    for name in ("twice", "often"):
        out.append(np.zeros((1 << bits) // 64, dtype=U64))
        out[-1][at] = words.column(name).to_numpy().view(U64)
    return out[0], listed(out[1]) if out[1].any() else None, pc.sum(words.column("n")).as_py() or 0


def parted(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``on`` may be among ``keys``, and those whose is not: two scans without a shuffle."""
    slot = F.shiftrightunsigned(F.xxhash64(*on), 64 - ROW_BITS).alias("slot")
    words = keys.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros((1 << ROW_BITS) // 64, dtype=U64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    sent, names = rows.sparkSession.sparkContext.broadcast(bitmap), rows.columns

    def where(wanted: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held(sent.value, batch.column(0).to_numpy()) == wanted)).select(names)

        return rows.select(slot, *names).mapInArrow(keep, rows.schema)

    return where(True), where(False)
