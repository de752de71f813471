"""Packing of tokenized documents into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of
them and every shorter document is placed, longest first, into the open window
with the least sufficient room, found in a segment tree over remaining room.

Tokenizing happens where the rows lie. Only piece records (a few numbers each)
are shuffled, to shards of about as many documents each by a hash of the piece
(id, start and the checksum of its tokens), so no source, length, copy group or
long document, nor rows without an id, can gather in one task; each shard packs
its own windows and numbers them from ``shard << 32``. A shard leaves only its
last windows part full. The hash follows from the piece alone, so a task that is
run again after an executor was lost deals its pieces as before; only rows equal
in id and text share a shard.

Null texts are empty and still get their end id. Repeated rows are packed each
on its own. Equal lengths are placed by id, then by start, so results do not
depend on the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pretokens import default_tokenizer_path, encode_rows
from tessera.llm.textbytes import U64, mixed, slices, small_batches

WINDOW = 2048
#: Documents whose pieces one task packs.
SHARD_DOCS = 4_096


class RoomTree:
    """Open windows by remaining room, in a segment tree that finds the least room that suffices."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, ident: int) -> None:
        self.open[room].append(ident)
        i, count = self.size + room, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the tightest open window with room >= need."""
        i, count = self.size + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; lengths must not increase and be at most window."""
    tree, where, offset, opened = RoomTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, ident = found if found else (window, opened)
        opened += not found
        where.append(ident)
        offset.append(window - room)
        if room > n:
            tree.add(room - n, ident)
    return where, offset


def copy_numbers(ids: pa.Array, start: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """0 for the first piece of its id, start and content, 1 for the next, and so on."""
    known = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy()
    key = mixed(known.view(U64) * U64(0x9E3779B97F4A7C15) + mixed((start.astype(U64) << U64(32)) ^ crc.astype(U64)))
    order = np.argsort(key, kind="stable")
    held = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.searchsorted(held, held)
    return out


def cut_pieces(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, window: int, path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Tokenizes documents and cuts each into full windows and a remainder."""
    for rows, data, offsets in slices(batches, text_col):
        ids, at = encode_rows(data, offsets, path)
        total = np.diff(at)
        pieces = (total + window - 1) // window
        row = np.repeat(np.arange(len(total)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = nth * window
        length = np.minimum(window, total[row] - start)
        first = at[:-1][row] + start
        raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        columns = [rows.column(rows.schema.get_field_index(id_col)).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])]
        columns.append(pa.array(copy_numbers(columns[0], start, np.array(crc, np.int64))))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, first[-1:] + length[-1:]) if len(first) else [0], pa.int32()), pa.array(ids.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pack_shard(window: int):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(pieces["length"].tolist(), window)
        pieces["sequence_id"] = (int(key[0]) << 32) + np.array(where, dtype=np.int64)
        pieces["offset"] = np.array(offset, dtype=np.int64)
        return pieces.drop(columns="shard")

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer_path: str | None = None, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``docs`` needs an integer ``id_col`` and a string ``text_col``; other columns are not read.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()
    shards = max(1, -(-docs.count() // shard_docs))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: cut_pieces(it, "doc_id", "text", window, path, with_ids), fields)
    # copies that were read together are dealt out too, so that no row repeats its way into one shard
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("shard", shard).drop("copy")
    return dealt.groupBy("shard").applyInPandas(pack_shard(window), fields.replace(", copy long", "") + ", sequence_id long, offset long")


def op3_sequence_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
