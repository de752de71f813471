"""Removal of repeated byte strings by longest-previous-factor arrays, dealt out by minimizers.

A string of ``min_length`` bytes (a window) that occurs twice has the same least
hash of ``GRAM`` bytes, its minimizer, at both places. Windows that start next to
each other mostly share it, so each document falls into segments: runs of windows
with one minimizer. Equal windows can only lie in segments of one minimizer, and
so suffix arrays need not span the corpus:

1. Minimizers of all segments are counted; one of a single segment repeats nothing,
   unless it recurs inside it.
2. Segments of the others go, with their bytes, to the bucket of their minimizer. There
   copies are compared on all of their bytes, and the windows of those that differ are put
   in suffix order, where the previous and next smaller (and greater) positions show
   whether the longest match with an earlier (later) one reaches ``min_length``.
3. Minimizers of more than ``HOT`` segments would overfill a bucket. Their segments are
   grouped by all of their bytes into kinds first; further copies of a kind repeat in
   full, and the first copies go to buckets as above.
4. Minimizers of which more than ``HOT`` kinds are left are cut into single windows,
   which are grouped by two hashes; the first and last copy of each window that recurs
   go through suffix order in buckets of their own, and further copies take over what is
   found on the bytes of these two.

The counts of step 1 and the rows that lose something reach the tasks as bitmaps of a
fixed size, which only spare rows a shuffle: beyond about ``2**BITMAP_BITS`` segments
more of them pass, and results are the same.

``keep="none"`` removes every occurrence, ``keep="first"`` all but the first, by id,
then in the order of rows of one id; null ids come last. Texts are UTF-8 bytes,
matches never cross documents, null texts are empty, and texts shorter than
``min_length`` stay. What is removed is judged on the input. Every row is a document,
whatever its id: rows are told apart by two hashes of id and text, since rows equal in
both have equal results, or with ``keep="first"`` by a number kept with the texts in
the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import held, parted, recurring, slots_of
from tessera.llm.checkpoints import cut
from tessera.llm.textbytes import CODES, U64, RollingHash, mixed, slices, small_batches

MIN_LENGTH = 200
GRAM = 24
#: Segments of a bucket, of about 290 bytes each, and segments of one minimizer beyond which it gets none: 4,096 segments
#: are 1.5 MB at most, for which suffix order takes about 100 MB.
BUCKET_SEGMENTS = 2048
HOT = 4096
BITMAP_BITS = 27
SLICE = 1 << 20
OTHER_BASE = 0xD6E8FEB86659FD93 | 5


class Segments:
    """Segments of a slice of documents: minimizer, hash, document row, first window, windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        span = length - GRAM + 1
        self.rolling = RollingHash(CODES[data])
        windows = len(data) - length + 1
        empty = np.zeros(0, dtype=np.int64)
        self.start = self.windows = self.row = empty
        self.inner = np.zeros(0, dtype=bool)
        self.minimizer = np.zeros(0, dtype=U64)
        if windows < 1:
            return
        grams = mixed(self.rolling.grams(GRAM))
        least = _sliding_least(grams, span)
        # windows that begin in a document's last bytes would cross into the next
        inside = np.ones(windows, dtype=bool)
        for a, b in zip(np.maximum(offsets[1:] - length + 1, offsets[:-1]).tolist(), offsets[1:].tolist(), strict=True):
            inside[a : min(b, windows)] = False
        new = np.ones(windows, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        edges = offsets[1:-1]
        new[edges[edges < windows]] = True
        start = np.flatnonzero(new & inside)
        breaks = np.append(np.flatnonzero(new | ~inside), windows)
        run = breaks[np.searchsorted(breaks, start, side="right")] - start
        # text with a short period has one minimizer on and on: segments of at most ``span`` windows
        parts = -(-run // span)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(start, parts) + nth * span
        self.windows = np.minimum(np.repeat(run, parts) - nth * span, span)
        self.end = self.start + self.windows + length - 1
        #: Whether windows within the segment may be equal: one but the last begins with the minimizer.
        leads = np.concatenate([[0], np.cumsum(grams[:windows] == least)])
        self.inner = leads[self.start + self.windows - 1] > leads[self.start]
        # the least of many hashes is small: mixed again, all of its bits are as good as random
        self.minimizer = mixed(least[self.start])
        self.row = np.searchsorted(offsets, self.start, side="right") - 1


def _sliding_least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours, from running minima of blocks in both directions."""
    n = len(h)
    padded = np.full(-(-n // span) * span, np.iinfo(U64).max, dtype=U64)
    padded[:n] = h
    grid = padded.reshape(-1, span)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], forth[span - 1 : n])


def _packed(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First window and number of windows in one number, ordered by the first."""
    return (start << 16) | (windows << 1)


#: The parts of such a number in SQL.
START, WINDOWS = "shiftright({0}, 16)", "shiftright({0}, 1) & 32767"


def _count_minimizers(length: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches, "text", SLICE):
            s = Segments(data, offsets, length)
            slot, n = np.unique(slots_of(np.concatenate([s.minimizer, s.minimizer[s.inner]]), bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int32))], ["slot", "n"])

    return count


def _bodies(s: Segments, data: np.ndarray, keep: np.ndarray) -> pa.Array:
    size = (s.end - s.start)[keep] if len(keep) else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    text = data[np.repeat(s.start[keep] - (ends - size), size) + np.arange(size.sum())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])


def _list_segments(length: int, bits: int, bitmap, but=None):
    """Segments whose minimizers are in one bitmap and not in another."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text", SLICE):
            s = Segments(data, offsets, length)
            slot = slots_of(s.minimizer, bits)
            keep = held(bitmap.value, slot)
            if but is not None:
                keep &= ~held(but.value, slot)
            keep = np.flatnonzero(keep)
            row = s.row[keep]
            columns = [s.minimizer[keep].view(np.int64), *(rows.column(i).to_numpy()[row] for i in (0, 1)), _packed(s.start[keep] - offsets[row], s.windows[keep])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), _bodies(s, data, keep)], ["minimizer", *PLACE, "body"])

    return segments


KIND = ["minimizer", "hash"]
PLACE = ["doc", "tag", "at"]
SEGMENT = "minimizer long, doc long, tag long, at long, body binary"
TEXTS = "minimizer long, hash long, doc long, tag long, at long, body binary"
BODY = [*KIND, *PLACE, "body"]


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """Each position's next 8 bytes as a number, zeros beyond the end."""
    n = len(text)
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = text
    out = np.empty(-(-n // 8) * 8, dtype=U64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(">u8")[: len(out) // 8]
    return out[:n]


def _order_numbers(key: np.ndarray) -> np.ndarray:
    """1 for the least key, 2 for the next greater, and so on."""
    order = np.argsort(key)
    held = key[order]
    step = np.zeros(len(key), dtype=np.int64)
    step[1:] = held[1:] != held[:-1]
    rank = np.empty(len(key), dtype=U64)
    rank[order] = np.cumsum(step) + 1
    return rank


def suffix_ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The order numbers of ``starts`` by their next ``length`` bytes.

    Numbers for longer pieces are made of as many shorter ones as a word holds, the last two
    overlapping if need be, so the sorts triple the length where others double it.
    """
    n = len(text)
    bits = max(n, 1).bit_length()
    per = 64 // bits
    rank, size, at = _order_numbers(eight_bytes(text)), 8, np.arange(n)
    while size < length:
        last = per * size >= length
        whole = length if last else per * size
        at = starts if last else at
        padded = np.concatenate([rank, np.zeros(whole, dtype=U64)])
        key = np.zeros(len(at), dtype=U64)
        for k in range(-(-whole // size)):
            key = (key << U64(bits)) | padded[at + min(k * size, whole - size)]
        rank, size = _order_numbers(key), whole
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with a smaller value, -1 without; pointers jump over larger values."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        to = at[open_]
        open_ = open_[values[to] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def has_long_factor(position: np.ndarray, rank: np.ndarray, later: bool = False) -> np.ndarray:
    """For suffixes in suffix order, whether the longest match with an earlier (or later) position has the ranked length.

    The longest previous factor of a suffix is shared with the previous or the next smaller
    position in suffix order; it has the ranked length where that one's rank is the same.
    """
    n, values = len(position), -position if later else position
    before = previous_smaller(values)
    after = n - 1 - previous_smaller(values[::-1])[::-1]
    hit = np.zeros(n, dtype=bool)
    for to in (before, after):
        some = np.flatnonzero((to >= 0) & (to < n))
        hit[some] |= rank[some] == rank[to[some]]
    return hit


def _repeat_flags(bodies: list[bytes], windows: np.ndarray, length: int, keep: str) -> np.ndarray:
    """For all windows of differing segments, in order, whether an earlier one (or any, if none is kept) is equal."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    nth = np.repeat(np.arange(len(windows)), windows)
    starts = (np.cumsum(size) - size)[nth] + np.arange(len(nth)) - np.repeat(np.cumsum(windows) - windows, windows)
    flags = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return flags
    # windows whose hash is the only one of its kind need no place in the order
    h = RollingHash(CODES[text]).ranges(starts, starts + length)
    held = np.sort(h)
    often = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(often):
        return flags
    some = np.flatnonzero(often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h)
    # of the text, only what these windows cover
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, starts[some] + length, -1)
    covered = np.cumsum(edge)[:-1] > 0
    place = (np.cumsum(covered) - 1)[starts[some]]
    rank = suffix_ranks(text[covered], place, length)
    order = np.argsort(rank, kind="stable")
    hit = has_long_factor(place[order], rank[order])
    if keep == "none":
        hit |= has_long_factor(place[order], rank[order], later=True)
    flags[some[order[hit]]] = True
    return flags


def _window_flags(bodies: list[bytes], windows: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window of segments, in their order, repeats; its segment, and its number there."""
    nth = np.repeat(np.arange(len(windows)), windows)
    local = np.arange(len(nth)) - np.repeat(np.cumsum(windows) - windows, windows)
    # a copy of all bytes of a segment repeats with it; suffix order is for those that differ
    first: dict[bytes, int] = {}
    origin = np.fromiter((first.setdefault(body, i) for i, body in enumerate(bodies)), np.int64, len(bodies))
    copy = origin != np.arange(len(bodies))
    flags = copy[nth]
    own = np.flatnonzero(~copy)
    of_own = np.zeros(len(nth), dtype=bool)
    of_own[~copy[nth]] = _repeat_flags([bodies[i] for i in own.tolist()], windows[own], length, keep)
    flags |= of_own
    if keep == "none":  # a later match counts too
        copied = np.zeros(len(bodies), dtype=bool)
        copied[origin[copy]] = True
        flags |= copied[nth]
    return flags, nth, local


def _runs(flags: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of flagged windows that lie side by side."""
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1] | (local[1:] == 0)
    last[:-1] &= ~flags[1:] | (local[1:] == 0)
    return np.flatnonzero(first), np.flatnonzero(last)


def _bucket_spans(length: int, keep: str):
    """Spans of repeated windows among the segments of a bucket."""

    def spans(table: pa.Table) -> pa.Table:
        table = table.select([*PLACE, "body"]).sort_by([(c, "ascending") for c in PLACE])
        doc, tag, at = (table.column(c).to_numpy() for c in PLACE)
        flags, nth, local = _window_flags(table.column("body").to_pylist(), (at >> 1) & 32767, length, keep)
        a, b = _runs(flags, local)
        k = nth[a]
        return pa.table([doc[k], tag[k], (at[k] >> 16) + local[a], (at[k] >> 16) + local[b] + length], names=["doc", "tag", "start", "end"])

    return spans


def _repeated_windows(length: int, keep: str):
    names = ["minimizer", "hash", "doc", "tag", "start", "end", "whole"]
    schema = pa.schema([(c, pa.bool_() if c == "whole" else pa.int64()) for c in names])

    def repeated(table: pa.Table) -> pa.Table:
        """Spans of repeated windows in a bucket of windows, and the (minimizer, hash) of which a second copy is one such span."""
        table = table.sort_by([("doc", "ascending"), ("tag", "ascending"), ("at", "ascending")])
        minimizer, kind, doc, tag, at = (table.column(c).to_numpy() for c in BODY[:5])
        start, windows = at >> 16, (at >> 1) & 32767
        flags, nth, local = _window_flags(table.column("body").to_pylist(), windows, length, keep)
        a, b = _runs(flags, local)
        k = nth[a]
        # a kind's copies stand one after another, in their order
        of_kind = np.lexsort((np.arange(len(kind)), kind, minimizer))
        again = of_kind[1:][(kind[of_kind[1:]] == kind[of_kind[:-1]]) & (minimizer[of_kind[1:]] == minimizer[of_kind[:-1]])]
        full = again[np.logical_and.reduceat(flags, np.cumsum(windows) - windows)[again]] if len(again) else again
        n, m = len(k), len(full)
        columns = [np.append(x[k], x[full]) for x in (minimizer, kind, doc, tag)]
        columns += [np.append(start[k] + local[a], start[full]), np.append(start[k] + local[b] + length, start[full] + windows[full] + length - 1), np.arange(n + m) >= n]
        return pa.table(columns, schema=schema)

    return repeated


def _window_hashes(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row and two hashes of all bytes of each of its windows."""
    at = batch.column(4).to_numpy()
    for i, body in enumerate(batch.column(5).to_pylist()):
        symbols = CODES[np.frombuffer(body, dtype=np.uint8)]
        nth = np.arange(int(at[i] >> 1) & 32767)
        yield i, [mixed(RollingHash(symbols, *b).ranges(nth, nth + length)) for b in ((), (OTHER_BASE,))]


def _count_window_slots(length: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [slots_of(keys[0], bits) for _, keys in _window_hashes(batch, length)]
            slot, n = np.unique(np.concatenate(slots) if slots else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int32))], ["slot", "n"])

    return count


def _hash_windows(length: int, bits: int, bitmap):
    """Cuts segments into single windows; ``at`` holds a window's start and its distance from the segment's."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, at = (batch.column(i).to_numpy() for i in (2, 3, 4))
            for i, keys in _window_hashes(batch, length):
                nth = np.flatnonzero(held(bitmap.value, slots_of(keys[0], bits)))
                columns = [*(k[nth].view(np.int64) for k in keys), np.full(len(nth), doc[i]), np.full(len(nth), tag[i]), _packed((at[i] >> 16) + nth, nth)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], BODY[:5])

    return hashes


def _cut_windows(length: int):
    """Texts of single windows out of the texts of segments, for windows listed by segment."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, tag, body, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "body", "places")), strict=True):
                for p in places:
                    from_, nth = p["at"] >> 16, (p["at"] >> 1) & 32767
                    out.append((p["minimizer"], p["hash"], doc, tag, (from_ << 16) | 2, body[nth : nth + length]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i == 5 else pa.int64()) for i in range(6)], BODY)

    return texts


def _hot_spans(body: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans of repeated windows in the texts of segments, each window dealt by its own bytes."""
    # windows that are alone in their slot of a bitmap recur nowhere
    counted = body.mapInArrow(_count_window_slots(length, BITMAP_BITS), "slot int, n int")
    bitmap = body.sparkSession.sparkContext.broadcast(recurring(counted, BITMAP_BITS, HOT)[0])
    windows = cut(body.mapInArrow(_hash_windows(length, BITMAP_BITS, bitmap), "minimizer long, hash long, doc long, tag long, at long"))
    place = F.struct(*PLACE)
    often = windows.groupBy(*KIND).agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("last")).where("copies > 1")
    often = cut(often)
    two = often.select(*KIND, F.explode(F.array("first", "last")).alias("p")).select(*KIND, "p.*")
    # a window's segment begins ``nth`` bytes before it
    lists = two.withColumn("from_at", F.expr(f"{START.format('at')} - ({WINDOWS.format('at')})")).groupBy(F.col("doc").alias("d"), F.col("tag").alias("t"), "from_at").agg(F.collect_list(F.struct(*KIND, "at")).alias("places"))
    pieces = body.join(lists, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")) & (F.expr(START.format("at")) == F.col("from_at")))
    pieces = pieces.select("doc", "tag", "body", "places").mapInArrow(_cut_windows(length), TEXTS)
    bucket = F.pmod(F.xxhash64("minimizer"), F.lit(max(1, -(-2 * often.count() // BUCKET_SEGMENTS))))
    found = cut(pieces.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_repeated_windows(length, keep), "minimizer long, hash long, doc long, tag long, start long, end long, whole boolean"))
    whole = found.where("whole").select(*KIND).join(often.where("copies > 2").select(*KIND, "first"), KIND)
    rest = windows.join(whole, KIND).where(place != F.col("first"))
    spans = found.where("not whole").select(*SPAN)
    start = F.expr(START.format("at"))
    return spans.unionByName(rest.select("doc", "tag", start.alias("start"), (start + length).alias("end")))


def _often_spans(segments: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans of segments whose minimizers occur too often for a bucket: copies are grouped on their bytes first."""
    place = F.struct(*PLACE)
    kinds = cut(segments.groupBy("minimizer", "body").agg(F.count("*").alias("copies"), F.min(place).alias("first")))
    hot = cut(kinds.groupBy("minimizer").count().where(F.col("count") > HOT).select("minimizer"))
    firsts = kinds.select("minimizer", "first.*", "body")
    few = firsts.join(hot, "minimizer", "left_anti")
    bucket = F.pmod(F.xxhash64("minimizer"), F.lit(max(1, -(-kinds.count() // BUCKET_SEGMENTS))))
    spans = few.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_bucket_spans(length, keep), SPANS)
    if hot.limit(1).count():
        body = firsts.join(hot, "minimizer", "left_semi").select("minimizer", F.lit(0).cast("long").alias("hash"), *PLACE, "body")
        spans = spans.unionByName(_hot_spans(cut(body), length, keep))
    copied = kinds.where("copies > 1").select("minimizer", "body", "first")
    whole = segments.join(copied, ["minimizer", "body"])
    if keep == "first":
        whole = whole.where(place != F.col("first"))
    start = F.expr(START.format("at"))
    return spans.unionByName(whole.select("doc", "tag", start.alias("start"), (start + F.length("body")).alias("end")))


SPAN = ["doc", "tag", "start", "end"]
SPANS = "doc long, tag long, start long, end long"


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """doc_id and text with a key of two numbers; for ``keep="first"`` the key has the order of ids, then of rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if keep == "first":
        return cut(rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.monotonically_increasing_id().alias("tag"), "doc_id", "text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64("text", "doc_id").alias("tag"), "doc_id", "text")


def repeated_spans(rows: DataFrame, min_length: int = MIN_LENGTH, keep: str = "none") -> DataFrame:
    """doc, tag, start, end of repeated byte ranges of rows with doc, tag and text; ranges of a document may overlap."""
    if min_length % 8 or not 2 * GRAM <= min_length < 1 << 15:
        raise ValueError("min_length must be a multiple of 8 from 48 to 32760")
    small_batches(rows.sparkSession)
    context, texts = rows.sparkSession.sparkContext, rows.select("doc", "tag", "text")
    twice, often, many = recurring(rows.select("text").mapInArrow(_count_minimizers(min_length, BITMAP_BITS), "slot int, n int"), BITMAP_BITS, HOT)
    twice, often = context.broadcast(twice), context.broadcast(often) if often is not None else None
    segments = texts.mapInArrow(_list_segments(min_length, BITMAP_BITS, twice, often), SEGMENT)
    bucket = F.pmod(F.xxhash64("minimizer"), F.lit(max(1, -(-many // BUCKET_SEGMENTS)))).alias("bucket")
    spans = segments.select(bucket, *PLACE, "body").groupBy("bucket").applyInArrow(_bucket_spans(min_length, keep), SPANS)
    if often is not None:
        spans = spans.unionByName(_often_spans(texts.mapInArrow(_list_segments(min_length, BITMAP_BITS, often), SEGMENT), min_length, keep))
    return spans


def _merge(spans, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], size)) for s in spans):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for rows, data, offsets in slices([batch.select([0, 1]).append_column("row", pa.array(np.arange(batch.num_rows)))], "text"):
                raw, out = data.tobytes(), []
                for k, r in enumerate(rows.column(2).to_pylist()):
                    text = raw[offsets[k] : offsets[k + 1]]
                    cuts = _merge(spans[r] or (), len(text))
                    kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True))
                    out.append((len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns[: 4 + with_text]], ["doc_id", *names[: 4 + with_text]])

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, keep: str = "none", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes)."""
    rows = _rows(docs, id_col, text_col, keep)
    lists = cut(repeated_spans(rows, min_length, keep).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    # only texts that lose something meet their spans; the others are judged as they are read
    touched, whole = parted(rows, lists, ["doc", "tag"])
    joined = touched.join(lists, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    whole = whole.select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    return joined.unionByName(whole).mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window of every text in hexadecimal, so only for small tables.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, len(h) // 2 - 199)) AS t(i)
), often AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1
), starts AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w WHERE k IN (SELECT k FROM often)
), runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM starts
), spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run
), gaps AS (SELECT spans.r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY spans.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY spans.r ORDER BY a), 0))) AS kept FROM spans JOIN d ON d.r = spans.r
), cuts AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM gaps GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cuts ON d.r = cuts.r
"""
