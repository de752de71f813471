"""Removal of passages that an earlier document holds, by compressed FM-indexes of shards.

Equal windows of ``window`` words have the same least hash of ``GRAM`` words, their
minimizer, so each document falls into segments: runs of windows with one minimizer.
All segments that may hold a window lie in the shard of its minimizer, and a window
needs to be searched in one shard only:

1. Minimizers are counted; segments whose minimizer occurs once in all documents
   repeat nothing and go no further.
2. A shard's segments are told apart by all of their words; equal ones are a kind, with its
   least document id. The kinds are indexed: suffixes in order, the Burrows-Wheeler
   transform in a wavelet matrix of packed bits, and the least document of any range of
   suffixes. Every window of a kind is streamed through backward search, a word at a time,
   as long as the range holds a document before the kind's first one: its matching statistic.
3. Windows that reach ``window`` words are flagged in the kind's first document. In later
   ones all windows of the kind are, since the first one holds them.

Minimizers of more than ``HOT`` segments would overfill a task. Their segments are
aggregated to kinds first and look up their kind's flags in a join on all words. If more than
``HOT`` kinds are left of one minimizer, these are cut into windows, and each is given its least
document by its own words. The counts of step 1 and the rows that lose something reach the
tasks as bitmaps of fixed size, which only spare rows a shuffle: beyond about
``2**BITMAP_BITS`` segments more of them pass, and results are the same.

A document is a row. Words are runs of bytes other than blanks and ASCII white space,
unchanged; null texts have none. What is removed is judged on the input. Rows of one id
never precede one another; a null id comes after all others (2**63 - 1 ranks with it). Equal rows have equal results.
Other columns, whatever their names, are not read. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import held, parted, recurring, slots_of
from tessera.llm.checkpoints import cut
from tessera.llm.suffix_dedup import _sliding_least
from tessera.llm.textbytes import CODES, U64, RollingHash, byte_class, mixed, slices, small_batches

WINDOW = 13
GRAM = 4
WORD_BASE = 0xC2B2AE3D27D4EB4F
IS_WORD = byte_class((0x20, 0x20), (0x09, 0x0D), negate=True)
#: Segments of a shard, of about 110 bytes each, and kinds of a minimizer beyond which its windows are dealt one by one.
SHARD_SEGMENTS = 4096
HOT = 4096
BITMAP_BITS = 28
#: The id that stands for null.
LAST = 2**63 - 1


class PlainWords:
    """Words of all rows of a slice, and the text with one blank after each of them: word w is plain[start[w]:end[w]], row r has the words bounds[r] to bounds[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = IS_WORD[data]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edge - 1] = inside[edge - 1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(begin, offsets)
        self.hash = mixed(RollingHash(CODES[data]).ranges(begin, stop) + (stop - begin).astype(U64))
        inside[stop[stop < len(data)]] = True
        place = np.cumsum(inside) - 1
        self.plain = data[inside]
        self.plain[~IS_WORD[self.plain]] = 0x20
        self.start, self.end = place[begin], place[stop - 1] + 1

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Segments:
    """Segments of a slice of documents: row, minimizer, first word, number of windows, and their words joined by blanks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.words = words = PlainWords(data, offsets)
        self.window, self.bounds = window, words.bounds
        places, span = max(0, len(words.hash) - window + 1), window - GRAM + 1
        self.first = self.row = self.windows = np.zeros(0, np.int64)
        self.minimizer = np.zeros(0, U64)
        if not places:
            return
        least = _sliding_least(mixed(RollingHash(words.hash, WORD_BASE).grams(GRAM)), span)
        row = words.rows()[:places]
        inside = np.arange(places) + window <= words.bounds[1:][row]
        new = np.ones(places, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
        start = np.flatnonzero(new & inside)
        breaks = np.append(np.flatnonzero(new | ~inside), places)
        run = breaks[np.searchsorted(breaks, start, side="right")] - start
        parts = -(-run // span)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.repeat(start, parts) + nth * span
        self.windows = np.minimum(np.repeat(run, parts) - nth * span, span)
        # the least of many hashes is small: mixed again, all of its bits are as good as random
        self.minimizer, self.row = mixed(least[self.first]), row[self.first]

    def bodies(self, keep: np.ndarray) -> pa.Array:
        start = self.words.start[self.first[keep]]
        size = self.words.end[self.first[keep] + self.windows[keep] + self.window - 2] - start
        ends = np.cumsum(size)
        text = self.words.plain[np.repeat(start - (ends - size), size) + np.arange(size.sum())]
        offsets = np.append(0, ends).astype(np.int32)
        return pa.StringArray.from_buffers(len(keep), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))


def _count_slots(window: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches, "text"):
            slot, n = np.unique(slots_of(Segments(data, offsets, window).minimizer, bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int32))], ["slot", "n"])

    return count


KIND = ["minimizer", "body"]
PLACE = ["id", "hash", "at"]


def _list_segments(window: int, bits: int, bitmap, but=None):
    """Segments whose minimizers are in one bitmap and not in another."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            s = Segments(data, offsets, window)
            slot = slots_of(s.minimizer, bits)
            wanted = held(bitmap.value, slot)
            if but is not None:
                wanted &= ~held(but.value, slot)
            keep = np.flatnonzero(wanted)
            row = s.row[keep]
            columns = [pa.array(s.minimizer[keep].view(np.int64)), s.bodies(keep), *(pa.array(rows.column(i).to_numpy()[row]) for i in (0, 1)), pa.array((s.first[keep] - s.bounds[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*KIND, *PLACE])

    return listed


class WaveletMatrix:
    """Counts of any symbol before any place of a sequence; a level holds one packed bit of each symbol."""

    def __init__(self, symbols: np.ndarray, many: int):
        n = len(symbols)
        self.bits = max(1, int(many).bit_length())
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            packed = np.zeros(n // 64 * 8 + 8, dtype=np.uint8)
            packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            word = packed.view(U64)
            before = np.zeros(len(word), dtype=np.int32)
            np.cumsum(np.bitwise_count(word[:-1]), out=before[1:])
            self.levels.append((shift, word, before, n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(many + 1)
        self.origin = self._place(every, np.zeros(many + 1, np.int64))

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, word, before, zeros in self.levels:
            held = at >> 6
            ones = before[held] + np.bitwise_count(word[held] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols equal ``symbol``."""
        return self._place(symbol, at) - self.origin[symbol]


class RangeLeast:
    """The least value of any non-empty range, from leasts of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table, step = [values], 1
        while 2 * step <= len(values):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))
            step *= 2
        self.size = np.array([len(t) for t in self.table])
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.table)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self.begin[level]
        return np.minimum(self.flat[at + low], self.flat[at + high - (1 << level)])


def suffix_order(symbols: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of their next ``depth`` symbols at least, none beyond their ``end``.

    As many order numbers as a word holds are sorted at once, so that a few sorts do.
    """
    n = len(symbols)
    bits = max(n, int(symbols.max(initial=0))).bit_length()
    per, size, at, rank = 64 // bits, 1, np.arange(n), symbols.astype(U64)
    while True:
        key = np.zeros(n, dtype=U64)
        for k in range(min(per, -(-depth // size))):
            place = at + k * size
            key = (key << U64(bits)) | np.where(place < end, rank[np.minimum(place, n - 1)], U64(0))
        size *= per
        order = np.argsort(key)
        if size >= depth:
            return order
        held = key[order]
        step = np.ones(n, dtype=U64)
        step[1:] = held[1:] != held[:-1]
        rank = np.empty(n, dtype=U64)
        rank[order] = np.cumsum(step)


class FmIndex:
    """Suffixes of several word sequences, to be searched for up to ``depth`` words from the last to the first.

    ``symbols`` are numbers from 1 to ``many``; ``end`` is, for each place, the end of its
    sequence, and ``owner`` a number whose least is wanted of any range of suffixes.
    """

    def __init__(self, symbols: np.ndarray, many: int, end: np.ndarray, owner: np.ndarray, depth: int):
        order = suffix_order(symbols, end, depth)
        opens = np.ones(len(symbols), dtype=bool)
        opens[1:] = end[1:] != end[:-1]
        before = np.where(opens, 0, np.roll(symbols, 1))
        self.wavelet = WaveletMatrix(before[order], many)
        count = np.bincount(symbols, minlength=many + 2)
        self.low = np.cumsum(count) - count
        # a sequence's last word alone comes first among the suffixes that begin with it
        self.after_ends = self.low[: many + 1] + np.bincount(symbols[end[np.flatnonzero(opens)] - 1], minlength=many + 1)
        self.owners = RangeLeast(owner[order])

    def begin(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.low[symbol], self.low[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges after one more word on the left."""
        base = self.after_ends[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)


def matching_statistics(index: FmIndex, symbols: np.ndarray, last: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For patterns that end at ``last``, how many words, ``window`` at most, an owner before their own holds too."""
    length = np.zeros(len(last), np.int64)
    low, high = index.begin(symbols[last])
    open_ = np.arange(len(last))
    for n in range(1, window + 1):
        some = low < high
        some[some] = index.owners.least(low[some], high[some]) < owner[open_[some]]
        open_, low, high = open_[some], low[some], high[some]
        length[open_] = n
        if n == window or not len(open_):
            return length
        low, high = index.extend(symbols[last[open_] - n], low, high)
    return length


def kind_flags(bodies: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """Of differing word sequences and their least ids, a bit for each window that one with a smaller id holds."""
    words = pc.split_pattern(bodies, " ")
    many = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    symbols = coded.indices.to_numpy().astype(np.int64) + 1
    owner = np.unique(first, return_inverse=True)[1]
    end = np.cumsum(many)
    kind = np.repeat(np.arange(len(many)), many)
    index = FmIndex(symbols, len(coded.dictionary), end[kind], owner[kind], window)
    nth = np.arange(len(kind)) - (end - many)[kind] - (window - 1)
    last = np.flatnonzero(nth >= 0)
    whole = last[matching_statistics(index, symbols, last, owner[kind[last]], window) >= window]
    flags = np.zeros(len(many), np.int64)
    np.add.at(flags, kind[whole], np.int64(1) << nth[whole])
    return flags


def _search_segments(window: int):
    """Streams all segments of a shard through the index of its kinds."""

    def search(table: pa.Table) -> pa.Table:
        coded = table.column("body").combine_chunks().dictionary_encode()
        kind, ident = coded.indices.to_numpy(), table.column("id").to_numpy()
        first = np.full(len(coded.dictionary), LAST)
        np.minimum.at(first, kind, ident)
        windows = pc.count_substring(coded.dictionary, " ").to_numpy().astype(np.int64) + 2 - window
        flags = np.where(ident > first[kind], ((np.int64(1) << windows) - 1)[kind], kind_flags(coded.dictionary, first, window)[kind])
        some = np.flatnonzero(flags)
        return table.select(PLACE).take(pa.array(some)).append_column("flags", pa.array(flags[some]))

    return search


def _search_kinds(window: int):
    def search(table: pa.Table) -> pa.Table:
        flags = kind_flags(table.column("body").combine_chunks(), table.column("first").to_numpy(), window)
        return table.drop_columns(["shard"]).append_column("found", pa.array(flags))

    return search


def _flagged_by_window(kinds: DataFrame, window: int) -> DataFrame:
    """Flags of kinds whose windows are dealt one by one, each by its own words."""
    words = F.split("body", " ")
    single = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.array_join(F.slice(words, i + 1, window), " "))
    single = kinds.select(*KIND, "first", "later", F.posexplode(single).alias("nth", "window"))
    least = single.groupBy("window").agg(F.min("first").alias("least"))
    flag = F.when(F.col("least") < F.col("first"), F.expr("shiftleft(1L, nth)")).otherwise(F.lit(0))
    return single.join(least, "window").groupBy(*KIND, "first", "later").agg(F.sum(flag).alias("found"))


def _flagged_often(segments: DataFrame, shard: Column, window: int) -> DataFrame:
    """Flagged segments of minimizers that occur too often for a task: their kinds are counted first, and looked up after."""
    kinds = cut(segments.groupBy(*KIND).agg(F.min("id").alias("first"), F.max("id").alias("later")))
    hot = cut(kinds.groupBy("minimizer").count().where(F.col("count") > HOT).select("minimizer"))
    few = kinds.join(hot, "minimizer", "left_anti").withColumn("shard", shard)
    found = few.groupBy("shard").applyInArrow(_search_kinds(window), "minimizer long, body string, first long, later long, found long")
    found = found.unionByName(_flagged_by_window(kinds.join(hot, "minimizer", "left_semi"), window)).where("found <> 0 or later > first")
    every = F.expr(f"shiftleft(1L, size(split(body, ' ')) - {window - 1}) - 1")
    flags = F.when(F.col("id") > F.col("first"), every).otherwise(F.col("found"))
    return segments.join(found.drop("later"), KIND).select(*PLACE, flags.alias("flags")).where("flags <> 0")


def flagged_segments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, hash, at, flags of segments with windows that an earlier document holds: bit i stands for the window from word at + i.

    ``rows`` has id, hash (of the text) and text.
    """
    if not GRAM < window <= 48:
        raise ValueError(f"window must be {GRAM + 1} to 48 words")
    small_batches(rows.sparkSession)
    twice, often, many = recurring(rows.select("text").mapInArrow(_count_slots(window, BITMAP_BITS), "slot int, n int"), BITMAP_BITS, HOT)
    context, texts = rows.sparkSession.sparkContext, rows.select("id", "hash", "text")
    twice, often = context.broadcast(twice), context.broadcast(often) if often is not None else None
    schema = "minimizer long, body string, id long, hash long, at int"
    shard = F.pmod(F.xxhash64("minimizer"), F.lit(max(1, -(-many // SHARD_SEGMENTS))))
    segments = texts.mapInArrow(_list_segments(window, BITMAP_BITS, twice, often), schema).select(shard.alias("shard"), "body", *PLACE)
    found = segments.groupBy("shard").applyInArrow(_search_segments(window), "id long, hash long, at int, flags long")
    if often is not None:
        found = found.unionByName(_flagged_often(texts.mapInArrow(_list_segments(window, BITMAP_BITS, often), schema), shard, window))
    return found


def _remove(window: int, with_text: bool):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_pylist()
            numbered = batch.select([0, 1]).append_column("row", pa.array(np.arange(batch.num_rows)))
            for rows, data, offsets in slices([numbered], "text"):
                words, out = PlainWords(data, offsets), []
                plain = words.plain.tobytes()
                for k, r in enumerate(rows.column(2).to_pylist()):
                    a, b = words.bounds[k : k + 2].tolist()
                    covered = np.ones(b - a + 2, dtype=bool)
                    covered[1:-1] = False
                    for p in places[r] or ():
                        for i in range(p["flags"].bit_length()):
                            if p["flags"] >> i & 1:
                                covered[p["at"] + i + 1 : p["at"] + i + 1 + window] = True
                    # runs of kept words, which the blanks between them join already
                    edges = a + np.flatnonzero(covered[1:] != covered[:-1])
                    first, last = words.start[edges[::2]].tolist(), words.end[edges[1::2] - 1].tolist()
                    kept = b" ".join([plain[x:y] for x, y in zip(first, last, strict=True)])
                    out.append((b - a, int(covered.sum()) - 2, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + with_text]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["doc_id", *OUT[: 3 + with_text]])

    return removed


OUT = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def remove_earlier_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("hash"))
    places = F.collect_set(F.struct("at", "flags")).alias("places")
    lists = cut(flagged_segments(rows, window).groupBy("id", "hash").agg(places))
    # only texts that lose something meet their places; the others are written as they are read
    touched, untouched = parted(rows, lists, ["id", "hash"])
    joined = touched.join(lists, ["id", "hash"], "left").select("doc_id", "text", "places")
    whole = untouched.select("doc_id", "text", F.lit(None).cast(joined.schema["places"].dataType).alias("places"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.unionByName(whole).mapInArrow(_remove(window, with_text), schema)


def op12_fm_index_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_earlier_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (SELECT r, id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13
), x AS (SELECT r, id, p, array_to_string(w[p : p + 12], ' ') AS g FROM s
), f AS (SELECT g, min(id) AS first FROM x GROUP BY g
), hit AS (SELECT DISTINCT r, p + unnest(range(0, 13)) AS p FROM x JOIN f USING (g) WHERE first < id
), gone AS (SELECT r, list(p) AS p, count(*) AS n FROM hit GROUP BY r
), kept AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
    CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda e: NOT list_contains(gone.p, e[2])), lambda e: e[1]) END AS k
  FROM d LEFT JOIN gone ON d.r = gone.r)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
