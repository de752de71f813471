"""Benchmark decontamination by suffix arrays over the training text.

Every slice of documents is a shard with its own array of word suffixes, sorted
by their first words. Each distinct window that opens a benchmark suffix is looked
up by binary search in each shard: the suffixes that begin with it form one range,
whose members are the places of verbatim matches. A place opens at most one window
of a length, so a shard has at most as many matches as words, whatever repeats.
Matches are extended to their longest in the benchmark's own suffix array, where
suffixes of one window lie side by side. Openings that the other side lacks are
left out before sorting and searching (bitmaps without false negatives).

The benchmark travels to the tasks. Its size is summed first; beyond
``part_bytes`` it is cut by row into parts of about that size (a row that is longer is
a part by itself), which are searched for one after another, and the hits of each row are merged by a row number kept
with the texts in the shared folder. Results do not depend on ``part_bytes``. No
word of a document is skipped.

A window is ``window`` consecutive words of an item; a shorter item is one
window. Null or wordless documents and items, and items without an id, match
nothing. Repeated items count once; an id with several texts has the windows of
all. Rows that repeat an id, or have none, are judged each on their own text. An
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.checkpoints import cut, unused
from tessera.llm.textbytes import U64, RollingHash, Words, byte_class, mixed, slices, small_batches, text_buffers

WINDOW = 13
#: Benchmark text that is sent to tasks at once.
PART_BYTES = 32 << 20
#: Letters, digits and everything beyond ASCII, in lower-cased text.
IS_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Suffixes are told apart by this many words before they are sorted or searched.
OPENING = 3
BITS = 22
WORD_BASE = 0xC2B2AE3D27D4EB4F


def _opening_keys(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    key = hashes[at].copy()
    for d in range(1, words):
        key = mixed(key * U64(0x100000001B3) + hashes[at + d])
    return key


def _bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[(keys >> U64(64 - BITS)).astype(np.int64)] = True
    return seen


def _has(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return seen[(keys >> U64(64 - BITS)).astype(np.int64)]


def _spread(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... low[i] + many[i] - 1 for every i, one after another."""
    return np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())


def suffix_order(hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions in the order of the words from there to ``end``, by doubling; words are ordered by hash."""
    n = len(hashes)
    at = np.arange(n)
    rank = np.unique(hashes, return_inverse=True)[1] + 1
    size, longest = 1, int((end - at).max(initial=0))
    while size < longest:
        follow = np.where(at + size < end, rank[np.minimum(at + size, n - 1)], 0)
        distinct, rank = np.unique(rank * (n + 1) + follow, return_inverse=True)
        rank += 1
        if len(distinct) == n:
            break
        size *= 2
    return np.argsort(rank, kind="stable")


@dataclass
class Windows:
    """Distinct windows of one length; window w is opened by the suffixes at[low[w]:low[w + 1]], in suffix order."""

    at: np.ndarray
    low: np.ndarray
    opening: np.ndarray
    owners: np.ndarray  # the set of items of each window

    @property
    def first(self) -> np.ndarray:
        return self.at[self.low[:-1]]


@dataclass
class TestSuffixes:
    """The benchmark's words, its windows by length in suffix order, and the items that hold them."""

    item_ids: list[str]
    names: list[str]  # an item id of each text
    hashes: np.ndarray
    begin: np.ndarray  # of each word's text
    end: np.ndarray
    text: np.ndarray  # of each word
    windows: dict[int, Windows]
    filters: dict[int, np.ndarray]  # words of an opening -> bitmap
    set_low: np.ndarray  # set s has the items set_items[set_low[s]:set_low[s + 1]]
    set_items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> TestSuffixes:
        rows = sorted({(str(i), t or "") for i, t in rows if i is not None})
        ids = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(ids)}
        held: dict[str, list[int]] = {}
        for i, t in rows:
            held.setdefault(t, []).append(number[i])
        words = Words(*text_buffers(pa.array(list(held), pa.string())), IS_WORD)
        text = words.rows()
        begin, end = (b[text] if len(text) else text for b in (words.bounds[:-1], words.bounds[1:]))
        at = suffix_order(words.hash, end)
        length = np.minimum(end - begin, window)
        opens = (at + length[at] <= end[at]) & ((end - begin >= window)[at] | (at == begin[at]))
        rolling = RollingHash(words.hash, WORD_BASE)
        windows, filters, members = {}, {}, []
        text_items = np.fromiter((x for v in held.values() for x in v), np.int64)
        text_low = np.cumsum([0, *map(len, held.values())])
        for n in np.unique(length[at[opens]]).tolist():
            own = at[opens & (length[at] == n)]
            key = rolling.ranges(own, own + n)
            new = np.append(True, key[1:] != key[:-1])
            low = np.append(np.flatnonzero(new), len(own))
            pairs = np.unique(np.stack([np.cumsum(new) - 1, text[own]], axis=1), axis=0)
            many = np.diff(text_low)[pairs[:, 1]]
            owner = np.unique(np.stack([np.repeat(pairs[:, 0], many), text_items[_spread(text_low[:-1][pairs[:, 1]], many)]], axis=1), axis=0)
            members.append(owner)
            windows[n] = Windows(own, low, _opening_keys(words.hash, own[low[:-1]], min(n, OPENING)), np.zeros(len(low) - 1, np.int64))
        # windows of the same items share one set
        sets, set_low, set_items = {}, [0], []
        for w, owner in zip(windows.values(), members, strict=True):
            cuts = np.searchsorted(owner[:, 0], np.arange(len(w.low)))
            for k in range(len(w.low) - 1):
                items = owner[cuts[k] : cuts[k + 1], 1]
                key = items.tobytes()
                if key not in sets:
                    sets[key] = len(sets)
                    set_items.append(items)
                    set_low.append(set_low[-1] + len(items))
                w.owners[k] = sets[key]
        for k in {min(n, OPENING) for n in windows}:
            filters[k] = _bitmap(np.concatenate([w.opening for n, w in windows.items() if min(n, OPENING) == k]))
        names = [ids[min(v)] for v in held.values()]
        return cls(ids, names, words.hash, begin, end, text, windows, filters, np.array(set_low), np.concatenate(set_items) if set_items else np.zeros(0, np.int64))


def suffix_array(hashes: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of their first ``depth`` words, and those words.

    A suffix that ends earlier is filled up with zeros. Words are ordered by
    hash: any fixed order keeps equal beginnings together.
    """
    where = at[:, None] + np.arange(depth)
    keys = np.where(where < end[at][:, None], hashes[np.minimum(where, len(hashes) - 1)], U64(0))
    order = np.lexsort(keys.T[::-1]) if len(at) else np.zeros(0, np.int64)
    return at[order], np.ascontiguousarray(keys[order])


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of rows of ``keys`` that equal each row of ``wanted``: binary search, all rows at once."""
    n, depth = len(keys), wanted.shape[1]
    ranges = []
    for strict in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n, np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            row = keys[np.minimum(mid, n - 1), :depth]
            differs = row != wanted
            first = differs.argmax(axis=1)
            pick = np.arange(len(wanted))
            less = row[pick, first] < wanted[pick, first]
            below = less | (strict & ~differs.any(axis=1))
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        ranges.append(low)
    return ranges[0], ranges[1]


@dataclass
class Matches:
    """Places of a shard where windows occur: word position, window length, window; each (position, length) once."""

    place: np.ndarray
    length: np.ndarray
    window: np.ndarray


def window_matches(words: Words, tests: TestSuffixes) -> Matches:
    """Looks up every distinct window of the benchmark in the shard's suffix array."""
    n, nothing = len(words.hash), np.zeros(0, np.int64)
    if not n or not tests.windows:
        return Matches(nothing, nothing, nothing)
    end = words.bounds[1:][words.rows()]
    wanted, here = np.zeros(n, dtype=bool), {}
    for k, seen in tests.filters.items():
        at = np.flatnonzero(np.arange(n) + k <= end)
        keys = _opening_keys(words.hash, at, k)
        both = _has(seen, keys)
        wanted[at[both]] = True
        here[k] = _bitmap(keys[both])
    position, keys = suffix_array(words.hash, end, np.flatnonzero(wanted), max(tests.windows))
    found = []
    for length, w in tests.windows.items():
        some = np.flatnonzero(_has(here[min(length, OPENING)], w.opening))
        if not len(some) or not len(position):
            continue
        low, high = _search(keys, tests.hashes[w.first[some][:, None] + np.arange(length)])
        place = position[_spread(low, high - low)]
        found.append((place, np.full(len(place), length), np.repeat(some, high - low)))
    return Matches(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Matches(nothing, nothing, nothing)


class Extender:
    """Extends matches of a shard to their longest, by hashes of word ranges and the benchmark's suffix order."""

    def __init__(self, words: Words, tests: TestSuffixes):
        self.words, self.tests = words, tests
        self.end = words.bounds[1:][words.rows()]
        self.here, self.there = RollingHash(words.hash, WORD_BASE), RollingHash(tests.hashes, WORD_BASE)

    def common(self, place: np.ndarray, test: np.ndarray) -> np.ndarray:
        """Equal words from ``place`` and from ``test`` on."""
        limit = np.minimum(self.end[place] - place, self.tests.end[test] - test)
        same, step = np.zeros(len(place), np.int64), 1 << int(limit.max(initial=0)).bit_length()
        while step:
            some = np.flatnonzero(same + step <= limit)
            a, b = place[some] + same[some], test[some] + same[some]
            same[some[self.here.ranges(a, a + step) == self.there.ranges(b, b + step)]] += step
            step >>= 1
        return same

    def longest(self, place: np.ndarray, length: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each match, the words that the place has in common with the best suffix of its window, and that suffix."""
        best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for n in np.unique(length).tolist():
            w, some = self.tests.windows[n], np.flatnonzero(length == n)
            p, low, high = place[some], w.low[window[some]], w.low[window[some] + 1]
            a, b = low.copy(), high.copy()
            while len(open_ := np.flatnonzero(b - a > (high - low == 1))):
                mid = (a[open_] + b[open_]) // 2
                test, q = w.at[mid], p[open_]
                same = self.common(q, test)
                mine, theirs = (np.where(x + same < e[x], h[np.minimum(x + same, len(h) - 1)], U64(0)) for x, e, h in ((q, self.end, self.words.hash), (test, self.tests.end, self.tests.hashes)))
                less = theirs < mine
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            for neighbour in (np.maximum(a - 1, low), np.minimum(a, high - 1)):
                same = self.common(p, w.at[neighbour])
                better = same > best[some]
                best[some[better]], where[some[better]] = same[better], w.at[neighbour][better]
        return best, where

    def earliest(self, place: int, length: int, window: np.ndarray, size: np.ndarray) -> int:
        """Of the suffixes that share ``length`` words with ``place``, the first in the benchmark."""
        out = []
        for n, k in zip(size.tolist(), window.tolist(), strict=True):
            own = self.tests.windows[n]
            at = own.at[own.low[k] : own.low[k + 1]]
            some = at[self.tests.end[at] - at >= length]
            some = some[self.there.ranges(some, some + length) == self.here.ranges(np.array([place]), np.array([place + length]))]
            out += [int(some.min())] if len(some) else []
        return min(out)


def longest_by_row(words: Words, tests: TestSuffixes, m: Matches, start: np.ndarray, stop: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """row -> (words, place, test position) of its longest match; ``start`` and ``stop`` bound its runs of hit words.

    A run that its first match fills is settled; in others every match is extended.
    """
    if not len(m.place):
        return {}
    grow, row = Extender(words, tests), words.rows()
    run = np.searchsorted(start, m.place, side="right") - 1
    best = np.zeros(len(m.place), np.int64)
    lead = np.flatnonzero(m.place == start[run])
    best[lead], _ = grow.longest(m.place[lead], m.length[lead], m.window[lead])
    full = np.zeros(len(start), dtype=bool)
    full[run[lead[best[lead] == (stop - start)[run[lead]]]]] = True
    rest = np.flatnonzero(~full[run] & (m.place != start[run]))
    best[rest], _ = grow.longest(m.place[rest], m.length[rest], m.window[rest])
    order = np.lexsort((m.place, -best, row[m.place]))
    own = row[m.place[order]]
    out = {}
    for k in np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist():
        p, n = int(m.place[order[k]]), int(best[order[k]])
        at = np.flatnonzero(m.place == p)
        out[int(own[k])] = (n, p, grow.earliest(p, n, m.window[at], m.length[at]))
    return out


def _benchmark_parts(benchmark: DataFrame, part_bytes: int, item_col: str, text_col: str) -> list[DataFrame]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // part_bytes) if total > part_bytes else 1
    if parts == 1:
        return [items]
    parts *= 2  # parts of a hash are uneven
    # rows of one id are dealt by their texts: items are united by id when all parts are done
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


FOUND = "hits array<struct<start: int, end: int>>, items array<string>, longest long, longest_start long, longest_item string, longest_item_start long"


def _hit_words(words: Words, m: Matches) -> np.ndarray:
    """Whether each word lies in an occurrence of a window."""
    n = len(words.hash)
    depth = np.bincount(m.place, minlength=n + 1)[: n + 1] - np.bincount(m.place + m.length, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:-1] > 0


def _found(words: Words, tests: TestSuffixes) -> list[pa.Array]:
    """The columns of FOUND for a shard's rows."""
    row, m = words.rows(), window_matches(words, tests)
    hit = _hit_words(words, m)
    change = hit.copy()
    change[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    start, end = np.flatnonzero(change), np.flatnonzero(stop) + 1
    base = words.bounds[:-1][row[start]] if len(start) else start
    spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"])
    per_row = np.searchsorted(start, words.bounds).astype(np.int32)
    owners = np.concatenate([tests.windows[n].owners[m.window[m.length == n]] for n in tests.windows]) if len(m.place) else m.place
    places = np.concatenate([m.place[m.length == n] for n in tests.windows]) if len(m.place) else m.place
    sets = np.unique(np.stack([row[places], owners], axis=1), axis=0) if len(places) else np.zeros((0, 2), np.int64)
    many = np.diff(tests.set_low)[sets[:, 1]] if len(sets) else np.zeros(0, np.int64)
    pairs = np.stack([np.repeat(sets[:, 0], many), tests.set_items[_spread(tests.set_low[:-1][sets[:, 1]], many)]], axis=1) if len(sets) else sets
    pairs = np.unique(pairs, axis=0)
    names = pa.array(tests.item_ids, pa.string()).take(pa.array(pairs[:, 1])) if len(pairs) else pa.array([], pa.string())
    at = np.searchsorted(pairs[:, 0], np.arange(len(words.bounds))).astype(np.int32)
    best = longest_by_row(words, tests, m, start, end)
    rows = range(len(words.bounds) - 1)
    return [
        pa.ListArray.from_arrays(pa.array(per_row), spans),
        pa.ListArray.from_arrays(pa.array(at), names),
        pa.array([best[r][0] if r in best else 0 for r in rows], pa.int64()),
        pa.array([best[r][1] - int(words.bounds[r]) if r in best else None for r in rows], pa.int64()),
        pa.array([tests.names[tests.text[best[r][2]]] if r in best else None for r in rows], pa.string()),
        pa.array([best[r][2] - int(tests.begin[best[r][2]]) if r in best else None for r in rows], pa.int64()),
    ]


def _search_documents(tests, hits_only: bool):
    names = ["row", "doc_id", "n_words", "hits", "items", "longest", "longest_start", "longest_item", "longest_item_start"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            words = Words(data, offsets, IS_WORD)
            columns = [rows.column(0), rows.column(1), pa.array(np.diff(words.bounds).astype(np.int64)), *_found(words, tests.value)]
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out.filter(pa.array(np.array(out.column(5)) > 0)) if hits_only else out

    return search


def contamination_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: row, doc_id, n_words, hits (disjoint word ranges, ascending), items, and the longest match.

    ``row`` is null where one part was enough. The longest match is the first in the document, and of the items that
    hold it the first id: longest (words, 0 without), longest_start, longest_item, longest_item_start.
    """
    small_batches(docs.sparkSession)
    parts = _benchmark_parts(benchmark, part_bytes, item_col, item_text_col)
    context = docs.sparkSession.sparkContext
    number = F.lit(None).cast("long") if len(parts) == 1 else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"row long, doc_id long, n_words long, {FOUND}"
    if len(parts) == 1:
        return rows.mapInArrow(_search_documents(context.broadcast(TestSuffixes.of([tuple(r) for r in parts[0].toLocalIterator()], window)), False), schema)
    rows, found = cut(rows), None
    for k, part in enumerate(parts):
        # one part at a time is held by the driver and the tasks
        tests = context.broadcast(TestSuffixes.of([tuple(r) for r in part.toLocalIterator()], window))
        held = cut(rows.mapInArrow(_search_documents(tests, k > 0), schema))
        tests.unpersist()
        found = held if found is None else found.unionByName(held)
    best = F.struct((-F.col("longest")).alias("minus"), *[F.col(c) for c in ("longest_start", "longest_item", "longest_item_start")])
    merged = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.min(best).alias("best"),
    )
    return merged.select("row", "doc_id", "n_words", _united(F.col("hits")).alias("hits"), "items", (-F.col("best.minus")).alias("longest"), "best.longest_start", "best.longest_item", "best.longest_item_start")


def _united(hits: Column) -> Column:
    """Ascending word ranges without overlaps, neighbours joined."""

    def add(done: Column, h: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (h["start"] <= last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.array_append(done, h))

    return F.aggregate(hits, F.array().cast("array<struct<start:int,end:int>>"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits and its longest match.

    ``contaminated``: n_hit > 0 and n_hit makes at least ``percent`` of n_words.
    """
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    found = contamination_hits(docs, benchmark, **options).withColumn("items", F.array_sort("items")).withColumn("n_hit", covered)
    return found.select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
        "items",
        "hits",
        "longest",
        "longest_start",
        "longest_item",
        "longest_item_start",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, percent: int = 5) -> DataFrame:
    """Documents that are not contaminated, with all their columns.

    With one part of the benchmark rows are checked where they lie; with more they are
    kept with a row number in the shared folder first.
    """
    small_batches(docs.sparkSession)
    parts = _benchmark_parts(benchmark, part_bytes, item_col, item_text_col)
    if len(parts) > 1:
        names, key = docs.columns, unused("row", docs.columns)
        numbered = cut(docs.withColumn(key, F.monotonically_increasing_id()))
        bad = decontaminate(numbered, benchmark, percent, id_col=key, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window, part_bytes=part_bytes)
        bad = bad.where("contaminated").select(F.col("doc_id").alias(key))
        return numbered.join(bad, key, "left_anti").select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes.of([tuple(r) for r in parts[0].toLocalIterator()], window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, text_col):
            words = Words(data, offsets, IS_WORD)
            hit = np.concatenate([[0], np.cumsum(_hit_words(words, window_matches(words, shared.value)))])
            n_hit = hit[words.bounds[1:]] - hit[words.bounds[:-1]]
            yield rows.filter(pa.array((n_hit == 0) | (100 * n_hit < percent * np.diff(words.bounds))))

    return docs.mapInArrow(keep, docs.schema)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


#: A word is hit if it lies in a window that begins at most 12 words before it. Windows that follow one another in a
#: document and in an item make one match.
OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), openings AS (
  SELECT item_id, i AS j, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, win FROM openings),
lengths AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (SELECT doc_id, i, places.n, item_id FROM places JOIN windows USING (win) WHERE places.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
chains AS (
  SELECT doc_id, openings.n, i - row_number() OVER (PARTITION BY doc_id, item_id, openings.n, i - j ORDER BY i) AS chain, item_id, i - j AS shift
  FROM places JOIN openings USING (win) WHERE places.n = openings.n
), longest AS (SELECT doc_id, max(many) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS many FROM chains GROUP BY doc_id, item_id, n, shift, chain) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
