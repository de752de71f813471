"""Token counts of edited documents without encoding them again.

A document is kept as a segment tree over blocks of consecutive pre-tokens; each
node has the characters and tokens below it. An edit descends to the blocks it
touches. Splitting starts again at the last pre-token that the edit, or the few
characters a split may look ahead, cannot have changed, and stops at the first
new pre-token that begins where an old one began after the edit: from there on
the split depends only on unchanged text. Only pre-tokens in between are encoded
and the sums above them updated. The touched blocks share what they then hold; if
that is more than ``MOST`` each, they are cut into new blocks.

Documents carry their own edits, applied in order, so nothing is shuffled.
Positions are code points; a position or length beyond the text is cut to it.
Null texts are empty, null edits none. Every row is a document: rows that repeat an id, or have
none, are counted each, and keep the id they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pretokens import Pieces, default_tokenizer_path, piece_cache
from tessera.llm.textbytes import slices, small_batches

#: Pre-tokens of a block at first.
BLOCK = 32
#: Pre-tokens that a block may hold after edits.
MOST = 256
#: Characters beyond a pre-token's end that its split may depend on, and one to spare.
LOOKAHEAD = 3


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class TokenTree:
    """Segment tree over blocks of pre-tokens with sums of characters and tokens."""

    def __init__(self, text: str, starts: np.ndarray, counts: np.ndarray, encode):
        self.encode, self.encoded = encode, 0
        self.text, self.starts, self.piece_counts = text, starts, counts
        first = np.arange(0, len(counts), BLOCK)
        self.blocks: list = list(zip(first.tolist(), np.append(first[1:], len(counts)).tolist(), strict=True)) if len(counts) else [([], [])]
        chars = np.diff(np.append(starts[first], len(text))).tolist() if len(counts) else [0]
        tokens = np.add.reduceat(counts, first).tolist() if len(counts) else [0]
        self._sum_up(chars, tokens)

    def _sum_up(self, chars: list[int], tokens: list[int]) -> None:
        """The tree over the sums of all blocks."""
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        pad = [0] * (self.size - len(self.blocks))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def block(self, b: int) -> tuple[list[str], list[int]]:
        """A block's pre-tokens and their tokens; made into strings when first touched."""
        held = self.blocks[b]
        if isinstance(held[0], int):
            a, z = held
            cut = [*self.starts[a:z].tolist(), int(self.starts[z]) if z < len(self.starts) else len(self.text)]
            held = self.blocks[b] = ([self.text[x:y] for x, y in zip(cut, cut[1:], strict=False)], self.piece_counts[a:z].tolist())
        return held

    def find(self, position: int) -> tuple[int, int]:
        """The block with the character at ``position`` (the last block for the end) and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if before + self.chars[i] <= position and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _replace(self, b: int, pieces: list[str], counts: list[int]) -> None:
        self.blocks[b] = (pieces, counts)
        i = self.size + b
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        while i > 1:
            i >>= 1
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _deal(self, low: int, high: int, pieces: list[str], counts: list[int]) -> None:
        """Gives blocks ``low`` to ``high`` even shares of what they hold, or puts more blocks in their place."""
        share = max(BLOCK, -(-len(pieces) // (high - low + 1)))
        if share <= MOST:
            for k, b in enumerate(range(low, high + 1)):
                self._replace(b, pieces[k * share : (k + 1) * share], counts[k * share : (k + 1) * share])
            return
        new = [(pieces[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(pieces), BLOCK)]
        leaves = [side[self.size : self.size + len(self.blocks)] for side in (self.chars, self.tokens)]
        self.blocks[low : high + 1] = new
        leaves[0][low : high + 1] = [sum(map(len, p)) for p, _ in new]
        leaves[1][low : high + 1] = [sum(c) for _, c in new]
        self._sum_up(*leaves)

    def edit(self, start: int, removed: int, added: str) -> None:
        """Replaces ``removed`` characters from ``start`` by ``added``."""
        start = min(max(start, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - start)
        low, at = self.find(max(start - LOOKAHEAD, 0))
        # pre-tokens from the first block on, taken as far as they are needed
        pieces, counts, high = list(self.block(low)[0]), list(self.block(low)[1]), low
        keep, end = 0, at
        while keep < len(pieces) and end + len(pieces[keep]) + LOOKAHEAD <= start:
            end += len(pieces[keep])
            keep += 1

        def more() -> bool:
            nonlocal high
            while high + 1 < len(self.blocks):
                high += 1
                p, c = self.block(high)
                if p:
                    pieces.extend(p)
                    counts.extend(c)
                    return True
            return False

        shift = len(added) - removed
        known = at + sum(map(len, pieces))
        while known < start + removed and more():
            known = at + sum(map(len, pieces))
        old = "".join(pieces[keep:])
        fresh = old[: start - end] + added + old[start - end + removed :]
        after, where = keep, end  # the first old pre-token that begins at or after the edit's end
        while after < len(pieces) and where < start + removed:
            where += len(pieces[after])
            after += 1
        match, new, done = _pattern().match, [], 0
        complete = high + 1 >= len(self.blocks)
        while True:
            # what is split so far ends at end + done in the new text
            while after < len(pieces) and where + shift < end + done:
                where += len(pieces[after])
                after += 1
            if after < len(pieces) and where + shift == end + done and end + done >= start + len(added):
                break
            if not complete and len(fresh) - done < 64:
                taken = len(pieces)
                if more():
                    fresh += "".join(pieces[taken:])
                    continue
                complete = True
            if done >= len(fresh):
                after = len(pieces)
                break
            stop = match(fresh, done).end()
            if stop == len(fresh) and not complete:  # the run may go on
                taken = len(pieces)
                if more():
                    fresh += "".join(pieces[taken:])
                    continue
                complete = True
            new.append(fresh[done:stop])
            done = stop
        self.encoded += len(new)
        pieces[keep:after], counts[keep:after] = new, self.encode(new)
        self._deal(low, high, pieces, counts)

    def text_now(self) -> str:
        return "".join(p for b in range(len(self.blocks)) for p in self.block(b)[0])

    @property
    def total(self) -> int:
        return self.tokens[1]


def _encoder(path: str):
    cache = piece_cache(path)
    if cache.merger:
        return lambda pieces: [len(cache.merger(p.encode("utf-8"))) for p in pieces]
    return lambda pieces: [len(e.ids) for e in cache.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def edited_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cache, encode = piece_cache(path), _encoder(path)
    for rows, data, offsets in slices(batches, "text"):
        pieces = Pieces(data, offsets)
        slot = cache.lookup(pieces.hash, pieces.begin, pieces.end, data) if len(pieces.hash) else np.zeros(0, np.int64)
        counts = cache.lengths[slot]
        size = pieces.end_point - np.append(0, pieces.end_point[:-1]) if len(slot) else np.zeros(0, np.int64)
        odd = set(pieces.odd.tolist())
        out = []
        for r, edits in enumerate(rows.column(rows.schema.get_field_index("edits")).to_pylist()):
            text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8")
            a, b = pieces.bounds[r], pieces.bounds[r + 1]
            edits = [(e["start"] or 0, e["removed"] or 0, e["added"] or "") for e in edits or [] if e]
            if r in odd:
                split = [m.group() for m in _pattern().finditer(text)]
                starts = np.cumsum([0, *map(len, split)])[:-1].astype(np.int64)
                own = np.array(encode(split), dtype=np.int64)
            else:
                own = counts[a:b]
                starts = np.cumsum(size[a:b]) - size[a:b]
            tree = TokenTree(text, starts, own, encode)
            before = tree.total
            for start, removed, added in edits:
                tree.edit(start, removed, added)
            out.append((before, len(edits), tree.total, tree.encoded, tree.chars[1]))
        columns = [rows.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(5))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens_before", "n_edits", "tokens_after", "pieces_encoded", "chars_after"])


def count_after_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, tokens_before, n_edits, tokens_after, pieces_encoded, chars_after.

    ``edits``: array<struct<start, removed, added>>, in the order in which they were made. The
    special token's string in a text is counted as ordinary text.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.cast("array<struct<start:long,removed:long,added:string>>").alias("edits"))
    return rows.mapInArrow(lambda it: edited_counts(it, path), "doc_id long, tokens_before long, n_edits long, tokens_after long, pieces_encoded long, chars_after long")


#: What the query's edits insert, by turns.
ADDED = (" revised", "'s", "\n\n", "2", "", " (see below) ")


def hashed_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> Column:
    """``n`` edits per document at places, of lengths and with additions that follow from hashes of its id."""
    added = F.array(*[F.lit(a) for a in ADDED])
    length = F.coalesce(F.length(text_col), F.lit(0)) + 1

    def draw(k: int, what: str, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col), F.lit(k), F.lit(what)), below)

    return F.array(*[F.struct(draw(k, "start", length.cast("long")).alias("start"), draw(k, "removed", F.lit(12)).alias("removed"), F.element_at(added, (draw(k, "added", F.lit(len(ADDED))) + 1).cast("int")).alias("added")) for k in range(n)])


def op10_edit_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_after_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), hashed_edits())
