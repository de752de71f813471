"""Pre-tokens and ids of a byte-level BPE vocabulary, each distinct pre-token encoded once.

A byte-level BPE tokenizer splits a text by a fixed pattern and encodes the pieces
independently. Pieces are found here for whole batches with numpy, and only
pieces not met before by this Python worker go to the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from tessera.llm.textbytes import U64, RollingHash, mixed

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: A piece's own end of text in a document's id stream.
END_ID = 1
#: The tokenizer treats this string in a text as one token.
SPECIAL = b"<|endoftext|>"
#: Code points from here on, rare in any text, are left to the tokenizer's own splitter.
TABLE_END = 0x3000
#: White space beyond what the C0 and Latin-1 rules of str.isspace agree on.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 400_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.full(TABLE_END, OTHER, dtype=np.uint8)
    for c in range(TABLE_END):
        major = unicodedata.category(chr(c))[0]
        kind[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    kind[list(WHITE_SPACE)] = SPACE
    return kind


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes and the byte at which each begins (and the end)."""
    if not (data & 0x80).any():
        return data.astype(np.uint32), np.arange(len(data) + 1)
    lead = (data & 0xC0) != 0x80
    at = np.append(np.flatnonzero(lead), len(data))
    order = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    return np.frombuffer(data.tobytes().decode("utf-8").encode(order), dtype=np.uint32), at


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin, for code points below TABLE_END; no piece crosses a text's start.

    The pattern: contractions; an optional blank with a run of letters, of numbers or
    of other signs; white space, whose last character stays for the next piece.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_starts[text_starts < n]] = True
    edge[0] = edge[n] = True
    run = edge.copy()  # a run of one class begins here
    run[1:n] |= kind[1:] != kind[:-1]
    begin = run[:n].copy()
    white = kind == SPACE
    # the last of a white run before another class: a blank joins what follows, others stand alone
    tail = white & run[1:] & ~edge[1:]
    begin[tail] = True
    joins = np.flatnonzero(tail & (points == 32))
    begin[joins + 1] = False
    # contractions: a lone apostrophe that no blank joined, then s t d m or re ve ll
    lone = np.flatnonzero((points == 39) & begin & run[1:] & ~edge[1:])
    if len(lone):
        nxt = points[lone + 1]
        far = np.minimum(lone + 2, n - 1)
        after = np.where((lone + 2 < n) & ~edge[np.minimum(lone + 2, n)], points[far], 0)
        one = np.isin(nxt, [115, 116, 109, 100])
        two = ((nxt == 114) | (nxt == 118)) & (after == 101) | (nxt == 108) & (after == 108)
        for hit, length in ((lone[one], 1), (lone[two & ~one], 2)):
            begin[hit + 1] = False
            rest = hit + 1 + length
            ok = (rest < n) & ~run[np.minimum(rest, n)]
            begin[rest[ok]] = True
    return np.flatnonzero(begin)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def load_merger(path: str):
    """bytes of a piece -> ids, from the same file's merges; None unless ids follow the order of the merges.

    The tokenizer's own call costs about ten times a piece's merging.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    letters = _byte_letters()
    if any(y <= x for x, y in zip(made, made[1:], strict=False)) or made[:1] < [0] or not all(c in vocab for c in letters):
        return None
    kept = set(made)
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i in kept or token in letters}
    core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


class PieceCache:
    """Ids of pieces by hash; flat arrays hold all ids one after another."""

    def __init__(self, path: str):
        self.path, self.tokenizer, self.merger = path, load_tokenizer(path), load_merger(path)
        self._clear()

    def _clear(self):
        self.slot: dict[int, int] = {}
        self.lengths, self.starts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, hashes: list[int], pieces: list[bytes]) -> None:
        if self.merger:
            ids = [self.merger(p) for p in pieces]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, k, total = len(self.slot), len(ids), int(lengths.sum())
        while n + k > len(self.lengths):
            self.lengths, self.starts = np.concatenate([self.lengths, np.zeros_like(self.lengths)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + total] = np.fromiter((x for e in ids for x in e), np.uint32, total)
        self.used += total
        self.slot.update(zip(hashes, range(n, n + k), strict=True))

    def lookup(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The slot of each piece, given its hash and its bytes data[begin:end]."""
        codes, distinct = pd.factorize(hashes)
        if len(self.slot) + len(distinct) > CACHE_PIECES:
            self._clear()
        first = np.zeros(len(distinct), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        get = self.slot.get
        keys = distinct.tolist()
        slots = np.fromiter((get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            pieces = [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            self._add([keys[i] for i in new.tolist()], pieces)
            slots[new] = np.fromiter((self.slot[keys[i]] for i in new.tolist()), np.int64, len(new))
        return slots[codes]


_CACHES: dict[str, PieceCache] = {}


def piece_cache(path: str) -> PieceCache:
    if path not in _CACHES:
        _CACHES[path] = PieceCache(path)
    return _CACHES[path]


_PLANE = U64(0xD6E8FEB86659FD93)
_CODES32 = np.random.default_rng(11).integers(1, 2**63, 1 << 16, dtype=U64) * U64(2) + U64(1)


def _symbols(points: np.ndarray) -> np.ndarray:
    """A random number for each code point: of its lower 16 bits, and beyond them a multiple of the plane."""
    symbols = _CODES32[(points & 0xFFFF).astype(np.int64)]
    plane = points >> 16
    return symbols + plane.astype(U64) * _PLANE if plane.any() else symbols


class Pieces:
    """The pieces of a slice of texts: their byte ranges, hashes and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points, at = code_points(data)
        #: Rows whose pieces are left to the tokenizer.
        self.odd = self._odd_rows(data, offsets, points, at)
        safe = np.where(points < TABLE_END, points, 0x2FFF) if len(self.odd) else points
        text_starts = np.searchsorted(at[:-1], offsets[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
        starts = piece_starts(safe, text_starts)
        self.end_point = np.append(starts[1:], len(points)) if len(starts) else starts
        rolling = RollingHash(_symbols(points))
        self.hash = mixed(rolling.ranges(starts, self.end_point) + (self.end_point - starts).astype(U64)) if len(starts) else np.zeros(0, U64)
        self.begin, self.end = at[starts], at[self.end_point] if len(starts) else at[:0]
        #: Row r has the pieces bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.begin, offsets)

    @staticmethod
    def _odd_rows(data, offsets, points, at) -> np.ndarray:
        spots = at[:-1][points >= TABLE_END] if len(points) else np.zeros(0, np.int64)
        if (data == SPECIAL[0]).any():
            raw, found, i = data.tobytes(), [], -1
            while (i := raw.find(SPECIAL, i + 1)) >= 0:
                found.append(i)
            spots = np.concatenate([spots, np.array(found, dtype=np.int64)]) if found else spots
        return np.unique(np.searchsorted(offsets, spots, side="right") - 1) if len(spots) else np.zeros(0, np.int64)


def encode_rows(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each row's followed by END_ID, and the rows' offsets among them."""
    cache, rows = piece_cache(path), len(offsets) - 1
    pieces = Pieces(data, offsets)
    slot = cache.lookup(pieces.hash, pieces.begin, pieces.end, data) if len(pieces.hash) else np.zeros(0, np.int64)
    lengths = cache.lengths[slot]
    total = np.zeros(len(slot) + 1, dtype=np.int64)
    np.cumsum(lengths, out=total[1:])
    ids = cache.ids[np.repeat(cache.starts[slot] - total[:-1], lengths) + np.arange(total[-1])]
    per_row = total[pieces.bounds[1:]] - total[pieces.bounds[:-1]]
    if len(pieces.odd):
        parts = np.split(ids, total[pieces.bounds[1:-1]])
        for r in pieces.odd.tolist():
            text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8")
            parts[r] = np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            per_row[r] = len(parts[r])
        ids = np.concatenate(parts)
    ends = np.cumsum(per_row)
    out = np.insert(ids, ends, END_ID)
    return out.astype(np.uint32), np.concatenate([[0], ends + np.arange(1, rows + 1)])
