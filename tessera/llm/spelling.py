"""Spelling variants: near words of a corpus, found by automatons over halves of words.

Two words are near if one inserted, deleted or replaced code point makes them equal.
Cut a word in two: of the segments of a near word's cut, one at least stands unchanged in
the other word, at its beginning or at its end, and lengths differ by one at most.

1. Every word owns its two segments. Segments are dealt to shards of bounded size, and
   every word is sent to the shards where a segment of a near word would lie.
2. A shard builds an Aho-Corasick automaton of its segments and scans its words. A
   segment counts where it lies at the right end of the word and the owner's length fits.
3. Distance is verified for a word and all owners of a segment at once: the words with one
   code point left out are looked up by hash, and what is found is compared in full. A
   pair that both segments find counts for the first only, so a shard returns a count and
   a best near word for each of its words, and no pairs.

A segment with so many words that it would overfill a shard is fixed, and the rest of
the word is cut in two again, and so on; the last rest of one code point has no more near
words than the alphabet has letters. Shards that hold no such segment are not looked at
again.

A word's form is its near word of the largest count (ties: the smallest in code-point
order) if that is ``ratio`` times its own at least; its root is reached by following forms.
Counts grow by that ratio at every step, so chains are short, and no two words are each
other's form.

Null texts have no words, and a null id stands as the empty text in the hash that draws the
deleted code points. Every row is a document, so repeated rows count again. Other columns,
whatever their names, are not read. An empty table has no words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.checkpoints import cut
from tessera.llm.textbytes import CODES, U64, mixed

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: One run in so many, by hash, loses a code point.
DRAW = 31
#: Rows of a shard, on average, and rows of one segment that make it too large for one.
SHARD_ROWS = 100_000
HOT = 50_000
RUN = "[a-zÀ-ÿ]{%d,}"
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
FOUND = "word string, n_near long, best_n long, best string"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: runs of letters, A-Z in lower case, of which one in DRAW has lost the code point that its hash names."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(text_col, upper, upper.lower()), F.lit(RUN % min_length), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % DRAW == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cut_in_two(rows: DataFrame) -> DataFrame:
    """Each frame, the first ``ahead`` and last ``behind`` code points of an owner of ``length``, becomes two: half of its rest joins one or the other.

    ``limit`` tells a pair that an earlier frame finds too: its words share as many first code points.
    """
    rest = F.col("length") - F.col("ahead") - F.col("behind")
    front = F.floor(rest / 2).cast("int")
    first = F.struct((F.col("ahead") + front).alias("ahead"), F.col("behind").alias("behind"), F.col("limit").alias("limit"))
    last = F.struct(F.col("ahead").alias("ahead"), (F.col("behind") + rest - front).cast("int").alias("behind"), (F.col("ahead") + front).alias("limit"))
    others = [c for c in rows.columns if c not in ("ahead", "behind", "limit", "key")]
    rows = rows.select(*others, F.explode(F.array(first, last)).alias("frame")).select(*others, "frame.*")
    return rows.withColumn("key", F.xxhash64("length", "ahead", "behind", F.expr("left(word, ahead)"), F.expr("right(word, behind)")))


def _frames(words: DataFrame) -> DataFrame:
    """Every word as the owner of its frames, and as one that may be near owners of its own length, one more and one less."""
    size = F.length("word")
    roles = F.array(F.struct(F.lit(True).alias("owner"), size.alias("length")), *(F.struct(F.lit(False).alias("owner"), (size + d).alias("length")) for d in (-1, 0, 1)))
    whole = words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.*", F.lit(0).alias("ahead"), F.lit(0).alias("behind"), F.lit(2**31 - 1).alias("limit"))
    return _cut_in_two(whole)


def dealt_frames(words: DataFrame, many: int) -> DataFrame:
    """Frames with their shard; those that would overfill one are cut further."""
    shards = F.lit(max(1, -(-8 * many // SHARD_ROWS)))
    rows, done = _frames(words).withColumn("shard", F.pmod("key", shards)), None
    while True:
        full = cut(rows.groupBy("shard").count().where(F.col("count") > 2 * SHARD_ROWS).select("shard"))
        if not full.limit(1).count():
            break
        may_cut = rows.where(F.col("length") - F.col("ahead") - F.col("behind") > 1)
        hot = cut(may_cut.join(full, "shard", "left_semi").groupBy("key").count().where(F.col("count") > HOT).select("key"))
        if not hot.limit(1).count():
            break
        rest = rows.join(hot, "key", "left_anti").select(rows.columns)
        done = rest if done is None else done.unionByName(rest)
        rows = _cut_in_two(rows.join(hot, "key", "left_semi").select(rows.columns).drop("shard")).withColumn("shard", F.pmod("key", shards))
    rows = rows if done is None else done.unionByName(rows)
    return rows.select("shard", "word", "n", "owner", "ahead", "behind", "limit")


class Letters:
    """Code points of several words, with hashes of any word as it is and with one place left out."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        n = len(self.points)
        local = np.arange(n) - np.repeat(self.begin, self.size)
        powers = np.ones(max(1, int(self.size.max(initial=0))), dtype=U64)
        powers[1:] = BASE
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(CODES[self.points & 0xFF] * np.cumprod(powers)[local], out=self.sums[1:])
        ends = np.ones(n, dtype=bool)
        ends[:-1] = (self.points[1:] != self.points[:-1]) | (local[1:] == 0)
        last = np.flatnonzero(ends)
        #: The place, in its word, where a run of one letter ends.
        self.run_end = local[last[np.searchsorted(last, np.arange(n))]] if n else local

    def whole(self, word: np.ndarray) -> np.ndarray:
        return self.sums[self.begin[word] + self.size[word]] - self.sums[self.begin[word]]

    def without(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end = self.begin[word], self.begin[word] + self.size[word]
        return self.sums[start + at] - self.sums[start] + (self.sums[end] - self.sums[start + at + 1]) * INVERSE


def _spread(word: np.ndarray, frame: np.ndarray, letters: Letters, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of every code point that its frame leaves open."""
    many = letters.size[word] - ahead[frame] - behind[frame]
    row = np.repeat(np.arange(len(word)), many)
    return row, ahead[frame][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _equal(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of ``left`` and ``right`` with equal keys."""
    order = np.argsort(right, kind="stable")
    held = right[order]
    low = np.searchsorted(held, left)
    many = np.searchsorted(held, left, side="right") - low
    at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(np.arange(len(left)), many), order[at]


def scan(words: list[str], some: np.ndarray, frames: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``some`` and the frames (length, beginning, end) they fit, found by one automaton of all segments."""
    segments: dict[str, tuple[list[int], list[int]]] = {}
    for f, (_, ahead, behind) in enumerate(frames):
        at_end = len(behind) > len(ahead)
        segments.setdefault(behind if at_end else ahead, ([], []))[at_end].append(f)
    automaton = ahocorasick.Automaton()
    for segment, owned in segments.items():
        automaton.add_word(segment, (len(segment) - 1, owned))
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    fits: list[tuple[int, int]] = []
    for w in some.tolist():
        word = words[w]
        size = len(word)
        for end, (head, owned) in automaton.iter(word):
            for at_end, here in ((0, end == head), (1, end == size - 1)):
                if here:
                    for f in owned[at_end]:
                        length, ahead, behind = frames[f]
                        if -1 <= length - size <= 1 and len(ahead) + len(behind) <= size and (word.startswith(ahead) if at_end else word.endswith(behind)):
                            fits.append((w, f))
    found = np.array(fits, dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def verified(words: list[str], letters: Letters, fit: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], limit: np.ndarray, frames: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) of words and owners of one frame, each pair once in all shards."""
    (word, frame), (owner, owned) = fit, own
    length, ahead, behind = (np.array([g(f) for f in frames], dtype=np.int64) for g in (lambda f: f[0], lambda f: len(f[1]), lambda f: len(f[2])))
    difference = letters.size[word] - length[frame]
    key = lambda h, f: mixed(h + f.astype(U64) * U64(0xD6E8FEB86659FD93))
    found = []
    for d in (-1, 0, 1):
        mine = np.flatnonzero(difference == d)
        w, f = word[mine], frame[mine]
        # places of the longer word are left out, of both if they are equally long
        if d >= 0:
            row, at = _spread(w, f, letters, ahead, behind)
        else:
            row = at = None
        if d <= 0:
            own_row, own_at = _spread(owner, owned, letters, ahead, behind)
        else:
            own_row = own_at = None
        if d == 0:
            a, b = _equal(key(letters.without(w[row], at) + mixed(at.astype(U64)), f[row]), key(letters.without(owner[own_row], own_at) + mixed(own_at.astype(U64)), owned[own_row]))
            place, pair_w, pair_o = at[a], w[row[a]], own_row[b]
        elif d == 1:
            row, at = _once(letters, w, row, at, behind[f])
            a, b = _equal(key(letters.without(w[row], at), f[row]), key(letters.whole(owner), owned))
            place, pair_w, pair_o = letters.run_end[letters.begin[w[row[a]]] + at[a]], w[row[a]], b
        else:
            own_row, own_at = _once(letters, owner, own_row, own_at, behind[owned])
            a, b = _equal(key(letters.whole(w), f), key(letters.without(owner[own_row], own_at), owned[own_row]))
            place, pair_w, pair_o = letters.run_end[letters.begin[owner[own_row[b]]] + own_at[b]], w[a], own_row[b]
        # a pair that an earlier frame finds counts there
        some = (pair_w != owner[pair_o]) & (place < limit[pair_o])
        for x, y, p in zip(pair_w[some].tolist(), owner[pair_o[some]].tolist(), place[some].tolist(), strict=True):
            u, v = words[x], words[y]
            if u[:p] == v[:p] and u[p + (d >= 0) :] == v[p + (d <= 0) :]:
                found.append((x, y))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _once(letters: Letters, word: np.ndarray, row: np.ndarray, at: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in one run of a letter, which all leave the same word, only the last open one."""
    w = word[row]
    keep = (letters.run_end[letters.begin[w] + at] == at) | (at == letters.size[w] - behind[row] - 1)
    return row[keep], at[keep]


def _near_in_shard(table: pa.Table) -> pa.Table:
    coded = table.column("word").combine_chunks().dictionary_encode()
    words, row_word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    n = np.zeros(len(words), np.int64)
    n[row_word] = table.column("n").to_numpy()
    owns = table.column("owner").to_numpy(zero_copy_only=False)
    ahead, behind, limit = (table.column(c).to_numpy()[owns] for c in ("ahead", "behind", "limit"))
    owner, numbers = row_word[owns].astype(np.int64), {}
    owned = np.array([numbers.setdefault((len(w), w[:a], w[len(w) - b :]), len(numbers)) for w, a, b in zip([words[i] for i in owner.tolist()], ahead.tolist(), behind.tolist(), strict=True)], dtype=np.int64)
    frames = list(numbers)
    fit = scan(words, np.unique(row_word[~owns]), frames)
    x, y = verified(words, Letters(words), fit, (owner, owned), limit, frames)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
    many = np.diff(np.append(first, len(x)))
    text = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
    return pa.table([text(x[first]), pa.array(many.astype(np.int64)), pa.array(n[y[first]]), text(y[first])], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for the words (word, n, each word once) that have a near one."""
    many = words.count()
    found = dealt_frames(words, many).groupBy("shard").applyInArrow(_near_in_shard, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("lead")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("lead.minus")).alias("best_n"), F.col("lead.best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root: where following ``form`` from a word ends, by pointer jumping."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return roots


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (word, n, each word once)."""
    words = cut(words.select("word", "n"))
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    named = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = followed(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), held AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS h FROM held, tab
), drawn AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM drawn WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, d FROM less WHERE d IN (SELECT word FROM v)
  UNION SELECT d, word FROM less WHERE d IN (SELECT word FROM v)
), near AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS best, max(o.n) AS best_n FROM pairs p JOIN v o ON p.other = o.word GROUP BY p.word
), named AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN near ON v.word = near.word
), chain AS (
  SELECT word, word AS root, form AS next FROM named UNION ALL SELECT c.word, n.word, n.form FROM chain c JOIN named n ON c.next = n.word
)
SELECT n.word, n.form, c.root, n.n, n.n_near, n.form_n FROM named n JOIN chain c ON n.word = c.word AND c.next IS NULL
"""
