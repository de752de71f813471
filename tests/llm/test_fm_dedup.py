"""Passages that earlier documents hold: FM-index and removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fm_dedup
from tessera.llm.fm_dedup import FmIndex, RangeLeast, WaveletMatrix, matching_statistics, remove_earlier_passages
from tests.llm.fixtures import DOCS, awkward_texts, documents, with_clashes, words


def plain(rows, window):
    last = 2**63
    split = [(i, last if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for _, i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, last), i)
    out = []
    for given_id, i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((given_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) for r in df.collect()), key=str)


def check(spark, rows, window, parts=3):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(parts)
    assert got(remove_earlier_passages(with_clashes(df, "minimizer", "body", "flags"), window=window, with_text=True)) == plain(rows, window)


def repeating(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (12, 13, 14, 30, 80)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 30)), *rng.sample(passages, rng.randint(0, 3)), words(rng, rng.randint(0, 20))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rng.shuffle(rows)
    return rows


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 5))
def test_matching_statistics_are_the_longest_matches_with_earlier_owners(sequences, window):
    symbols = np.array([x for s in sequences for x in s])
    size = np.array([len(s) for s in sequences])
    end = np.cumsum(size)
    kind = np.repeat(np.arange(len(size)), size)
    owner = np.array([k // 2 for k in range(len(size))])
    index = FmIndex(symbols, 4, end[kind], owner[kind], window)
    places = np.flatnonzero(np.arange(len(symbols)) - (end - size)[kind] >= window - 1)
    found = matching_statistics(index, symbols, places, owner[kind[places]], window)
    for p, n in zip(places.tolist(), found.tolist(), strict=True):
        earlier = [s for k, s in enumerate(sequences) if owner[k] < owner[kind[p]]]
        best = 0
        for m in range(1, window + 1):
            piece = symbols[p - m + 1 : p + 1].tolist()
            best = m if any(piece == s[a : a + m] for s in earlier for a in range(len(s) - m + 1)) else best
        assert n == best


def test_wavelet_matrix_counts_and_range_least():
    rng = np.random.default_rng(3)
    for many, n in ((1, 5), (7, 64), (100, 1000)):
        symbols = rng.integers(0, many + 1, n)
        wavelet, at, wanted = WaveletMatrix(symbols, many), rng.integers(0, n + 1, 200), rng.integers(0, many + 1, 200)
        assert wavelet.rank(wanted, at).tolist() == [int((symbols[:a] == s).sum()) for a, s in zip(at, wanted, strict=True)]
    values = rng.integers(0, 50, 77)
    low = rng.integers(0, 77, 300)
    high = np.array([rng.integers(a + 1, 78) for a in low])
    assert RangeLeast(values).least(low, high).tolist() == [int(values[a:b].min()) for a, b in zip(low, high, strict=True)]


@pytest.mark.parametrize("window", [5, 13])
def test_equals_brute_force(spark, window):
    check(spark, repeating(window), window)


def test_awkward_texts(spark):
    rows = list(enumerate(awkward_texts()))
    df = documents(spark)
    assert got(remove_earlier_passages(df, with_text=True)) == plain(rows, 13)


def test_null_and_repeated_ids(spark):
    rows = [(None if i % 7 == 0 else i // 3, t) for i, t in repeating(9)]
    rows += rows[:5] + [(None, None), (3, ""), (2**63 - 2, rows[4][1]), (-5, rows[8][1])]
    check(spark, rows, 13)


def test_many_kinds_of_one_minimizer_and_small_shards(spark, monkeypatch):
    rng = random.Random(4)
    hot = words(rng, fm_dedup.GRAM)
    rows = [(i, f"{words(rng, 15)} {hot} {words(rng, 15)}") for i in range(150)]
    rows += [(200 + i, rows[i * 3][1]) for i in range(40)] + [(300 + i, " ".join(rows[i][1].split()[4:28])) for i in range(40)]
    expected = plain(rows, 13)
    for name, value in (("HOT", 10), ("SHARD_SEGMENTS", 7)):
        monkeypatch.setattr(fm_dedup, name, value)
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(5)
        assert got(remove_earlier_passages(df, with_text=True)) == expected


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = repeating(11)
    monkeypatch.setattr(fm_dedup, "BITMAP_BITS", 7)
    check(spark, rows, 13)


def test_empty_table_and_refused_window(spark):
    empty = remove_earlier_passages(documents(spark, []))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert empty.collect() == []
    with pytest.raises(ValueError, match="window"):
        remove_earlier_passages(documents(spark, []), window=4)
