import collections
import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import awkward_texts, documents, with_clashes, words
from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import remove_repeats


def brute(texts, length=200, keep="none"):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    first, out = set(), []
    for k, t in enumerate(raw):
        cover = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if seen[w] > 1 and (keep == "none" or w in first):
                cover[i] += 1
                cover[i + length] -= 1
            first.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted(tuple(r)[:5] for r in df.collect())


@pytest.mark.parametrize("keep", ["none", "first"])
def test_equals_brute_force(spark, keep):
    texts = awkward_texts()
    docs = with_clashes(documents(spark, texts), "spans", "minimizer", "start", "span_id")
    assert rows(remove_repeats(docs, keep=keep)) == brute(texts, keep=keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_minimizers_small_buckets_and_full_bitmaps_give_the_same(spark, monkeypatch, keep):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "BITMAP_BITS", 8)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SEGMENTS", 3)
    texts = awkward_texts()
    assert rows(remove_repeats(documents(spark, texts), keep=keep)) == brute(texts, keep=keep)


def test_text_comes_back(spark):
    got = {r.doc_id: bytes(r.kept_bytes) for r in remove_repeats(documents(spark, ["a" * 300, "b c"]), with_text=True).collect()}
    assert got == {0: b"", 1: b"b c"}


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).count() == 0


def test_long_factors_against_definition():
    rng = np.random.default_rng(4)
    for n, letters in ((600, 2), (5, 1), (70, 1)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw, starts = text.tobytes(), np.arange(max(n - 16, 0))
        rank = suffix_dedup.suffix_ranks(text, starts, 16)
        assert sorted(starts.tolist(), key=lambda s: raw[s : s + 16]) == np.argsort(rank, kind="stable").tolist()
        order = np.argsort(rank, kind="stable")
        for later in (False, True):
            hit = dict(zip(order.tolist(), suffix_dedup.has_long_factor(starts[order], rank[order], later).tolist(), strict=True))
            for s in starts.tolist():
                others = range(s + 1, len(starts)) if later else range(s)
                assert hit[s] == any(raw[a : a + 16] == raw[s : s + 16] for a in others)


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_and_null_ids(spark, monkeypatch, keep, hot):
    """Every row is a document: unique text of a repeated id stays, null ids come last."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(7)
    w, unique, other = (words(rng, 80) for _ in range(3))
    texts = [(1, w), (1, unique), (2, w), (None, other), (None, other + " tail"), (None, None), (3, unique[:250] + w[50:300]), (3, w)]
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0, i))
    docs = spark.createDataFrame([texts[i] for i in order], "doc_id long, text string").coalesce(1)
    want = brute([texts[i][1] for i in order], keep=keep)
    got = sorted((tuple(r)[1:] for r in remove_repeats(docs, keep=keep).collect()), key=str)
    assert got == sorted((r[1:] for r in want), key=str)


def test_rows_alike_in_id_and_text(spark):
    text = words(random.Random(1), 60)
    docs = with_clashes(spark.createDataFrame([(4, text)] * 3, "doc_id long, text string"), "doc", "tag", "at")
    assert [r.n_removed for r in remove_repeats(docs).collect()] == [len(text)] * 3
    assert sorted(r.n_removed for r in remove_repeats(docs, keep="first").collect()) == [0, len(text), len(text)]
