"""Near words, forms and roots against comparing all pairs."""

import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tessera.llm import spelling
from tessera.llm.spelling import corpus_words, spelling_variants
from tests.llm.fixtures import awkward_texts, documents, with_clashes

WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(count, ratio=10):
    forms, many = {}, {}
    for w, n in count.items():
        around = [v for v in count if near(w, v)]
        many[w] = len(around)
        best = min(around, key=lambda v: (-count[v], v), default=None)
        forms[w] = best if best is not None and count[best] >= ratio * n else None
    out = []
    for w, n in count.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, many[w], count[forms[w]] if forms[w] else None))
    return sorted(out)


def plain_words(rows, min_length=7):
    count = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if n >= 2}


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def mutated(rng, word, letters="abé"):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + rng.choice(letters) + word[at:], word[: max(0, at - 1)] + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def vocabulary(seed, n=250, letters="abé", least=1):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(max(7, least), 14))) for _ in range(n // 5)}
    while len(words) < n:
        words.add(mutated(rng, rng.choice(sorted(words)), letters))
    return {w: rng.choice([2, 2, 3, 20, 20, 30, 300, 4000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize(("seed", "shard_rows", "hot"), [(1, 100_000, 50_000), (2, 60, 20), (3, 20, 4)])
def test_equals_all_pairs(spark, monkeypatch, seed, shard_rows, hot):
    monkeypatch.setattr(spelling, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(spelling, "HOT", hot)
    count = vocabulary(seed)
    assert got(spelling_variants(spark.createDataFrame(list(count.items()), WORDS).repartition(5))) == plain(count)


def test_one_segment_in_a_third_of_all_words_is_cut_further(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_ROWS", 200)
    monkeypatch.setattr(spelling, "HOT", 60)
    rng = random.Random(8)
    count = {"beginning" + "".join(rng.choice("abc") for _ in range(9)): rng.choice([2, 50, 700]) for _ in range(150)}
    count |= {"".join(rng.choice("abc") for _ in range(9)) + "beginning": rng.choice([2, 50, 700]) for _ in range(150)}
    for w in sorted(count)[::3]:
        count.setdefault(mutated(rng, w, "abc"), 20)
    frames = spelling.dealt_frames(spark.createDataFrame(list(count.items()), WORDS), len(count))
    assert frames.where("ahead > 0 and behind > 0").count() > 0
    assert got(spelling_variants(spark.createDataFrame(list(count.items()), WORDS))) == plain(count)


def test_chains_runs_of_one_letter_and_very_long_words(spark):
    long = "ab" * 15_000
    count = {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaab": 200, "aaaaaaaabb": 2000, "aaaaaaabbb": 1_000_000, "zzzzzzzzz": 5}
    count |= {long: 3, long[:-1]: 30, long[:20_000] + "x" + long[20_001:]: 400, "c" + long: 4}
    assert got(spelling_variants(spark.createDataFrame(list(count.items()), WORDS))) == plain(count)


def test_words_of_documents(spark):
    rng = random.Random(6)
    texts = [*awkward_texts(), *(" ".join(rng.choice(["Straßeÿß", "ÉTÉétéété", "commonword", "Commonwords", "shórtéñ", "x" * 40]) for _ in range(rng.randint(0, 200))) + "×÷-Été,été" for _ in range(40))]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], documents(spark, []).schema)
    df = with_clashes(df, "word", "n", "run", "h")
    assert {r["word"]: r["n"] for r in corpus_words(df).collect()} == plain_words(rows)
    assert got(spelling_variants(corpus_words(df))) == plain(plain_words(rows))


def test_empty_tables(spark):
    assert spelling_variants(corpus_words(documents(spark, []))).collect() == []
    assert spelling_variants(corpus_words(documents(spark, [None, "", "short words"]))).collect() == []
