import hashlib
import re
import time

import pytest

from tests.llm.fixtures import documents, with_clashes, words
from tessera.llm.decontamination import decontaminate, remove_contaminated


def brute(texts, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in enumerate(texts):
        w, hit, found, longest = split(t), set(), set(), 0
        for item, x in items:
            v = split(x)
            n = min(len(v), 13)
            for win in {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else ():
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) == win:
                        hit.update(range(a, a + n))
                        found.add(str(item))
                        for b in range(len(v) - n + 1):
                            if tuple(v[b : b + n]) == win:
                                same = n
                                while a + same < len(w) and b + same < len(v) and w[a + same] == v[b + same]:
                                    same += 1
                                longest = max(longest, same)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w), longest))
    return out


@pytest.fixture(scope="module")
def case(spark):
    import random

    rng = random.Random(3)
    items = [(k, words(rng, n)) for k, n in enumerate((40, 30, 13, 12, 2, 1, 50))] + [(7, None), (8, " .,! "), (9, "Ça et là"), (0, words(rng, 20)), (10, None)]
    items.append((11, items[0][1]))  # one text, two ids
    texts = [words(rng, 100), f"{words(rng, 50)} {items[0][1]} {words(rng, 20)}", items[0][1].upper(), " ".join(items[1][1].split()[3:16]), " ".join(items[1][1].split()[3:15]), items[3][1] + ". " + items[3][1], items[5][1], None, "", "...", "ça! ET; là", f"{words(rng, 3000)} {items[6][1]}"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return texts, items, bench


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest").collect())


def test_equals_brute_force(spark, case):
    texts, items, bench = case
    assert rows(decontaminate(documents(spark, texts), bench)) == brute(texts, items)


def test_parts_of_a_large_benchmark_merge(spark, case):
    texts, items, bench = case
    assert rows(decontaminate(documents(spark, texts), bench, part_bytes=600)) == brute(texts, items)


def test_removal_keeps_columns_and_clean_rows(spark, case):
    texts, items, bench = case
    clean = [r[0] for r in brute(texts, items) if not r[5]]
    docs = with_clashes(documents(spark, texts), "hits", "items", "n_words", "contaminated")
    for part_bytes in (1 << 20, 600):
        kept = remove_contaminated(docs, bench, part_bytes=part_bytes)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == clean


def test_empty_tables(spark, case):
    texts, _, bench = case
    assert decontaminate(documents(spark, []), bench).count() == 0
    assert not any(r[5] for r in rows(decontaminate(documents(spark, texts), bench.limit(0))))


def test_longest_match_and_its_place(spark):
    item = words_of(40, 1)
    text = " ".join(["before", "it", *item[10:35], "between", *item[:20], "x"])
    docs = documents(spark, [text])
    bench = spark.createDataFrame([("b", " ".join(item)), ("a", " ".join(item[5:38]))], "item_id string, text string")
    for part_bytes in (1 << 20, 200):
        r = decontaminate(docs, bench, part_bytes=part_bytes).collect()[0]
        assert (r.longest, r.longest_start, r.longest_item, r.longest_item_start) == (25, 2, "a", 5)
        assert [tuple(h) for h in r.hits] == [(2, 27), (28, 48)]


def words_of(n, seed):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_repeated_words_take_no_pairs(spark):
    """100,000 equal words in a document and an item: 10**10 pairs of places."""
    bench = spark.createDataFrame([(1, "na " * 100_000), (2, "na na ba " * 5_000)], "item_id long, text string")
    docs = documents(spark, ["na " * 100_000, "na na ba " * 2_000 + "na " * 3_000, "ba na " * 100])
    began = time.time()
    got = {r.doc_id: (r.n_hit, r.n_items, r.longest) for r in decontaminate(docs, bench).collect()}
    assert time.time() - began < 60
    assert got[0] == (100_000, 1, 100_000)
    assert got[1] == (9_000, 2, 6_002)
    assert got[2] == (0, 0, 0)


@pytest.mark.parametrize("part_bytes", [1 << 20, 600])
def test_repeated_and_null_ids_are_rows_of_their_own(spark, case, part_bytes):
    texts, items, bench = case
    base = documents(spark, texts)
    docs = base.selectExpr("if(doc_id % 2 = 0, null, 1L) doc_id", "text", "lang", "source", "n_chars")
    want = sorted((r[1:] for r in brute(texts, items)), key=str)
    got = [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest) for r in decontaminate(docs, bench, part_bytes=part_bytes).collect()]
    assert sorted(got, key=str) == want
    kept = remove_contaminated(docs, bench, part_bytes=part_bytes).collect()
    clean = [t for t, r in zip(texts, brute(texts, items), strict=True) if not r[5]]
    assert sorted((r.text for r in kept), key=str) == sorted(clean, key=str)


def test_nulls_and_repeats_in_the_benchmark(spark):
    passage = " ".join(words_of(20, 2))
    bench = spark.createDataFrame([(None, passage), ("a", None), ("a", passage), ("a", passage), ("b", passage)], "item_id string, text string")
    r = decontaminate(documents(spark, [passage]), bench).collect()[0]
    assert (r.n_items, r["items"], r.n_hit, r.longest) == (2, ["a", "b"], 20, 20)
