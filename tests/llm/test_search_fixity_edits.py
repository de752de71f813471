import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, with_clashes
from tessera.llm.edit_counts import MOST, TokenTree, count_after_edits, edited_counts, hashed_edits
from tessera.llm.fixity import audit_hashes, audit_replicas, page_hashes, page_replicas
from tessera.llm.pretokens import default_tokenizer_path, load_tokenizer
from tessera.llm.topk import Best, SortedLists, quantized, search_blocks, threshold_topk


def brute_topk(rows, k=5):
    """Each pair of ids once, with the best score of any of their vectors."""
    best: dict = {}
    for q, v in rows:
        if q is None or q % 50:
            continue
        held = best.setdefault(q, {})
        for i, w in rows:
            if i != q and i is not None and len(w) == len(v):
                held[i] = max(held.get(i, -(10**30)), sum(int(a) * int(b) for a, b in zip(v, w, strict=True)))
    out = []
    for q, held in best.items():
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.3, (300, 8)).round(2)
    vectors[40:90] = vectors[0]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(350, None), (351, [None] * 8), (352, [float("nan")] * 8), (353, [float("inf")] * 8), (400, []), (450, [0.5, -0.5]), (500, [0.25, 1.0]), (None, [0.1] * 8)]
    df = with_clashes(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), "rank", "score", "block")
    base = df.select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    whole = [(r.id, r.vector) for r in base.collect() if r.vector is not None and r.id is not None]
    got = threshold_topk(base, base.where("id % 50 = 0"), block=16, group=64, query_block=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(whole)
    assert threshold_topk(base.limit(0), base.limit(0)).count() == 0


def test_topk_with_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 70, v.tolist()) for i, v in enumerate(rng.normal(0, 0.3, (200, 6)))]
    rows += rows[:60] + [(50, rows[0][1]), (50, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    base = df.select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    whole = [(r.id, r.vector) for r in base.collect()]
    got = threshold_topk(base, base.where("id % 50 = 0"), block=16, group=64, query_block=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(whole)


def test_threshold_stops_early_and_right():
    rng = np.random.default_rng(5)
    x = np.zeros((4000, 6))
    x[:, 0] = rng.permutation(4000)
    lists = SortedLists(np.arange(4000), x)
    best = Best(np.array([-1, -1]), 3, np.float64)
    read = lists.improve(np.array([[1.0, 0, 0, 0, 0, 0], [0.0] * 6]), best)
    assert best.scores.tolist() == [[3999, 3998, 3997], [0, 0, 0]]
    assert best.ids[1].tolist() == [0, 1, 2]
    assert read[0] < 50 and read[1] == 4000
    # a second block that cannot beat the carried scores is not read
    again = SortedLists(np.arange(5000, 9000), x - 4000).improve(np.array([[1.0, 0, 0, 0, 0, 0], [0.0] * 6]), best)
    assert again[0] == 0 and best.scores[0].tolist() == [3999, 3998, 3997]


def test_no_more_rows_are_scored_than_in_a_full_scan_and_fewer_of_clustered_vectors():
    rng = np.random.default_rng(8)
    around = rng.normal(0, 60, (20, 16))
    for name, spread in (("clustered", 4), ("alike in all directions", None)):
        x = np.floor(rng.normal(0, 60, (4000, 16)) if spread is None else around[rng.integers(0, 20, 4000)] + rng.normal(0, spread, (4000, 16)))
        ids = np.arange(4000) // 2 * (1 if spread is None else 2) + (0 if spread is None else np.arange(4000) % 2)
        queries = x[:40]
        best = Best(np.full(40, -1), 5, np.float64)
        read = search_blocks(ids, x, queries, best, 256)
        for q in range(40):
            score = {}
            for i, v in zip(ids.tolist(), (x @ queries[q]).tolist(), strict=True):
                score[i] = max(score.get(i, v), v)
            assert list(zip(best.ids[q].tolist(), best.scores[q].tolist(), strict=True)) == sorted(score.items(), key=lambda s: (-s[1], s[0]))[:5], name
        assert read.max() <= 4000
        assert spread is None or read.sum() < 0.3 * 40 * 4000


def test_scores_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(0, [3e30, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    base = df.select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    with pytest.raises(Exception, match="fit a long|OVERFLOW"):
        threshold_topk(base, base.where("id = 0")).collect()


def records(spark, rows):
    return spark.createDataFrame(rows, "archive long, offset long, record binary")


def test_audit_finds_each_difference(spark):
    rng = random.Random(3)
    a = [(k, 5000 * i, bytes(rng.randbytes(200))) for k in range(20) for i in range(30)]
    b = dict(((x, y), z) for x, y, z in a)
    b[3, 10_000] = b"changed"
    del b[7, 0]
    b[19, 999_999_999] = b"extra"
    got = audit_replicas(records(spark, a), records(spark, [(x, y, z) for (x, y), z in b.items()]))
    assert sorted((r.archive, r.offset, r.finding) for r in got.collect()) == [(3, 10_000, "changed"), (7, 0, "missing"), (19, 999_999_999, "extra")]
    assert audit_replicas(records(spark, a), records(spark, a[::-1])).count() == 0
    assert audit_replicas(records(spark, []), records(spark, [])).count() == 0
    assert audit_replicas(records(spark, a), records(spark, [])).count() == len(a)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(0, None, None, "x"), (1, "u", "é" * 10, "x"), (1500, "u", "", "x")], "page_id long, url string, html string, digest string")
    hashed = page_hashes(pages)
    assert [r.offset for r in hashed.orderBy("archive", "offset").collect()][0] == 0
    assert audit_hashes(hashed, page_hashes(pages, F.upper("html"))).count() == 1


def test_pages_of_one_id_and_without_one(spark):
    rng = random.Random(2)
    rows = [(5, f"u{i}", "x" * rng.randint(0, 50)) for i in range(8)]
    rows += [(None, "n", "a"), (None, "n", "b"), (5, "u0", "same"), (5, "u0", "same"), (6, "v", "y" * 300_000), (7, None, None)]
    make = lambda r: with_clashes(spark.createDataFrame(r, "page_id long, url string, html string"), "size", "key", "digest", "offset", "archive", "part")
    one, other = page_hashes(make(rows)), page_hashes(make(rows[::-1]).repartition(3))
    assert audit_hashes(one, other).count() == 0
    changed = audit_hashes(one, page_hashes(make(rows), F.concat(F.lit("#"), F.coalesce("html", F.lit("")))))
    assert changed.count() == len(rows)
    lost = audit_hashes(one, page_hashes(make(rows), None, F.col("page_id").isNull()))
    assert [r.finding for r in lost.collect()] == ["missing", "missing"]


def test_pages_alike_in_id_and_text_are_counted(spark):
    rows = [(5, "u", "same")] * 5000 + [(5, "u", "more"), (6, "v", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    one, other, short = page_replicas(pages, [(None, None), (None, None), (None, F.col("page_id") == 6)])
    offsets = sorted(r.offset for r in one.collect())
    sizes = sorted(r.length for r in one.collect())
    assert len(offsets) == len(set(offsets)) == 5002 and max(offsets) < sum(sizes)
    assert audit_hashes(one, other).count() == 0
    assert [r.finding for r in audit_hashes(one, short).collect()] == ["missing"]


def test_rows_of_one_offset_are_a_multiset(spark):
    a = [(0, 0, b"p"), (0, 0, b"q"), (0, 0, b"q"), (None, None, b"r"), (1, 40_000, b"s")]
    b = [(0, 0, b"q"), (0, 0, b"p"), (0, 0, b"q"), (None, None, b"r"), (1, 40_000, b"s")]
    assert audit_replicas(records(spark, a), records(spark, b)).count() == 0
    b[2], b[3] = (0, 0, b"z"), (None, None, b"R")
    got = audit_replicas(records(spark, a), records(spark, b)).collect()
    assert sorted(((r.archive, r.offset, r.finding) for r in got), key=str) == [(0, 0, "changed"), (None, None, "changed")]
    got = audit_replicas(records(spark, a), records(spark, a[:2] + a[3:])).collect()
    assert [(r.archive, r.offset, r.finding) for r in got] == [(0, 0, "missing")]


def applied(text, edits):
    for e in edits or []:
        if e is None:
            continue
        start = min(max(e["start"] or 0, 0), len(text))
        gone = min(max(e["removed"] or 0, 0), len(text) - start)
        text = text[:start] + (e["added"] or "") + text[start + gone :]
    return text


def test_counts_after_edits_equal_encoding_anew():
    rng = random.Random(8)
    letters = list("ab s'tlreved  \n\t é²9#.!'日")
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for i in range(1500):
        n = rng.choice([0, 3, 20, 100, 900])
        edits = [{"start": rng.randint(-2, n + 5), "removed": rng.choice([0, 0, 1, 5, 40, 700]), "added": text(rng.choice([0, 1, 2, 8, 60]))} for _ in range(rng.randint(0, 6))]
        rows.append((i, text(n), edits))
    rows += [(9000, None, None), (9001, None, [{"start": 0, "removed": 3, "added": "hello"}]), (9002, "abc", [None, {"start": None, "removed": None, "added": None}])]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("removed", pa.int64()), ("added", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind)], ["doc_id", "text", "edits"])
    tokens = lambda t: len(load_tokenizer(default_tokenizer_path()).encode(t, add_special_tokens=False).ids)
    out = pa.Table.from_batches(list(edited_counts([batch], default_tokenizer_path()))).to_pylist()
    for (_, t, edits), o in zip(rows, out, strict=True):
        after = applied(t or "", edits)
        assert (o["tokens_before"], o["tokens_after"], o["chars_after"]) == (tokens(t or ""), tokens(after), len(after)), (t, edits)


def test_edits_of_a_long_text_encode_little(spark):
    docs = with_clashes(documents(spark, ["word and more " * 20_000]), "edits", "tokens_after")
    edits = F.array(F.struct(F.lit(100_000).alias("start"), F.lit(4).alias("removed"), F.lit("xyz").alias("added")))
    r = count_after_edits(docs, edits).first()
    assert r.n_edits == 1 and 0 < r.pieces_encoded < 20
    assert count_after_edits(documents(spark, []), edits).count() == 0


def test_counts_of_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (4, "three"), (4, "four five six"), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("removed"), F.lit("so ").alias("added")))
    tokens = lambda t: len(load_tokenizer(default_tokenizer_path()).encode(t, add_special_tokens=False).ids)
    found = sorted(((r.doc_id, r.tokens_before, r.tokens_after) for r in count_after_edits(docs, edits).collect()), key=str)
    assert found == sorted(((i, tokens(t or ""), tokens("so " + (t or ""))) for i, t in rows), key=str)
    assert op10_rows(spark, docs) == len(rows)


def op10_rows(spark, docs):
    return count_after_edits(docs, hashed_edits()).count()


def test_blocks_stay_small_after_a_large_insertion():
    rng = random.Random(8)
    encode = lambda pieces: [len(p) for p in pieces]
    tree, text = TokenTree("", np.zeros(0, np.int64), np.zeros(0, np.int64), encode), ""
    edits = [(0, 0, "word and more " * 5_000), (30_000, 2, "x y " * 3_000)]
    edits += [(rng.randint(0, 60_000), rng.choice([0, 3, 9_000]), "z " * rng.randint(0, 300)) for _ in range(60)]
    for start, removed, added in edits:
        tree.edit(start, removed, added)
        start = min(start, len(text))
        text = text[:start] + added + text[start + removed :]
        assert max(len(tree.block(b)[0]) for b in range(len(tree.blocks))) <= MOST
    assert tree.text_now() == text and tree.total == tree.chars[1] == len(text)
    for at in range(0, len(text), 997):
        b, before = tree.find(at)
        assert before <= at < before + tree.chars[tree.size + b]
