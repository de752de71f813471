import random
import zlib

import numpy as np

from tests.llm.fixtures import documents, with_clashes
from tessera.llm.packing import best_fit_decreasing, pack_documents
from tessera.llm.pretokens import default_tokenizer_path, encode_rows, load_tokenizer
from tessera.llm.textbytes import text_buffers

import pyarrow as pa

ALPHABET = list("ab s'tlreved  \n\t é²9#.!'日")


def ids_of(text):
    return load_tokenizer(default_tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    texts = ["", None, "it's we'll 'sabc ''s x's\n's  's I'LL we're'd \t\n  \n\nword   ", "   ", "\n\n a", "<|endoftext|> hi", "日本 語 text 's", "½ ²3 x²", " x   y z"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, at = encode_rows(data, offsets, default_tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(t), t


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    where, offset = best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for n, w, o in zip(lengths, where, offset, strict=True):
        fits = [r for r in room if r >= n]
        if w == len(room):
            assert not fits
            room.append(100)
        else:
            assert room[w] == min(fits)
        assert o == 100 - room[w]
        room[w] -= n


def test_pieces_make_up_every_document(spark):
    docs = with_clashes(documents(spark), "start", "length", "shard", "ids")
    rows = pack_documents(docs, shard_docs=10, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == ids_of(texts[i])
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        for r in parts:
            assert r.doc_tokens == len(ids_of(texts[i])) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for parts in by_window.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_table(spark):
    assert pack_documents(documents(spark, [])).count() == 0


def test_code_points_of_other_planes_keep_their_own_ids():
    texts = ["x \U00020061 \U000100e9", "x a é", " a", "\U00010061", "a"]
    ids, at = encode_rows(*text_buffers(pa.array(texts, pa.string())), default_tokenizer_path())
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(t)


def test_a_long_document_and_rows_without_an_id_have_many_shards(spark):
    from pyspark.sql import functions as F

    texts = ["na " * 300_000, *(f"text {i}" for i in range(200))]
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") == 0, 0))
    rows = pack_documents(docs, shard_docs=10).collect()
    shards = lambda some: {r.sequence_id >> 32 for r in some}
    assert len(shards(r for r in rows if r.doc_id == 0)) > 5
    assert len(shards(r for r in rows if r.doc_id is None)) > 15
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for t in texts)


def test_rows_alike_in_id_and_text_have_many_shards(spark):
    docs = spark.createDataFrame([(7, "the same words again and again")] * 3000 + [(1, "other"), (None, None), (None, None)], "doc_id long, text string").repartition(3)
    rows = pack_documents(docs, shard_docs=100).collect()
    assert len(rows) == 3003
    many = {}
    for r in rows:
        many[r.sequence_id >> 32] = many.get(r.sequence_id >> 32, 0) + 1
    assert len(many) > 20 and max(many.values()) < 400
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048
