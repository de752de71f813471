import random

import corpus_pipeline
from tests.llm.fixtures import documents, with_clashes
from tests.llm.test_classifiers import make
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_neardup import brute as grouped
from tests.llm.test_secrets import base_spans


def test_each_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    langs = ["en", "de", "es"]
    texts = [make(rng, langs[i % 3], 60) for i in range(60)]
    texts += [texts[0], texts[1] + " more", None, "", "123 456"]
    item = make(rng, "en", 20)
    texts += [f"{make(rng, 'en', 20)} {item}", f"{make(rng, 'en', 2000)} {item}", make(rng, "de", 50) + " password=abcdef123 " + make(rng, "de", 50)]
    docs = documents(spark, texts, langs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, before, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before = spark.read.parquet(str(tmp_path / f"stage{k}"))
        got = {r.doc_id: r.text for r in before.collect()}
        ids = sorted(kept)
        if k == 1:
            kept = {ids[g[0]]: kept[ids[g[0]]] for g in grouped([kept[i] for i in ids]) if g[3]}
        if k == 2:
            kept = {ids[c[0]]: kept[ids[c[0]]] for c in contaminated([kept[i] for i in ids], [(1, item)]) if not c[5]}
        if k == 3:
            assert set(got) == set(kept) and not any(base_spans(t) for t in got.values())
        else:
            assert got == kept
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(21)
    langs = ["en", "de", "es"]
    texts = [make(rng, langs[i % 3], 60) for i in range(45)]
    rows = [(None if i % 9 == 0 else i // 2, t, langs[i % 3], "s", len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, None, None, None, None), (7, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words in any document at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # every row is a document: all of them stay but the copies and those without a letter
    assert len(pieces) == 45 and sum(r.doc_id is None for r in pieces) == 5
    wide = with_clashes(docs, "row", "component", "hits", "spans", "slot", "score", "__id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and {r.slot for r in out.collect()} == {"clash"}


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
