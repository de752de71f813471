from tessera import catalog
from tessera.operators import inventory

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_passages_are_found_anywhere(spark, tmp_path):
    words = ITEM.split()
    docs = [(1, f"A start. Then {ITEM.upper()}, and an end."), (2, "A. " + ", ".join(words[1:14])), (3, "A start. " + " ".join(words[:12])), (4, " "), (5, f"x. {ITEM}"), (6, None), (7, "b Short, item c"), (8, "short x item")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM + "."), (2, "Short item"), (3, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sealed = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    held = inventory.holding_phrases(spark.read.parquet(f"{tmp_path}/documents.parquet"), sealed, "doc_id", "text")
    assert sorted(r.doc_id for r in held.collect()) == [1, 2, 5, 7]
    assert {r.reason: r.n for r in catalog.QUERIES["exposure_phrase_reasons"](spark, str(tmp_path)).collect()} == {"empty": 1, "toxic": 1, "benchmark": 3, "kept": 3}
    assert inventory.holding_phrases(sealed, sealed.limit(0), "item_id", "text").count() == 0
