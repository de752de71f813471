from tessera import catalog


def test_every_line_is_read(spark, tmp_path):
    text = "x" * 60 + "\n\ta|b\n | c;d\ndir/k.wav  the rest \n"
    spark.createDataFrame([(1, text, "en"), (2, "", "de"), (3, None, "es")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.value, r.delimiter) for r in catalog.QUERIES["line_fields_and_delimiters"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): ("x" * 60, "none"), (1, 2): ("\ta", "tab"), (1, 3): ("en", "pipe"), (1, 4): ("dir/k.wav  the rest", "space"), (1, 5): ("en", "none"), (2, 1): ("de", "none")}
    lines = {(r.doc_id, r.line_no): (r.key, r.rest) for r in catalog.QUERIES["document_label_lines"](spark, str(tmp_path)).collect()}
    assert lines[1, 4] == ("k", "the rest") and lines[1, 2] == ("", "") and len(lines) == 6
