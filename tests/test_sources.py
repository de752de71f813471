import hashlib
import io
import json
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import canonical_json_hash, salted_hash, stable_hash, waveform_hash
from tessera.operators.contracts import MANIFEST
from tessera.sources import binary, manifests, trees
from tests.test_contracts import manifest, record


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def wav(path, samples, rate=16_000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def test_manifest_round_trip(spark, tmp_path):
    m = manifest(spark, {"utt_id": "1"}, {"utt_id": "2", "source_meta": {"k": "值"}})
    assert manifests.write_jsonl(m, str(tmp_path / "m")) == 2
    back = manifests.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(back.select(*MANIFEST.names).collect()) == sorted(m.select(*MANIFEST.names).collect())
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "m").glob("part-*"))
    assert list(json.loads(text.splitlines()[0])) == sorted(json.loads(text.splitlines()[0]))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        manifests.write_jsonl(m, str(tmp_path / "m"))


def test_bad_lines_name_their_file(spark, tmp_path):
    p = lines(tmp_path / "m.jsonl", record(), "", "{broken")
    with pytest.raises(Exception, match="m.jsonl"):
        manifests.read_manifest(spark, p).collect()
    assert manifests.read_jsonl(spark, p, MANIFEST, strict=False).where("is_bad").count() == 1


def test_task_rows_and_index(spark, tmp_path):
    p = lines(tmp_path / "t.jsonl", {"utt_id": "mdsc:a", "label": "x", "task_label": " ", "split": "train"}, {"utt_id": "b", "dataset": "gsc", "label": "x", "task_label": "y", "split": "dev"}, {"utt_id": "c", "split": "test"})
    rows = {r.utt_id: (r.dataset, r.label) for r in manifests.read_task_rows(spark, p).collect()}
    assert rows == {"mdsc:a": ("mdsc", "x"), "b": ("gsc", "y")}
    with pytest.raises(ValueError, match="sealed"):
        manifests.read_task_rows(spark, p, splits=("test",))
    i = lines(tmp_path / "i.jsonl", {"dataset": "d", "utt_id": "a", "shard": "s", "start_frame": 1, "end_frame": 3}, {"dataset": "d", "utt_id": "a"})
    with pytest.raises(AssertionError, match="duplicate"):
        manifests.read_cache_index(spark, i)
    i = lines(tmp_path / "i2.jsonl", {"dataset": "d", "utt_id": "a", "shard": "s", "start_frame": 1, "end_frame": 3})
    frames = spark.createDataFrame([("s", k, [float(k)]) for k in range(5)], "shard string, frame_idx long, vec array<double>")
    got = manifests.utterance_frames(frames, manifests.read_cache_index(spark, i)).orderBy("frame").collect()
    assert [(r.frame, r.vec) for r in got] == [(0, [1.0]), (1, [2.0])]


def test_metrics_csv_sweep_report(spark, tmp_path):
    p = lines(tmp_path / "e.jsonl", {"epoch": 1, "dev": {"generic_dev_score": 0.5}})
    assert manifests.read_metrics(spark, p).first().dev.generic_dev_score == 0.5
    with pytest.raises(ValueError, match="sealed"):
        manifests.read_metrics(spark, lines(tmp_path / "s.jsonl", {"epoch": 1, "dev": {"test_score": 1}}))
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    manifests.write_csv_with_mark(df, str(tmp_path / "c"))
    assert (next((tmp_path / "c").glob("part-*"))).read_bytes().startswith(b"\xef\xbb\xbf")
    assert manifests.read_csv(spark, str(tmp_path / "c")).columns == ["x", "y"]
    entry = {"kind": "wavlm", "base_config": "c/w.yaml", "hidden_layers": [1, 2]}
    assert [tuple(r) for r in manifests.expand_sweep(spark, {"backbones": [entry]}).collect()] == [("wavlm", "c/w.yaml", 1), ("wavlm", "c/w.yaml", 2)]
    for change, message in (({"hidden_layers": [1, 1]}, "duplicate"), ({"hidden_layers": []}, "no candidates"), ({"hidden_layers": [True]}, "whole"), ({"hidden_layers": "1"}, "whole"), ({"hidden_layers": [-1]}, "whole"), ({"kind": "other"}, "kind"), ({"base_config": "/abs"}, "relative"), ({"base_config": " "}, "relative")):
        with pytest.raises(ValueError, match=message):
            manifests.expand_sweep(spark, {"backbones": [entry | change]})
    manifests.write_report(spark, str(tmp_path / "r"), df)
    assert json.loads((next((tmp_path / "r").glob("part-*"))).read_text()) == {"x": 1, "y": "a"}
    manifests.append_metrics(df, str(tmp_path / "a"))
    manifests.append_metrics(df, str(tmp_path / "a"))
    assert manifests.read_metric_log(spark, str(tmp_path / "a"), "x int, y string").count() == 2


def test_metric_log_holds_a_batch_once(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.createDataFrame([(1, 0.5), (2, 0.25)], "epoch int, loss double")
    assert [manifests.append_metrics(rows, log, b) for b in (7, 7, "b-8")] == [True, False, True]
    # what a lost driver wrote aside is no batch
    rows.write.json(f"{log}/_aside/9-x")
    assert sorted(r.epoch for r in manifests.read_metric_log(spark, log, rows.schema).collect()) == [1, 1, 2, 2]
    with pytest.raises(ValueError, match="batch"):
        manifests.append_metrics(rows, log, "../up")
    source, seen = str(tmp_path / "in"), str(tmp_path / "seen")
    rows.write.parquet(source)
    for checkpoint in ("c1", "c2"):  # the second query begins anew and sends its batch 0 again
        q = spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(manifests.metric_sink(seen)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert manifests.read_metric_log(spark, seen, rows.schema).count() == 2
    q = manifests.stream_metric_log(spark, log, rows.schema).writeStream.format("memory").queryName("metric_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("metric_rows").count() == 4


def test_stored_frames_are_read_by_folder_and_not_exchanged(spark, tmp_path):
    frames = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("shard"), F.floor(F.col("id") / 3).alias("frame_idx"), F.array(F.col("id").cast("double")).alias("vec"))
    ranges = [("a", "s0", 5, 8), ("b", "s1", 63, 130), ("c", "s2", 40, 40), ("d", "s0", 990, 2000), ("e", "none", 0, 5)]
    index = spark.createDataFrame([(u, s, a, z) for u, s, a, z in ranges], "utt_id string, shard string, start_frame long, end_frame long")
    want = sorted((u, k - a, [float(3 * k + int(s[1:]))]) for u, s, a, z in ranges if s != "none" for k in range(a, min(z, 1000)))
    got = lambda df: sorted((r.utt_id, r.frame, r.vec) for r in df.collect())
    assert got(manifests.utterance_frames(frames, index, 64)) == want
    manifests.store_frames(frames, "frame_store", 64, 8, 4)
    try:
        held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = manifests.stored_frames(spark, "frame_store", index, 64, 8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert got(found) == want
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan and "PartitionFilters: [part" in plan
        assert got(manifests.stored_frames(spark, "frame_store", index.where("utt_id = 'c'"), 64, 8)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("drop table frame_store")


def test_keyword_tree(spark, tmp_path):
    for p in ("yes/s1_nohash_0.wav", "yes/s2_nohash_0.wav", "no/s1_nohash_1.wav", "_background_noise_/hum.wav"):
        wav(tmp_path / "c" / p, [0, 1])
    dev, test = lines(tmp_path / "dev.txt", "yes/s2_nohash_0.wav", ""), lines(tmp_path / "test.txt", "no/s1_nohash_1.wav")
    rows = {r.relpath: (r.label, r.speaker_id, r.split, r.record_type) for r in trees.keyword_corpus(spark, str(tmp_path / "c"), dev, test).collect()}
    assert rows == {"yes/s1_nohash_0.wav": ("yes", "s1", "train", "speech"), "yes/s2_nohash_0.wav": ("yes", "s2", "dev", "speech"), "no/s1_nohash_1.wav": ("no", "s1", "test", "speech"), "_background_noise_/hum.wav": (None, None, "train", "noise")}
    with pytest.raises(AssertionError):
        trees.keyword_corpus(spark, str(tmp_path / "c"), dev, dev)


def test_transcript_tree(spark, tmp_path):
    root = tmp_path / "m"
    lines(root / "Control/train/S1/label.txt", "﻿a.wav  开 灯 ", "b.wav 关灯")
    wav(root / "Control/train/S1/wav/a.wav", [0])
    wav(root / "Control/train/S1/wav/c.wav", [0])
    labels, files = trees.transcripts(spark, str(root)), trees.listing(spark, str(root))
    assert {(r.key, r.transcript) for r in labels.collect()} == {("a", "开 灯"), ("b", "关灯")}
    found = {r.key: r.path for r in trees.resolved_audio(labels, files).collect()}
    assert found["a"].endswith("wav/a.wav") and found["b"] is None
    assert {(r.key, r.state) for r in trees.reconciliation(labels, files).collect()} == {("a", "matched"), ("b", "no_audio"), ("c", "no_label")}
    sem = files.select(*trees.path_semantics(F.col("parts"))).first()
    assert (sem.domain, sem.split, sem.role) == ("control", "train", "train")
    catalog = trees.audio_catalog(files)
    rows = spark.createDataFrame([("mdsc:x/y.wav", None), ("a", None), ("q", "z/q.wav")], "utt_id string, audio_relpath string")
    got = {r.utt_id: r.audio for r in trees.audio_paths(rows, catalog).collect()}
    assert got["mdsc:x/y.wav"] == "x/y.wav" and got["a"].endswith("a.wav") and got["q"] == "z/q.wav"
    lines(root / "Control/train/S2/label.txt", "a 1", "a 2")
    with pytest.raises(AssertionError, match="two label lines"):
        trees.transcripts(spark, str(root))


def test_plausible_manifest(spark, tmp_path):
    a, b, c = (lines(tmp_path / n, *rows) for n, rows in (("a", [{"utt_id": "1", "split": "x"}] * 2), ("b", [{"utt_id": "1", "split": "x"}]), ("c", [{"other": 1}] * 9)))
    assert trees.plausible_manifest(spark, [a, b, c], ("utt_id", "split")) == a
    with pytest.raises(ValueError, match="tie"):
        trees.plausible_manifest(spark, [a, lines(tmp_path / "d", *[{"utt_id": "1", "split": "x"}] * 2)], ("utt_id",))


def test_audio(spark, tmp_path):
    wav(tmp_path / "a.wav", [0, 16384, -16384, 0], channels=2)
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    h = {r.path.rpartition("/")[2]: r for r in binary.audio_headers(spark, str(tmp_path)).collect()}
    assert (h["a.wav"].num_frames, h["a.wav"].num_channels, h["a.wav"].error) == (2, 2, None)
    assert h["bad.wav"].num_frames is None and h["bad.wav"].error
    x = binary.audio_signals(spark, str(tmp_path), "a.wav").first()
    assert x.signal == [0.25, -0.25] and x.sample_rate_hz == 16_000
    headers = binary.audio_headers(spark, str(tmp_path), "a.wav").withColumn("k", F.lit(1))
    m = spark.createDataFrame([(1, 8000, 2, 2)], "k int, sample_rate_hz int, num_channels int, num_frames long")
    assert binary.header_mismatches(headers, m, "k").first().wrong == ["sample_rate_hz"]


def test_archives_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top/a.txt", "abc")
        z.writestr("top/b.txt", "")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("other/c")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    members = binary.archive_members(spark, str(tmp_path))
    assert {(r.member, r.size) for r in members.collect()} == {("top/a.txt", 3), ("top/b.txt", 0), ("other/c", 2)}
    assert [(r.prefix, r.n) for r in binary.top_prefixes(members).collect()] == [("top", 2), ("other", 1)]
    np.savez(tmp_path / "s.npz", ids=np.array(["u1", "u2"]), emb=np.array([[1.0, 2.0], [3.0, 4.0]]))
    arrays = binary.array_archives(spark, str(tmp_path))
    assert {(r.array, r.row, r.text, tuple(r["values"] or ())) for r in arrays.collect()} == {("ids", 0, "u1", ()), ("ids", 1, "u2", ()), ("emb", 0, None, (1.0, 2.0)), ("emb", 1, None, (3.0, 4.0))}
    ids = spark.createDataFrame([("u1",), ("zz",)], "utt_id string")
    assert binary.array_coverage(arrays, ids, "utt_id").first().covered == 1


def test_encodings_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([("a".encode("utf-8-sig"),), ("开灯".encode("gb18030"),), (None,)], "b binary")
    assert [r[0] for r in df.select(binary.decoded("b")).collect()] == ["a", "开灯", None]
    want = hashlib.sha256(b"s\x00x\x00").hexdigest()
    row = spark.range(1).select(stable_hash(F.lit("s"), F.lit("x")).alias("a"), salted_hash("s", F.lit("x")).alias("b"), salted_hash("s", F.lit("x"), separator="\\0").alias("c")).first()
    assert row.a == want and row.b == hashlib.sha256(b"s\x00x").hexdigest() and row.c == hashlib.sha256(b"s\\0x").hexdigest()
    j = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",)], "t string").select(canonical_json_hash("t").alias("h")).collect()
    assert j[0].h == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest() and j[1].h is None
    w = spark.createDataFrame([([0.5, -0.5], 16000)], "x array<float>, r int").select(waveform_hash("x", "r").alias("h")).first()
    assert w.h == hashlib.sha256(b"sr=16000;n=2;" + np.array([0.5, -0.5], dtype="<f4").tobytes()).hexdigest()
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = binary.files(spark, str(tmp_path), "f.bin")
    path = files.first().path
    rows = spark.createDataFrame([(path, hashlib.sha256(b"abc").hexdigest()), (path + "x", "00")], "p string, d string")
    assert [r.p for r in binary.verified(rows, files, "p", "d").collect()] == [path + "x"]
