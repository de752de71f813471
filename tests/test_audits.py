import json

import numpy as np
import pytest

from pyspark.sql import functions as F
from tessera.functions.text import first_present_or_meta, flattened_keys
from tessera.operators import heads, inventory, selection, thresholds, views
from tessera.sources import manifests, trees


def test_unique_task_rows_and_temporal_index(spark, tmp_path):
    rows = [{"utt_id": "d:a", "label": "x", "split": "train"}, {"utt_id": "d:b", "label": "x", "split": "dev"}]
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)))
    assert manifests.read_unique_task_rows(spark, str(p)).count() == 2
    p.write_text("\n".join(map(json.dumps, [*rows, rows[0]])))
    with pytest.raises(AssertionError, match="duplicate"):
        manifests.read_unique_task_rows(spark, str(p))
    folder = tmp_path / "f" / "temporal"
    folder.mkdir(parents=True)
    (folder / "index.jsonl").write_text('{"utt_id": "a", "cache_relpath": "x/a.npy", "frames": 3}\n\n')
    got = manifests.read_temporal_index(spark, str(tmp_path / "f")).first()
    assert got.path == f"{folder}/x/a.npy" and got.frames == 3
    (folder / "index.jsonl").write_text('{"utt_id": "a"}\n{"utt_id": "a"}')
    with pytest.raises(AssertionError, match="duplicate"):
        manifests.read_temporal_index(spark, str(tmp_path / "f"))


SWEEP = """# layers to try
backbones:
  - kind: wav2vec2   # the small one
    base_config: configs/a.yaml
    hidden_layers: [8, 12]

  - kind: wavlm
    base_config: "configs/b.yaml"
    hidden_layers:
      - 15
      - 22
"""


def test_sweep_files(spark, tmp_path):
    (tmp_path / "sweep.yaml").write_text(SWEEP)
    want = [("wav2vec2", "configs/a.yaml", 8), ("wav2vec2", "configs/a.yaml", 12), ("wavlm", "configs/b.yaml", 15), ("wavlm", "configs/b.yaml", 22)]
    assert [tuple(r) for r in manifests.read_sweep(spark, str(tmp_path / "sweep.yaml")).collect()] == want
    assert [tuple(r) for r in manifests.expand_sweep(spark, json.dumps(manifests.sweep_of_text(SWEEP))).collect()] == want
    for text in ("", "backbones: x", "backbones:\n  {a}", "kind: a\n- b", "backbones:\n    kind: wavlm"):
        with pytest.raises(ValueError):
            manifests.expand_sweep(spark, text)


def test_audio_sources(spark):
    files = spark.createDataFrame([("/d/train/a.wav", "train/a.wav", ["train", "a.wav"], "a"), ("/d/dev/b.wav", "dev/b.wav", ["dev", "b.wav"], "b"), ("/d/train/x/b.wav", "train/x/b.wav", ["train", "x", "b.wav"], "b")], "path string, relpath string, parts array<string>, stem string")
    cases = [
        ("q:z", "train/a.wav", "train", "explicit_path", "/d/train/a.wav", None),
        ("q:dev/b.wav", None, "dev", "qualified_id", "/d/dev/b.wav", None),
        ("q:dev/b.wav", " ", "train", "qualified_id", None, "split_mismatch"),
        ("a", None, "train", "catalog", "/d/train/a.wav", None),
        ("b", None, "train", "catalog", None, "ambiguous_stem"),
        ("c", None, "train", "catalog", None, "unresolved"),
        (None, None, "train", None, None, "no_audio_field"),
        ("q:no", "train/none.wav", None, "explicit_path", None, "unresolved"),
        ("a", None, None, "catalog", None, "split_mismatch"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, utt_id string, audio_relpath string, split string")
    got = {r.i: (r.resolution, r.audio, r.problem) for r in trees.audio_sources(rows, files).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}
    assert trees.unresolved_audio(rows, files).count() == 6
    with pytest.raises(Exception, match="split_mismatch"):
        trees.checked_audio(rows.where("i = 2"), files).collect()
    assert trees.checked_audio(rows.where("i < 2"), files).count() == 2
    assert trees.audio_sources(rows.limit(0), files).count() == 0


def test_nested_fields_and_keys(spark):
    df = spark.createDataFrame([(" ", {"text": "m"}), ("own", {"text": "m"}), (None, {"other": "x"}), (None, None)], "transcript string, source_meta map<string,string>")
    assert [r[0] for r in df.select(first_present_or_meta(["transcript"], "source_meta", ("transcript", "text"))).collect()] == ["m", "own", None, None]
    text = spark.createDataFrame([('{"a": {"b": [{"c": 1}, {"d.e": 2}]}, "f": null}',), ("no",), (None,), ("[]",), ("",)], "t string")
    assert [r[0] for r in text.select(flattened_keys("t")).collect()] == [["a", "a.b", "a.b.c", "a.b.d.e", "f"], [], [], [], []]


def test_failures(spark):
    df = spark.createDataFrame([(1, True, "ACCEPT", "a", "a"), (2, True, "ACCEPT", "b", "a"), (3, True, "CONFIRM", "a", "a"), (4, True, "REJECT", None, "a"), (5, False, "ACCEPT", "a", None), (6, False, "CONFIRM", "a", None), (7, False, "REJECT", None, None), (8, True, None, "a", "a"), (9, True, "ACCEPT", None, "a")], "i int, known boolean, status string, pred string, true string")
    got = views.failure_rows(df, *[F.col(c) for c in ("known", "status", "pred", "true")]).collect()
    assert {(r.i, r.failure, r.ranking_correct) for r in got} == {(2, "KNOWN_WRONG_ACCEPT", False), (3, "KNOWN_CONFIRM", True), (4, "KNOWN_REJECT", False), (5, "UNKNOWN_FALSE_ACCEPT", False), (8, "KNOWN_OTHER", True), (9, "KNOWN_OTHER", False)}


def test_coverage_and_readiness(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert sorted(r.v for r in inventory.covered(ids("a", "b", "a", None), rows, "k").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="no row for z"):
        inventory.covered(ids("a", "z"), rows, "k").collect()
    with pytest.raises(Exception, match="several rows for b"):
        inventory.covered(ids("b"), rows, "k", unique=True).collect()
    each = [("s", l, i) for l, n in (("x", 3), ("y", 2), ("z", 1)) for i in range(n)] + [("t", "x", i) for i in range(9)] + [(None, "x", 0)]
    got = {r.shot: tuple(r)[1:] for r in inventory.shot_readiness(spark.createDataFrame(each, "s string, l string, i int"), "s", "l", [0, 1, 5], 3).collect()}
    assert got == {0: (1, 1, 3, 6, 0.5), 1: (1, 0, 2, 6, pytest.approx(1 / 3)), 5: (0, 0, 0, 6, 0.0)}


def test_pareto_cells(spark):
    cells = spark.createDataFrame([("a", 0.9, 0.2), ("b", 0.6, 0.6), ("c", 0.6, 0.8), ("d", 0.1, 0.9)], "k string, g double, r double")
    got = {x.kind: x.k for x in selection.pareto_cells(cells, ["k"], "g", "r", 0.5, 0.5).collect()}
    assert got == {"best_gain": "c", "best_guard": "c", "nearest": "c"}
    got = {x.kind: x.k for x in selection.pareto_cells(cells, ["k"], "g", "r", 0.95, 0.7).collect()}
    assert got == {"best_guard": "a", "nearest": "c"}
    assert selection.pareto_cells(cells.limit(0), ["k"], "g", "r", 0.5, 0.5).count() == 0


def test_held_out_thresholds_equal_enumeration(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(s) / 10, bool(k), bool(k and r)) for g, s, k, r in zip(rng.integers(0, 4, 200), rng.integers(0, 12, 200), rng.integers(0, 3, 200), rng.integers(0, 2, 200), strict=True)]
    df = spark.createDataFrame(rows, "g int, score double, known boolean, ok boolean")
    got = {r.g: tuple(r)[1:] for r in thresholds.held_out_thresholds(df, "g", "score", F.col("known"), F.col("ok"), 0.3).collect()}

    def rates(part, t):
        known, other = [r for r in part if r[2]], [r for r in part if not r[2]]
        share = lambda hit, base: sum(hit(r) for r in base) / len(base) if base else 0.0
        return share(lambda r: r[3] and r[1] >= t, known), share(lambda r: not r[3] and r[1] >= t, known), share(lambda r: r[1] >= t, other)

    for g in range(4):
        others, own = [r for r in rows if r[0] != g], [r for r in rows if r[0] == g]
        keys = [(ca, -wi, -fa, t) for t in {*(r[1] for r in others), float("inf"), float("-inf")} for ca, wi, fa in [rates(others, t)] if fa <= 0.3]
        ca, wi, fa, t = max(keys)
        assert got[g] == pytest.approx((t, ca, -wi, -fa, *rates(own, t))), g


def test_ranker_prefers_the_right_candidate(spark):
    rng = np.random.default_rng(1)
    rows = [(q, c, int(c == q % 5), [float((c == q % 5) + rng.normal(0, 0.2)), float(rng.normal())]) for q in range(60) for c in range(5)]
    df = spark.createDataFrame(rows, "q int, c int, right int, x array<double>")
    weights = {r.right: r.weight for r in heads.with_positive_weight(df, "right").select("right", "weight").distinct().collect()}
    assert weights == {0: 1.0, 1: 4.0}
    best = heads.best_candidates(heads.fit_ranker(df, "x", "right"), df, "q", "c", "x").collect()
    assert len(best) == 60 and sum(r.c == r.q % 5 for r in best) >= 57
