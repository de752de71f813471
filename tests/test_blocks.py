from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import inventory, nearest, retrieval, sampling, selection, sequences, views


def clustered(rng, n, centers=12, dims=6, spread=0.05):
    around = rng.normal(size=(centers, dims))
    return around[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dims))


def test_best_classes_equal_a_full_ranking_and_skip_far_groups(spark):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 300)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    protos = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "label int, prototype array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([vectors[:20], rng.normal(size=(10, 6))]))], "id int, v array<double>")
    whole = {r.id: [(c.label, round(c.score, 9)) for c in r.ranked[:5]] for r in retrieval.scored(queries, protos, "label", "v").select("id", "ranked").collect()}
    for block, query_block in ((10, 7), (25, 1000), (1000, 1000)):
        found = nearest.top_classes(queries, protos, "id", "label", "v", 5, block, query_block).collect()
        assert {r.id: [(c.label, round(c.score, 9)) for c in r.ranked] for r in found} == whole
        share = sum(r.classes_scored for r in found) / (30 * 300)
        assert share == 1 if block == 1000 else share < 0.6


def test_best_classes_with_ties_few_classes_and_vectors_of_other_lengths(spark):
    protos = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "name string, prototype array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [0.0, None]), (1, [3.0, 0.0])], "id int, v array<float>")
    for block in (1, 2, 50):
        found = {r.id: [(c.label, c.score) for c in r.ranked] for r in nearest.top_classes(queries, protos, "id", "name", "v", 5, block).collect()}
        assert found == {1: [("a", 1.0), ("b", 1.0), ("c", 0.0)], 4: [("a", 0.0), ("b", 0.0), ("c", 0.0)]}
    none = nearest.top_classes(queries, protos.limit(0), "id", "name", "v", 2)
    assert none.columns == ["id", "ranked", "classes_scored"] and none.collect() == []
    assert nearest.top_classes(queries.limit(0), protos, "id", "name", "v", 2).collect() == []


def test_best_classes_of_many_slabs_with_repeated_classes(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-3, 4, size=(500, 3)).astype(float)  # nothing to skip, many ties
    vectors[(vectors == 0).all(axis=1)] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    protos = spark.createDataFrame(rows * 3, "label int, prototype array<double>").repartition(5)
    queries = spark.createDataFrame(rows[:60] + [(900, rng.normal(size=3).tolist())], "id int, v array<double>")
    unit = {i: np.array(v) / np.sqrt(np.dot(v, v)) for i, v in rows}
    want = {q.id: sorted(np.round([unit[i] @ (np.array(q.v) / np.linalg.norm(q.v)) for i in unit], 9), reverse=True)[:4] for q in queries.collect()}
    ranked = []
    for sizes in ((1, 7, 20), (40, 1000, 100), (1000, 1000, 100_000)):
        found = nearest.top_classes(queries, protos, "id", "label", "v", 4, *sizes).collect()
        assert {r.id: [round(c.score, 9) for c in r.ranked] for r in found} == want
        assert all(len({c.label for c in r.ranked}) == 4 and r.classes_scored <= 500 for r in found)
        ranked.append({r.id: r.ranked for r in found})
    assert ranked[0] == ranked[1] == ranked[2]


def test_a_query_goes_to_a_slab_once_however_many_groups_may_hold_its_best(spark):
    unit = np.random.default_rng(1).normal(size=(3000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cells = nearest.Cells(unit[:600], np.full(600, np.pi), np.full(600, 50.0), np.arange(600) // 200)
    batch = pa.RecordBatch.from_pydict({"key": list(range(3000)), "unit": unit.tolist(), "part": [0] * 3000, "floor": [0.5] * 3000, "met": [[1]] * 3000})
    sent = list(nearest._other_slabs(SimpleNamespace(value=cells))([batch]))
    assert sum(b.num_rows for b in sent) == 6000 and max(b.num_rows for b in sent) <= 2 * nearest.ROWS
    assert {s for b in sent for s in b.column("slab").to_pylist()} == {0, 2}


def test_mean_cosine_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    units = [v / np.linalg.norm(v) for v in rng.normal(size=(9, 4))]
    protos = spark.createDataFrame([(v.tolist(),) for v in units], "prototype array<double>")
    want = np.mean([units[i] @ units[j] for i in range(9) for j in range(i)])
    assert abs(retrieval.mean_pair_cosine(protos).first()[0] - want) < 1e-12


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=500).round(2), "b": rng.integers(0, 3, 400).astype(float), "c": np.array([7.0]), None: rng.normal(size=30)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q, r.m) for r in inventory.quantiles(df, "g", "x", {"q": 0.05, "m": 0.5}, slices=8).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, [0.05, 0.5]))
    summary = {r.g: r for r in inventory.group_summary(df, "g", "x").collect()}
    assert summary["d"].n == 0 and summary["d"].median is None and summary["c"].p95 == 7.0


def test_half_of_a_label_calibrates(spark):
    df = spark.createDataFrame([(lab, i) for lab in ("x", "y", None) for i in range(41)] + [("z", 1)], "label string, item int")
    out = sampling.calibration_split(df, "label", "item", "s")
    assert out.columns == ["label", "item", "part"] and out.count() == df.count()
    got = {r.label: r.n for r in out.groupBy("label").agg(F.count_if(F.col("part") == "cal").alias("n")).collect()}
    assert got["x"] == got["y"] == 20 and got["z"] == 0


def test_numbers_in_ranges_equal_a_sorted_list(spark):
    labels = sorted({f"w{(i * 7919) % 1000}" for i in range(400)} | {"", "é"})
    df = spark.createDataFrame([(x,) for x in labels] + [(None,)], "label string").repartition(5)
    for size in (1, 30, 10_000):
        got = {r.label: r.class_id for r in views.numbered(df, size).collect()}
        assert got == {x: i for i, x in enumerate(labels)}
    assert views.numbered(df.limit(0)).collect() == []


def test_states_of_parts_add_up(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("a", 2, 40_000), ("b", 1, -3), ("b", 1, 0), ("b", 2, None), ("a", 1, 2**40)]
    df = spark.createDataFrame(rows, "k string, day int, id long")
    per_day = inventory.distinct_state(df, ["k", "day"], "id")
    assert {(r.k, r.day): r.n_distinct for r in inventory.distinct_of_state(per_day, ["k", "day"]).collect()} == {("a", 1): 2, ("a", 2): 2, ("b", 1): 2}
    assert {r.k: r.n_distinct for r in inventory.distinct_of_state(inventory.merged_state(per_day, ["k"]), ["k"]).collect()} == {"a": 3, "b": 2}


def test_distinct_speakers_are_counted_without_copies_of_rows(spark):
    rows = spark.createDataFrame([("x", "s1", "train", "control"), ("x", "s1", "eval", "dysarthria"), ("x", None, "eval", "control"), ("y", "s2", "enrollment", "control")], "label string, speaker_id string, role string, domain string")
    out = inventory.label_stats(rows)
    assert {r.label: (r.n, r.speakers, r.n_eval, r.enrollment_speakers, r.eval_speakers) for r in out.collect()} == {"x": (3, 1, 2, 0, 1), "y": (1, 1, 0, 1, 0)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_blocks_are_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, rng.normal(size=(n, 2)).tolist()) for g, many in (("u", 23), ("v", 1), ("w", 6)) for i, n in enumerate(rng.integers(2, 5, many))]
    df = spark.createDataFrame(rows + [("u", 90, None), ("w", None, [[1.0, 0.0]]), (None, 1, [[1.0, 0.0]]), ("w", 2, [[0.0, 1.0]])], "g string, i int, f array<array<double>>").repartition(3)
    want = {(g, a, b): sequences.aligned_distances(np.array([x]), np.array([y]))[0] for g, a, x in rows for h, b, y in rows if g == h and a < b}
    for block in (4, 1000):
        found = sequences.pair_distances(df, "g", "i", "f", block).collect()
        assert {(r.g, r.a) for r in found if r.b == 90} == {("u", i) for i in range(23)} and all(r.distance is None for r in found if r.b == 90)
        own = [r for r in found if r.b != 90 and not (r.g == "w" and 2 in (r.a, r.b))]
        assert len(own) == len({(r.g, r.a, r.b) for r in own})
        assert {(r.g, r.a, r.b): round(r.distance, 9) for r in own} == {k: round(v, 9) for k, v in want.items() if not (k[0] == "w" and 2 in k[1:])}
        assert sum(r.g == "w" and 2 in (r.a, r.b) for r in found) == 2 * 5


def test_batches_of_like_length_go_across_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 40, 500))] + [(900, None)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(6)
    order = sorted((n, k) for k, n in rows if n is not None)
    want = {k: i // 7 for i, (_, k) in enumerate(order)} | {900: None}
    for size in (1, 60, 10_000):
        assert {r.k: r.batch for r in selection.length_batches(df, "n", "k", 7, size).collect()} == want
