import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.audio import envelope, peak_db, rms_db, spectrum
from tessera.operators import retrieval, thresholds


def test_margins_evidence_and_format(spark):
    df = spark.createDataFrame([([(0.9, "a"), (0.7, "b"), (0.1, "c")], [(0.8, "a", 0.9, 0.5), (0.6, "b", 0.7, 0.9)])], "r array<struct<score: double, label: string>>, f array<struct<fused: double, label: string, first: double, second: double>>")
    r = df.select(retrieval.margins_to_others(F.col("r")).alias("m"), retrieval.candidate_evidence(F.col("f"), F.lit(0.4), F.lit(0.0)).alias("e"), retrieval.formatted_candidates(F.col("f"), 2).alias("t")).first()
    assert [round(m.margin, 6) for m in r.m] == [0.2, -0.2, -0.8]
    assert np.allclose(r.e[1].features, [0.6, 0.7, 0.9, -0.2, -0.2, 0.4, 0.0])
    assert r.t == "a=0.80; b=0.60"


def test_cluster_members_keep_the_first_label(spark):
    clusters = spark.createDataFrame([(1, "x", ["s1", "s2"]), (2, "y", ["s2", "s3"])], "at int, label string, members array<string>")
    segments = spark.createDataFrame([("s1", 1), ("s2", 2), ("s4", 4)], "segment string, size int")
    got = retrieval.cluster_members(clusters, segments, "label", "segment", "at")
    assert {(r.segment, r.label, r["size"]) for r in got.collect()} == {("s1", "x", 1), ("s2", "x", 2)}


def test_frame_parity(spark):
    rows = [(1, [[1.0, 0.0], [0.0, 2.0]], [[1.0, 0.0], [2.0, 0.0]]), (2, [[1.0]], [[1.0], [2.0]])]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {r.k: r for r in retrieval.frame_parity(df, "k", "a", "b").collect()}
    assert (got[1].mean_cosine, got[1].min_cosine, got[1].max_abs) == (0.5, 0.0, 2.0)
    assert math.isnan(got[2].mean_cosine) and got[2].max_abs == math.inf


def test_gated_threshold_equals_enumeration(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s), int(t) if t < 3 else None, int(p)) for s, t, p in zip(rng.integers(0, 15, 300) / 15, rng.integers(0, 4, 300), rng.integers(0, 3, 300), strict=True)]
    rows += [(0.9, c, c) for c in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "score double, t int, p int")
    for limits in ({"correct_accept": 0.3, "unknown_reject": 0.2}, {"correct_accept": 0.99, "unknown_reject": 0.99}):
        got = thresholds.gated_threshold(df, "score", "t", "p", [0, 1, 2], limits).first()
        best = None
        for t in [*{round(r[0], 6) for r in rows}, math.inf, -math.inf]:
            known, acc = [r for r in rows if r[1] is not None], lambda r: round(r[0], 6) >= t  # noqa: B023
            ca = sum(acc(r) and r[1] == r[2] for r in known) / len(known)
            unknown = [r for r in rows if r[1] is None]
            ur = 1 - sum(map(acc, unknown)) / len(unknown)
            f1 = sum(2 * sum(acc(r) and r[1] == r[2] == c for r in known) / max(sum(acc(r) and r[2] == c for r in known) + sum(r[1] == c for r in known), 1) for c in range(3)) / 3
            ok = ca >= limits["correct_accept"] and ur >= limits["unknown_reject"]
            miss = sum(max(0, v - x) / v for v, x in ((limits["correct_accept"], ca), (limits["unknown_reject"], ur)))
            best = max(best or (False, -9), (ok, f1 if ok else -miss, ca, t))
        assert (got.passed, got.threshold) == (best[0], best[3])


def test_exact_2d_equals_enumeration_without_gathering_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("the pool was gathered"))
    for seed, limit in ((0, 0.85), (1, 0.5), (2, 1.0), (3, 0.0)):
        rows = [(bool(k), bool(k and r), float(s / 20), float(m / 10)) for k, r, s, m in zip(rng.integers(0, 3, 250) > seed % 2, rng.integers(0, 2, 250), rng.integers(0, 21, 250), rng.integers(0, 8, 250), strict=True)]
        rows += [(True, True, 0.99, None), (False, False, 0.31, None)]
        known, unknown = sum(r[0] for r in rows), sum(not r[0] for r in rows)
        best = None
        for s in {r[2] for r in rows}:
            for m in {*(r[3] for r in rows if r[3] is not None), math.inf, -math.inf}:
                acc = [r for r in rows if r[2] >= s and r[3] is not None and r[3] >= m]
                far = sum(not r[0] for r in acc) / unknown
                if 1 - far >= limit - 1e-12:
                    key = (sum(r[1] for r in acc) / known, -sum(r[0] and not r[1] for r in acc) / known, -far, s, m)
                    best = max(best or key, key)
        df = spark.createDataFrame(rows, "known boolean, right boolean, score double, margin double").repartition(5)
        for cells in (1, 40, 10_000):
            got = thresholds.exact_2d(df, limit, range_cells=cells).first()
            assert tuple(got) == pytest.approx((best[0], -best[1], 1 + best[2], best[3], best[4])), (seed, cells)


def plain_best(cells, most):
    best = None
    for s in {c[0] for c in cells if c[0] is not None}:
        for m in {*(c[1] for c in cells if not math.isnan(c[1])), math.inf}:
            at = [c for c in cells if (c[0] is None or c[0] >= s) and c[1] >= m]
            r, w, u = (sum(c[i] for c in at) for i in (2, 3, 4))
            if u <= most:
                best = max(best or (r, -w, -u, s, m), (r, -w, -u, s, m))
    return best and (best[0], -best[1], -best[2], best[3], best[4])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 0.1, 0.2, 0.3, 0.4]), st.sampled_from([math.nan, -1.0, 0.0, 0.5, 2.0]), *[st.integers(0, 2)] * 3), max_size=25), st.integers(-1, 12))
def test_best_of_a_range_with_carried_counts_and_ties(cells, most):
    cells = [c for c in cells if c[0] is not None or not math.isnan(c[1])]
    columns = [np.array([math.nan if c[i] is None else c[i] for c in cells], dtype=np.float64 if i < 2 else np.int64) for i in range(5)]
    assert thresholds.best_of_range(*columns, most) == (plain_best(cells, most) if most >= 0 else None)


def test_exact_2d_without_candidates(spark):
    kind = "known boolean, right boolean, score double, margin double"
    for rows, limit in (([], 0.5), ([(True, True, None, 0.5)], 0.5), ([(True, True, 0.5, 0.5)], 1.5)):
        assert thresholds.exact_2d(spark.createDataFrame(rows, kind), limit).collect() == []
    only = thresholds.exact_2d(spark.createDataFrame([(True, True, 0.5, None), (False, False, 0.25, None)], kind)).first()
    assert tuple(only) == (0.0, 0.0, 1.0, 0.5, math.inf)


def test_signal_functions(spark):
    x = [math.sin(2 * math.pi * 8 * i / 256) for i in range(512)]
    df = spark.createDataFrame([(x,), ([0.5],)], "s array<double>")
    r = df.select(peak_db(F.col("s")).alias("p"), rms_db(F.col("s")).alias("r"), envelope(F.col("s"), 4).alias("e"), spectrum()("s").alias("f")).collect()
    assert r[0].p == pytest.approx(0, abs=1e-6) and r[0].r == pytest.approx(-3.0103, abs=1e-3)
    assert all(e == pytest.approx(1, abs=1e-3) for e in r[0].e)
    assert int(np.argmax(r[0].f[0])) == 8 and len(r[0].f) == 3
    assert next_row(spark) == np.nextafter(1.0, 2.0)


def next_row(spark):
    return spark.range(1).select(thresholds.next_after(F.lit(1.0), F.lit(2.0)).alias("x")).first().x
