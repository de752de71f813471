"""Lloyd clustering against a plain loop in Python integers."""

import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tessera.llm.lloyd import lloyd_clusters
from tests.llm.fixtures import with_clashes

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def assign():
        out = []
        for i, v in kept:
            squares = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, squares.index(min(squares)), min(squares), v))
        return out

    for _ in range(rounds):
        label = assign()
        for c in range(len(centroids)):
            mine = [v for _, at, _, v in label if at == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = [sum(d for _, at, d, _ in last if at == c) for c in range(len(centroids))]
    return sorted(((i, c, d, per[c], sum(per), digest[c]) for i, c, d, _ in last), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def awkward():
    rows = [(i, [float((i * 7 + d * 3) % 11) / 4 - 1, float((i * i + d) % 5) / 2 - 1, ((-1) ** i) / 3]) for i in range(60) for d in (0, 1)]
    rows += [(3, [0.5, 0.5, 0.5])] * 40 + [(None, [0.1, 0.2, 0.3]), (None, [9.0, -9.0, 0.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 0.0, 0.0]), (906, [-0.0001, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize(("k", "rounds", "parts"), [(4, 3, 1), (4, 10, 7), (1, 2, 3), (500, 2, 2)])
def test_equals_plain_loop(spark, k, rounds, parts):
    rows = awkward()
    df = with_clashes(spark.createDataFrame(rows, ROWS).repartition(parts), "cluster", "distance", "vector")
    assert got(lloyd_clusters(df, k=k, rounds=rounds, dimensions=3, scale=16)) == plain(rows, k, rounds, 3, 16)


def test_ties_take_the_lower_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0]) for i in range(10)] + [(20, [8.0])]
    found = got(lloyd_clusters(spark.createDataFrame(rows, ROWS), k=5, rounds=3, dimensions=1, scale=1))
    assert found == plain(rows, 5, 3, 1, 1)
    assert len({c for _, c, *_ in found}) <= 2


def test_empty_table_and_table_without_valid_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out = lloyd_clusters(spark.createDataFrame(rows, ROWS), dimensions=3)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert out.collect() == []


def test_refuses_components_beyond_the_range(spark):
    with pytest.raises(PySparkException, match="after scaling"):
        lloyd_clusters(spark.createDataFrame([(1, [3e30])], ROWS), dimensions=1).collect()
