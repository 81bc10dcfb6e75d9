import math
import random

import numpy as np
import pytest

from sparkwatch.llm import queries, whitening
from sparkwatch.llm.whitening import Spectrum, WhiteningConfig

SCHEMA = "vec_id long, embedding array<float>, whitened string, x int"
TOL = WhiteningConfig().tolerance


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40])
def test_secular_roots(k):
    r = np.random.default_rng(k)
    for power in (0, 3, 8):
        poles, weights = np.sort(r.random(k)) + np.arange(k) * 1e-6, r.random(k) * 10.0 ** -r.integers(0, power + 1, k)
        base, at = whitening.secular_roots(poles, weights)
        root = np.sqrt(weights)
        assert np.allclose(poles[base] + at, np.linalg.eigvalsh(np.diag(poles) + np.outer(root, root)), rtol=1e-12, atol=1e-13)


def scatter(x):
    away = x - x.mean(0)
    return away.T @ away


@pytest.mark.parametrize("kind", ["plain", "repeated", "same", "low rank", "two values", "few"])
def test_incremental_spectrum(kind):
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(300, 24)) * np.linspace(1, 200, 24)) + 100_000
    if kind == "repeated":
        x[100:] = x[5]
    elif kind == "same":
        x[:] = x[0]
    elif kind == "low rank":
        x = np.round(x[:, :3] @ r.integers(0, 3, (3, 24)))
    elif kind == "two values":
        x = np.round(x[:, :1] / 1000) * np.ones(24)
    elif kind == "few":
        x = x[:7]
    want = scatter(x)
    whole = Spectrum.empty(24)
    whole.add(x, TOL)
    parts = []
    for piece in np.array_split(x, 5):
        parts.append(Spectrum.empty(24))
        parts[-1].add(piece, TOL)
    for part in parts[1:]:
        parts[0].unite(part, TOL)
    for s in (whole, parts[0]):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-13)
        assert np.abs(s.basis.T @ s.basis - np.eye(24)).max() < 1e-11
        assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - want).max() <= 1e-10 * max(want.max(), 1)


def brute(vectors, components=8):
    """Exact whole-number covariance, LAPACK's eigenvectors."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    away = n * x - s
    v = (away.T @ away).astype(float) / n**3
    values, vecs = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    white = (away.astype(float) / n) @ vecs[:, order] / np.sqrt(values[order])
    return n, (away * away).sum(1), white, values[order] / np.trace(v)


def check(rows, vectors, size):
    n, deviations, white, explained = brute(vectors)
    assert len(rows) == n * size and {r["n"] for r in rows} == {n}
    got = np.array([[r["whitened"] for r in sorted(rows) if r["component"] == c + 1] for c in range(size)]).T
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert [r["deviation"] for r in sorted(rows) if r["component"] == 1] == list(deviations)
    share = [next(r["explained"] for r in rows if r["component"] == c + 1) for c in range(size)]
    assert np.allclose(share, explained, rtol=1e-10)
    (error,) = {r["identity_error"] for r in rows}
    assert 0 <= error < 1e-8


def test_hostile_table(spark):
    r = random.Random(2)
    good = [[r.gauss(0, 0.1 * (d + 1)) for d in range(12)] for _ in range(700)]
    good[300:500] = [good[3]] * 200
    rows = [(i, v, "clash", 1) for i, v in enumerate(good)]
    bad = [None, [], [None] * 12, [0.5] * 11, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [0.0] * 11 + [None], [1.0] * 13, [1e30] + [0.0] * 11]
    rows += [(10_000 + i, v, None, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    check(whitening.report(df, WhiteningConfig(vectors_per_task=50, together=3)).collect(), good, 8)


def test_missing_and_repeated_ids_are_rows(spark):
    r = random.Random(4)
    rows = [(None if i % 2 else 5, [r.gauss(0, 1) for _ in range(3)], None, None) for i in range(40)]
    out = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 120 and {r["component"] for r in out} == {1, 2, 3}


def test_no_variance_and_no_rows(spark):
    flat = whitening.report(spark.createDataFrame([(i, [0.25, -1.0], None, None) for i in range(9)], SCHEMA)).collect()
    assert len(flat) == 18 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in flat} == {(None, 0.0, 0, 0.0)}
    line = whitening.report(spark.createDataFrame([(i, [i / 4, 1.0], None, None) for i in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert whitening.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.report(spark.createDataFrame([(1, None, None, None), (2, [], None, None)], SCHEMA)).collect() == []


def test_deviation_beyond_a_long_is_null():
    from sparkwatch.llm.whitening import Components

    components = Components(10**9, (0, 0), np.eye(2), np.ones(2), np.ones(2))
    import pyarrow as pa

    work = whitening._deviations(components)
    assert work(pa.array([[1, 1], [10, 0], [2, 0]], pa.list_(pa.int64()))).to_pylist() == [2 * 10**18, None, 4 * 10**18]


def test_whiten_keeps_extra_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "mine", i) for i in range(20)], SCHEMA)
    rows = df.withColumn("v", whitening.whole_numbers(df["embedding"]))
    out = whitening.whiten(rows, "v", whitening.fit(rows, "v"))
    assert out.columns == [*rows.columns, "_whitened"] and out.count() == 20


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check(queries.embedding_whitening(spark, sf).collect(), vectors, 8)
