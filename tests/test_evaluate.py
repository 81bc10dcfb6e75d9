import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import same
from sparkwatch.functions.ladder import LEVELS, covered, monotone, pinball, pit
from sparkwatch.operators import evaluate


def pits_frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "pit double")


def ladder_frame(spark, rows):
    return spark.createDataFrame([(float(a), [float(x) for x in q]) for a, q in rows], "value double, q array<double>")


def test_pinball(spark):
    rows = [(10.0, 8.0), (8.0, 10.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 2.0)]
    df = spark.createDataFrame(rows, "value double, predicted double")
    got = df.agg(evaluate.pinball_loss(0.5).alias("half"), evaluate.pinball_loss(0.9).alias("high")).first()
    assert got["half"] == 1.0
    assert got["high"] == pytest.approx((0.9 * 2 + 0.1 * 2) / 2)
    assert df.limit(0).agg(evaluate.pinball_loss(0.5).alias("x")).first()["x"] is None


def test_coverage_counts_ends_and_skips_missing(spark):
    rows = [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, 1.0, 2.0), (float("nan"), 1.0, 2.0), (1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "a double, lo double, hi double")
    assert df.agg(evaluate.coverage(F.col("a"), F.col("lo"), F.col("hi"))).first()[0] == pytest.approx(2 / 3)


def test_pit_equals_interpolation_with_ties_and_ends(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        q = np.sort(rng.integers(0, 6, 7)).astype(float)
        rows.append((float(rng.choice(np.append(q, rng.uniform(-1, 7)))), q))
    want = [float(np.interp(a, q, LEVELS, left=0.0, right=1.0)) for a, q in rows]
    # shuffled rungs: the ladder is repaired before use
    df = ladder_frame(spark, [(a, rng.permutation(q)) for a, q in rows]).withColumn("n", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("n").select(pit(F.col("value"), F.col("q"))).collect()]
    same(got, want, 1e-12)


def test_pit_needs_a_whole_ladder(spark):
    df = spark.createDataFrame([(1.0, [1.0] * 6 + [None]), (float("nan"), [1.0] * 7), (1.0, None)], "value double, q array<double>")
    assert evaluate.with_pit(df).count() == 0


def test_far_values_pin_to_the_ends(spark):
    df = evaluate.with_pit(ladder_frame(spark, [(1e9, range(7)), (-1e9, range(7))]))
    assert sorted(r["pit"] for r in df.collect()) == [0.0, 1.0]
    assert tuple(df.agg(*evaluate.tail_mass()).first()) == (0.5, 0.5)


def by_hand(values):
    u = np.sort(np.asarray(values))
    n = len(u)
    return max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())


@pytest.mark.parametrize("cells", [1, 7, 65536])
def test_ks(spark, cells):
    rng = np.random.default_rng(2)
    for values in (np.arange(1000) / 1000 + 0.0005, np.append(rng.random(500), [0.0] * 40 + [1.0] * 30), rng.random(300) ** 3):
        got = evaluate.ks_distance(pits_frame(spark, values), cells=cells).first()
        assert got["ks"] == pytest.approx(by_hand(values), abs=1e-12)
    assert got["n"] == 300


def test_ks_of_nothing(spark):
    assert tuple(evaluate.ks_distance(pits_frame(spark, [0.5]).limit(0)).first()) == (None, 0)


@pytest.mark.parametrize("bins", [10, 20])
def test_histogram_edges(spark, bins):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.arange(bins + 1) / bins, [0.15, 0.3, 0.35, 0.55, 0.7], rng.random(200)])
    counts, edges = np.histogram(values, bins=bins, range=(0.0, 1.0))
    rows = evaluate.pit_histogram(pits_frame(spark, values), bins).orderBy("bin").collect()
    assert [r["observed"] for r in rows] == list(counts)
    same([r["from"] for r in rows], list(edges[:-1]), 0)
    same([r["ratio"] for r in rows], list(counts / (len(values) / bins)), 1e-12)
    empty = evaluate.pit_histogram(pits_frame(spark, [0.5]).limit(0), bins).collect()
    assert len(empty) == bins and all(r["ratio"] is None for r in empty)


def test_crossed_quantiles_are_sorted(spark):
    df = spark.createDataFrame([([5.0, 9.0, 1.0],), ([3.0, None, 2.0],)], "q array<double>")
    assert [r[0] for r in df.select(monotone(F.col("q"))).collect()] == [[1.0, 5.0, 9.0], [2.0, 3.0, None]]


def test_uniform_and_wrong_spread(spark):
    rng = np.random.default_rng(5)
    z = np.array([-2.3263, -1.6449, -0.6745, 0.0, 0.6745, 1.6449, 2.3263])
    for scale, low, high in ((1.0, 0.0, 0.04), (0.4, 0.12, 1.0)):
        df = ladder_frame(spark, [(v, z * scale) for v in rng.normal(0, 1, 4000)])
        assert low <= evaluate.ks_distance(evaluate.with_pit(df)).first()["ks"] < high
