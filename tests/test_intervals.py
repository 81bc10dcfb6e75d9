import random

import pytest
from pyspark.sql import functions as F

from sparkwatch.operators.intervals import settle


@pytest.mark.parametrize("spread", [30, 10**15])
def test_pieces_against_every_point(spark, spread):
    r = random.Random(spread)
    rows = []
    for name, count in (("a", 120), ("b", 1), ("c", 9)):
        for n in range(count):
            low = r.randrange(spread)
            high = low + r.choice([0, 1, 5, spread, -3, r.randrange(1, spread)])
            rows.append((name, low, high, n, r.choice([0.5, 2.0, 4.0])))
    df = spark.createDataFrame(rows, "k string, x long, y long, n int, f double").repartition(5)
    found = settle(df, ["k"], "x", "y", {"n": F.min, "f": F.product}).collect()
    for name in "abc":
        mine = [q for q in rows if q[0] == name and q[1] < q[2]]
        ends = sorted({e for q in mine for e in q[1:3]})
        want = []
        for low, high in zip(ends, ends[1:]):
            over = [q for q in mine if q[1] <= low and high <= q[2]]
            if over:
                factor = 1.0
                for q in over:
                    factor *= q[4]
                want.append((low, high, min(q[3] for q in over), factor))
        assert sorted((q["x"], q["y"], q["n"], q["f"]) for q in found if q["k"] == name) == want


def test_nothing_to_settle(spark):
    df = spark.createDataFrame([("a", 4, 4, 1)], "k string, x long, y long, n int")
    assert settle(df, ["k"], "x", "y", {"n": F.min}).collect() == []
    assert settle(df.limit(0), ["k"], "x", "y", {"n": F.min}).collect() == []
