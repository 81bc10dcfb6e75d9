"""Small telemetry tables built by hand."""

from __future__ import annotations

import numpy as np
import pandas as pd

from sparkwatch.schema import TELEMETRY

START = pd.Timestamp("2026-01-01T00:00:00Z")


def times(n, step=60):
    return pd.date_range(START, periods=n, freq=f"{step}s")


def long_rows(series, step=60):
    """{(service, metric): values with NaN for missing} to long rows."""
    parts = []
    for (service, metric), values in series.items():
        parts.append(
            pd.DataFrame(
                {"timestamp": times(len(values), step), "service": service, "metric": metric, "value": np.asarray(values, dtype=float)}
            )
        )
    return pd.concat(parts, ignore_index=True)


def telemetry(spark, series, step=60):
    from sparkwatch.schema import as_telemetry

    rows = long_rows(series, step)
    tuples = [(t.to_pydatetime(), s, m, float(v)) for t, s, m, v in rows.itertuples(index=False)]
    return as_telemetry(spark.createDataFrame(tuples, TELEMETRY))


def sparse_grid(spark, series, step=60):
    from sparkwatch.operators.grid import cells, indexed

    return indexed(cells(telemetry(spark, series, step)))


def column(df, name, service="a", metric="m"):
    """One series of a result, by time."""
    rows = df.where((df.service == service) & (df.metric == metric)).orderBy("timestamp").select(name).collect()
    return [r[0] for r in rows]


def same(got, want, tolerance=1e-9):
    want = [None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in want]
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        if g is None or w is None:
            assert g is None and w is None, (i, g, w)
        else:
            assert abs(g - w) <= tolerance * max(1.0, abs(w)), (i, g, w)


def gappy(n, seed=0, missing=0.2, level=50.0):
    rng = np.random.default_rng(seed)
    values = rng.normal(level, 3.0, n)
    values[rng.random(n) < missing] = np.nan
    return values
