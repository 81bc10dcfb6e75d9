"""Registered queries against their SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from sparkwatch.operators import forecast
from sparkwatch.plans import forecasting
from sparkwatch.workload import tables

SF = "/root/testdata/sf0.001"
#: Large enough for the rows that a forecaster needs.
FIT = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for schema, folder in (("small", SF), ("fit", FIT)):
        connection.execute(f"CREATE SCHEMA {schema}")
        for name in TABLES.split():
            connection.execute(f"CREATE VIEW {schema}.{name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def test_every_sql_belongs_to_a_query():
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert {n for n in without if not re.match(r"op\d+_|pipeline$", n)} == {"boosted_forecast"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


# every query is compared by the driver; these keep the shared pieces honest in a short run
@pytest.mark.parametrize(
    "name",
    ["request_rate", "grid_resample", "ewma", "k_sigma_alerts", "features_all", "ks_per_series", "pit_histogram", "accuracy_by_metric",
     "run_header", "upstream_hops", "label_incidents", "fault_overlay", "incident_records", "impact_report"],
)
def test_query_agrees_with_sql(spark, duck, name):
    fits = name in ("ks_per_series", "pit_histogram", "accuracy_by_metric")
    found = contract.queries()[name](spark, FIT if fits else SF)
    duck.execute(f"USE {'fit' if fits else 'small'}")
    names = sorted(found.columns)
    cursor = duck.execute(contract.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    want = sorted(repr([row[order.index(n)] for n in names]) for row in cursor.fetchall())
    assert sorted(repr([row[n] for n in names]) for row in found.collect()) == want


def test_too_few_clean_rows_is_an_error_here(spark):
    plan = tables.forecast_plan(spark, SF)
    grid = tables.clean_grid(spark, SF)
    train = forecasting.train_changes(grid, plan)
    with pytest.raises(ValueError, match="clean rows to fit on"):
        forecast.require_rows(forecast.training_counts(grid, train))


def test_only_needed_columns_are_read(spark):
    plan = tables.telemetry(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_series_with_few_clean_rows_are_in_the_reports(spark, tmp_path):
    """Errors every hour leave a series without clean hours, and others with fewer than a forecaster should have."""
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    duck.execute(
        """CREATE TABLE events AS SELECT row_number() OVER (ORDER BY m, u) AS event_id, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts,
        u AS user_id, CASE WHEN u = 0 AND m % 60 = 0 OR u = 1 AND m % 1440 = 0 THEN 'error' ELSE 'click' END AS event_type,
        (hash(m, u) % 1000003)::DOUBLE / 10007 AS value, '{"k": 1}' AS props FROM range(0, 9000, 15) a(m), range(0, 2) b(u)"""
    )
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    counts = [r["rows"] for r in contract.queries()["train_row_counts"](spark, str(tmp_path)).collect()]
    assert min(counts) == 0 and any(0 < n < forecast.MIN_TRAINING_ROWS for n in counts)
    for name in ("quantile_ladder", "pit_values", "accuracy_by_metric", "target_comparison"):
        with pytest.warns(UserWarning, match="clean rows to fit on"):
            found = contract.queries()[name](spark, str(tmp_path))
        names = sorted(found.columns)
        cursor = duck.execute(contract.oracle_sql()[name])
        order = [d[0] for d in cursor.description]
        want = sorted(repr([row[order.index(n)] for n in names]) for row in cursor.fetchall())
        assert sorted(repr([row[n] for n in names]) for row in found.collect()) == want
        assert want


@pytest.mark.parametrize("name", ["run_manifest", "manifest_json_round_trip"])
def test_manifest_makes_its_tables_once(spark, monkeypatch, name):
    made = []
    for table in ("telemetry", "incidents"):
        plain = getattr(tables, table)
        monkeypatch.setattr(tables, table, lambda *a, plain=plain, table=table: made.append(table) or plain(*a))
    assert contract.queries()[name](spark, SF).count() == 1
    assert sorted(made) == ["incidents", "telemetry"]


@pytest.fixture(scope="module")
def hourly_errors(tmp_path_factory):
    """Events of two services; an error every hour leaves one of them without clean hours, one a day leaves the other few."""
    duckdb = pytest.importorskip("duckdb")
    folder, duck = tmp_path_factory.mktemp("hourly_errors"), duckdb.connect()
    duck.execute(
        """CREATE TABLE events AS SELECT row_number() OVER (ORDER BY m, u) AS event_id, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts,
        u AS user_id, CASE WHEN u = 0 AND m % 60 = 0 OR u = 1 AND m % 1440 = 0 THEN 'error' ELSE 'click' END AS event_type,
        (hash(m, u) % 1000003)::DOUBLE / 10007 AS value, '{"k": 1}' AS props FROM range(0, 9000, 15) a(m), range(0, 2) b(u)"""
    )
    duck.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder), duck


@pytest.mark.parametrize(
    "name",
    ["accuracy_pooled", "calibration", "forecast_report", "honesty", "honesty_histogram", "ks_per_series", "ks_pooled", "pit_histogram",
     "pit_values", "quantile_ladder", "separation", "tail_mass"],
)
def test_each_report_has_series_with_few_clean_rows(spark, hourly_errors, name):
    folder, duck = hourly_errors
    with pytest.warns(UserWarning, match="clean rows to fit on"):
        found = contract.queries()[name](spark, folder)
    names = sorted(found.columns)
    cursor = duck.execute(contract.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    want = sorted(repr([row[order.index(n)] for n in names]) for row in cursor.fetchall())
    assert sorted(repr([row[n] for n in names]) for row in found.collect()) == want
    assert want


def test_boosted_reports_have_series_with_few_clean_rows(spark, hourly_errors):
    folder, _ = hourly_errors
    counts = {(r["service"], r["metric"]): r["rows"] for r in contract.queries()["train_row_counts"](spark, folder).collect()}
    assert 0 in counts.values()
    with pytest.warns(UserWarning, match="clean rows to fit on"):
        rows = contract.queries()["boosted_forecast"](spark, folder).collect()
    assert {(r["service"], r["metric"]) for r in rows} == set(counts)
    assert {(r["service"], r["metric"]) for r in rows if r["q50"] is not None} == {s for s, n in counts.items() if n}
    with pytest.warns(UserWarning, match="clean rows to fit on"):
        checks = contract.queries()["boosted_quality"](spark, folder).collect()
    assert sum(c["rows"] for c in checks) == len(rows) and all(c["ordered"] for c in checks)
