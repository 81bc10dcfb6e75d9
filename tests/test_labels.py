import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import telemetry, times
from sparkwatch.functions.profiles import KINDS, effect_table
from sparkwatch.operators import labels
from sparkwatch.plans import incidents as plans
from sparkwatch.schema import METRICS

ALL = ("ledger", "stock", "maps", "batch")
STEP, STEPS = 40, 16
SCHEMA = (
    "ordinal long, incident_id string, kind string, root_service string, start timestamp, end timestamp, affected_services array<string>"
)


def mesh(spark, services=ALL, metrics=("latency_p95_ms",)):
    return telemetry(spark, {(s, m): [3.5] * STEPS for s in services for m in metrics}, STEP)


def incidents(spark, *rows):
    at = times(STEPS, STEP)
    data = [
        (n, f"INC-{n:04d}", kind, affected[0], at[a].to_pydatetime(), at[b].to_pydatetime(), affected)
        for n, (a, b, affected, kind) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def flagged(df):
    return {(r["service"], r["metric"], int((r["timestamp"] - times(1)[0].to_pydatetime().replace(tzinfo=None)).total_seconds() // STEP)): r["incident_id"] for r in df.where("is_anomalous").collect()}


def test_window_is_closed_and_only_affected_services_are_marked(spark):
    got = flagged(labels.label(mesh(spark), incidents(spark, (5, 11, ["ledger", "stock"], "latency_injection"))))
    assert set(got) == {(s, "latency_p95_ms", i) for s in ALL[:2] for i in range(5, 12)}
    assert set(got.values()) == {"INC-0000"}


def test_comma_text_equals_list(spark):
    table = incidents(spark, (1, 13, ["stock", "maps", "ledger"], "error_spike"))
    text = table.withColumn("affected_services", F.concat(F.array_join("affected_services", ","), F.lit(",")))
    assert flagged(labels.label(mesh(spark), text)) == flagged(labels.label(mesh(spark), table))


@pytest.mark.parametrize("bucket", [40, 90, 21600])
def test_first_claim_wins(spark, bucket):
    table = incidents(spark, (3, 7, ["maps"], "latency_injection"), (6, 12, ["maps"], "cpu_saturation"), (1, 14, ["maps"], "memory_leak"))
    got = flagged(labels.label(mesh(spark), table, bucket_seconds=bucket))
    want = {i: "INC-0002" for i in (1, 2, 13, 14)} | {i: "INC-0000" for i in range(3, 8)} | {i: "INC-0001" for i in range(8, 13)}
    assert {k[2]: v for k, v in got.items()} == want


def test_no_incidents_and_duplicate_rows(spark):
    rows = mesh(spark).unionByName(mesh(spark))
    none = labels.label(rows, incidents(spark, (9, 10, ["batch"], "latency_injection")).limit(0))
    assert none.count() == 128 and none.where("is_anomalous").count() == 0
    assert none.where("incident_id <> ''").count() == 0
    some = labels.label(rows, incidents(spark, (9, 10, ["batch"], "latency_injection")))
    assert some.count() == 128 and some.where("is_anomalous").count() == 4


def test_metrics_per_kind(spark):
    table = effect_table(spark).toPandas()
    origin = table.groupby("kind")["metric"].apply(set)
    callers = table[table.at_caller].groupby("kind")["metric"].apply(set)
    assert set(origin.index) == set(KINDS)
    assert set(table.metric) <= set(METRICS)
    assert origin["cpu_saturation"] == {"cpu_pct", "latency_p95_ms", "error_rate"}
    assert callers["cpu_saturation"] == {"latency_p95_ms", "error_rate"}
    assert "mem_mb" in origin["memory_leak"] and callers["memory_leak"] == {"latency_p95_ms"}


def test_cpu_is_marked_at_the_origin_only_and_memory_not_at_all(spark):
    data = mesh(spark, ("pricing", "orders"), METRICS)
    got = flagged(labels.label(data, incidents(spark, (0, 15, ["pricing", "orders"], "cpu_saturation"))))
    assert {m for s, m, _ in got if s == "pricing"} == {"cpu_pct", "latency_p95_ms", "error_rate"}
    assert {m for s, m, _ in got if s == "orders"} == {"latency_p95_ms", "error_rate"}


def test_unknown_kind_fails(spark):
    with pytest.raises(Exception, match="unknown fault kind"):
        # counting would not need the labels at all
        labels.label(mesh(spark), incidents(spark, (4, 5, ["maps"], "gremlins"))).collect()


def test_reports(spark):
    table = incidents(spark, (2, 4, ["ledger", "stock", "batch"], "latency_injection"), (10, 14, ["maps"], "error_spike"))
    marked = labels.label(mesh(spark), table)
    assert plans.label_problems(marked, table).count() == 0
    ghost = table.where("ordinal = 0")
    assert [r["problem"] for r in plans.label_problems(marked, ghost).collect()] == ["label without incident"]
    silent = table.withColumn("incident_id", F.concat("incident_id", F.lit("x"))).where("ordinal = 1")
    found = {r["problem"] for r in plans.label_problems(marked, table.unionByName(silent)).collect()}
    assert found == {"incident without label", "root not marked"}
    assert plans.onset_order(marked).count() == 4
    assert plans.summary_text(table) == "2 incidents, mean fan-out 2.0 services (error_spike: 1, latency_injection: 1)"
    assert plans.summary_text(table.limit(0)) == "no incidents"
    manifest = plans.run_manifest(marked, table, 40.0).first()
    assert (manifest["services"], manifest["series"], manifest["rows"], manifest["incidents"]) == (4, 4, 64, 2)
    assert manifest["anomalous_fraction"] == round(14 / 64, 6)


def test_impact_report(spark):
    data = telemetry(
        spark,
        {
            ("a", "cpu_pct"): [10.0] * 5 + [80.0] * 5,
            ("a", "latency_p95_ms"): [10.0, 12.0, 11.0, 900.0, 9.0] + [40.0] * 5,
            ("b", "latency_p95_ms"): [0.0] * 5 + [5.0] * 5,
            ("b", "cpu_pct"): [1.0] * 10,
            ("gone", "latency_p95_ms"): [1.0] * 5 + [float("nan")] * 5,
            ("zz", "latency_p95_ms"): [2.0] * 10,
        },
    )
    hops = spark.createDataFrame([("a", "b", 2)], "origin string, service string, hops int")
    middle = F.lit(times(10)[5].to_pydatetime())
    found = plans.impact(data.where("value is not null"), "a", hops, F.col("timestamp") < middle, F.col("timestamp") >= middle)
    rows = [(r["service"], r["distance"], r["p95_ratio"]) for r in found.collect()]
    assert rows == [("a", 0, pytest.approx(40 / 11)), ("b", 2, None), ("zz", 99, 1.0)]


def test_an_incident_without_end_and_thousands_that_overlap(spark):
    table = incidents(spark, (3, 7, ["maps"], "latency_injection"))
    endless = table.withColumns({"ordinal": F.lit(1).cast("long"), "incident_id": F.lit("INC-0001"), "end": F.lit("9999-12-31 23:59:59").cast("timestamp")})
    early = endless.withColumns({"ordinal": F.lit(2).cast("long"), "incident_id": F.lit("INC-0002"), "start": F.lit("0001-01-01").cast("timestamp")})
    got = flagged(labels.label(mesh(spark), table.unionByName(endless).unionByName(early)))
    assert {k[2]: v for k, v in got.items()} == {i: "INC-0002" if i < 3 else "INC-0000" if i < 8 else "INC-0001" for i in range(STEPS)}
    many = spark.range(3_000).select((F.col("id") + 5).alias("ordinal"), F.format_string("INC-%04d", F.col("id") + 5).alias("incident_id"))
    covered = endless.drop("ordinal", "incident_id").crossJoin(many).select(*table.columns)
    got = flagged(labels.label(mesh(spark), covered))
    assert set(got.values()) == {"INC-0005"} and len(got) == STEPS - 3


def test_rows_without_a_timestamp_or_a_series_are_not_marked(spark):
    rows = spark.createDataFrame([(None, "maps", "latency_p95_ms", 1.0), (times(1)[0].to_pydatetime(), None, "latency_p95_ms", 1.0)], "timestamp timestamp, service string, metric string, value double")
    got = labels.label(mesh(spark).unionByName(rows), incidents(spark, (0, 15, ["maps"], "latency_injection")))
    assert got.count() == 66 and got.where("is_anomalous").count() == 16
    assert labels.label(rows.limit(0), incidents(spark, (0, 15, ["maps"], "latency_injection"))).collect() == []


def test_incidents_between_two_times_are_not_spelled_out(spark):
    table = incidents(spark, (5, 11, ["ledger"], "latency_injection"), (2, 2, ["stock"], "latency_injection"), (7, 7, ["maps"], "latency_injection"))
    second = F.expr("INTERVAL 1 SECOND")
    inside = F.col("ordinal") == 2  # from one second after a time to one second before the next
    table = table.withColumn("end", F.when(inside, F.col("start") + (STEP - 1) * second).otherwise(F.col("end"))).withColumn("start", F.when(inside, F.col("start") + second).otherwise(F.col("start")))
    table = table.unionByName(table.where("ordinal = 0").withColumns({"ordinal": F.lit(9).cast("long"), "end": F.lit(None).cast("timestamp")}))
    assert sorted(r["ordinal"] for r in labels._touching(mesh(spark), table).collect()) == [0, 1]
    got = flagged(labels.label(mesh(spark), table))
    assert {(k[0], k[2]) for k in got} == {("ledger", i) for i in range(5, 12)} | {("stock", 2)}
