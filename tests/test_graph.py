import pytest

from sparkwatch.operators import graph

#: A delivery platform: two ways in, a diamond, a ring of three and a service of its own.
PLATFORM = {
    "app": ["orders", "tracking"],
    "partner-api": ["orders"],
    "orders": ["pricing", "stock"],
    "pricing": ["ledger"],
    "stock": ["ledger", "warehouse"],
    "tracking": ["routes"],
    "routes": ["maps"],
    "maps": ["tiles"],
    "tiles": ["routes"],
    "ledger": [],
    "warehouse": [],
    "batch": [],
}


def services(spark, graph_):
    return spark.createDataFrame(list(graph_.items()), "name string, depends_on array<string>")


def hops_to(df, origin):
    return {r["service"]: r["hops"] for r in df.where(df.origin == origin).collect()}


def test_hops_through_a_diamond(spark):
    table = services(spark, PLATFORM)
    calls = graph.edges(table)
    assert calls.count() == sum(map(len, PLATFORM.values()))
    assert sorted(r[0] for r in graph.callers_of(calls, "ledger").collect()) == ["pricing", "stock"]
    assert graph.callers_of(calls, "app").count() == 0
    found = graph.upstream_hops(calls)
    assert hops_to(found, "ledger") == {"pricing": 1, "stock": 1, "orders": 2, "app": 3, "partner-api": 3}
    assert hops_to(found, "warehouse") == {"stock": 1, "orders": 2, "app": 3, "partner-api": 3}
    assert hops_to(found, "batch") == {} == hops_to(found, "partner-api")
    only = spark.createDataFrame([("stock",)], "o string")
    assert {r["origin"] for r in graph.upstream_hops(calls, only).collect()} == {"stock"}
    radius = {r["root"]: r["affected_services"] for r in graph.blast_radius(table, found).collect()}
    assert radius["stock"] == ["app", "orders", "partner-api", "stock"] and radius["batch"] == ["batch"]


def test_a_ring_ends(spark):
    found = graph.upstream_hops(graph.edges(services(spark, PLATFORM)))
    assert hops_to(found, "maps") == {"routes": 1, "tiles": 2, "tracking": 2, "app": 3}
    assert hops_to(found, "tiles") == {"maps": 1, "routes": 2, "tracking": 3, "app": 4}
    alone = graph.upstream_hops(graph.edges(services(spark, {"x": ["x", "y"], "y": []})))
    assert hops_to(alone, "x") == {} and hops_to(alone, "y") == {"x": 1}


def test_dangling_is_refused(spark):
    table = services(spark, {**PLATFORM, "batch": ["mainframe"]})
    assert [tuple(r) for r in graph.dangling(graph.edges(table), table).collect()] == [("batch", "mainframe")]
    with pytest.raises(ValueError, match="unknown service"):
        graph.require_known(graph.edges(table), table)


def test_drift_names_the_side(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z")], "caller string, callee string")
    b = spark.createDataFrame([("x", "y"), ("z", "z")], "caller string, callee string")
    got = {(r["caller"], r["side"]) for r in graph.drift(a, b).collect()}
    assert got == {("y", "described"), ("z", "observed")}
