"""The service call graph: edges run from caller to callee, and trouble travels the other way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwatch.session import cut_lineage

EDGE = ["caller", "callee"]


def edges(services: DataFrame) -> DataFrame:
    """(caller, callee) rows of a service table with a ``depends_on`` list."""
    return services.select(F.col("name").alias("caller"), F.explode("depends_on").alias("callee"))


def dangling(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Edges to a service that is not in the table."""
    return calls.join(services.select(F.col("name").alias("callee")), "callee", "left_anti").select(*EDGE)


def require_known(calls: DataFrame, services: DataFrame) -> None:
    bad = dangling(calls, services).orderBy(*EDGE).first()
    if bad is not None:
        raise ValueError(f"{bad['caller']} depends on unknown service {bad['callee']!r}")


def callers_of(calls: DataFrame, name: str) -> DataFrame:
    """Direct callers of one service."""
    return calls.where(F.col("callee") == name).select("caller").distinct()


def upstream_hops(calls: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Rows (origin, service, hops): every transitive caller at its shortest distance.

    One join per hop, for all origins together. A pair is kept the first time it is reached, which makes its
    distance the shortest and ends the search on cycles. Each round is written to the
    checkpoint folder, so the plan does not grow with the depth of the graph.
    """
    links = cut_lineage(calls.select(*EDGE).distinct())
    if origins is not None:
        start = origins.select(F.col(origins.columns[0]).alias("origin")).distinct()
        first = links.join(start, F.col("callee") == F.col("origin"), "left_semi")
    else:
        first = links
    reached = first.where(F.col("caller") != F.col("callee")).select(
        F.col("callee").alias("origin"), F.col("caller").alias("service"), F.lit(1).alias("hops")
    )
    reached = frontier = cut_lineage(reached)
    hops = 1
    while not frontier.isEmpty():
        hops += 1
        stepped = (
            frontier.join(links, F.col("service") == F.col("callee"))
            .where(F.col("caller") != F.col("origin"))
            .select("origin", F.col("caller").alias("service"))
            .distinct()
            .join(reached.select("origin", "service"), ["origin", "service"], "left_anti")
        )
        frontier = cut_lineage(stepped.withColumn("hops", F.lit(hops)))
        reached = reached.unionByName(frontier)
    return reached


def blast_radius(services: DataFrame, hops: DataFrame) -> DataFrame:
    """Per root: itself and all its transitive callers, sorted."""
    own = services.select(F.col("name").alias("root"), F.col("name").alias("service"))
    callers = hops.select(F.col("origin").alias("root"), "service").join(
        services.select(F.col("name").alias("root")), "root", "left_semi"
    )
    return (
        own.unionByName(callers).groupBy("root").agg(F.array_sort(F.collect_set("service")).alias("affected_services"))
    )


def drift(described: DataFrame, observed: DataFrame) -> DataFrame:
    """Edges only one of two descriptions has, with the ``side`` that has them."""
    a, b = described.select(*EDGE).distinct(), observed.select(*EDGE).distinct()
    return (
        a.exceptAll(b).withColumn("side", F.lit("described")).unionByName(b.exceptAll(a).withColumn("side", F.lit("observed")))
    )
