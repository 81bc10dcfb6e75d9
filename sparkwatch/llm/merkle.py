"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and the siblings that prove each row.

Digests are lowercase hex SHA-256 of their inputs, one behind the other; digests enter as hex text. A row's digest covers the chosen
columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. In a tree every ``fanout`` consecutive nodes (the last run
has fewer, even one) become their digest while there are several nodes.

* **Places.** Rows are sorted over all tasks by group, order column, digest and a salt, so that a group that holds most rows, or one row
  repeated without end, is spread over many tasks. A row's place is its place in its task and the rows of earlier tasks.
* **Up.** The slot pivot: conditional aggregates spread the children of a node into columns, one per slot, and concatenated columns are
  hashed. Children of several levels are spread at once (16 slots hold four levels of two), which saves passes over the nodes.
* **Down.** The columns of a run without a child's own one are its siblings. They are joined to what is known of the parent, level
  by level, so work and shuffles are in proportion to the number of nodes and no task holds a whole level.

Missing groups are a group of their own, the first. Rows of one group without order value come first, and equal ones follow their
digests; equal rows keep one place each. Texts of any length are hashed whole and are not moved. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.session import discard, stored


@dataclass(frozen=True)
class MerkleConfig:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    by: str = "lang"
    order: str = "doc_id"
    fanout: int = 2
    #: Most slots that are spread at once; at least one level is.
    slots: int = 16

    @property
    def levels(self) -> int:
        """Levels of the tree that one pivot covers."""
        k = 1
        while self.fanout ** (k + 1) <= self.slots:
            k += 1
        return k


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, config: MerkleConfig = MerkleConfig(), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: its order column, ``leaf``, place and size in its group's tree (``place``, ``n_leaves``) and in the tree
    over the groups (``group_place``, ``n_groups``), ``subroot``, ``root`` and ``siblings``, their digests from the leaf up, left to right.

    ``extra`` are columns computed from a row that are to come along.
    """
    extra = dict(extra or {})
    group = F.col(config.by).cast("string")
    rows = docs.select(
        # never null, and in the order of the bytes behind the missing one
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("_g"),
        F.col(config.order).alias("_order"),
        leaf([F.col(c) for c in config.fields]).alias("_h"),
        *[value.alias(f"_x_{name}") for name, value in extra.items()],
    )
    placed = _placed(rows)
    steps, subroots = _up(placed.select("_g", "_i", "_n", "_h"), config)

    groups = _placed(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_order"), "_h"))
    top_steps, top = _up(groups.select("_g", "_i", "_n", "_h"), config)
    found = top.select("_h").first()
    root = found["_h"] if found else None
    proofs = _down(top_steps, top.select("_g", F.lit(0).cast("long").alias("_i"), F.lit("").alias("_proof")), config, [])
    carried = ["_subroot", "_top_i", "_top_n"]
    tops = groups.select("_i", F.col("_order").alias("_group"), F.col("_h").alias("_subroot"), F.col("_n").alias("_top_n")).join(proofs.drop("_g"), "_i")
    tops = tops.select(F.col("_group").alias("_g"), F.lit(0).cast("long").alias("_top"), "_subroot", F.col("_i").alias("_top_i"), "_top_n", "_proof")
    proofs = _down(steps, tops.withColumnRenamed("_top", "_i"), config, carried)

    done = placed.join(proofs, ["_g", "_i"]).select(
        F.col("_order").alias(config.order),
        F.col("_h").alias("leaf"),
        F.col("_i").alias("place"),
        F.col("_n").alias("n_leaves"),
        F.col("_top_i").alias("group_place"),
        F.col("_top_n").alias("n_groups"),
        F.col("_subroot").alias("subroot"),
        F.lit(root).cast("string").alias("root"),
        F.col("_proof").alias("siblings"),
        *[F.col(f"_x_{name}").alias(name) for name in extra],
    )
    return done


def folded(own: Column, place: Column, nodes: Column, siblings: Column, fanout: int) -> Column:
    """The root of a tree of ``nodes`` leaves, from a leaf's digest, its place and its siblings.

    A struct of ``root`` and ``at``, the characters of ``siblings`` that were used.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(nodes, F.lit(1)).cast("double"))).cast("int") + 1)
    start = F.struct(own.alias("h"), place.cast("long").alias("i"), nodes.cast("long").alias("m"), F.lit(0).cast("long").alias("at"))

    def up(acc: Column, _: Column) -> Column:
        run = F.floor(acc["i"] / fanout).cast("long")
        left = acc["i"] - run * fanout
        others = F.least(F.lit(fanout).cast("long"), acc["m"] - run * fanout) - 1
        taken = lambda start, count: F.substring(siblings, (acc["at"] + 64 * start + 1).cast("int"), (64 * count).cast("int"))
        made = F.struct(
            F.sha2(F.concat(taken(F.lit(0), left), acc["h"], taken(left, others - left)), 256).alias("h"),
            run.alias("i"),
            F.ceil(acc["m"] / fanout).cast("long").alias("m"),
            (acc["at"] + 64 * others).cast("long").alias("at"),
        )
        return F.when(acc["m"] > 1, made).otherwise(acc)

    return F.aggregate(steps, start, up, lambda acc: F.struct(acc["h"].alias("root"), acc["at"].alias("at")))


def proven_root(own: Column, fanout: int) -> Column:
    """The root that ``own`` in the place of a row's leaf leads to, given the columns of ``manifest``."""
    inner = folded(own, F.col("place"), F.col("n_leaves"), F.col("siblings"), fanout)
    rest = F.substring(F.col("siblings"), (inner["at"] + 1).cast("int"), F.length("siblings"))
    return folded(inner["root"], F.col("group_place"), F.col("n_groups"), rest, fanout)["root"]


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_i``, their place in group ``_g`` by ``_order`` and digest, and ``_n``, the size of the group. Written."""
    keys = ["_g", "_order", "_h", "_salt"]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    # the number counts the rows of a task in their order; the task's own number stands above bit 33
    numbered = stored(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)))
    parts = numbered.groupBy("_g", "_task").agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    # a row per task that holds the group
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_g", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(group).alias("_n"))
    placed = stored(numbered.join(parts, ["_g", "_task"]).withColumn("_i", F.col("_row") + F.col("_shift")).drop("_row", "_task", "_shift"))
    discard(numbered)
    return placed


def _up(nodes: DataFrame, config: MerkleConfig) -> tuple[list[DataFrame], DataFrame]:
    """The written pivots, lowest first, and the root ``_h`` of each group."""
    slots = config.fanout**config.levels
    largest = nodes.agg(F.max("_n")).first()[0] or 0
    steps, done = [], 1
    while done < largest:
        nodes = _pivot(nodes, done, slots, config)
        steps.append(stored(nodes))
        nodes = steps[-1].select("_g", "_i", "_n", F.col(_slot(config.levels, 0)).alias("_h"))
        done *= slots
    return steps, nodes.select("_g", "_h")


def _slot(level: int, number: int) -> str:
    return f"_s{level}_{number}"


def _pivot(nodes: DataFrame, done: int, slots: int, config: MerkleConfig) -> DataFrame:
    """A row per parent with the nodes below it in columns, level by level up to the parent itself.

    ``done`` leaves stand below a node so far. Where a level has one node only, the tree has ended and the node moves up as it is.
    """
    spread = [F.max(F.when(F.col("_i") % slots == j, F.col("_h"))).alias(_slot(0, j)) for j in range(slots)]
    rows = nodes.groupBy("_g", F.expr(f"_i div {slots}").alias("_i")).agg(F.max("_n").alias("_n"), *spread)
    width = slots
    for level in range(config.levels):
        several = F.col("_n") > done
        made = {}
        for run in range(width // config.fanout):
            below = [F.col(_slot(level, run * config.fanout + j)) for j in range(config.fanout)]
            digest = F.when(below[0].isNotNull(), F.sha2(F.concat_ws("", *below), 256))
            made[_slot(level + 1, run)] = F.when(several, digest).otherwise(below[0])
        rows = rows.withColumns(made)
        done *= config.fanout
        width //= config.fanout
    return rows


def _down(steps: list[DataFrame], tops: DataFrame, config: MerkleConfig, carried: list[str]) -> DataFrame:
    """``_g``, ``_i``, ``_proof`` and ``carried`` of the lowest nodes; ``tops`` has them for the top ones."""
    slots = config.fanout**config.levels
    for step in reversed(steps):
        children = F.array(*[F.struct(F.lit(j).alias("slot"), F.col(_slot(0, j)).isNotNull().alias("there"), _siblings(j, config).alias("proof")) for j in range(slots)])
        below = step.join(tops, ["_g", "_i"]).select("_g", "_i", "_proof", *carried, F.explode(F.filter(children, lambda c: c["there"])).alias("_c"))
        tops = below.select("_g", (F.col("_i") * slots + F.col("_c.slot")).alias("_i"), F.concat("_c.proof", "_proof").alias("_proof"), *carried)
    return tops


def _siblings(slot: int, config: MerkleConfig) -> Column:
    """The siblings of a slot and of its ancestors within a pivot: their runs without the own column."""
    others = []
    for level in range(config.levels):
        run = slot // config.fanout * config.fanout
        others += [F.col(_slot(level, run + j)) for j in range(config.fanout) if run + j != slot]
        slot //= config.fanout
    return F.concat_ws("", *others)


def report(docs: DataFrame, config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """Proofs of all rows, checked against rows of which every seventh (by the CRC of its id) counts one character more."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = leaf([changed if c == "n_chars" else F.col(c) for c in config.fields])
    done = manifest(docs, config, {"tampered": tampered}).withColumn("folded_root", proven_root(F.col("tampered"), config.fanout))
    proof = F.sha2("siblings", 256).alias("proof_sha256")
    return done.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows in DuckDB's SQL: two recursions up, proofs gathered level by level. CRC-32 is spelled out bit by bit.
ORACLE = """
WITH RECURSIVE docs AS (
  SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)) % 7 = 0 AS hit,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT)::VARCHAR, '-') || tail) AS tampered
  FROM (SELECT * REPLACE (coalesce(hit, false) AS hit) FROM docs)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT 0 AS level, lang, i, n AS m, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, lang, i // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE m > 1 GROUP BY level, lang, i // 2),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS top_i, count(*) OVER () AS top_n FROM tree WHERE m = 1),
top AS (
  SELECT 0 AS level, top_i AS i, top_n AS m, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE m > 1 GROUP BY level, i // 2),
up AS (
  SELECT doc_id, leaf, tampered AS h, lang, i, n AS m, 0 AS level, '' AS proof, i AS leaf_i FROM placed
  UNION ALL
  SELECT u.doc_id, u.leaf, sha256(CASE WHEN u.i % 2 = 0 THEN u.h || coalesce(t.h, '') ELSE t.h || u.h END), u.lang, u.i // 2, (u.m + 1) // 2, u.level + 1,
    u.proof || coalesce(t.h, ''), u.leaf_i
  FROM up u LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM u.lang AND t.level = u.level AND t.i = xor(u.i, 1) WHERE u.m > 1),
over AS (
  SELECT u.doc_id, u.leaf, u.h, u.lang, u.leaf_i, s.subroot, s.top_i AS i, s.top_n AS m, 0 AS level, u.proof
  FROM up u JOIN subroots s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.m = 1
  UNION ALL
  SELECT o.doc_id, o.leaf, sha256(CASE WHEN o.i % 2 = 0 THEN o.h || coalesce(t.h, '') ELSE t.h || o.h END), o.lang, o.leaf_i, o.subroot, o.i // 2, (o.m + 1) // 2,
    o.level + 1, o.proof || coalesce(t.h, '')
  FROM over o LEFT JOIN top t ON t.level = o.level AND t.i = xor(o.i, 1) WHERE o.m > 1)
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM over o, (SELECT h FROM top WHERE m = 1) r WHERE o.m = 1
"""
