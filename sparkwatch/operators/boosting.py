"""Gradient-boosted quantile trees per series, grown from histograms.

One model per (series, level). Training rows are binned per series and lie in blocks of a bounded number of rows, a table row per block.

* A series that fits in one block is grown in the task that holds the block, one task per model; its histograms need no exchange.
* A longer series (one may hold a third of all rows) is grown round by round: per tree level, tasks count histograms of their blocks,
  one fixed array per series x level x node x feature, and one exchange sums them. Only the smaller of two siblings is counted,
  the other is what is left of the parent's. Leaves are exact quantiles over all blocks.

Counts are whole numbers and both ways share the same steps (``functions.trees``), so they grow the same trees. No series is gathered in one
task, and trees are never on the driver.

A model is a row of flat arrays (number, feature, bin, missing side and leaf of the nodes that its trees have). Prediction brings the models
of a series, a row each, to bounded parts of its rows and takes all rows of a part down each tree at once. Rows of blocks and of models are
wide, so few of them are written or read at a time, and none are gathered outside of the task that works on a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkwatch.functions import trees as grown
from sparkwatch.functions.ladder import LEVELS
from sparkwatch.functions.percentiles import exact_percentiles
from sparkwatch.operators.forecast import anchored
from sparkwatch.schema import SERIES
from sparkwatch.session import discard, stored

MODEL = "service string, metric string, level int, node binary, feature binary, bin binary, side binary, leaf binary"
_BLOCK = "service string, metric string, parts int, edges array<array<double>>, base array<double>, bins binary, target binary, at binary"
_COUNTED = "service string, metric string, level int, node int, feature int, counts binary"
_SETTLED = f"{_COUNTED}, gain double, bin int, side boolean, left long, right long"
#: Histogram bytes that a task gathers before it sends them on.
_HELD = 128 << 20


@dataclass(frozen=True)
class BoostConfig:
    """Rounds, learning rate, depth and least rows per leaf. ``bins`` excludes the one for missing values."""

    rounds: int = 200
    learning_rate: float = 0.06
    depth: int = 6
    min_leaf: int = 40
    bins: int = 255
    levels: tuple[float, ...] = LEVELS
    #: Most training rows of a block, and about the most rows that are predicted together.
    block_rows: int = 1 << 16

    @property
    def nodes(self) -> int:
        """Node numbers per tree: node k has children 2k and 2k + 1."""
        return 2 ** (self.depth + 1)

    def edge_bytes(self, features: int) -> int:
        """What a row with the bin edges of a series may take; about, as are the next two."""
        return 8 * (features * self.bins + len(self.levels)) + 1024

    def block_bytes(self, features: int) -> int:
        return self.block_rows * (2 * features + 8 + 8 * len(self.levels)) + self.edge_bytes(features)

    def model_bytes(self, features: int) -> int:
        return self.rounds * self.nodes * 17 + self.edge_bytes(features)


def fit(train: DataFrame, features: Sequence[str], config: BoostConfig = BoostConfig()) -> DataFrame:
    """Model table, a row per series and level, with the series' bin ``edges`` and the model's ``base``.

    ``train`` holds the series, ``target`` and the feature columns; a feature that is null or NaN counts as missing.
    """
    if config.rounds < 1 or config.depth < 1:
        raise ValueError("at least one round and one level of splits are needed")
    series = _series(train, features, config)
    blocks = stored(_blocks(train, series, features, config), config.block_bytes(len(features)))
    sizes = series.agg(F.count(F.lit(1)), F.sum((F.col("parts") > 1).cast("int"))).first()
    models = _grown_whole(blocks.where("parts = 1"), sizes[0], config)
    if sizes[1]:
        models = models.unionByName(_grown_by_rounds(blocks.where("parts > 1"), len(features), config))
    base = F.get("base", F.col("level")).alias("base")
    whole = models.join(series, SERIES).select(*SERIES, "level", "edges", base, *_FIELDS)
    models = stored(whole, config.model_bytes(len(features)))
    discard(blocks)
    return models


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """Candidate thresholds per series and feature: distinct approximate quantiles.

    The sketches are mergeable and of fixed size. They only decide where a split may be tried.
    """
    shares = F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)])
    found = [F.array_distinct(F.percentile_approx(F.nanvl(f, F.lit(None).cast("double")), shares, 10_000)) for f in features]
    return train.groupBy(*SERIES).agg(F.array(*[F.coalesce(e, F.array().cast("array<double>")) for e in found]).alias("edges"))


def _series(train: DataFrame, features: Sequence[str], config: BoostConfig) -> DataFrame:
    """A row per series: bin edges, base predictions, number of blocks."""
    base = exact_percentiles(train, SERIES, "target", config.levels, "base")
    parts = train.groupBy(*SERIES).agg(F.ceil(F.count(F.lit(1)) / config.block_rows).cast("int").alias("parts"))
    return stored(bin_edges(train, features, config.bins).join(base, SERIES).join(parts, SERIES), config.edge_bytes(len(features)))


def _in_parts(rows: DataFrame, series: DataFrame) -> DataFrame:
    """``rows`` with a ``_part`` below their series' ``parts``."""
    plain = [f.name for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    dealt = rows.join(series.select(*SERIES, F.col("parts").alias("_parts")), SERIES)
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int"))
    return dealt.drop("_parts")


def _each_part(series: DataFrame) -> DataFrame:
    """``series`` once for each of its ``parts``."""
    # named anew: it may come from the rows that it is brought to
    return series.select(*[F.col(c).alias(c) for c in series.columns], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))


def _matrix(table: pa.Table, features: Sequence[str]) -> np.ndarray:
    columns = [table.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.column_stack(columns) if columns else np.zeros((table.num_rows, 0))


def _blocks(train: DataFrame, series: DataFrame, features: Sequence[str], config: BoostConfig) -> DataFrame:
    """A row per block: its binned rows, targets and predictions so far (one row of ``at`` per level)."""
    rows, each = _in_parts(train.select(*SERIES, "target", *features), series), _each_part(series)
    schema = pa.schema([("service", pa.string()), ("metric", pa.string()), ("parts", pa.int32()), ("edges", pa.list_(pa.list_(pa.float64()))), ("base", pa.list_(pa.float64())), ("bins", pa.binary()), ("target", pa.binary()), ("at", pa.binary())])
    empty = schema.empty_table()

    def pack(part: pa.Table, about: pa.Table) -> pa.Table:
        if not part.num_rows:
            return empty
        (row,) = about.select(["service", "metric", "parts", "edges", "base"]).to_pylist()
        edges = [np.array(e) for e in row["edges"]]
        bins = grown.to_bins(_matrix(part, features), edges)
        target = part.column("target").to_numpy(zero_copy_only=False)
        at = np.repeat(np.array(row["base"])[:, None], len(target), 1)
        return pa.Table.from_pylist([row | {"bins": bins.tobytes(), "target": target.tobytes(), "at": at.tobytes()}], schema)

    keys = [*SERIES, "_part"]
    return rows.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(pack, _BLOCK)


class _Block:
    """A row of the block table as arrays."""

    def __init__(self, row: dict):
        self.key = (row["service"], row["metric"])
        self.slots = grown.slots_of(row["edges"])
        self.base = row["base"]
        self.target = np.frombuffer(row["target"])
        self.bins = np.frombuffer(row["bins"], np.uint16).reshape(len(self.target), -1)
        self.at = np.frombuffer(row["at"]).reshape(-1, len(self.target)) if "at" in row else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _packed(key: tuple, level: int, found: Sequence[grown.Tree]) -> dict:
    return {"service": key[0], "metric": key[1], "level": level, **{name: array.tobytes() for name, array in grown.packed(found).items()}}


#: The arrays of a model and the types of their entries.
_FIELDS = {"node": np.int32, "feature": np.int16, "bin": np.int16, "side": bool, "leaf": np.float64}
_MODEL = pa.schema([("service", pa.string()), ("metric", pa.string()), ("level", pa.int32()), *((name, pa.binary()) for name in _FIELDS)])


def _grown_whole(blocks: DataFrame, series: int, config: BoostConfig) -> DataFrame:
    """Models of series of one block, a task per model as far as there are tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, level = _Block(row), row["level"]
            made = grown.grow(block.bins, block.target, block.base[level], config.levels[level], config, block.slots)
            yield pa.RecordBatch.from_pylist([_packed(block.key, level, made)], _MODEL)

    # one block starts from the base, so its predictions so far are left behind
    each = blocks.drop("at").withColumn("level", F.explode(_level_numbers(config)))
    return each.repartition(min(series * len(config.levels), 10_000) or 1).mapInArrow(work, MODEL)


# --- series of several blocks -------------------------------------------------------------------


def _grown_by_rounds(blocks: DataFrame, features: int, config: BoostConfig) -> DataFrame:
    """Models of series of several blocks: histograms of all blocks are summed by an exchange per tree level."""
    rounds: list[DataFrame] = []
    names = stored(blocks.select(*SERIES).distinct().withColumn("level", F.explode(_level_numbers(config))))
    now = blocks
    for number in range(config.rounds):
        rounds.append(_round(now, names, config).withColumn("round", F.lit(number)))
        if number + 1 < config.rounds:
            moved = stored(_moved(now, rounds[-1], config), config.block_bytes(features))
            if number:
                discard(now)
            now = moved
    every = rounds[0]
    for tree in rounds[1:]:
        every = every.unionByName(tree)

    def pack(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["round"])
        first = found[0]
        return pa.Table.from_pylist([_packed((first["service"], first["metric"]), first["level"], [_tree(r, config) for r in found])], _MODEL)

    return every.groupBy(*SERIES, "level").applyInArrow(pack, MODEL)


def _round(blocks: DataFrame, names: DataFrame, config: BoostConfig) -> DataFrame:
    """A tree per series and level: ``splits`` and ``leaves``."""
    splits = "array<struct<node:int,feature:int,bin:int,side:boolean>>"
    tree = names.select(*SERIES, "level", F.array().cast(splits).alias("splits"), F.array(F.lit(1)).alias("open"))
    before: DataFrame | None = None
    for depth in range(config.depth):
        settled = stored(_settled(_counted(blocks, tree, config), before, config))
        if before is not None:
            discard(before)
        before = settled
        best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), "bin", "side", "left", "right")).alias("b")
        chosen = settled.where("gain > 0").groupBy(*SERIES, "level", "node").agg(best)
        new = F.struct("node", (-F.col("b.f")).alias("feature"), F.col("b.bin").alias("bin"), F.col("b.side").alias("side"))
        small = F.col("node") * 2 + (F.col("b.left") > F.col("b.right")).cast("int")
        again = F.when(F.greatest("b.left", "b.right") >= 2 * config.min_leaf, small)
        # at most a tree's nodes
        found = chosen.groupBy(*SERIES, "level").agg(F.collect_list(new).alias("_new"), F.collect_list(again).alias("_open"))
        joined = tree.drop("open").join(found, [*SERIES, "level"], "left")
        grown_on = F.concat("splits", F.coalesce("_new", F.array().cast(splits))).alias("splits")
        older, tree = tree, stored(joined.select(*SERIES, "level", grown_on, F.coalesce("_open", F.array().cast("array<int>")).alias("open")))
        if depth:
            discard(older)
        if tree.where(F.size("open") > 0).isEmpty():
            break
    discard(before)
    own = F.get(F.col("_all"), F.col("level")).alias("value")
    left = stored(_residuals(blocks, tree, config))
    quantiles = exact_percentiles(left, [*SERIES, "level", "node"], "residual", config.levels, "_all")
    leaves = quantiles.groupBy(*SERIES, "level").agg(F.collect_list(F.struct("node", own)).alias("leaves"))
    whole = stored(tree.drop("open").join(leaves, [*SERIES, "level"]))
    discard(left)
    discard(tree)
    return whole


def _with_trees(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """Blocks with the trees of their series, an entry per level."""
    fields = [c for c in tree.columns if c not in SERIES and c != "round"]
    return blocks.join(tree.groupBy(*SERIES).agg(F.collect_list(F.struct(*fields)).alias("trees")), SERIES)


def _tree(row: dict, config: BoostConfig) -> grown.Tree:
    tree = grown.Tree(config.depth)
    for s in row["splits"]:
        tree.split(s["node"], s["feature"], s["bin"], s["side"])
    for leaf in row.get("leaves") or []:
        tree.leaf[leaf["node"]] = leaf["value"]
    return tree


def _nodes(block: _Block, tree: grown.Tree, config: BoostConfig) -> np.ndarray:
    node = np.ones(len(block.target), np.int64)
    for _ in range(config.depth):
        node = grown.step_down(block.bins, node, block.slots - 1, tree.feature, tree.bin, tree.side)
    return node


def _counted(blocks: DataFrame, tree: DataFrame, config: BoostConfig) -> DataFrame:
    """Histograms of the ``open`` nodes, a row per task (or as much as a task may hold), node and feature."""
    schema = pa.schema([("service", pa.string()), ("metric", pa.string()), ("level", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("counts", pa.binary())])

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for (key, level), (nodes, counts) in held.items():
            rows = [
                {"service": key[0], "metric": key[1], "level": level, "node": node, "feature": f, "counts": counts[c, f].tobytes()}
                for c, node in enumerate(nodes)
                for f in range(counts.shape[1])
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for row in _rows(batches):
            block = _Block(row)
            for entry in row["trees"]:
                if not entry["open"]:
                    continue
                place = np.full(config.nodes, -1, np.int64)
                place[entry["open"]] = np.arange(len(entry["open"]))
                up = block.target > block.at[entry["level"]]
                counts = grown.histograms(block.bins, up, place[_nodes(block, _tree(entry, config), config)], len(entry["open"]), block.slots)
                at = (block.key, entry["level"])
                held[at] = (entry["open"], held[at][1] + counts if at in held else counts)
            if sum(counts.nbytes for _, counts in held.values()) > _HELD:
                yield from sent(held)
                held = {}
        yield from sent(held)

    return _with_trees(blocks, tree).mapInArrow(work, _COUNTED)


def _settled(counted: DataFrame, before: DataFrame | None, config: BoostConfig) -> DataFrame:
    """Summed histograms of the counted nodes and of their siblings, each with its best split on the feature."""
    keys = [*SERIES, "level", "_over", "feature"]
    schema = pa.schema(
        [("service", pa.string()), ("metric", pa.string()), ("level", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("counts", pa.binary())]
        + [("gain", pa.float64()), ("bin", pa.int32()), ("side", pa.bool_()), ("left", pa.int64()), ("right", pa.int64())]
    )
    empty = schema.empty_table()

    def settle(parts: pa.Table, over: pa.Table | None) -> pa.Table:
        if not parts.num_rows:
            return empty
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in parts.column("counts"))
        first = parts.select(["service", "metric", "level", "node", "feature"]).slice(0, 1).to_pylist()[0]
        cells = {first["node"]: total}
        if over is not None:
            cells[first["node"] ^ 1] = np.frombuffer(over.column("counts")[0].as_py(), np.int64) - total
        counts = np.stack([c.reshape(1, -1, 2) for c in cells.values()])
        best = grown.best_splits(counts, config.levels[first["level"]], config.min_leaf)
        rows = []
        for c, node in enumerate(cells):
            split = {"gain": float(best["gain"][c]), "bin": int(best["bin"][c]), "side": bool(best["side"][c]), "left": int(best["left"][c]), "right": int(best["right"][c])}
            rows.append(first | {"node": node, "counts": counts[c].tobytes(), **split})
        return pa.Table.from_pylist(rows, schema)

    counted = counted.withColumn("_over", F.expr("node div 2"))
    if before is None:
        return counted.groupBy(*keys).applyInArrow(lambda parts: settle(parts, None), _SETTLED)
    over = before.withColumn("_over", F.col("node")).select(*keys, "counts")
    return counted.groupBy(*keys).cogroup(over.groupBy(*keys)).applyInArrow(settle, _SETTLED)


def _residuals(blocks: DataFrame, tree: DataFrame, config: BoostConfig) -> DataFrame:
    """Per training row and level the leaf it is in and what is missing there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            for entry in row["trees"]:
                node = _nodes(block, _tree(entry, config), config)
                n, level = len(node), entry["level"]
                columns = [pa.repeat(v, n) for v in block.key] + [pa.repeat(pa.scalar(level, pa.int32()), n), pa.array(node.astype(np.int32)), pa.array(block.target - block.at[level])]
                yield pa.RecordBatch.from_arrays(columns, ["service", "metric", "level", "node", "residual"])

    return _with_trees(blocks, tree).mapInArrow(work, "service string, metric string, level int, node int, residual double")


def _moved(blocks: DataFrame, tree: DataFrame, config: BoostConfig) -> DataFrame:
    """Blocks with the round's trees added to their predictions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = []
            for row in _rows(iter([batch])):
                block = _Block(row)
                at = block.at.copy()
                for entry in row["trees"]:
                    found = _tree(entry, config)
                    at[entry["level"]] += config.learning_rate * found.leaf[_nodes(block, found, config)]
                column.append(at.tobytes())
            names = batch.schema.names[: names_kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names if n != "at"), pa.array(column, pa.binary())], [*(n for n in names if n != "at"), "at"])

    names_kept = len(blocks.columns)
    return _with_trees(blocks, tree).mapInArrow(work, _BLOCK)


# --- prediction ---------------------------------------------------------------------------------


def predict(rows: DataFrame, features: Sequence[str], model: DataFrame | None, config: BoostConfig = BoostConfig()) -> DataFrame:
    """Add ``q``, the ladder of predicted values, to rows with features and ``anchor``; null for a series without a model."""
    if model is None:
        raise RuntimeError("fit before predict")
    kept = rows.columns
    parts = rows.groupBy(*SERIES).agg(F.ceil(F.count(F.lit(1)) / config.block_rows).cast("int").alias("parts"))
    # the edges of a series come with its first level
    found = model.select(*SERIES, "level", F.when(F.col("level") == 0, F.col("edges")).alias("edges"), "base", *_FIELDS)
    dealt, each = _in_parts(rows, parts), _each_part(parts.join(found, SERIES))
    schema = T.StructType([*rows.schema.fields, T.StructField("_changes", T.ArrayType(T.DoubleType()))])
    levels, nodes = len(config.levels), config.nodes

    def score(part: pa.Table, about: pa.Table) -> pa.Table:
        part = part.select(kept)
        if not part.num_rows or not about.num_rows:
            return part.append_column("_changes", pa.nulls(part.num_rows, pa.list_(pa.float64())))
        models = about.select(["level", "edges", "base", *_FIELDS]).to_pylist()
        edges = [np.array(e) for m in models if m["level"] == 0 for e in m["edges"]]
        bins, missing = grown.to_bins(_matrix(part, features), edges), grown.slots_of(edges) - 1
        out = np.full((part.num_rows, levels), np.nan)
        for m in models:
            arrays = grown.unpacked(*(np.frombuffer(m[name], kind) for name, kind in _FIELDS.items()), nodes)
            out[:, m["level"]] = grown.add_up(bins, m["base"], *arrays, config.learning_rate, config.depth, missing)
        offsets = np.arange(part.num_rows + 1, dtype=np.int32) * levels
        return part.append_column("_changes", pa.ListArray.from_arrays(offsets, out.ravel()))

    keys = [*SERIES, "_part"]
    scored = dealt.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(score, schema)
    q = F.when(F.col("_changes").isNotNull(), anchored(F.col("_changes"))).alias("q")
    return scored.select(*kept, q)


def _level_numbers(config: BoostConfig) -> Column:
    return F.array(*[F.lit(i) for i in range(len(config.levels))])
