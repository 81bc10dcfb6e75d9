"""Whitening of vectors on their principal components by incremental eigendecomposition.

1. Every task keeps count, mean and the eigendecomposition of the scatter of what it has read. A vector changes the scatter by a
   centred rank-one term, n / (n + 1) (x - mean) (x - mean)': the new eigenvalues are the roots of the secular equation, found for all
   intervals between poles at once, after deflation (equal eigenvalues are reflected into one direction, directions without share
   keep their pair). Weights are then recomputed from the roots, so that the new eigenvectors are orthogonal.
2. Spectra of tasks are united in rounds of ``together`` at most: each eigenpair of one is a rank-one term for the other, and
   so is the distance of the means. A round's state is a square matrix, whatever the number of vectors.
3. A last pass over all vectors takes the covariance in the basis found, and its small eigenproblem (Rayleigh-Ritz on the whole
   basis) gives the components to double precision.

Vectors that are null, or hold nulls or entries that are not finite (or from 2^52 on, which have no whole number of 64 bits), are
dropped. So are those whose length is not the most frequent
one (the larger of equally frequent ones); an empty vector counts as such a length, and of a table of these nothing is left. Repeated and missing
ids are rows like others; extra columns go along where ``whiten`` is used on its own. Along a component without variance nothing can be
scaled to one: ``whitened`` is null and ``explained`` 0 there. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.llm.common import free_name
from sparkwatch.session import discard, stored

STATE = "id long, n long, mean binary, basis binary, values binary"


@dataclass(frozen=True)
class WhiteningConfig:
    components: int = 8
    #: Vectors that one spectrum is built from, while that takes no more than ``most_tasks`` spectra.
    vectors_per_task: int = 4096
    most_tasks: int = 20_000
    together: int = 16
    #: Eigenvalues nearer than this share of the largest count as equal, weights below it as none.
    tolerance: float = 1e-14


# --- one eigendecomposition ---------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - x)), one right of each pole; poles ascend, weights are positive.

    A root is the pole it is nearest to (first result, an index) and its distance from it (second), which keeps its digits near poles.
    All roots are found at once: bisection inside their intervals, sped up by the rational model of both neighbouring poles.
    """
    k = len(poles)
    total = weights.sum()
    right = np.append(poles[1:], poles[-1] + total)
    gap = right - poles
    own = np.arange(k)
    apart = poles[:, None] - poles[None, :]  # [i, j] = pole i - pole j

    middle = 1.0 + (weights[:, None] / (apart - gap / 2)).sum(0)
    nearer_right = middle < 0
    nearer_right[-1] = False  # the last interval ends at no pole
    base = own + nearer_right
    shifted = poles[:, None] - poles[base][None, :]
    low = np.where(nearer_right, -gap / 2, 0.0)
    high = np.where(nearer_right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1] * (1 + 1e-14)  # the root may be the end itself
    else:
        low[-1], high[-1] = 0.0, gap[-1] / 2
    at = (low + high) / 2
    left = own[:, None] <= own[None, :]  # poles at or left of the interval
    to_left = poles - poles[base]
    to_right = np.append(poles[1:], poles[-1]) - poles[base]
    for _ in range(60):
        d = shifted - at
        share = weights[:, None] / d
        slope = share / d
        value = 1.0 + share.sum(0)
        low = np.where(value < 0, at, low)
        high = np.where(value >= 0, at, high)
        bound = 1.0 + np.abs(share).sum(0)
        done = (np.abs(value) <= 4e-16 * k * bound) | (high - low <= 4e-16 * np.abs(at))
        if done.all():
            break
        # value = c + s / (left pole - x) + t / (right pole - x), with slopes of the poles on either side
        below = np.where(left, slope, 0.0).sum(0)
        above = slope.sum(0) - below
        a, b = to_left - at, to_right - at
        c = value - below * a - above * b
        s, t = below * a * a, above * b * b
        c[-1], t[-1] = value[-1] - below[-1] * a[-1], 0.0
        # c (a - y)(b - y) + s (b - y) + t (a - y) = 0 for the step y
        q1 = c * (a + b) + s + t
        q0 = c * a * b + s * b + t * a
        root = np.sqrt(np.maximum(q1 * q1 - 4 * c * q0, 0.0))
        big = q1 + np.where(q1 >= 0, root, -root)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = [big / (2 * c), 2 * q0 / big]
            steps[0][-1] = steps[1][-1] = a[-1] + s[-1] / c[-1]  # no pole on the right: one root
        best = (low + high) / 2
        for step in steps:
            tried = at + step
            best = np.where((tried > low) & (tried <= high), tried, best)  # false for NaN
        at = np.where(done, at, best)
    return base, at


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, scale: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of basis diag(values) basis' + scale vector vector'; scale is positive."""
    z = vector @ basis
    norm = float(z @ z)
    if not norm * scale > 0:
        return values, basis
    largest = max(abs(values[-1]), abs(values[0]), scale * norm)
    # equal eigenvalues: a reflection turns the share of all of them into the first direction
    ends = np.flatnonzero(np.diff(values) > tolerance * largest) + 1
    starts = np.concatenate(([0], ends))
    if len(starts) < len(values):
        basis = basis.copy()
        z = z.copy()
        for start, end in zip(starts, np.append(ends, len(values))):
            if end - start > 1:
                part = z[start:end]
                size = np.sqrt(part @ part)
                if size > 0:
                    mirror = part.copy()
                    mirror[0] += np.copysign(size, part[0])
                    mirror /= np.sqrt(mirror @ mirror)
                    basis[:, start:end] -= np.outer(basis[:, start:end] @ mirror, 2 * mirror)
                    z[start] = -np.copysign(size, part[0])
                    z[start + 1 : end] = 0.0
    # directions without a share of the vector keep their pair
    live = np.flatnonzero(scale * np.abs(z) * np.sqrt(norm) > tolerance * largest)
    if not len(live):
        return values, basis
    poles, weights = values[live], scale * z[live] ** 2
    base, at = secular_roots(poles, weights)
    away = (poles[:, None] - poles[base][None, :]) - at  # [i, j] = pole i - root j
    # the weights for which these roots are exact (Loewner), from ratios near one
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = away / (poles[:, None] - poles[None, :])
    np.fill_diagonal(ratio, -np.diag(away))
    exact = np.copysign(np.sqrt(np.abs(ratio.prod(1))), z[live])
    vectors = exact[:, None] / away
    vectors /= np.sqrt((vectors * vectors).sum(0))
    changed = basis.copy()
    changed[:, live] = basis[:, live] @ vectors
    new = values.copy()
    new[live] = poles[base] + at
    order = np.argsort(new, kind="stable")
    return new[order], changed[:, order]


@dataclass
class Spectrum:
    """Count, mean and the eigendecomposition of the scatter around it."""

    n: int
    mean: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.eye(size), np.zeros(size))

    def add(self, vectors: np.ndarray, tolerance: float) -> None:
        for x in vectors:
            away = x - self.mean
            if self.n:
                self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1), tolerance)
            self.n += 1
            self.mean = self.mean + away / self.n

    def unite(self, other: Spectrum, tolerance: float) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.basis, self.values = other.n, other.mean, other.basis, other.values
            return
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, value, tolerance)
        away = other.mean - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / (self.n + other.n), tolerance)
        self.mean = self.mean + away * (other.n / (self.n + other.n))
        self.n += other.n

    def row(self, number: int) -> dict:
        return {"id": number, "n": self.n, "mean": self.mean.tobytes(), "basis": np.ascontiguousarray(self.basis).tobytes(), "values": self.values.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        return cls(row["n"], mean, np.frombuffer(row["basis"]).reshape(len(mean), len(mean)), np.frombuffer(row["values"]))


_STATE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("basis", pa.binary()), ("values", pa.binary())])


# --- passes over the vectors --------------------------------------------------------------------


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite entries only, all of the most frequent length."""
    v = F.col(column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(1 << 52)))
    kept = rows.where(v.isNotNull() & finite)
    # a row per length
    lengths = kept.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    return kept.where((F.size(v) == size) & (F.size(v) > 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass(frozen=True)
class Components:
    """What whitening needs: exact sums, components (columns, by falling eigenvalue), eigenvalues, their shares of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # Python divides whole numbers with one rounding

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN along components without variance."""
        n = self.n
        whole = np.array([s // n for s in self.sums], np.int64)
        part = np.array([(s % n) / n for s in self.sums])
        # whole numbers first: x and the mean agree in their leading digits
        centred = (x - whole).astype(np.float64) - part
        with np.errstate(divide="ignore"):
            scale = np.where(self.explained > 0, 1 / np.sqrt(self.values), np.nan)
        return (centred @ self.vectors) * scale


def sums(rows: DataFrame, column: str) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their exact sums per dimension; an exact sum is a decimal, which does not overflow."""
    per = rows.select(F.posexplode(column).alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["d"], int(r["s"]), r["n"]) for r in per.collect())  # a row per dimension
    return (found[0][2] if found else 0), tuple(s for _, s, _ in found)


def spectrum(rows: DataFrame, column: str, n: int, size: int, config: WhiteningConfig = WhiteningConfig()) -> Spectrum:
    """The incremental eigendecomposition of all vectors."""
    tolerance, together = config.tolerance, config.together

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Spectrum.empty(size)
        for batch in batches:
            state.add(_matrix(batch.column(0)).astype(np.float64), tolerance)
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], _STATE)

    def unite(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        state = Spectrum.read(rows[0])
        for row in rows[1:]:
            state.unite(Spectrum.read(row), tolerance)
        return pa.Table.from_pylist([state.row(rows[0]["id"] // together)], _STATE)

    tasks = min(config.most_tasks, max(1, -(-n // config.vectors_per_task)))
    # dealt row by row: neither a frequent vector nor a large file makes a task longer than others
    states = stored(rows.select(column).repartition(tasks).mapInArrow(build, STATE))
    while tasks > 1:
        fewer = stored(states.groupBy(F.floor(F.col("id") / together)).applyInArrow(unite, STATE))
        discard(states)
        states, tasks = fewer, -(-tasks // together)
    (row,) = states.collect()  # one matrix
    discard(states)
    return Spectrum.read(row.asDict())


def _moments(rows: DataFrame, column: str, change, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares (a matrix) of ``change`` of all vectors, as one row per task, added up by Spark."""
    schema = pa.schema([("total", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for batch in batches:
            made = change(_matrix(batch.column(0)))
            total[:size] += made.sum(0)
            total[size:] += (made.T @ made).ravel()
        yield pa.RecordBatch.from_pylist([{"total": total}], schema)

    parts = rows.select(column).mapInArrow(work, "total array<double>")
    added = parts.select(F.posexplode("total").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in added])
    return flat[:size], flat[size:].reshape(size, size)


def fit(rows: DataFrame, column: str, config: WhiteningConfig = WhiteningConfig()) -> Components | None:
    """The components of all whole-number vectors in ``column``, which have one length; None if there are none."""
    n, total = sums(rows, column)
    if not n:
        return None
    found = spectrum(rows, column, n, len(total), config)
    basis, whole = found.basis, np.array([s // n for s in total], np.int64)
    part = np.array([(s % n) / n for s in total])
    _, scatter = _moments(rows, column, lambda x: ((x - whole).astype(np.float64) - part) @ basis, len(total))
    values, turns = np.linalg.eigh(scatter / n)
    trace = float(np.trace(scatter)) / n
    order = np.argsort(-values, kind="stable")[: config.components]
    values = values[order]
    vectors, _ = np.linalg.qr(basis @ turns[:, order])  # the basis is orthogonal up to rounding; make it exactly so
    vectors = vectors * np.sign((vectors * (basis @ turns[:, order])).sum(0))
    some = values > max(trace, 0.0) * len(total) * 1e-15
    return Components(n, total, vectors, np.where(some, values, 0.0), np.where(some, values / trace if trace else 0.0, 0.0))


def identity_error(rows: DataFrame, column: str, components: Components) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, over components with variance."""
    live = np.flatnonzero(components.explained > 0)
    if not len(live):
        return 0.0
    total, squares = _moments(rows, column, lambda x: components.project(x)[:, live], len(live))
    mean = total / components.n
    return float(np.abs(squares / components.n - np.outer(mean, mean) - np.eye(len(live))).max())


def whiten(rows: DataFrame, column: str, components: Components, out: str = "whitened") -> DataFrame:
    """``rows`` with ``out``, an array of the whitened coordinates, null along components without variance."""

    def work(x: pa.Array) -> pa.Array:
        made = components.project(_matrix(x))
        values = pa.array(made.ravel(), from_pandas=True)  # NaN to null
        return pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], values)

    return rows.withColumn(free_name(rows, out), F.arrow_udf(work, "array<double>")(column))


def deviation(components: Components, column: str) -> Column:
    """Per vector the exact sum over dimensions of (n x - sum)^2; null beyond the range of a long."""
    return F.arrow_udf(_deviations(components), "long")(column)


def _deviations(components: Components):
    n, total = components.n, components.sums

    def work(x: pa.Array) -> pa.Array:
        m = _matrix(x)
        if not len(m):
            return pa.array([], pa.int64())
        away = m.astype(np.float64) * n - np.array(total, np.float64)
        if (away * away).sum(1).max() < 4e18 and abs(m).max() * n < 4e18:
            exact = m * n - np.array(total, np.int64)
            return pa.array((exact * exact).sum(1))
        made = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in m]
        return pa.array([d if d < 1 << 63 else None for d in made], pa.int64())

    return work


def whole_numbers(column: Column) -> Column:
    """Entries as whole numbers, 1024 steps to one, raised by 100,000."""
    return F.transform(column, lambda c: F.try_add(F.floor(F.lit(1024.0) * c.cast("double")).cast("long"), F.lit(100_000).cast("long")))


def report(embeddings: DataFrame, config: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """A row per usable vector and component."""
    rows = usable(embeddings.select("vec_id", "embedding")).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    components = fit(rows, "x", config)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if components is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, "x", components)
    numbers = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(e)).alias("explained")) for i, e in enumerate(components.explained)])
    done = whiten(rows, "x", components).select("vec_id", deviation(components, "x").alias("deviation"), F.explode(F.arrays_zip(numbers.alias("c"), F.col("whitened").alias("w"))).alias("p"))
    return done.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("p.c.component").alias("component"),
        F.lit(components.n).cast("long").alias("n"),
        "deviation",
        F.col("p.w").alias("whitened"),
        F.col("p.c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
