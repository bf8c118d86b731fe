"""Embedding whitening by a tall-skinny QR decomposition (TSQR).

Entries become integers, x = floor(``SCALE`` * c) + ``OFFSET``, so sums are
exact.  One pass sums each dimension; a second centres the rows with these sums
and folds them, batch by batch, into one R factor a task; R factors are merged
as a tree, ``FAN`` at a time, until one is left, whose singular vectors are the
covariance's eigenvectors: the covariance itself is never formed.  Rows are then
projected on those and divided by the deviation along each.  A last pass
measures what is left between the whitened rows' covariance and the identity.

What reaches the driver are sums and one R factor, dimensions times dimensions
at most; a task holds one batch and one R factor, or ``FAN`` of them.

Vectors that are null or hold null or non-finite entries take no part.  Nor do
vectors of another length than most (of two lengths that are as frequent, the
shorter counts); an empty vector has no dimensions and is left out too.  Rows
that repeat are rows each, and null ids stay.  Integers saturate at 62 bits, and
sums and deviations stay exact beyond 64: only where a result must be a long does
a larger deviation become null.  Along a component without variance (dimensions
that are constant or depend on others, or a single row) whitened is null and
explained 0; where nothing varies at all, explained and identity_error are null.
Columns of the names of new ones are replaced, others may have any name.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch

SCALE, OFFSET = 1024, 100_000
#: R factors that one task merges.
FAN = 8
#: Rows centred and decomposed at a time.
BATCH = 4096
#: Magnitude at which integers saturate.
MOST = 1 << 62
#: Components of the query.
COMPONENTS = 8
_LOW = 31


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums per dimension, components (rows, unit), their variances and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def varies(self) -> np.ndarray:
        """Which components have a variance that double precision tells from none."""
        most = self.variances[0] if len(self.variances) else 0.0
        return self.variances > most * (np.finfo(float).eps * max(len(self.sums), 1)) ** 2 if most else np.zeros(len(self.variances), bool)


def _integers(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of each length of vectors (or one of them): length, which rows have it, and their entries as integers."""
    column = pc.cast(column, pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    out = []
    for size in np.unique(sizes) if length is None else [length]:
        rows = np.flatnonzero(sizes == size)
        if size <= 0 or not len(rows):
            continue
        each = values[(ends[rows] - size)[:, None] + np.arange(size)]
        finite = np.isfinite(each).all(axis=1)
        if not finite.any():
            continue
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(each[finite] * SCALE), -float(MOST), float(MOST)).astype(np.int64) + OFFSET
        out.append((int(size), rows[finite], np.clip(scaled, -MOST, MOST)))
    return sizes, out


def _sums(df: DataFrame, vector: str) -> tuple[int, tuple[int, ...]]:
    """Number of vectors of the most frequent length, and their exact sums by dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, rows, x in _integers(batch.column(0))[1]:
                n, high, low = held.get(size, (0, 0, 0))
                held[size] = n + len(rows), high + (x >> _LOW).sum(axis=0), low + (x & ((1 << _LOW) - 1)).sum(axis=0)
        for size, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "dim": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "high": high, "low": low})

    parts = df.select(F.col(f"`{vector}`")).mapInArrow(each, "size int, dim int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    of_size = parts.groupBy("size", "dim").agg(*exact).groupBy("size").agg(F.max("n").alias("n"), F.collect_list(F.struct("dim", "high", "low")).alias("dims"))
    top = of_size.orderBy(F.desc("n"), "size").limit(1).collect()
    if not top:
        return 0, ()
    return int(top[0]["n"]), tuple((int(d["high"]) << _LOW) + int(d["low"]) for d in sorted(top[0]["dims"], key=lambda d: d["dim"]))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, as exact integers: 64 bits where they suffice, else Python's."""
    if max(int(np.abs(x).max()), 1) * n < MOST and max(map(abs, sums)) < MOST:
        return x * n - np.asarray(sums, np.int64)
    return x.astype(object) * n - np.asarray(sums, object)


def _folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _packed(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})


def _factors(df: DataFrame, vector: str, n: int, sums: tuple[int, ...]) -> DataFrame:
    """One R factor of the centred rows for each task: (node, r)."""
    d = len(sums)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, d)), False
        for batch in batches:
            for _, _, x in _integers(batch.column(0), d)[1]:
                for at in range(0, len(x), BATCH):
                    r, seen = _folded(r, (_centred(x[at : at + BATCH], n, sums) / n).astype(float)), True
        if seen:
            yield _packed(TaskContext.get().partitionId(), r)

    return df.select(F.col(f"`{vector}`")).mapInArrow(each, "node long, r binary")


def _tree(factors: DataFrame, d: int, count: int) -> DataFrame:
    """Merges neighbouring R factors, ``FAN`` at a time, until one is left; ``count`` is how many places there are."""

    def merge(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for part in table.sort_by("node")["r"]:
            r = _folded(r, np.frombuffer(part.as_py()).reshape(-1, d))
        return pa.Table.from_batches([_packed(table["node"][0].as_py() // FAN, r)])

    while count > 1:
        factors = factors.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInArrow(lambda t: merge(t.drop(["parent"])), "node long, r binary")
        count = -(-count // FAN)
    return factors


def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """Principal components of all vectors, found through the merged R factor of their centred rows."""
    n, sums = _sums(df, vector)
    d = len(sums)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    with Scratch(df.sparkSession, "whitening") as scratch:
        factors = scratch.table(_factors(df, vector, n, sums))
        last = factors.agg(F.max("node")).first()[0]
        r = np.frombuffer(_tree(factors, d, last + 1).first()["r"]).reshape(-1, d)
    scale = float(np.abs(r).max()) or 1.0
    _, deviations, components = np.linalg.svd(r / scale, full_matrices=True)
    variances = np.zeros(d)
    variances[: len(deviations)] = (deviations * scale) ** 2 / n
    return Whitening(n, sums, components, variances, float(variances.sum()))


def project(df: DataFrame, fitted: Whitening, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows that take part with ``whitened`` (an entry for each component) and ``deviation`` (decimal, exact)."""
    k, n, sums = min(components, len(fitted.sums)), fitted.n, fitted.sums
    kept = df.drop("whitened", "deviation")
    schema = T.StructType([*kept.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    if not n:
        return kept.withColumn("whitened", F.lit(None).cast("array<double>")).withColumn("deviation", F.lit(None).cast("decimal(38,0)")).where(F.lit(False))
    varies = fitted.varies[:k]
    axes = fitted.components[:k].T / np.sqrt(np.where(varies, fitted.variances[:k], 1.0))
    names = kept.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, x in _integers(batch.column(names.index(vector)), len(sums))[1]:
                for at in range(0, len(rows), BATCH):
                    part, centred = rows[at : at + BATCH], _centred(x[at : at + BATCH], n, sums)
                    whitened = (centred / n).astype(float) @ axes
                    largest = max(map(abs, (int(centred.max()), int(centred.min()))))
                    exact = centred if largest * largest * len(sums) < MOST else centred.astype(object)
                    squares = [int(v) for v in (exact * exact).sum(axis=1)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * k + 1, k), pa.int32()), pa.array(whitened.reshape(-1), mask=np.tile(~varies, len(part))))
                    fits = pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(part)).columns, lists, fits], names=[*names, "whitened", "deviation"])

    return kept.mapInArrow(each, schema)


def identity_error(projected: DataFrame, fitted: Whitening, components: int = COMPONENTS) -> float | None:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity, over components that vary.

    Each task gives its number of rows, their mean and their products about it; those are merged as a tree, too."""
    varies = np.flatnonzero(fitted.varies[: min(components, len(fitted.sums))])
    k = len(varies)
    if not k:
        return None

    def packed(node: int, n: int, mean: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "n": pa.array([n], pa.int64()), "moments": pa.array([np.vstack([mean, products]).tobytes()], pa.binary())})

    def added(a: tuple, b: tuple) -> tuple:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    zero = 0, np.zeros(k), np.zeros((k, k))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zero
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, varies]
                mean = rows.mean(axis=0)
                held = added(held, (len(rows), mean, (rows - mean).T @ (rows - mean)))
        if held[0]:
            yield packed(TaskContext.get().partitionId(), *held)

    def merge(table: pa.Table) -> pa.Table:
        held, node = zero, table["node"][0].as_py() // FAN
        for row in table.sort_by("node").to_pylist():
            moments = np.frombuffer(row["moments"]).reshape(k + 1, k)
            held = added(held, (row["n"], moments[0], moments[1:]))
        return pa.Table.from_batches([packed(node, *held)])

    schema = "node long, n long, moments binary"
    with Scratch(projected.sparkSession, "whitening") as scratch:
        parts = scratch.table(projected.select("whitened").mapInArrow(each, schema))
        count = parts.agg(F.max("node")).first()[0] + 1
        while count > 1:
            parts = parts.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInArrow(lambda t: merge(t.drop(["parent"])), schema)
            count = -(-count // FAN)
        row = parts.first()
    return float(np.abs(np.frombuffer(row["moments"]).reshape(k + 1, k)[1:] / row["n"] - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The rows that take part with ``whitened`` and ``deviation``, and what was fitted on all of them."""
    fitted = fit(df, vector)
    return project(df, fitted, vector, components), fitted


def components_of_rows(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: its exact deviation, whitened coordinate and the component's share."""
    made, fitted = whiten(df.select("vec_id", "embedding"), components=components)
    error = identity_error(made, fitted, components)
    shares = [float(v / fitted.total) if fitted.total else None for v in fitted.variances[:components]]
    shares = [s if s is None or varied else 0.0 for s, varied in zip(shares, fitted.varies)]
    explained = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    rows = made.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
