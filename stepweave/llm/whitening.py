"""Whitening of embeddings by their own covariance.

Vectors become whole numbers, each different one counts once. Sums per dimension are exact; the scatter is summed from
vectors that were centred before, task by task, and reduced by rows of the matrix. What reaches the driver is one
number and one matrix of dimensions x dimensions, whatever the number of vectors. There the scatter V is factored as
L L' by Cholesky with the greatest remaining diagonal first, and one-sided Jacobi rotates the columns of the
triangular L itself until they are orthogonal: V = (L J)(L J)', so their norms are the roots of the eigenvalues
and the columns over their norms the components. V is never iterated on, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import stored


@dataclass(frozen=True)
class Whitening:
    components: int = 16
    scale: int = 64
    shift: int = 1_000_000


LARGEST = 2**50  # whole numbers stay within this, so that sums of a slice are exact
SLICE = 4096
SWEEPS = 60


def whiten(
    vectors: DataFrame, config: Whitening = Whitening(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable row of ``vectors`` and component: id, component, n, deviation, whitened, explained,
    identity_error.

    An entry c counts as floor(scale * c) + shift, held within 2^50 either way. Rows whose vector is null, empty, holds a null or non-finite
    entry, or has not the commonest number of entries (the greater one at ties) are left out. ``n`` is the
    number of different vectors, which are what is fitted; repeated rows and rows of a null id are returned like any
    other. ``deviation``, decimal(38,0), is the exact sum over dimensions of (n x - S)^2, S being the sum of x over the fitted vectors;
    null if it has more than 38 digits. Only components of positive variance are returned (against rounding: above 1e-13 of the greatest),
    none if all vectors are equal or the table is empty. Component signs are those that make the entry of greatest size positive.
    Other columns are ignored.
    """
    rows, fitted = _whole_numbers(vectors, config, id_col, vector_col)
    model = _fit(fitted, config)
    if model is None:
        return rows.where("false").select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in OUT])
    error = _identity_error(fitted, model)
    kind = rows.schema["id"].dataType.simpleString()
    fields = ", ".join(f"{c} {t}" for c, t in OUT)
    out = rows.mapInArrow(lambda batches: _project(batches, model, error), f"id {kind}, {fields}")
    return out.withColumnRenamed("id", id_col)


OUT = [
    ("component", "int"),
    ("n", "long"),
    ("deviation", "decimal(38,0)"),
    ("whitened", "double"),
    ("explained", "double"),
    ("identity_error", "double"),
]


@dataclass(frozen=True)
class Model:
    """The mean is ``offset``, whole numbers, plus ``rest``, at least 0 and below 1."""

    n: int
    sums: list[int]
    offset: np.ndarray
    rest: np.ndarray
    directions: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # eigenvalues of the covariance
    explained: np.ndarray


def _whole_numbers(vectors: DataFrame, config: Whitening, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where((F.size("v") > 0) & fine)
    # Bounded before the cast, so that no entry overflows.
    edge = float(LARGEST - config.shift)
    whole = F.transform(
        "v", lambda c: F.floor(F.greatest(F.least(c * config.scale, F.lit(edge)), F.lit(-edge))) + config.shift
    )
    rows = stored(rows.select("id", whole.alias("x")), "whole-vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if sizes:
        rows = rows.where(F.size("x") == sizes[0].d)
    # The whole vector is the key: copies meet in partial aggregates, no row is hot.
    return rows, stored(rows.select("x").distinct(), "fitted")


def _fit(fitted: DataFrame, config: Whitening) -> Model | None:
    parts = fitted.mapInArrow(_sums, "j int, s decimal(38,0), n long")
    totals = sorted(parts.groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())
    if not totals:
        return None
    n, sums = totals[0].n, [int(t.s) for t in totals]
    offset = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    d = len(sums)
    scatter = np.zeros((d, d))
    partial = fitted.mapInArrow(lambda b: _scatter(b, offset, rest), "i int, row array<double>")
    # Rows of the matrix are summed where they meet, in as many tasks as there are rows, before any reaches the driver.
    for r in partial.repartition(F.col("i")).mapInArrow(_add_rows, "i int, row array<double>").collect():
        scatter[r.i] += r.row
    covariance = (scatter + scatter.T) / (2 * n)
    values, directions = components_of(covariance)
    good = values > 1e-13 * values[:1].sum()
    keep = np.flatnonzero(good)[: config.components]
    if not len(keep):
        return None
    return Model(n, sums, offset, rest, directions[:, keep], values[keep], values[keep] / np.trace(covariance))


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; only of the part that Cholesky reaches."""
    factor = pivoted_cholesky(covariance)
    rotated = jacobi(factor)
    norms = np.linalg.norm(rotated, axis=0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    directions = rotated[:, order] / norms[order]
    strongest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[strongest, np.arange(len(order))] < 0, -1, 1)
    return norms[order] ** 2, directions


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Dimensions x rank; ``matrix`` = factor @ factor.T, and factor is lower triangular in the order of its pivots."""
    rest = np.array(matrix, float)
    d = len(rest)
    factor = np.zeros((d, d))
    left = np.ones(d, bool)
    start = np.diagonal(rest).max(initial=0.0)
    for k in range(d):
        pivot = int(np.where(left, np.diagonal(rest), -np.inf).argmax())
        if rest[pivot, pivot] <= start * d * 1e-16:
            return factor[:, :k]
        column = np.where(left, rest[:, pivot], 0) / np.sqrt(rest[pivot, pivot])
        factor[:, k] = column
        left[pivot] = False
        rest -= np.outer(column, column)
    return factor


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal, all disjoint pairs of a round at once."""
    a = np.array(factor)
    rank = a.shape[1]
    players = list(range(rank)) + [-1] * (rank % 2)
    half = len(players) // 2
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(x, y) for x, y in zip(players[:half], reversed(players[half:]), strict=True) if x >= 0 and y >= 0]
            players.insert(1, players.pop())
            p, q = np.array(pairs).T
            ap, aq = a[:, p], a[:, q]
            pp, qq, pq = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(pp * qq)
            turn = np.abs(pq) > 1e-16 * size
            worst = max(worst, float((np.abs(pq)[turn] / size[turn]).max(initial=0.0)))
            zeta = (qq - pp) / np.where(turn, 2 * pq, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
        if worst < 1e-15:
            break
    return a


def _identity_error(fitted: DataFrame, model: Model) -> float:
    """Largest entry, in size, of the covariance of the whitened fitted vectors minus the identity."""
    k = len(model.values)
    partial = fitted.mapInArrow(lambda b: _whitened_scatter(b, model), "i int, row array<double>")
    total = np.zeros((k + 1, k))
    for r in partial.repartition(F.col("i")).mapInArrow(_add_rows, "i int, row array<double>").collect():
        total[r.i] += r.row
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


# In tasks


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield _matrix(batch["x"].slice(at, SLICE))


def _decimals(values) -> pa.Array:
    return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _slices(batches):
        d = x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), _decimals(x.sum(axis=0)), pa.array([len(x)] * d, pa.int64())], ["j", "s", "n"]
        )


def _rows_of(matrix: np.ndarray) -> pa.RecordBatch:
    n, d = matrix.shape
    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(matrix.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), rows], ["i", "row"])


def _scatter(batches: Iterator[pa.RecordBatch], offset: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _slices(batches):
        y = (x - offset).astype(float) - rest
        total = y.T @ y + (0 if total is None else total)
    if total is not None:
        yield _rows_of(total)


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal row numbers; as many as the matrix has rows, at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch["i"].to_pylist(), _matrix(batch["row"]), strict=True):
            total[i] = total[i] + row if i in total else row
    if total:
        rows = _rows_of(np.array(list(total.values())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), rows["row"]], ["i", "row"])


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    centred = (x - model.offset).astype(float) - model.rest
    return centred @ model.directions / np.sqrt(model.values)


def _whitened_scatter(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _slices(batches):
        w = _whitened(x, model)
        part = np.vstack([w.T @ w, w.sum(axis=0)])
        total = part if total is None else total + part
    if total is not None:
        yield _rows_of(total)


def _deviations(x: np.ndarray, model: Model) -> pa.Array:
    """Sum of (n x - S)^2, in 64-bit integers where they hold it."""
    largest = np.abs((x - model.offset).astype(float)).max(initial=0.0) + 1
    if (largest * model.n) ** 2 * x.shape[1] < 2**62:
        rest = np.array([s - model.n * int(o) for s, o in zip(model.sums, model.offset, strict=True)], np.int64)
        gap = (x - model.offset) * model.n - rest
        return _decimals((gap * gap).sum(axis=1))
    sums = np.array(model.sums, object)
    exact = [int(((row * model.n - sums) ** 2).sum()) for row in x.astype(object)]
    # Arrow takes whole numbers of this size as decimals only.
    from decimal import Decimal

    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def _project(batches: Iterator[pa.RecordBatch], model: Model, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = _matrix(part["x"])
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"].take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(m, model.n, np.int64)),
                    _deviations(x, model).take(rows),
                    pa.array(_whitened(x, model).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(m, error)),
                ],
                ["id", *[c for c, _ in OUT]],
            )
