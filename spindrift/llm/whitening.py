"""Whitening of embeddings: the leading components of all rows by a randomised range finder.

Entries become integers (floor(1024 c) + 100000), so sums are exact. A basis of k + 8 random directions is multiplied by the
covariance in a pass over all centred rows; the product is both the next basis (a power pass) and, by Rayleigh-Ritz, gives
the basis's own eigenpairs and their residuals. Passes are repeated until the residuals of the first k pairs are at
the level of rounding. As soon as the gain of a pass shows that POWER_PASSES passes won't get there, which is so where
eigenvalues fall slowly, the basis is expanded to the full dimension, whose one pass gives the covariance itself.

A task reads its rows in batches and gives one matrix of dimension by basis; those are added up in a tree. So memory and what
the driver holds depend on the dimension alone (its square, if the basis must be expanded), never on the rows.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped; vectors shorter than the longest
count as filled up with entries of 0; entries beyond 2^52 count as that; repeated rows count each; a null key is kept. Components
whose eigenvalue is zero to rounding can't be whitened and aren't returned, so equal vectors, a single one or an empty table
give no rows. A deviation that doesn't fit a long is null. Equal eigenvalues: any basis of their space, the same for all rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, OVERSAMPLING = 8, 8
POWER_PASSES = 4
#: Residual of an eigenpair, as a share of the first eigenvalue.
TOLERANCE = 1e-13
MOST = 1 << 52
LONG = (1 << 63) - 1


class Fit(NamedTuple):
    n: int
    sums: np.ndarray  # of Python integers, one for each dimension
    vectors: np.ndarray  # dimension x components
    values: np.ndarray  # eigenvalues, falling
    trace: float
    expanded: bool


def usable(rows: DataFrame, vector: str) -> DataFrame:
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & good)


def integers(column: pa.ListArray, dimension: int | None = None) -> np.ndarray:
    """The vectors of a batch as a matrix of longs; dimension None: that of its longest."""
    flat, lengths = np.asarray(column.flatten().cast(pa.float64())), np.diff(np.asarray(column.offsets))
    width = int(lengths.max(initial=0)) if dimension is None else dimension
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return (np.clip(np.floor(1024 * np.clip(out, -MOST, MOST)), -MOST, MOST) + 100000).astype(np.int64)


def exact_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Sums as Python integers, which can't overflow."""
    fits = x.size == 0 or x.dtype != object and max(abs(int(x.max())), abs(int(x.min()))) < LONG // x.shape[axis]
    return (x if fits else x.astype(object)).sum(axis=axis).astype(object)


def _added(rows: DataFrame, vector: str, zero, step, merge):
    """What `step` makes of all batches of a task, from `zero`, merged over the tasks in a tree."""

    def run(batches):
        out = zero
        for b in batches:
            out = merge(out, step(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["part"])

    return rows.select(vector).mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate(zero, merge, merge)


def totals(rows: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension."""

    def step(column):
        x = integers(column)
        return {x.shape[1]: (len(x), exact_sum(x, 0))}

    def merge(a: dict, b: dict) -> dict:
        if not a or not b:
            return a or b
        (d, (m, s)), (e, (n, t)) = *a.items(), *b.items()
        width = max(d, e)
        fill = lambda v, rows: np.concatenate([v, np.full(width - len(v), 100000 * rows, object)])
        return {width: (m + n, fill(s, m) + fill(t, n))}

    got = _added(rows, vector, {}, step, merge)
    return next(iter(got.values())) if got else (0, np.array([], object))


def covered(rows: DataFrame, vector: str, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times the basis, and the covariance's trace, from one pass over all centred rows."""
    mean = (sums / n).astype(float)

    def step(column):
        x = integers(column, len(mean)) - mean
        return x.T @ (x @ basis), float((x * x).sum())

    product, squares = _added(rows, vector, (np.zeros_like(basis), 0.0), step, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return product / n, squares / n


def fit(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, passes: int = POWER_PASSES) -> Fit | None:
    """The first k components of all rows; None without rows."""
    n, sums = totals(rows, vector)
    d = len(sums)
    if not n or not d:
        return None
    basis, last = np.linalg.qr(np.random.default_rng(d).normal(size=(d, min(d, k + OVERSAMPLING))))[0], np.inf
    for done in range(passes + 2):
        product, trace = covered(rows, vector, n, sums, basis)
        small = basis.T @ product
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        vectors = basis @ inner
        residual = np.linalg.norm(product @ inner - vectors * values, axis=0)[:k].max()
        if basis.shape[1] == d or residual <= TOLERANCE * values[0]:
            break
        left = residual * (residual / last) ** (passes - done)  # if the next passes gain what this one did; at first unknown
        basis, last = np.linalg.qr(product)[0] if left <= TOLERANCE * values[0] else np.eye(d), residual
    whole = values[:k] > d * np.finfo(float).eps * values[0]
    return Fit(n, sums, vectors[:, :k][:, whole], values[:k][whole], trace, basis.shape[1] == d)


def projected(x: np.ndarray, model: Fit) -> np.ndarray:
    return (x - (model.sums / model.n).astype(float)) @ model.vectors / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """The exact sums of (n x - S)^2."""
    sums, most = model.sums, max(abs(int(s)) for s in model.sums)
    top = model.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + most
    y = model.n * x - sums.astype(np.int64) if top < LONG else model.n * x.astype(object) - sums
    if y.dtype != object and (y.size == 0 or max(abs(int(y.max())), abs(int(y.min()))) ** 2 * y.shape[1] > LONG):
        y = y.astype(object)
    return [int(v) if v <= LONG else None for v in (y * y).sum(axis=1)]


def identity_error(rows: DataFrame, vector: str, model: Fit) -> float:
    """The largest entry of the whitened rows' covariance, minus the identity."""
    k = len(model.values)

    def step(column):
        w = projected(integers(column, len(model.sums)), model)
        return w.T @ w, w.sum(axis=0)

    squares, sums = _added(rows, vector, (np.zeros((k, k)), np.zeros(k)), step, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    mean = sums / model.n
    return float(np.abs(squares / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, passes: int = POWER_PASSES) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    own = usable(rows.select(F.col(key).alias(key), F.col(vector).alias(vector)), vector)
    kind = own.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(own, vector, k, passes)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, count = identity_error(own, vector, model), len(model.values)

    def run(batches):
        for b in batches:
            x = integers(b.column(1), len(model.sums))
            each = np.repeat(np.arange(len(x)), count)
            columns = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), model.n)), pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                pa.array(projected(x, model).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema)
