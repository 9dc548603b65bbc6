"""Many logistic regressions over the same rows, fitted together: a step of all of them is one pass.

The objective is that of pyspark.ml's LogisticRegression without standardisation: mean loss + penalty / 2 * |w|^2, the
intercept free. A pass is a job whose tasks add up losses and gradients of all models by block products. The steps are
L-BFGS in coordinates in which the curvature is one at most: a row's curvature is a quarter at most, so the features'
covariance bounds it. Few passes are needed then, however weak the penalty is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK, STRIPES, MEMORY, MAX_ITER, TOLERANCE = 512, 16, 10, 1000, 1e-10


@dataclass
class Model:
    """Of label number `label`, fitted on the rows whose fold isn't `without`; n rows, of which a share `positive` has label 1."""

    label: int
    without: int
    penalty: float
    n: int
    positive: float
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: float = 0.0


def blocks(batches: Iterator[pa.RecordBatch], size: int, most: int = BLOCK, kind: type = float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (fold, labels, features): folds, labels by column, and dense features, a few rows at a time."""
    x = np.zeros((most, size), kind)
    for b in batches:
        folds, labels = b.column(0).to_numpy(), [c.to_numpy() for c in b.columns[1:-1]]
        vectors = b.column(b.num_columns - 1)
        lists = vectors.field("indices")
        ends, index, value = lists.offsets.to_numpy(), lists.values.to_numpy(), vectors.field("values").values.to_numpy()
        for i in range(0, b.num_rows, most):
            n = min(most, b.num_rows - i)
            own = slice(ends[i], ends[i + n])
            row = np.repeat(np.arange(n), np.diff(ends[i : i + n + 1]))
            x[row, index[own]] = value[own]
            yield folds[i : i + n], np.stack([y[i : i + n] for y in labels], 1).astype(float), x[:n]
            x[row, index[own]] = 0.0


def _products(size: int) -> Callable:
    """A task's sum of the products of features by each other, in STRIPES, as single floats, and with each the sum of features."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((size, size), np.float32), np.zeros(size), 0
        for _, _, x in blocks(batches, size, 2048, np.float32):
            total += x.T @ x
            sums += x.sum(0, dtype=float)
            n += len(x)
        for i, part in enumerate(np.array_split(total, STRIPES) if n else []):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())], ["stripe", "n", "sums", "part"])

    return multiply


def _summed(t: pa.Table) -> pa.Table:
    sums, part = (sum(np.frombuffer(v.as_buffer(), kind).astype(float) for v in t[c]) for c, kind in (("sums", float), ("part", np.float32)))
    return pa.table({"stripe": t["stripe"][:1], "n": [sum(t["n"].to_pylist())], "sums": pa.array([sums.tobytes()], pa.binary()), "part": pa.array([part.astype(np.float32).tobytes()], pa.binary())})


def spread_of(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and, in single precision, covariance of the features of rows (fold, labels, features)."""
    kind = "stripe int, n long, sums binary, part binary"
    found = sorted(rows.mapInArrow(_products(size), kind).groupBy("stripe").applyInArrow(_summed, kind).collect(), key=lambda r: r["stripe"])
    n, mean = found[0]["n"], np.frombuffer(found[0]["sums"]) / found[0]["n"]
    products = np.concatenate([np.frombuffer(r["part"], np.float32) for r in found]).reshape(size, size)
    return mean, products / n - np.outer(mean, mean)


def probability(margin: np.ndarray) -> np.ndarray:
    # of two equal expressions the one that can't overflow
    small = np.exp(-np.abs(margin))
    return np.where(margin >= 0, 1.0, small) / (1.0 + small)


def _added(w: np.ndarray, b: np.ndarray, label: np.ndarray, without: np.ndarray) -> Callable:
    """A task's sums for models by column: losses, residuals, and residuals times features."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, rest, slope = np.zeros(len(b)), np.zeros(len(b)), np.zeros(w.shape)
        for folds, labels, x in blocks(batches, len(w)):
            margin, y = x @ w + b, labels[:, label]
            small = np.exp(-np.abs(margin))
            inside = folds[:, None] != without
            loss += np.where(inside, np.log1p(small) + np.maximum(margin, 0) - y * margin, 0.0).sum(0)
            error = np.where(inside, np.where(margin >= 0, 1.0, small) / (1.0 + small) - y, 0.0)
            rest += error.sum(0)
            slope += x.T @ error
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (loss, rest, slope)], ["loss", "rest", "slope"])

    return add


def scored(rows: DataFrame, models: list[Model], own: bool) -> DataFrame:
    """(model, y, p) of rows (fold, labels, features): the label and the probability by each model; own: of the fold left out alone."""
    w, b = np.stack([m.w for m in models], 1), np.array([m.b for m in models])
    label, without = [m.label for m in models], [m.without for m in models]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folds, labels, x in blocks(batches, len(w)):
            at, m = np.nonzero((folds[:, None] == np.array(without)) | (not own))
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(labels[:, label][at, m].astype(np.int32)), pa.array(probability(x @ w + b)[at, m])], ["model", "y", "p"])

    return rows.mapInArrow(score, "model int, y int, p double")


class _Descent:
    """L-BFGS of one model: a point, where to evaluate next, and the last changes of point and gradient."""

    def __init__(self, start: np.ndarray):
        self.trial, self.point, self.steps, self.left = start, None, [], MAX_ITER

    def take(self, value: float, slope: np.ndarray) -> bool:
        """Takes value and gradient at the trial point; whether more is to do."""
        if self.point is None:
            self.least = max(TOLERANCE * (slope @ slope), 1e-26)
        elif value > self.value + 1e-4 * self.length * (self.slope @ self.way) + 1e-14 * abs(self.value):
            self.length /= 2
            self.trial = self.point + self.length * self.way
            return self.length > 1e-9
        else:
            s, y = self.trial - self.point, slope - self.slope
            if s @ y > 1e-12 * (s @ s):
                self.steps = [*self.steps, (s, y, 1 / (s @ y))][-MEMORY:]
            self.left -= 1
        self.point, self.value, self.slope = self.trial, value, slope
        if self.left <= 0 or slope @ slope <= self.least:
            return False
        way, back = -slope, []
        for s, y, r in reversed(self.steps):
            back.append(r * (s @ way))
            way = way - back[-1] * y
        if self.steps:
            s, y, r = self.steps[-1]
            way = way / (r * (y @ y))
        for (s, y, r), a in zip(self.steps, reversed(back)):
            way = way + (a - r * (y @ way)) * s
        self.way, self.length = way, 1.0
        self.trial = self.point + way
        return True


def fit(rows: DataFrame, models: list[Model]) -> int:
    """Fits all models on rows (fold, labels, features), which should be cached; fills in w and b and gives the passes.

    The driver holds a square of the features and some vectors a model.
    """
    if not models:
        return 0
    mean, covariance = spread_of(rows, rows.select("features").first()["features"].size)
    spread, turn = np.linalg.eigh(covariance)
    # by model: what a unit of the new coordinates is along each axis; the intercept's curvature is a quarter
    unit = np.stack([1 / np.sqrt(np.maximum(spread, 0) / 4 + m.penalty) for m in models], 1)
    label, without, n = np.array([m.label for m in models]), np.array([m.without for m in models]), np.array([m.n for m in models])
    penalty = np.array([m.penalty for m in models])
    runs = [_Descent(np.append(np.zeros(len(mean)), np.log(m.positive / (1 - m.positive)) / 2)) for m in models]

    def placed(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = turn @ (unit[:, which] * points[:-1])
        return w, 2 * points[-1] - mean @ w

    todo, passes = np.arange(len(models)), 0
    while len(todo):
        w, b = placed(np.stack([runs[i].trial for i in todo], 1), todo)
        parts = rows.mapInArrow(_added(w, b, label[todo], without[todo]), "loss binary, rest binary, slope binary").collect()
        loss, rest, slope = (sum(np.frombuffer(r[c]) for r in parts) for c in ("loss", "rest", "slope"))
        slope = slope.reshape(w.shape) - np.outer(mean, rest)
        value = loss / n[todo] + penalty[todo] / 2 * (w * w).sum(0)
        turned = unit[:, todo] * (turn.T @ (slope / n[todo] + penalty[todo] * w))
        slopes = np.vstack([turned, 2 * rest / n[todo]])
        todo, passes = np.array([i for k, i in enumerate(todo) if runs[i].take(value[k], slopes[:, k])], int), passes + 1
    for i, m in enumerate(models):
        w, b = placed(runs[i].point[:, None], np.array([i]))
        m.w, m.b = w[:, 0], float(b[0])
    return passes
