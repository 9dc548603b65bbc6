"""Numeric expressions: missing values, softmax, thresholds, small linear systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("down", "neutral", "up")
MATERIALITIES = ("material", "immaterial")


def clean(x: Column) -> Column:
    """NaN is a missing value like null, and leaves the engine as null only."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and the infinities are missing values."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def softmax(logs: Column) -> Column:
    """Probabilities of an array of log-probabilities; the largest is taken off first."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def argmax_label(probs: Column, labels: tuple[str, ...] = DIRECTIONS) -> Column:
    """The label of the largest probability, the first of equal ones."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probs, F.array_max(probs)).cast("int"))


def direction_label(z: Column, cut: float = 0.75) -> Column:
    return F.when(z < -cut, F.lit("down")).when(z > cut, F.lit("up")).when(z.isNotNull(), F.lit("neutral"))


def materiality_label(z: Column, cut: float = 1.5) -> Column:
    return F.abs(z) > cut


def z_score(x: Column, sigma: Column) -> Column:
    """Zero where sigma isn't above zero; null only where x is."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(sigma > 0, F.try_divide(x, sigma)).otherwise(F.lit(0.0))


def direction_score(direction: Column) -> Column:
    return F.when(direction == "down", F.lit(-1.0)).when(direction == "neutral", F.lit(0.0)).when(direction == "up", F.lit(1.0))


def predict_excess(alpha: Column, betas: list[Column], factors: list[Column]) -> Column:
    out = alpha
    for b, f in zip(betas, factors):
        out = out + b * f
    return out


def solve_spd(matrix: list[list[Column]], right: list[Column]) -> Column:
    """The solution, as an array, of a symmetric positive definite system given by columns; null if it is singular.

    Gauss-Jordan elimination as a fold over an array of rows, so the expression stays small however often it is
    used. A pivot under 1e-9 of its diagonal is what rounding leaves of a column that the others explain.
    """
    n = len(right)
    rows = F.array(*[F.array(*[x.cast("double") for x in (*matrix[i], right[i], matrix[i][i])]) for i in range(n)])

    def eliminate(m: Column, k: Column) -> Column:
        own = F.get(m, k)
        pivot = F.when(F.get(own, k) > 1e-9 * F.get(own, F.lit(n + 1)), F.get(own, k))
        # the last place keeps the diagonal that pivots are held against
        scaled = F.transform(own, lambda x, j: F.when(j <= n, x / pivot).otherwise(x))

        def other(row: Column, i: Column) -> Column:
            less = F.zip_with(row, scaled, lambda x, p: x - F.get(row, k) * p)
            return F.when(i == k, scaled).otherwise(F.concat(F.slice(less, 1, n + 1), F.slice(row, n + 2, 1)))

        return F.transform(m, other)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))
