"""Means and covariances over sliding frames, put together from the ends of two blocks.

The order is cut into blocks as long as the frame, so a frame is the end of one block and the beginning of the next.
Moments of all beginnings and all ends come from frames that only grow, in which each row is added once; a sliding frame
would add every row of the frame again for each row. Nothing is ever taken away from a sum: the two parts are merged by
the exact rule for means and co-moments, so a value far out of line disturbs the frames that hold it and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair(a: str, b: str, columns: Sequence[str]) -> str:
    """The name of the covariance of two columns, whichever comes first."""
    a, b = sorted((a, b), key=list(columns).index)
    return f"cov_{a}_{b}"


def frame_moments(rows: DataFrame, order: str, low: int, high: int, columns: Sequence[str], by: Sequence[str], out: str) -> DataFrame:
    """Adds columns `out`_... of the rows whose order lies in [own + low, own + high) within the group.

    _rows: all of them; _n: those with values (columns are null together); _mean_<c>; _cov_<a>_<b> for a at or before b,
    the sample covariance, null under two rows. order is a whole number; rows where it is null have no frame; equal ones
    belong to the same frames.
    """
    width, by = high - low, list(by)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    block = lambda at: F.floor(at / F.lit(width)).cast("long")
    cut = rows.withColumn("__block", block(F.col(order)))

    def grown(direction: Column) -> Column:
        frame = Window.partitionBy(*by, "__block").orderBy(direction).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        parts = [F.count(F.lit(1)).over(frame).alias("rows"), F.count(columns[0]).over(frame).alias("n")]
        parts += [F.avg(c).over(frame).alias(f"mean_{c}") for c in columns]
        parts += [F.covar_pop(a, b).over(frame).alias(f"co_{a}_{b}") for a, b in pairs]
        return F.struct(F.col("__block").alias("block"), *parts)

    ends = cut.withColumn("__begun", grown(F.col(order).asc())).withColumn("__ended", grown(F.col(order).desc())).drop("__block")
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(F.col(order).asc()).rangeBetween(Window.unboundedPreceding, high - 1)
    since = whole.orderBy(F.col(order).desc()).rangeBetween(Window.unboundedPreceding, -low)
    first, last = block(F.col(order) + low), block(F.col(order) + (high - 1))
    got = ends.withColumn("__tail", F.last("__ended").over(since)).withColumn("__head", F.last("__begun").over(upto)).drop("__begun", "__ended")
    # where the frame is a whole block, its end alone is all of it
    got = got.withColumn("__tail", F.when(F.col("__tail.block") == first, F.col("__tail"))).withColumn("__head", F.when((F.col("__head.block") == last) & (first != last), F.col("__head")))
    value = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0)).cast("double")
    a, b = value("__tail", "n"), value("__head", "n")
    n = a + b
    mean = lambda c: F.try_divide(a * value("__tail", f"mean_{c}") + b * value("__head", f"mean_{c}"), n)
    apart = lambda c: value("__tail", f"mean_{c}") - value("__head", f"mean_{c}")
    parts = {"rows": (value("__tail", "rows") + value("__head", "rows")).cast("long"), "n": n.cast("long")} | {f"mean_{c}": mean(c) for c in columns}
    for x, y in pairs:
        co = a * value("__tail", f"co_{x}_{y}") + b * value("__head", f"co_{x}_{y}") + F.try_divide(a * b, n) * apart(x) * apart(y)
        parts[f"cov_{x}_{y}"] = F.when(n > 1, F.try_divide(co, n - 1))
    # columns of their own, not a struct: an optimizer takes a struct apart and repeats its fields wherever they are used
    return got.withColumns({f"{out}_{k}": c for k, c in parts.items()}).drop("__tail", "__head")
