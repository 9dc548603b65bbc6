"""Ranks without sorting all rows in one task.

Approximate quantiles split each value's range, and serve for balance alone. A splitter that values equal is a cell of
its own, whatever share of the rows has that value: its rows are only counted. Between two splitters lies a cell of
about as many rows as between any others, in which a window ranks them. What lies below a cell comes from the cells'
counts, at most 2 * SPLITS of them a group. So each row is moved once for each value, ties and outliers cost nothing
more, and ranks are exact.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a value's range.
SPLITS = 64
#: Cells that are broadcast; more are joined by shuffling.
BROADCAST_CELLS = 100_000


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys where null equals null; b's keys go."""
    named = b.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in b.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = same if on is None else on & same
    return a.join(named, on, how).drop(*[f"__k_{k}" for k in keys])


def with_cell(df: DataFrame, value: str, out: str, splitters: list[float]) -> DataFrame:
    """Adds the cell of a value: 2 * i where it is the i-th edge, 2 * i + 1 above it and below the next; null for null."""
    inner = sorted({x for x in splitters if abs(x) != float("inf")}) or [0.0]
    edges = [float("-inf"), *inner, float("inf")]
    got = Bucketizer(splits=edges, inputCol=value, outputCol="__bucket", handleInvalid="keep").transform(df)
    i = F.col("__bucket").cast("int")
    edge = F.get(F.expr(f"array({', '.join(f"double('{x!r}')" for x in edges)})"), i)
    return got.withColumn(out, F.when(F.col(value).isNotNull(), 2 * i + (F.col(value) > edge).cast("int"))).drop("__bucket")


def with_ranks(df: DataFrame, values: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds, for each {out: value}, the rank of value among the group's values, from 1, ties averaged; null where it is null.

    Reads df once to find the splitters, SPLITS numbers a value, and about how many groups there are.
    """
    by, names = by or [], list(values)
    number = {k: F.col(v).cast("double") + F.lit(0.0) for k, v in values.items()}  # one zero
    shares = F.expr(f"array({', '.join(f'{i / SPLITS}D' for i in range(1, SPLITS))})")
    groups = F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)
    found = df.agg(groups.alias("__groups"), *[F.percentile_approx(number[k], shares, 10 * SPLITS).alias(k) for k in names]).first()
    few = found["__groups"] * 2 * SPLITS <= BROADCAST_CELLS
    rows = df.withColumns({f"__v_{k}": number[k] for k in names})
    for k in names:
        rows = with_cell(rows, f"__v_{k}", f"__c_{k}", found[k] or [])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__c_{k}").alias("c")) for i, k in enumerate(names)]))
    cells = rows.select(*by, each.alias("__e")).where("__e.c IS NOT NULL").groupBy(*by, F.col("__e.i").alias("__i"), F.col("__e.c").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by, "__i").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")
    for i, k in enumerate(names):
        known = cells.where(F.col("__i") == i).select(*by, F.col("__c").alias(f"__c_{k}"), "__n", "__b")
        rows = null_safe(rows, F.broadcast(known) if few else known, [*by, f"__c_{k}"], "left")
        tied = F.col(f"__c_{k}") % 2 == 0
        # rows that the window tells nothing (ties by themselves, and none) are dealt over many tasks
        rows = rows.withColumn("__t", F.when(F.coalesce(tied, F.lit(True)), spread).otherwise(-1))
        own = Window.partitionBy(*by, f"__c_{k}", "__t").orderBy(f"__v_{k}")
        ties = F.count(F.lit(1)).over(own.rangeBetween(Window.currentRow, Window.currentRow))
        among = F.when(F.col("__t") < 0, F.rank().over(own) + (ties - 1) / 2.0).otherwise((F.col("__n") + 1) / 2.0)
        rows = rows.withColumn(k, F.when(F.col(f"__c_{k}").isNotNull(), F.col("__b") + among)).drop("__n", "__b", "__t")
    return rows.drop(*[f"__{p}_{k}" for p in "vc" for k in names])
