"""Returns and their excess over the risk-free rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean

FACTOR_NAMES = ("MKT_RF", "SMB", "HML", "MOM")


def simple_return(prices: DataFrame, close: str = "close", day: str = "trade_date", by: str = "ticker", out: str = "ret") -> DataFrame:
    """Change of the close since the session before; a missing close counts as the last one known."""
    order = Window.partitionBy(by).orderBy(day)
    filled = prices.withColumn("__close", F.last(clean(F.col(close).cast("double")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn(out, F.try_divide(F.col("__close"), F.lag("__close").over(order)) - 1).drop("__close")


def join_factors(market: DataFrame, momentum: DataFrame, day: str = "date") -> DataFrame:
    """Market and momentum factors of the days that have both."""
    return market.join(momentum, day)


def excess_returns(prices: DataFrame, factors: DataFrame, day: str = "trade_date") -> DataFrame:
    """Sessions with a return and all factors, and the return over the risk-free rate."""
    names = [*FACTOR_NAMES, "RF"]
    both = prices.join(factors.withColumnRenamed("date", day), day)
    both = both.select(*prices.columns, *[clean(F.col(c)).alias(c) for c in names]).withColumn("ret", clean(F.col("ret")))
    return both.na.drop(subset=["ret", *names]).withColumn("excess", F.col("ret") - F.col("RF"))
