"""The engine's inputs derived from order tables, for tests and benches where there are no filings or prices.

ticker: market segment of an order's customer. Price: mean unit price of the segment's lines shipped on a weekday.
Factors: means over all lines of the day. Events: orders, at a minute of the day made from the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.returns import simple_return
from ..session import table
from .dims import FULL_TICKERS


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday lines with ticker, day and unit price."""
    li = table(spark, sf, "lineitem").where(F.weekday("l_shipdate") < 5)
    orders, customers = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    named = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("ticker"))
    return li.join(named, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("trade_date", F.to_date("l_shipdate")).withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, trade_date, open, high, low, close, volume, ret."""
    # whole numbers add up to the same in any order
    px = F.sum(F.floor(F.col("px") * 10000)) / F.count(F.lit(1)) / 10000.0
    daily = lines(spark, sf).groupBy("ticker", "trade_date").agg(px.alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), px.alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
    return simple_return(daily)


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """date, MKT_RF, SMB, HML, RF, MOM."""
    li = table(spark, sf, "lineitem").where(F.weekday("l_shipdate") < 5)
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))

    def spread(a: str, b: str):
        side = lambda c: F.avg(F.when(F.expr(c), F.col("px")))
        return F.round(F.coalesce(side(a) - side(b), F.lit(0.0)) / 1e4, 9)

    return rows.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("px") / 1e4, 9).alias("MKT_RF"), spread("p_size <= 25", "p_size > 25").alias("SMB"), spread("l_returnflag = 'A'", "l_returnflag = 'R'").alias("HML"),
        F.round(F.avg("l_tax") / 252, 9).alias("RF"), spread("l_discount < 0.05", "l_discount >= 0.05").alias("MOM"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, ticker, publish_ts (no zone, UTC), items."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    items = F.when(k % 5 == 0, F.lit("2.02,9.01")).when(k % 7 == 0, F.lit(None)).otherwise(F.concat((1 + k % 8).cast("string"), F.lit(".0"), (k % 3).cast("string")))
    return rows.select(k.alias("event_id"), F.col("c_mktsegment").alias("ticker"), F.expr("o_orderdate + make_dt_interval(0, 0, cast((o_orderkey * 37) % 1440 as int))").alias("publish_ts"), items.alias("items"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings: event_id, ticker, publish_ts, items, body_text, direction, material."""
    k = F.col("doc_id")
    tickers = F.array(*[F.lit(t) for t in FULL_TICKERS])
    items = F.when(k % 5 == 0, F.lit("2.02,9.01")).when(k % 7 == 0, F.lit(None)).otherwise(F.concat((1 + k % 8).cast("string"), F.lit(".0"), (k % 3).cast("string")))
    return table(spark, sf, "documents").select(
        k.alias("event_id"), F.element_at(tickers, (k * 3 % len(FULL_TICKERS) + 1).cast("int")).alias("ticker"),
        F.expr("timestamp_ntz'2018-06-01 00:00:00' + make_dt_interval(cast((doc_id * 37) % 1900 as int), 0, cast((doc_id * 53) % 1440 as int))").alias("publish_ts"),
        items.alias("items"), F.col("text").alias("body_text"),
        F.element_at(F.array(F.lit("down"), F.lit("neutral"), F.lit("up")), (k * 31 % 7 % 3 + 1).cast("int")).alias("direction"), (k % 4 == 1).alias("material"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Events with made-up truths and probabilities, exact in any engine."""
    k = F.col("event_id")
    parts = {"up": (k * 7919) % 997 + 1, "down": (k * 104729) % 991 + 1, "neutral": (k * 1299709) % 983 + 1}
    total = (parts["up"] + parts["down"] + parts["neutral"]).cast("double")
    pick = lambda n: F.element_at(F.array(F.lit("down"), F.lit("neutral"), F.lit("up")), (k * n % 3 + 1).cast("int"))
    p_material = ((k * 15485863) % 1001) / 1000.0
    return events(spark, sf).select(
        "event_id", "ticker", F.concat(F.lit("S"), F.substring("ticker", 1, 1)).alias("sector"), F.col("publish_ts").alias("publish_ts_utc"),
        F.when(k % 11 != 0, pick(31)).alias("direction"), F.when(k % 4 == 1, F.lit("material")).otherwise(F.lit("immaterial")).alias("materiality"),
        F.when(k % 13 != 0, ((k * 31337) % 2001 - 1000) / 10000.0).alias("car_0_1"), "items",
        F.when(k % 17 != 0, pick(7)).alias("pred_direction"), *[(v / total).alias(f"pred_p_{n}") for n, v in parts.items()],
        F.when(k % 17 != 0, F.when(p_material > 0.5, F.lit("material")).otherwise(F.lit("immaterial"))).alias("pred_materiality"), p_material.alias("pred_p_material"), (1 - p_material).alias("pred_p_immaterial"),
    )
