"""Readers of prices, predictions and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.returns import simple_return
from ..schemas import TRAINING_ROW


def read_prices(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Daily prices with lower-case names, the day as a date, and the return."""
    df = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    day = next(c for c in ("trade_date", "date", "day") if c in df.columns)
    df = df.withColumn(day, F.to_date(day)).withColumnRenamed(day, "trade_date")
    df = df.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close") if c in df.columns})
    return simple_return(df)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_ROW).json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts with what is known about each beside the text."""
    rows = read_jsonl(spark, path).select("text", "meta.*")
    return rows.withColumn("publish_ts_utc", F.to_timestamp("publish_ts_utc"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def counts_by_class(rows: DataFrame) -> DataFrame:
    """Counts of direction and materiality in training rows; rows without either don't count for it."""
    pairs = F.array(F.struct(F.lit("direction").alias("field"), F.col("meta.direction").alias("class")), F.struct(F.lit("materiality").alias("field"), F.col("meta.materiality").alias("class")))
    return rows.select(F.inline(pairs)).where("class IS NOT NULL").groupBy("field", "class").agg(F.count(F.lit(1)).alias("n"))


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """These columns of a Parquet dataset, or an empty table where there is none."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
