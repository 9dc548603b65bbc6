"""Writers. Partitioned writes replace the partitions they touch and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_utc
from ..functions.numeric import clean
from ..operators import features, splits


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("ticker", "year"), overwrite: bool = False) -> DataFrame:
    """Writes the partitions that aren't there yet, or with `overwrite` all that df has; returns what was written.

    A partition is known by its full key.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    if exists and not overwrite:
        old = spark.read.parquet(path).select(*by).distinct()
        df = df.join(old, list(by), "left_anti")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df


def training_json(rows: DataFrame, ts: str = "publish_ts") -> Column:
    """The JSON line of a row: its text and, all from the same row, what is known about it. Missing values are null."""
    number = lambda c: clean(F.col(c).cast("double")) if c in rows.columns else F.lit(None).cast("double")
    meta = F.struct(
        F.col("ticker").alias("ticker"), F.col("sector").alias("sector"), iso_utc(F.col(ts)).alias("publish_ts_utc"), F.col("direction").alias("direction"), F.col("materiality").alias("materiality"),
        number("car_0_1").alias("car_0_1"), number("car_z_0_1").alias("car_z_0_1"), F.col("items").alias("items"),
    )
    return F.to_json(F.struct(F.col("text"), meta.alias("meta")), {"ignoreNullFields": "false"})


def prompt_lines(events: DataFrame, answered: bool, ts: str = "publish_ts") -> DataFrame:
    """One JSON line per event with features, as column value."""
    rows = features.prompts(events, answered)
    return rows.select(training_json(rows, ts).alias("value"))


def write_jsonl(events: DataFrame, path: str, answered: bool, ts: str = "publish_ts") -> int:
    """Writes the lines and returns their number."""
    prompt_lines(events, answered, ts).write.mode("overwrite").text(path)
    return events.sparkSession.read.text(path).count()


def write_splits(events: DataFrame, sectors: DataFrame, folder: str, cfg: splits.SplitConfig = splits.SplitConfig(), balance: bool = False, ts: str = "publish_ts", key: str = "event_id") -> dict[str, int]:
    """train, {val,test}_prompt, {val,test}_labeled, and the earnings of val and test; returns the rows of each.

    Features come from the whole history, before events without a label are dropped, earnings too, and splits made.
    """
    known = features.event_features(events, sectors, ts, key=key)
    known = splits.require(known, [c for c in ("car_0_1", "direction") if c in known.columns])
    named = splits.temporal_split(known, ts, cfg).cache()
    plain = splits.drop_earnings(named)
    train = plain.where("split = 'train'")
    if balance:
        train = splits.seeded_shuffle(splits.oversample(train, "direction", key).withColumn("__k", F.concat_ws("-", key, "draw")), "__k").drop("__k", "draw")
    out = {"train": write_jsonl(train, f"{folder}/train", True, ts)}
    for s in ("val", "test"):
        part = plain.where(F.col("split") == s)
        out[f"{s}_prompt"] = write_jsonl(part, f"{folder}/{s}_prompt", False, ts)
        out[f"{s}_labeled"] = write_jsonl(part, f"{folder}/{s}_labeled", True, ts)
        out[f"{s}_earnings_only"] = write_jsonl(splits.earnings_only(named.where(F.col("split") == s)), f"{folder}/{s}_earnings_only", True, ts)
    named.unpersist()
    return out


def write_report(df: DataFrame, path: str) -> None:
    """A report's few rows as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> DataFrame:
    """Writes predictions and returns n_rows and the share with a parsed direction, of what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("pred_direction").isNotNull().cast("double")).alias("parseable_rate"))


def write_backtest(result: dict[str, DataFrame], folder: str) -> bool:
    """Trades and equity, if there are trades."""
    if result["trades"].isEmpty():
        return False
    for name in ("trades", "equity_curve"):
        result[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    return True
