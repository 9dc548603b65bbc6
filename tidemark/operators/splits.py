"""Training sets without leaks: earnings filter, splits by time with an embargo, oversampling, holdouts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitConfig:
    train_end: date = date(2021, 1, 1)
    val_end: date = date(2022, 1, 1)
    test_end: date = date(2023, 1, 1)
    embargo_days: int = 7


def is_earnings(items: Column) -> Column:
    return F.coalesce(items, F.lit("")).rlike(r"\b2\.02\b")


def drop_earnings(events: DataFrame, items: str = "items") -> DataFrame:
    return events.where(~is_earnings(F.col(items)))


def earnings_only(events: DataFrame, items: str = "items") -> DataFrame:
    return events.where(is_earnings(F.col(items)))


def date_range(df: DataFrame, day: str, start: date, end: date) -> DataFrame:
    """Rows of [start, end)."""
    return df.where((F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(end)))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that miss none of the columns; NaN counts as missing."""
    return df.na.drop(subset=columns)


def split_name(ts: Column, cfg: SplitConfig = SplitConfig()) -> Column:
    """train, val, test, or null in an embargo gap and after the end."""
    at = lambda d, days=0: F.lit(d).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))
    ts = ts.cast("timestamp_ntz")
    return (
        F.when(ts < at(cfg.train_end), F.lit("train"))
        .when((ts >= at(cfg.train_end, cfg.embargo_days)) & (ts < at(cfg.val_end)), F.lit("val"))
        .when((ts >= at(cfg.val_end, cfg.embargo_days)) & (ts < at(cfg.test_end)), F.lit("test"))
    )


def temporal_split(events: DataFrame, ts: str = "publish_ts", cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Events of the three splits, named in `split`; those in a gap go."""
    return events.withColumn("split", split_name(F.col(ts), cfg)).where("split IS NOT NULL")


def mixed_key(key: Column, seed: int) -> Column:
    """A shuffle key that any SQL engine can compute: a hash of the row's key and the seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(mixed_key(F.col(key), seed), key)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """All rows, and for each smaller class as many draws with replacement as it lacks to the largest.

    Draw k of a class takes the row whose rank is a hash of class, k and seed; `draw` is 0 for the rows themselves.
    Ranks are taken within 4096 hash buckets of the class, so a class is never one task.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn("__b", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    sizes = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(label, "__b").orderBy(key)) - 1).join(offsets, [label, "__b"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__i")).drop("__b", "__i", "__before")
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    want = counts.crossJoin(F.broadcast(counts.agg(F.max("__n").alias("__top")))).where("__top > __n")
    # draws are numbered in steps, so that many tasks make them
    step = 100_000
    lack = F.col("__top") - F.col("__n")
    steps = want.select(label, "__n", lack.alias("__lack"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((lack - 1) / step))).alias("__step")).repartition(label, "__step")
    first = F.col("__step") * step
    draws = steps.select(label, "__n", F.explode(F.sequence(first + 1, F.least(first + step, F.col("__lack")))).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(label), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    draws = draws.withColumn("__rank", F.pmod(pick, F.col("__n"))).drop("__n")
    drawn = draws.join(ranked, [label, "__rank"]).select(*df.columns, "draw")
    return df.withColumn("draw", F.lit(0).cast("bigint")).unionByName(drawn)


def time_holdout(df: DataFrame, ts: str, key: str, fraction: float = 0.7) -> DataFrame:
    """Adds `part`: train for the first int(n * fraction) rows by time, test for the rest.

    The cut is the time and key at that rank, found over counts by day, so that no task sorts all rows.
    """
    by_day = df.groupBy(F.to_date(ts).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    days = by_day.withColumn("__before", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    total = by_day.agg(F.sum("__n").alias("__total"))
    ranked = df.withColumn("__d", F.to_date(ts)).withColumn("__i", F.row_number().over(Window.partitionBy("__d").orderBy(ts, key)))
    before = days.select(F.col("__d").alias("__e"), "__before")
    ranked = ranked.join(before, F.col("__d").eqNullSafe(F.col("__e"))).crossJoin(F.broadcast(total))
    cut = F.floor(F.col("__total") * F.lit(fraction))
    return ranked.withColumn("part", F.when(F.col("__before") + F.col("__i") <= cut, F.lit("train")).otherwise(F.lit("test"))).select(*df.columns, "part")


def union_shards(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all shards; columns that a shard lacks are null; nothing is deduplicated."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first
