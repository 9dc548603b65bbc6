"""Checks for degenerate predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent


def class_distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of each class; rows without one aren't counted."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # a row a class: the window is over these few counts
    from pyspark.sql import Window

    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", share).withColumn("shown", percent(F.col("share")))


def edge_stats(predictions: DataFrame) -> DataFrame:
    """Spread of the direction edge and of P(material), and whether the edge is constant."""
    edge = (F.col("pred_p_up") - F.col("pred_p_down")).cast("double")
    rows = predictions.select(edge.alias("e"), F.col("pred_p_material").cast("double").alias("m"))
    out = rows.agg(
        F.min("e").alias("edge_min"), F.max("e").alias("edge_max"), F.avg("e").alias("edge_mean"), F.stddev_samp("e").alias("edge_std"),
        F.min("m").alias("material_min"), F.max("m").alias("material_max"), F.stddev_samp("m").alias("material_std"),
    )
    return out.withColumn("edge_is_constant", F.coalesce(F.col("edge_std") < 1e-3, F.lit(False)))


def collapse_diagnosis(predictions: DataFrame, train: DataFrame, few: int = 200) -> DataFrame:
    """One row: the only predicted class if there is just one and its share of the training rows, and issues found."""
    head = predictions.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pred_direction").alias("n_classes"), F.max("pred_direction").alias("c"))
    if {"pred_p_up", "pred_p_down"} <= set(predictions.columns):
        head = head.crossJoin(F.broadcast(predictions.agg(F.stddev_samp((F.col("pred_p_up") - F.col("pred_p_down")).cast("double")).alias("sd"))))
    else:
        head = head.withColumn("sd", F.lit(None).cast("double"))
    only = F.when(F.col("n_classes") == 1, F.col("c"))
    counts = train.where(F.col("direction").isNotNull()).groupBy("direction").agg(F.count(F.lit(1)).alias("k"))
    totals = counts.agg(F.sum("k").alias("k_all"), F.map_from_entries(F.collect_list(F.struct("direction", "k"))).alias("k_of"))
    out = head.crossJoin(F.broadcast(totals)).withColumn("collapsed_class", only)
    share = F.coalesce(F.try_element_at("k_of", "collapsed_class"), F.lit(0)) / F.greatest(F.coalesce("k_all", F.lit(0)), F.lit(1))
    out = out.withColumn("train_share", F.when(F.col("collapsed_class").isNotNull(), share))
    issues = F.filter(
        F.array(
            F.when(F.col("collapsed_class").isNotNull(), F.lit("majority_class_collapse")),
            F.when(F.col("n") < few, F.lit("tiny_test_set")),
            F.when(F.col("sd") < 1e-3, F.lit("zero_variance_edge")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select("n", "collapsed_class", "train_share", F.array_join(issues, ",").alias("issues"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
