"""Scores of predictions, over all rows or by group.

Every metric takes the group's columns in `by` (none: one row over all). Ranks are those of `ranks.py`: exact, and no
task sorts everything.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean, direction_score
from .ranks import null_safe, with_ranks


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys where null equals null; without keys, both have one row."""
    return null_safe(a, b, keys, how) if keys else a.crossJoin(F.broadcast(b))


def with_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds the rank of value in its group, from 1, ties averaged."""
    return with_ranks(df, {out: value}, by)


def auc_of(label: Column, rank: Column) -> Column:
    """The aggregate AUC of rows with a label, 0 or 1, and a rank; null where the label has one class."""
    pos, neg = F.sum(label.cast("double")), F.sum(1 - label.cast("double"))
    return F.try_divide(F.sum(F.when(label == 1, rank)) - pos * (pos + 1) / 2, pos * neg)


def rank_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """auc by group: ties averaged; null where the label has one class. label is 0 or 1."""
    by = by or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(label).alias("__y"), F.col(score).alias("__s"))
    return with_ranks(rows, {"__r": "__s"}, by).groupBy(*by).agg(auc_of(F.col("__y"), F.col("__r")).alias("auc"))


def confusion(df: DataFrame, by: list[str] | None = None, truth: str = "direction", pred: str = "pred_direction") -> DataFrame:
    """Counts of (group, truth, prediction); a row per pair of classes."""
    return df.groupBy(*(by or []), F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def direction_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, parseable_rate, accuracy, majority_baseline, lift_over_majority_pp, balanced_accuracy, macro_f1 by group.

    From one pass that counts pairs of classes; the rest works on those few counts. n is 0 and the others null
    where no row has both truth and prediction.
    """
    by = by or []
    pairs = confusion(df, by)
    both = pairs.where("y IS NOT NULL AND p IS NOT NULL")
    whole = pairs.groupBy(*by).agg(F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"), F.sum("n").alias("all"))
    hits = both.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    sides = both.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t")))).alias("s"), "y", "p", "n")
    per = sides.groupBy(*by, F.col("s.c").alias("c")).agg(
        F.sum(F.when(F.col("s.t") == 1, F.col("n")).otherwise(0)).alias("true"), F.sum(F.when(F.col("s.t") == 0, F.col("n")).otherwise(0)).alias("pred"),
        F.sum(F.when((F.col("s.t") == 1) & (F.col("y") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
    )
    classes = per.groupBy(*by).agg(
        F.max("true").alias("top"), F.avg(F.when(F.col("true") > 0, F.col("tp") / F.col("true"))).alias("balanced_accuracy"), F.avg(2.0 * F.col("tp") / (F.col("true") + F.col("pred"))).alias("macro_f1")
    )
    out = _null_safe(_null_safe(whole, hits, by, "left") if by else whole.crossJoin(F.broadcast(hits)), classes, by, "left")
    accuracy, majority = F.try_divide("hit", "n"), F.try_divide("top", "n")
    return out.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("parsed") / F.col("all")).alias("parseable_rate"), accuracy.alias("accuracy"), majority.alias("majority_baseline"),
        ((accuracy - majority) * 100).alias("lift_over_majority_pp"), "balanced_accuracy", "macro_f1",
    )


def has_probabilities(df: DataFrame) -> bool:
    return {"pred_p_up", "pred_p_down", "pred_p_material"} <= set(df.columns)


def ece(df: DataFrame, label: str, prob: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Expected calibration error by group; null under `bins` rows; probabilities outside [0, 1] fall in no bin."""
    by = by or []
    # edges as floating-point products: 3 * 0.1 isn't 0.3, and a probability of 0.3 lies below it
    at = F.lit(0)
    for i in range(1, bins):
        at = at + (F.col(prob) >= F.lit(i * (1.0 / bins))).cast("int")
    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).withColumn("__bin", F.when(F.col(prob).between(0.0, 1.0), at))
    per = rows.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("conf"), F.avg(label).alias("acc"))
    gap = F.sum(F.when(F.col("__bin").isNotNull(), F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0))
    return per.groupBy(*by).agg(F.when(F.sum("n") >= bins, gap / F.sum("n")).alias("ece_10bin"))


def materiality_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, auc, brier, ece_10bin, base_rate_material, score_is_proxy by group, of rows with both sides."""
    by = by or []
    proxy = "pred_p_material" not in df.columns
    score = (F.col("pred_materiality") == "material").cast("double") if proxy else clean(F.col("pred_p_material").cast("double"))
    rows = df.where("pred_materiality IS NOT NULL AND materiality IS NOT NULL").select(*by, (F.col("materiality") == "material").cast("int").alias("y"), score.alias("s"))
    one = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == (F.col("s") > 0.5).cast("int")).cast("double")).alias("accuracy"),
        F.when(F.min("y") < F.max("y"), F.avg((F.col("s") - F.col("y")) ** 2)).alias("brier"), F.avg("y").alias("base_rate_material"),
    )
    out = _null_safe(_null_safe(one, rank_auc(rows, "y", "s", by), by, "left"), ece(rows, "y", "s", by), by, "left")
    return out.select(*by, "n", "accuracy", "auc", "brier", "ece_10bin", "base_rate_material", F.lit(proxy).alias("score_is_proxy"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        top = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def spearman_p(rho: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta_tail((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def p_value(rho: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([spearman_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, k)], dtype="float64")

    return p(rho, n)


def _signal(df: DataFrame) -> Column:
    return clean((F.col("pred_p_up") - F.col("pred_p_down")).cast("double")) if has_probabilities(df) else direction_score(F.col("pred_direction"))


def _rho(s: str, c: str, rs: str, rc: str) -> tuple[Column, Column, Column]:
    """The aggregates n, whether a side is constant, and the ranks' correlation, of rows that have both sides or none."""
    flat = (F.stddev_pop(s) < 1e-12) | (F.stddev_pop(c) < 1e-12)
    return F.count(s), flat, F.try_divide(F.covar_pop(rs, rc), F.stddev_pop(rs) * F.stddev_pop(rc))


def spearman_ic(df: DataFrame, by: list[str] | None = None, with_p: bool = False) -> DataFrame:
    """n, spearman_rho, note, score_uses_probs by group, of score and car_0_1; under five rows only n."""
    by, probs = by or [], has_probabilities(df)
    rows = df.select(*by, _signal(df).alias("s"), clean(F.col("car_0_1").cast("double")).alias("c")).where("s IS NOT NULL AND c IS NOT NULL")
    n, flat, rho = _rho("s", "c", "rs", "rc")
    out = with_ranks(rows, {"rs": "s", "rc": "c"}, by).groupBy(*by).agg(n.alias("n"), flat.alias("flat"), rho.alias("rho"))
    few = F.col("n") < 5
    out = out.select(
        *by, "n", F.when(~few & ~F.col("flat"), clean(F.col("rho"))).alias("spearman_rho"), F.when(~few & F.col("flat"), F.lit("constant input")).alias("note"), F.when(~few, F.lit(probs)).alias("score_uses_probs")
    )
    return out.withColumn("p_value", p_value(F.col("spearman_rho"), F.col("n"))) if with_p else out


def strata_report(df: DataFrame, strata: dict[str, Column], min_n: int = 10) -> DataFrame:
    """stratum, key, n, direction_accuracy, spearman, materiality_auc of each group of `min_n` rows or more.

    strata: the key of each kind of group; a row without one is in none of that kind. All kinds come from the same pass: a
    row is repeated for each, as grouping sets do, and ranked in each. A missing prediction counts as wrong.
    """
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), c.cast("string").alias("key")) for k, c in strata.items()]))
    both = F.col("pred_materiality").isNotNull() & F.col("materiality").isNotNull()
    m = (F.col("pred_materiality") == "material").cast("double") if "pred_p_material" not in df.columns else clean(F.col("pred_p_material").cast("double"))
    s, c = _signal(df), clean(F.col("car_0_1").cast("double"))
    rows = df.select(
        at.alias("at"), F.coalesce((F.col("direction") == F.col("pred_direction")).cast("double"), F.lit(0.0)).alias("hit"),
        F.when(c.isNotNull(), s).alias("s"), F.when(s.isNotNull(), c).alias("c"), F.when(both, m).alias("m"), F.when(both & m.isNotNull(), (F.col("materiality") == "material").cast("int")).alias("y"),
    )
    rows = rows.select("at.stratum", "at.key", "hit", "s", "c", "m", "y").where("key IS NOT NULL")
    n, flat, rho = _rho("s", "c", "rs", "rc")
    out = with_ranks(rows, {"rs": "s", "rc": "c", "rm": "m"}, ["stratum", "key"]).groupBy("stratum", "key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("hit").alias("direction_accuracy"), n.alias("pairs"), flat.alias("flat"), rho.alias("rho"), auc_of(F.col("y"), F.col("rm")).alias("materiality_auc")
    )
    spearman = F.when((F.col("pairs") >= 5) & ~F.col("flat"), clean(F.col("rho")))
    return out.where(F.col("n") >= min_n).select("stratum", "key", "n", "direction_accuracy", spearman.alias("spearman"), "materiality_auc")


def stratified_report(df: DataFrame, by: str, min_n: int = 10) -> DataFrame:
    """key, n, direction_accuracy, spearman, materiality_auc of each group of `min_n` rows or more."""
    return strata_report(df, {by: F.col(by)}, min_n).drop("stratum")


def year_strata(df: DataFrame, ts: str = "publish_ts_utc", min_n: int = 10) -> DataFrame:
    return strata_report(df, {"year": F.year(ts)}, min_n).drop("stratum")


def sector_strata(df: DataFrame, min_n: int = 10) -> DataFrame | None:
    return stratified_report(df, "sector", min_n) if "sector" in df.columns else None


def overall_report(df: DataFrame) -> DataFrame:
    """(block, metric, value): all metrics over all rows, one row each."""

    def long(block: str, wide: DataFrame) -> DataFrame:
        names = [c for c, t in wide.dtypes if t not in ("string",)]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
        return wide.select(F.lit(block).alias("block"), F.inline(pairs))

    return long("direction", direction_metrics(df)).unionByName(long("materiality", materiality_metrics(df))).unionByName(long("ic", spearman_ic(df)))
