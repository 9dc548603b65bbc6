"""Abnormal-return labels: rolling factor regressions as window aggregates.

The betas of a session come from covariances over the sessions [-250, -30) of the factor calendar; residual sigma
and cumulative abnormal returns follow from moments of their windows, so nothing is expanded to event times day and
no row leaves the JVM. Moments of long windows are merged from the ends of two blocks (`moments.py`), so a row costs the
same whatever the window's length. Betas are fitted once for all event windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean, direction_label, materiality_label, solve_spd, z_score
from . import calendar
from .moments import frame_moments, pair
from .returns import FACTOR_NAMES

EST, IDIO = (-250, -30), (-60, -30)
MIN_ROWS, MIN_COMPLETE, MIN_IDIO = 60, 30, 10


def panel(prices: DataFrame, factors: DataFrame, day: str = "trade_date") -> DataFrame:
    """Sessions with two ordinals: fq on the factor calendar, pq on the ticker's own; y, x0..x3 null together."""
    # the calendar of factors has a row a day, whatever the data's size
    known = factors.withColumnRenamed("date", day).where(F.col(day).isNotNull()).withColumn("fq", F.dense_rank().over(Window.orderBy(day)))
    rows = prices.join(known, day, "left").withColumn("pq", F.row_number().over(Window.partitionBy("ticker").orderBy(day)))
    parts = {"y": clean(F.col("ret")) - clean(F.col("RF"))} | {f"x{i}": clean(F.col(c)) for i, c in enumerate(FACTOR_NAMES)}
    rows = rows.select("ticker", day, "fq", "pq", *[c.alias(f"__{k}") for k, c in parts.items()])
    whole = None
    for k in parts:
        whole = F.col(f"__{k}").isNotNull() if whole is None else whole & F.col(f"__{k}").isNotNull()
    return rows.select("ticker", day, "fq", "pq", *[F.when(whole, F.col(f"__{k}")).alias(k) for k in parts])


_X = tuple(f"x{i}" for i in range(len(FACTOR_NAMES)))


def _moments(rows: DataFrame, window: tuple[int, int], out: str) -> DataFrame:
    return frame_moments(rows, "fq", *window, (*_X, "y"), ["ticker"], out)


def _covariance(of: str, a: str, b: str) -> Column:
    return F.col(f"{of}_{pair(a, b, (*_X, 'y'))}")


def factor_model(rows: DataFrame, window: tuple[int, int] = EST) -> DataFrame:
    """Adds alpha, beta0..beta3 and r2 of each session, null where a gate fails or the system is singular."""
    n = len(_X)
    out = _moments(rows, window, "m")
    gate = (F.col("m_n") >= MIN_COMPLETE) & (F.col("m_rows") >= MIN_ROWS) & F.col("fq").isNotNull()
    system = [[_covariance("m", a, b) for b in _X] for a in _X]
    out = out.withColumn("m_b", F.when(gate, solve_spd(system, [_covariance("m", x, "y") for x in _X])))
    out = out.withColumns({f"beta{i}": F.get("m_b", F.lit(i)) for i in range(n)})
    alpha, fit, var_y = F.col("m_mean_y"), F.lit(0.0), _covariance("m", "y", "y")
    for i, x in enumerate(_X):
        alpha = alpha - F.col(f"beta{i}") * F.col(f"m_mean_{x}")
        fit = fit + F.col(f"beta{i}") * _covariance("m", x, "y")
    out = out.withColumns({"alpha": alpha, "r2": F.when(var_y > 0, fit / var_y)})
    return out.select(*rows.columns, "alpha", *[f"beta{i}" for i in range(n)], "r2", F.col("m_n").alias("n_complete"), F.col("m_rows").alias("n_rows"))


def idio_sigma(rows: DataFrame, window: tuple[int, int] = IDIO) -> DataFrame:
    """Adds sigma, the residuals' standard deviation over the window with the session's own betas."""
    out = _moments(rows, window, "s")
    variance = _covariance("s", "y", "y")
    for i, a in enumerate(_X):
        variance = variance - 2 * F.col(f"beta{i}") * _covariance("s", a, "y")
        for j, b in enumerate(_X):
            variance = variance + F.col(f"beta{i}") * F.col(f"beta{j}") * _covariance("s", a, b)
    sigma = F.when(F.col("s_n") >= MIN_IDIO, F.sqrt(F.greatest(variance, F.lit(0.0))))
    # greatest() skips nulls, so a null variance has to stay null by itself
    return out.withColumn("sigma", F.when(variance.isNotNull(), sigma)).select(*rows.columns, "sigma")


def car_window(rows: DataFrame, low: int, high: int, out: str) -> DataFrame:
    """Adds `out`, the abnormal returns' sum over sessions [low, high] of the ticker, null if the window is cut off."""
    n = len(FACTOR_NAMES)
    over = Window.partitionBy("ticker").orderBy("pq").rowsBetween(low, high)
    got = rows.withColumns({"w_n": F.count(F.lit(1)).over(over), "w_m": F.count("y").over(over), "w_y": F.sum("y").over(over)} | {f"w_{i}": F.sum(f"x{i}").over(over) for i in range(n)})
    value = F.col("w_y") - F.col("w_m") * F.col("alpha")
    for i in range(n):
        value = value - F.col(f"beta{i}") * F.col(f"w_{i}")
    full = (F.col("w_n") == high - low + 1) & (F.col("w_m") > 0)
    return got.withColumn(out, F.when(full, value)).select(*rows.columns, out)


def session_labels(prices: DataFrame, factors: DataFrame, windows: Sequence[tuple[int, int]] = ((0, 1), (-1, 0)), day: str = "trade_date") -> DataFrame:
    """Labels of every session taken as t0. The first window is the label's, others are checks beside it."""
    rows = idio_sigma(factor_model(panel(prices, factors, day)))
    names = [f"{'minus' if lo < 0 else ''}{abs(lo)}_{'minus' if hi < 0 else ''}{abs(hi)}" for lo, hi in windows]
    for (lo, hi), name in zip(windows, names):
        rows = car_window(rows, lo, hi, f"car_{name}").withColumn(f"car_{name}", F.when(F.col("sigma").isNotNull(), F.col(f"car_{name}")))
        rows = rows.withColumn(f"sigma_window_{name}", F.when(F.col(f"car_{name}").isNotNull(), F.col("sigma") * F.sqrt(F.lit(float(hi - lo + 1)))))
        rows = rows.withColumn(f"car_z_{name}", z_score(F.col(f"car_{name}"), F.col(f"sigma_window_{name}")))
    first, rest = names[0], names[1:]
    z = F.col(f"car_z_{first}")
    return rows.select(
        "ticker", F.col(day).alias("t0"), f"car_{first}", f"car_z_{first}", direction_label(z).alias("direction"), materiality_label(z).alias("material"),
        f"sigma_window_{first}", F.when(F.col(f"car_{first}").isNotNull(), F.col("r2")).alias("factor_r2"), *[c for k in rest for c in (f"car_{k}", f"car_z_{k}")],
    )


def label_events(events: DataFrame, prices: DataFrame, factors: DataFrame, ts: str = "publish_ts", windows: Sequence[tuple[int, int]] = ((0, 1), (-1, 0))) -> DataFrame:
    """Every event with the labels of the session after it, joined by key; null labels where none can be made."""
    labels = session_labels(prices, factors, windows)
    # the labelled sessions are the calendar; t0 stays only where the event could be labelled
    found = calendar.next_session(events, prices.select("ticker", "trade_date"), ts, "t0", by=["ticker"], beside=labels)
    return found.withColumn("t0", F.when(F.col("direction").isNotNull(), F.col("t0")))
