"""Event-driven backtest: gate, entry, exit, cost, daily result, equity and its summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean, finite
from . import calendar
from .metrics import has_probabilities

TRADING_DAYS = 252


@dataclass(frozen=True)
class BacktestConfig:
    holding_days: int = 10
    edge_threshold: float = 0.20
    material_threshold: float = 0.50
    position_size: float = 0.01
    cost_bps_round_trip: float = 15.0
    starting_equity: float = 1_000_000.0


def trade_signal(p_up: Column, p_down: Column, p_material: Column, cfg: BacktestConfig = BacktestConfig()) -> Column:
    """1 long, -1 short, 0 none. A threshold met exactly fires; missing probabilities don't."""
    edge = clean(p_up.cast("double")) - clean(p_down.cast("double"))
    fires = (F.abs(edge) >= cfg.edge_threshold) & (clean(p_material.cast("double")) >= cfg.material_threshold)
    return F.coalesce(F.when(fires, F.when(edge > 0, 1).otherwise(-1)), F.lit(0))


def trade_returns(signal: Column, entry: Column, exit_: Column, cfg: BacktestConfig = BacktestConfig()) -> tuple[Column, Column, Column]:
    """Gross return, net return, profit."""
    gross = signal * (exit_ / entry - 1.0)
    net = gross - cfg.cost_bps_round_trip / 10_000.0
    return gross, net, cfg.starting_equity * cfg.position_size * net


def price_bounds(predictions: DataFrame, cfg: BacktestConfig = BacktestConfig(), buffer_days: int = 30, ts: str = "publish_ts_utc") -> DataFrame:
    """n_tickers, first and last day of prices that the predictions may need."""
    return predictions.agg(F.countDistinct("ticker").alias("n_tickers"), F.date_sub(F.to_date(F.min(ts)), buffer_days).alias("start"), F.date_add(F.to_date(F.max(ts)), buffer_days + 2 * cfg.holding_days).alias("end"))


def trades(predictions: DataFrame, prices: DataFrame, cfg: BacktestConfig = BacktestConfig(), ts: str = "publish_ts_utc") -> DataFrame:
    """One row per executed trade; predictions without probabilities make none."""
    probs = has_probabilities(predictions)
    p = {c: F.col(c).cast("double") if c in predictions.columns else F.lit(None).cast("double") for c in ("pred_p_up", "pred_p_down", "pred_p_material")}
    signal = trade_signal(p["pred_p_up"], p["pred_p_down"], p["pred_p_material"], cfg) if probs else F.lit(0)
    rows = predictions.withColumns(p | {"direction_signed": signal}).where("direction_signed <> 0")
    placed = calendar.entry_session(rows, prices.select("ticker", "trade_date"), ts, "entry_day", by=["ticker"])
    px = prices.select("ticker", F.col("trade_date").alias("entry_day"), finite(F.col("open").cast("double")).alias("entry_price"), calendar.ahead("open", cfg.holding_days).cast("double").alias("exit_open"), calendar.ahead("trade_date", cfg.holding_days).alias("exit_day"))
    both = placed.join(px, ["ticker", "entry_day"]).withColumn("exit_price", finite(F.col("exit_open")))
    both = both.where("exit_day IS NOT NULL AND exit_price IS NOT NULL AND entry_price > 0")
    gross, net, pnl = trade_returns(F.col("direction_signed"), F.col("entry_price"), F.col("exit_price"), cfg)
    extra = [F.col("sector") if "sector" in predictions.columns else F.lit(None).cast("string").alias("sector")]
    car = F.col("car_0_1").cast("double") if "car_0_1" in predictions.columns else F.lit(None).cast("double")
    return both.select("ticker", *extra, F.col(ts).alias("publish_ts_utc"), "entry_day", "exit_day", "direction_signed", *p, "entry_price", "exit_price", gross.alias("gross_return"), net.alias("net_return"), pnl.alias("pnl"), car.alias("realized_car_0_1"))


def daily_pnl(done: DataFrame) -> DataFrame:
    return done.groupBy(F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("daily_pnl"))


def equity_curve(daily: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """day, daily_pnl, equity over Monday to Friday; a row a day, so one task whatever the trades' number."""
    dense = calendar.densify(daily, "day", {"daily_pnl": 0.0})
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("equity", cfg.starting_equity + F.sum("daily_pnl").over(run))


def drawdown(equity: DataFrame) -> DataFrame:
    """Adds peak and drawdown; the peak begins with the first day's equity, not with the starting equity."""
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max("equity").over(run)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def sharpe(mean: Column, deviation: Column, n: Column, active_days: Column) -> Column:
    """Of returns per trade, annualised by trades per active day; null under two trades or without deviation."""
    per_day = n / F.greatest(active_days, F.lit(1))
    return F.when((n >= 2) & (deviation > 0), mean * per_day / (deviation * F.sqrt(per_day)) * F.sqrt(F.lit(float(TRADING_DAYS))))


def summary(done: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One row of totals; without trades n_trades is 0 and a note says so."""
    curve = drawdown(equity_curve(daily_pnl(done), cfg))
    days = curve.agg(F.avg("daily_pnl").alias("daily_pnl_mean"), F.coalesce(F.stddev_samp("daily_pnl"), F.lit(0.0)).alias("daily_pnl_std"), F.count_if(F.col("daily_pnl") != 0).alias("active_days"), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    all_ = done.agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("direction_signed") > 0).alias("n_long"), F.count_if(F.col("direction_signed") < 0).alias("n_short"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"), F.avg("gross_return").alias("avg_gross_return_per_trade"), F.avg("net_return").alias("avg_net_return_per_trade"),
        F.sum("pnl").alias("total_pnl"), (F.sum("pnl") / cfg.starting_equity).alias("total_return"), F.stddev_samp("gross_return").alias("gross_sd"), F.stddev_samp("net_return").alias("net_sd"),
        F.countDistinct("ticker").alias("n_unique_tickers_traded"),
    )
    both = all_.crossJoin(F.broadcast(days))
    return both.withColumns(
        {
            "sharpe_gross": sharpe(F.col("avg_gross_return_per_trade"), F.col("gross_sd"), F.col("n_trades"), F.col("active_days")),
            "sharpe_net": sharpe(F.col("avg_net_return_per_trade"), F.col("net_sd"), F.col("n_trades"), F.col("active_days")),
            "note": F.when(F.col("n_trades") == 0, F.lit("no trades fired")),
        }
    ).drop("gross_sd", "net_sd")


def run_backtest(predictions: DataFrame, prices: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> dict[str, DataFrame]:
    done = trades(predictions, prices, cfg)
    return {"trades": done, "equity_curve": equity_curve(daily_pnl(done), cfg), "summary": summary(done, cfg)}
