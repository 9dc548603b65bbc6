"""python -m tidemark.cli STAGE ...: the stages over files. Defaults are those of the published runs."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import backtest, inference, splits
from .plans import pipelines
from .session import get_session
from .sources import dims, sinks, tables
from .sources.http import BACKOFF, PAUSE, RETRIES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    add = top.add_subparsers(dest="stage", required=True).add_parser
    one = add("ingest")
    one.add_argument("--root", required=True)
    one.add_argument("--tickers", nargs="+", default=list(dims.PILOT_TICKERS))
    one.add_argument("--start", type=date.fromisoformat, default=date(2015, 1, 1))
    one.add_argument("--end", type=date.fromisoformat, default=date(2023, 1, 1), help="exclusive")
    one.add_argument("--agent", default="tidemark", help="name and address that the service asks for")
    one.add_argument("--www", default="https://www.sec.gov")
    one.add_argument("--data", default="https://data.sec.gov")
    one.add_argument("--pause", type=float, default=PAUSE)
    one.add_argument("--retries", type=int, default=RETRIES)
    one.add_argument("--backoff", type=float, default=BACKOFF, help="seconds before the first retry, twice as many before each more")
    one.add_argument("--overwrite", action="store_true")
    one = add("label")
    one.add_argument("--root", required=True)
    one.add_argument("--prices", required=True)
    one.add_argument("--factors", required=True)
    one.add_argument("--tickers", nargs="+", default=list(dims.PILOT_TICKERS))
    one.add_argument("--start-year", type=int, default=2015)
    one.add_argument("--end-year", type=int, default=2022)
    one.add_argument("--overwrite", action="store_true")
    one.add_argument("--combined", help="also write all labelled events here, by time")
    one = add("dataset")
    one.add_argument("--events", required=True)
    one.add_argument("--out-dir", required=True)
    one.add_argument("--train-end", type=date.fromisoformat, default=date(2021, 1, 1))
    one.add_argument("--val-end", type=date.fromisoformat, default=date(2022, 1, 1))
    one.add_argument("--test-end", type=date.fromisoformat, default=date(2023, 1, 1))
    one.add_argument("--embargo-days", type=int, default=7)
    one.add_argument("--balance", action="store_true")
    for name in ("canary", "spot-check"):
        one = add(name)
        one.add_argument("--events", required=True)
    for name in ("infer", "infer-probs"):
        one = add(name)
        one.add_argument("--prompts", required=True)
        one.add_argument("--scorer", required=True, help="module:factory, a callable that makes the scorer on a worker")
        one.add_argument("--out", required=True)
        if name == "infer":
            one.add_argument("--batch-size", type=int, default=8)
            one.add_argument("--max-new-tokens", type=int, default=24)
    one = add("evaluate")
    one.add_argument("--predictions", required=True)
    one = add("backtest")
    one.add_argument("--predictions", required=True)
    one.add_argument("--prices", required=True)
    one.add_argument("--out-dir", required=True)
    one.add_argument("--holding-days", type=int, default=10)
    one.add_argument("--edge-threshold", type=float, default=0.20)
    one.add_argument("--material-threshold", type=float, default=0.50)
    one.add_argument("--position-size", type=float, default=0.01)
    one.add_argument("--cost-bps", type=float, default=15.0)
    one = add("diagnose")
    one.add_argument("--dataset-dir", required=True)
    one.add_argument("--predictions", required=True)
    return top


def rows_of(report: DataFrame) -> list[dict]:
    """A report's few rows."""
    return [json.loads(r["j"]) for r in report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def factory_of(name: str) -> Callable[[], object]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """Runs a stage and returns its report."""
    if args.stage == "ingest":
        done = pipelines.fetch_and_ingest(spark, args.tickers, args.start, args.end, args.root, args.agent, args.www, args.data, args.pause, overwrite=args.overwrite, retries=args.retries, backoff=args.backoff)
        written = tables.read_if_there(spark, pipelines.edgar_path(args.root), "ticker string, year int, accessionNumber string").where(F.col("ticker").isin(args.tickers)).join(done.filings.select("accessionNumber").distinct(), "accessionNumber", "left_semi")
        cells = rows_of(written.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n_filings")).orderBy("ticker", "year"))
        if not done.failed:
            return cells
        return {"ok": cells, "failed": [{"ticker": t, "year": y, "error": e} for t, y, e in sorted(done.failed, key=str)]}
    if args.stage == "label":
        prices, factors, years = tables.read_prices(spark, args.prices), spark.read.parquet(args.factors), list(range(args.start_year, args.end_year + 1))
        out: dict[str, object] = {"cells": rows_of(pipelines.label_cells(spark, args.tickers, years, prices, factors, args.root, args.overwrite))}
        if args.combined:
            out["combined"] = rows_of(pipelines.combine(spark, args.root, args.tickers, years, args.combined).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_events")).orderBy("ticker"))
        return out
    if args.stage == "dataset":
        cfg = splits.SplitConfig(args.train_end, args.val_end, args.test_end, args.embargo_days)
        return sinks.write_splits(spark.read.parquet(args.events), dims.sectors(spark), args.out_dir, cfg, args.balance, ts="acceptanceDateTime", key="accessionNumber")
    if args.stage == "canary":
        return rows_of(pipelines.canary_report(spark.read.parquet(args.events), key="accessionNumber"))
    if args.stage == "spot-check":
        return rows_of(pipelines.spot_check(spark.read.parquet(args.events)))
    if args.stage in ("infer", "infer-probs"):
        prompts, factory = tables.read_prompts(spark, args.prompts), factory_of(args.scorer)
        done = inference.greedy_infer(prompts, factory, batch=args.batch_size, max_new_tokens=args.max_new_tokens) if args.stage == "infer" else inference.prob_infer(prompts, factory)
        return rows_of(sinks.write_predictions(done, args.out))[0]
    if args.stage == "evaluate":
        return {name: rows_of(report) for name, report in pipelines.evaluate(spark.read.parquet(args.predictions)).items()}
    if args.stage == "backtest":
        cfg = backtest.BacktestConfig(args.holding_days, args.edge_threshold, args.material_threshold, args.position_size, args.cost_bps)
        result = backtest.run_backtest(spark.read.parquet(args.predictions), tables.read_prices(spark, args.prices), cfg)
        sinks.write_backtest(result, args.out_dir)
        return rows_of(result["summary"])[0]
    train = tables.read_jsonl(spark, f"{args.dataset_dir}/train").select("meta.direction")
    return {name: rows_of(report) for name, report in pipelines.diagnosis(train, spark.read.parquet(args.predictions)).items()}


def main(argv: list[str] | None = None) -> None:
    """Prints the stage's report as JSON. The master and its settings are those of spark-submit."""
    args = parser().parse_args(argv)
    print(json.dumps(run(get_session(f"tidemark-{args.stage}"), args), indent=2))


if __name__ == "__main__":
    main()
