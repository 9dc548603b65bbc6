"""The stages from filings to reports, each a function from DataFrames or paths to DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accession_path
from ..operators import canary, diagnose, labels, metrics, splits
from ..session import importable
from ..sources import filings, sinks
from ..sources.http import BACKOFF, PAUSE, RETRIES, ThrottledHttp


def edgar_path(root: str) -> str:
    """Raw filings, partitioned by ticker and year."""
    return f"{root}/filings"


def labeled_path(root: str) -> str:
    """Labelled events, partitioned by ticker and year."""
    return f"{root}/labeled"


def ingest(index: DataFrame, documents: DataFrame, root: str, form: str = "8-K", overwrite: bool = False) -> DataFrame:
    """Writes filings with their text.

    index: filings with ticker and cik. documents: a row per document (accessionNumber, position, name, html).
    A filing's main document is its primaryDocument, its exhibits are told by their names.
    """
    listed = filings.list_filings(index, form=form).withColumn("year", F.year("filingDate"))
    parts = documents.join(listed.select("accessionNumber", "primaryDocument"), "accessionNumber").withColumn("main", F.col("name") == F.col("primaryDocument"))
    kept = parts.where("main").unionByName(filings.exhibits(parts.where("NOT main")))
    body = filings.assemble_text(kept, "accessionNumber", "position", "html", "main")
    names = kept.where("NOT main").groupBy("accessionNumber").agg(F.array_sort(F.collect_list("name")).alias("exhibits"))
    from ..functions.text import items_mentioned

    out = listed.join(body.drop("n_exhibits"), "accessionNumber", "left").join(names, "accessionNumber", "left")
    out = out.withColumn("items_in_body", items_mentioned(F.coalesce("body_text", F.lit("")))).withColumn("exhibits", F.coalesce("exhibits", F.array().cast("array<string>")))
    return sinks.write_partitioned(out, edgar_path(root), overwrite=overwrite)


_LOG = "url string, status int, body string, error string, at timestamp"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """All answers up to now; none where nothing has been asked.

    The time is part of the plan: Spark takes scans of one folder for the same, whatever files each has seen.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    now = F.timestamp_micros(F.lit(time.time_ns() // 1000))
    return spark.read.schema(_LOG).parquet(folder).where(F.col("at") <= now) if there else spark.createDataFrame([], _LOG)


def fetch(spark: SparkSession, urls: list[str], folder: str, agent: str, pause: float = PAUSE, batch: int = 200, retries: int = RETRIES, backoff: float = BACKOFF) -> None:
    """Asks for each address and logs the answers in `folder`, `batch` of them a commit.

    What has answered once isn't asked for again, so a run that was killed goes on where its last commit ended. Failures
    are logged beside, with their status, and are asked for again by the next run.
    """
    asked = spark.createDataFrame([(u,) for u in sorted(set(urls))], "url string")
    new = [r["url"] for r in asked.join(_log(spark, folder).where("body IS NOT NULL").select("url"), "url", "left_anti").orderBy("url").collect()]
    importable(spark)
    spark.dataSource.register(ThrottledHttp)
    for lo in range(0, len(new), batch):
        if lo:
            time.sleep(pause)
        how = {"urls": " ".join(new[lo : lo + batch]), "agent": agent, "pause": str(pause), "retries": str(retries), "backoff": str(backoff), "skip_errors": "true"}
        answers = spark.read.format("throttled_http").options(**how).load()
        answers.select("url", "status", "body", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(folder)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """url, body, status, error: the last answer of each address, one with a body if there is any."""
    best = F.struct(F.col("body").isNotNull(), "at", "body", "status", "error")
    return _log(spark, folder).groupBy("url").agg(F.max(best).alias("a")).select("url", "a.body", "a.status", "a.error")


def fetched(spark: SparkSession, urls: list[str], folder: str, agent: str, pause: float, skip_errors: bool = False, **how) -> DataFrame:
    """url, body of each address, asked for until it has answered once; raises where one fails, but with skip_errors."""
    fetch(spark, urls, folder, agent, pause, **how)
    asked = spark.createDataFrame([(u,) for u in sorted(set(urls))], "url string")
    got = answers(spark, folder).join(F.broadcast(asked), "url", "left_semi")
    if not skip_errors and (bad := got.where("body IS NULL").select("url", "error").first()):
        raise OSError(f"{bad['url']}: {bad['error']}")
    return got.where("body IS NOT NULL").select("url", "body")


@dataclass(frozen=True)
class Ingested:
    """Filings of the cells that are whole, and (ticker, year, error) of those that aren't; year None: the whole ticker."""

    filings: DataFrame
    failed: list[tuple[str, int | None, str]]


def fetch_and_ingest(
    spark: SparkSession, tickers: list[str], start: date, end: date, root: str, agent: str = "tidemark", www: str = "https://www.sec.gov", data: str = "https://data.sec.gov", pause: float = PAUSE, form: str = "8-K", overwrite: bool = False, **how
) -> Ingested:
    """Filings of [start, end) of the tickers with their documents, from the public filing service's addresses.

    One partition asks, with a pause between requests, so the driver's lists of addresses are bounded by that rate. An
    exhibit that the service refuses with a status is left out, as is the list of a folder that isn't there (404). A main
    document, a list or an exhibit that fails otherwise, after all retries, fails its ticker and year: that cell isn't
    written, is named with the error, and is tried again by the next run, while the others go on. So does a ticker that
    no company has or whose index fails; KeyError if no company has any.
    """
    log = f"{root}/fetched"
    get = lambda urls, skip=False: fetched(spark, urls, log, agent, pause, skip, **how)
    companies = filings.parse_company_tickers(get([f"{www}/files/company_tickers.json"]), "body").cache()
    found = for_each_cell([(t, None) for t in tickers], lambda t, _: filings.cik_for_ticker(companies, t))
    failed = list(found["failed"])
    if not found["ok"]:
        raise KeyError(", ".join(t for t, _, _ in failed))
    ciks = {t: filings.cik_for_ticker(companies, t) for t, _ in found["ok"]}
    named = spark.createDataFrame([(f"{data}/submissions/CIK{c}.json", t, c) for t, c in ciks.items()], "url string, ticker string, cik string")
    whole = get([f"{data}/submissions/CIK{c}.json" for c in ciks.values()], True).join(F.broadcast(named), "url")
    keep = ("ticker", "cik")
    older = whole.select(*keep, F.explode(F.from_json(F.get_json_object("body", "$.filings.files"), "array<struct<name:string>>")).alias("f")).select(*keep, F.concat(F.lit(f"{data}/submissions/"), "f.name").alias("url"))
    shards = older.collect()
    more_rows = get([r["url"] for r in shards], True).join(older, "url")
    # a ticker of which a part of the index is missing is left out whole
    state = answers(spark, log)
    parts = named.select("url", *keep).unionByName(older.select("url", *keep))
    unlisted = parts.join(state, "url", "left").where("body IS NULL").groupBy("ticker").agg(F.min(F.coalesce("error", F.lit("not asked"))).alias("error")).collect()
    failed += [(r["ticker"], None, r["error"]) for r in unlisted]
    listed = ~F.col("ticker").isin([r["ticker"] for r in unlisted]) if unlisted else F.lit(True)
    recent = filings.columnar_json_to_rows(whole.where(listed).withColumn("json", F.get_json_object("body", "$.filings.recent")), keep=keep)
    index = filings.list_filings(recent, *([filings.columnar_json_to_rows(more_rows.where(listed), "body", keep)] if shards else []), form=form)
    index = splits.date_range(index, "filingDate", start, end).cache()
    base = F.concat(F.lit(f"{www}/Archives/edgar/data/"), accession_path(F.col("accessionNumber"), F.col("cik")))
    main = index.select("accessionNumber", F.lit(0).alias("position"), F.col("primaryDocument").alias("name"), F.concat_ws("/", base, "primaryDocument").alias("url"))
    lists = index.select("accessionNumber", "primaryDocument", base.alias("base"), F.concat(base, F.lit("/index.json")).alias("url"))
    items = get([r["url"] for r in lists.select("url").collect()], True).join(lists, "url")
    items = items.select("accessionNumber", "primaryDocument", "base", F.posexplode(F.from_json(F.get_json_object("body", "$.directory.item"), "array<struct<name:string>>")).alias("at", "item"))
    more = filings.exhibits(items.select("accessionNumber", "primaryDocument", (F.col("at") + 1).alias("position"), F.col("item.name").alias("name"), F.concat_ws("/", "base", "item.name").alias("url")))
    wanted = main.unionByName(more.drop("primaryDocument")).cache()
    bodies = get([r["url"] for r in wanted.select("url").collect()], True)
    needed = wanted.select("accessionNumber", "url", F.when(F.col("position") == 0, F.lit("main")).otherwise(F.lit("exhibit")).alias("kind")).unionByName(lists.select("accessionNumber", "url", F.lit("list").alias("kind")))
    passed = F.col("body").isNotNull() | (F.col("kind") == "exhibit") & F.col("status").isNotNull() | (F.col("kind") == "list") & F.coalesce(F.col("status") == 404, F.lit(False))
    broken = needed.join(answers(spark, log), "url", "left").where(~passed).join(index.select("accessionNumber", "ticker", F.year("filingDate").alias("year")), "accessionNumber")
    broken = broken.groupBy("ticker", "year").agg(F.min(F.concat_ws(": ", "url", "error")).alias("error")).collect()  # a row a cell
    failed += [(r["ticker"], r["year"], r["error"]) for r in broken]
    cells = spark.createDataFrame([(r["ticker"], r["year"]) for r in broken], "ticker string, year int")
    good = index.withColumn("year", F.year("filingDate")).join(F.broadcast(cells), ["ticker", "year"], "left_anti").drop("year")
    return Ingested(ingest(good, wanted.join(bodies, "url").select("accessionNumber", "position", "name", F.col("body").alias("html")), root, form, overwrite), failed)


def label(events: DataFrame, prices: DataFrame, factors: DataFrame, root: str, ts: str = "acceptanceDateTime", overwrite: bool = False) -> DataFrame:
    """Writes events with their labels; both windows come from one fit. An event without a label keeps its row."""
    out = labels.label_events(events, prices, factors, ts)
    if "year" not in out.columns:
        out = out.withColumn("year", F.year(ts))
    return sinks.write_partitioned(out, labeled_path(root), overwrite=overwrite)


def ingest_and_label(spark: SparkSession, index: DataFrame, documents: DataFrame, prices: DataFrame, factors: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    ingest(index, documents, root, overwrite=overwrite)
    return label(spark.read.parquet(edgar_path(root)), prices, factors, root, overwrite=overwrite)


def label_cells(spark: SparkSession, tickers: list[str], years: list[int], prices: DataFrame, factors: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Labels the events of all tickers and years in one job; ticker, year, n_events, n_labeled of each that has events."""
    events = spark.read.parquet(edgar_path(root)).where(F.col("ticker").isin(tickers) & F.col("year").isin(years))
    label(events, prices.where(F.col("ticker").isin(tickers)), factors, root, overwrite=overwrite)
    done = spark.read.parquet(labeled_path(root)).where(F.col("ticker").isin(tickers) & F.col("year").isin(years))
    return done.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n_events"), F.count("direction").alias("n_labeled")).orderBy("ticker", "year")


def combine(spark: SparkSession, root: str, tickers: list[str], years: list[int], path: str) -> DataFrame:
    """Writes the labelled events of all tickers and years as one dataset, by time."""
    filings.labeled_grid(spark, labeled_path(root), tickers, years).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def for_each_cell(cells: list[tuple], work: Callable[..., object]) -> dict[str, list]:
    """Runs work for each ticker and year; a cell that fails is named with its error and the others go on."""
    done: dict[str, list] = {"ok": [], "failed": []}
    for ticker, year in cells:
        try:
            work(ticker, year)
            done["ok"].append((ticker, year))
        except Exception as e:  # noqa: BLE001  the point is to go on
            done["failed"].append((ticker, year, f"{type(e).__name__}: {e}"[:500]))
    return done


def evaluate(predictions: DataFrame) -> dict[str, DataFrame]:
    """Overall and by ticker, year and, where there is one, sector.

    Predictions are read once: their columns that reports use are persisted. All strata come from one pass over them.
    """
    used = ("ticker", "sector", "publish_ts_utc", "direction", "pred_direction", "materiality", "pred_materiality", "car_0_1", "pred_p_up", "pred_p_down", "pred_p_material")
    kept = predictions.select(*[c for c in used if c in predictions.columns]).persist()
    strata = {"ticker": F.col("ticker"), "year": F.year("publish_ts_utc")} | ({"sector": F.col("sector")} if "sector" in predictions.columns else {})
    report = metrics.strata_report(kept, strata).persist()  # a few rows a group
    return {"overall": metrics.overall_report(kept)} | {f"by_{k}": report.where(F.col("stratum") == k).drop("stratum") for k in strata}


def canary_report(events: DataFrame, **how) -> DataFrame:
    """The canary over all events and over those without earnings."""
    from ..operators.splits import drop_earnings

    named = [("all", events), ("without_earnings", drop_earnings(events))]
    rows = [canary.run_canary(e, **how).select(F.lit(k).alias("events"), "*") for k, e in named]
    return rows[0].unionByName(rows[1])


def diagnosis(train: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    out = {"predicted": diagnose.class_distribution(predictions, "pred_direction"), "truth": diagnose.class_distribution(predictions, "direction"), "issues": diagnose.collapse_diagnosis(predictions, train)}
    if metrics.has_probabilities(predictions):
        out["edge"] = diagnose.edge_stats(predictions)
    return out


def spot_check(labeled: DataFrame, z: str = "car_z_0_1", n: int = 10) -> DataFrame:
    """The n events with the largest |z|, missing ones last, with their items described and a piece of the body."""
    from ..functions.text import excerpt
    from ..operators.features import described_items
    from ..sources.dims import ITEM_NAMES

    top = labeled.orderBy(F.abs(z).desc_nulls_last(), *[c for c in ("accessionNumber", "event_id") if c in labeled.columns]).limit(n)
    return top.withColumn("items_described", described_items(F.col("items"), ITEM_NAMES)).withColumn("excerpt", excerpt(F.col("body_text")))


__all__ = ["Ingested", "answers", "canary_report", "combine", "diagnosis", "edgar_path", "evaluate", "fetch", "fetch_and_ingest", "fetched", "for_each_cell", "ingest", "ingest_and_label", "label", "label_cells", "labeled_path", "spot_check"]
