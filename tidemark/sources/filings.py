"""Filings from their indexes, documents and exhibits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_exhibit, strip_html
from ..operators.splits import union_shards
from ..schemas import FILING_ARRAY_NAMES, FILING_ARRAYS

PRIMARY_CHARS, EXHIBIT_CHARS, BODY_CHARS = 4000, 8000, 12000


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) of a JSON object whose values are companies; cik has ten digits."""
    raw = spark.read.text(path, wholetext=True)
    return parse_company_tickers(raw, "value")


def parse_company_tickers(df: DataFrame, column: str) -> DataFrame:
    value = F.from_json(F.col(column), "map<string,struct<cik_str:bigint,ticker:string,title:string>>")
    rows = df.select(F.explode(F.map_values(value)).alias("c"))
    return rows.select(F.col("c.ticker").alias("ticker"), F.lpad(F.col("c.cik_str").cast("string"), 10, "0").alias("cik"), F.col("c.title").alias("title"))


def cik_for_ticker(companies: DataFrame, ticker: str) -> str:
    """The number of the company with that ticker, whatever its case."""
    row = companies.where(F.upper("ticker") == ticker.upper()).orderBy("cik").first()
    if row is None:
        raise KeyError(f"no company has the ticker {ticker}")
    return row["cik"]


def columnar_json_to_rows(df: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each place of the parallel arrays in a JSON object; bad dates are null, absent texts empty."""
    parsed = df.select(*keep, F.from_json(F.col(column), FILING_ARRAYS).alias("a"))
    names = FILING_ARRAY_NAMES
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"a.{n}"), F.array().cast("array<string>")).alias(n) for n in names])
    rows = parsed.select(*keep, F.inline(zipped)).toDF(*keep, *names)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        *keep, "accessionNumber", F.expr("try_cast(filingDate AS date)").alias("filingDate"), F.try_to_timestamp("acceptanceDateTime").alias("acceptanceDateTime"), "form", "primaryDocument",
        empty("primaryDocDescription").alias("primaryDocDescription"), empty("items").alias("items"),
    )


def list_filings(recent: DataFrame, *shards: DataFrame, form: str | None = "8-K", distinct: bool = False) -> DataFrame:
    """Filings of the recent index and older shards, of one form, by date; amendments are another form."""
    out = union_shards(recent, *shards)
    if form is not None:
        out = out.where(F.col("form") == form)
    return (out.dropDuplicates(["accessionNumber"]) if distinct else out).orderBy("filingDate", "accessionNumber")


def filing_text(html: Column, limit: int = 8000) -> Column:
    return F.substring(strip_html(html), 1, limit)


def assemble_text(parts: DataFrame, filing: str, position: str, html: str, primary: str) -> DataFrame:
    """(filing, body_text, n_exhibits): a filing's document and its exhibits in order, each cut, joined and cut.

    parts has a row for each document, `primary` true for the main one. A filing's documents are few.
    """
    piece = F.when(F.col(primary), filing_text(F.col(html), PRIMARY_CHARS)).otherwise(filing_text(F.col(html), EXHIBIT_CHARS))
    rows = parts.select(F.col(filing), F.struct((~F.col(primary)).cast("int").alias("o"), F.col(position).alias("p"), piece.alias("t")).alias("d"), F.col(primary).alias("m"))
    texts = F.transform(F.array_sort(F.collect_list("d")), lambda d: d["t"])
    return rows.groupBy(filing).agg(F.substring(F.trim(F.concat_ws(" ", texts)), 1, BODY_CHARS).alias("body_text"), F.count_if(~F.col("m")).alias("n_exhibits"))


def exhibits(index: DataFrame, name: str = "name", primary: str = "primaryDocument") -> DataFrame:
    """Rows of a filing's folder that are exhibits."""
    return index.where(is_exhibit(F.col(name), F.col(primary)))


def labeled_grid(spark: SparkSession, path: str, tickers: list[str], years: list[int]) -> DataFrame:
    """Labelled events of the grid, by time; the dataset is partitioned by ticker and year, and only those are read."""
    return spark.read.parquet(path).where(F.col("ticker").isin(tickers) & F.col("year").isin(years)).orderBy("acceptanceDateTime", "accessionNumber")


__all__ = ["assemble_text", "cik_for_ticker", "columnar_json_to_rows", "company_tickers", "exhibits", "filing_text", "labeled_grid", "list_filings", "parse_company_tickers"]
