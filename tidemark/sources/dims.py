"""Static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Universes, sectors and item names that results are labelled with.
PILOT_TICKERS = ("JPM", "XOM", "WMT", "MRK", "BA")
SECTORS = {
    "Communication Services": ("DIS", "VZ"),
    "Consumer Discretionary": ("HD", "MCD", "NKE"),
    "Consumer Staples": ("WMT", "KO", "PG"),
    "Energy": ("XOM", "CVX"),
    "Financials": ("JPM", "BAC", "GS"),
    "Health Care": ("MRK", "JNJ", "PFE"),
    "Industrials": ("BA", "CAT", "HON"),
    "Information Technology": ("ORCL", "IBM", "CSCO"),
    "Materials": ("LIN",),
    "Real Estate": ("AMT",),
    "Utilities": ("NEE",),
}
FULL_TICKERS = tuple(t for names in SECTORS.values() for t in names)
ITEM_NAMES = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition (EARNINGS)",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "3.01": "Notice of Delisting / Failure to Comply with Listing Standards",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previous Financial Statements",
    "5.02": "Departure / Appointment of Directors or Officers",
    "5.03": "Amendments to Articles of Incorporation or Bylaws",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, s) for s, names in SECTORS.items() for t in names], "ticker string, sector string")


def items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ITEM_NAMES.items()), "item string, description string")
