"""Time expressions. Timestamps without a zone count as UTC; the market's clock is New York's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"


def market_time(ts: Column) -> Column:
    """The wall clock at the market, as a timestamp without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), ts.cast("timestamp_ntz"))


def market_date(ts: Column) -> Column:
    return F.to_date(market_time(ts))


def micros_of_day(ts: Column) -> Column:
    """Microseconds since midnight at the market."""
    local = market_time(ts)
    return (F.hour(local) * 3600 + F.minute(local) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("bigint")


def clock(hour: int, minute: int) -> Column:
    return F.lit((hour * 3600 + minute * 60) * 1_000_000)


def time_label(ts: Column) -> Column:
    """unknown, weekend, pre_open, intraday or after_close; a boundary belongs to what it begins."""
    at = micros_of_day(ts)
    return (
        F.when(ts.isNull(), F.lit("unknown"))
        .when(F.weekday(market_date(ts)) >= 5, F.lit("weekend"))
        .when(at < clock(9, 30), F.lit("pre_open"))
        .when(at < clock(16, 0), F.lit("intraday"))
        .otherwise(F.lit("after_close"))
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
