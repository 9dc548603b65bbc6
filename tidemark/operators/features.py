"""What is known of an event before the market reacts: gaps, counts, sector, prompt fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, text


def days_since_previous(events: DataFrame, ts: str = "publish_ts", by: str = "ticker", key: str = "event_id", out: str = "days_since") -> DataFrame:
    """Calendar days at the market since the ticker's event before; -1 for its first."""
    day = clock.market_date(F.col(ts))
    before = F.lag(day).over(Window.partitionBy(by).orderBy(ts, key))
    return events.withColumn(out, F.coalesce(F.date_diff(day, before), F.lit(-1)))


def same_day_count(events: DataFrame, ts: str = "publish_ts", by: str = "ticker", out: str = "n_same_day", running: bool = False, key: str = "event_id") -> DataFrame:
    """The ticker's events on the same market day: all, or with `running` those published so far."""
    group = Window.partitionBy(by, clock.market_date(F.col(ts)))
    if running:
        group = group.orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.count(F.lit(1)).over(group))


def with_sector(events: DataFrame, sectors: DataFrame, by: str = "ticker", out: str = "sector") -> DataFrame:
    """The sector of each ticker, whatever its case; Unknown where it has none. The dimension has a row a ticker."""
    dim = sectors.select(F.upper("ticker").alias("__t"), F.col("sector").alias(out))
    return events.join(F.broadcast(dim), F.upper(F.col(by)) == F.col("__t"), "left").drop("__t").withColumn(out, F.coalesce(out, F.lit("Unknown")))


def described_items(items, names: dict[str, str]):
    """A line for each item of a comma-separated list, `?` for those without a name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    lines = F.transform(F.split(items, ","), lambda x: F.concat(F.lit("  Item "), F.trim(x), F.lit(": "), F.coalesce(F.try_element_at(table, F.trim(x)), F.lit("?"))))
    return F.when(F.coalesce(items, F.lit("")) == "", F.lit("")).otherwise(F.array_join(lines, "\n"))


def event_features(events: DataFrame, sectors: DataFrame, ts: str = "publish_ts", running: bool = False, key: str = "event_id") -> DataFrame:
    """Events with the prompt's fields beside them, each on its own row.

    Counts and gaps are over the events given: pass the whole history before any split.
    """
    out = with_sector(same_day_count(days_since_previous(events, ts, key=key), ts, running=running, key=key), sectors)
    return out.withColumns(
        {
            "publish_date": F.date_format(clock.market_date(F.col(ts)), "yyyy-MM-dd"),
            "time_label": clock.time_label(F.col(ts)),
            "items_shown": text.items_display(F.col("items")),
            "body": text.trim_body(F.col("body_text")),
            "materiality": text.materiality_text(F.col("material")),
        }
    )


def prompts(features: DataFrame, answered: bool) -> DataFrame:
    """Adds messages and text, the rendered chat."""
    user = text.user_prompt(
        ticker=F.col("ticker"), sector=F.col("sector"), publish_date=F.col("publish_date"), time_label=F.col("time_label"), n_same_day=F.col("n_same_day"),
        days_since=F.col("days_since"), items=F.col("items_shown"), body=F.col("body"),
    )
    answer = text.response(F.col("direction"), F.col("materiality")) if answered else None
    return features.withColumn("messages", text.messages(user, answer)).withColumn("text", text.chat_template(F.col("messages"), generation=not answered))
