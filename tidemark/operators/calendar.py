"""Trading calendars: ordinals, forward as-of resolution of sessions, windows and exits by ordinal, densifying.

As-of resolution is an equi-join: a session's calendar is spread to a dense map from every calendar day to the first
session at or after it, so no row is compared with a range of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock


def ordinals(sessions: DataFrame, day: str = "trade_date", by: list[str] | None = None, name: str = "seq") -> DataFrame:
    """Distinct sessions with their ordinal from 1, by group or over all.

    Without a group, the calendar has a row a day, tens of thousands at most, whatever the data's size.
    """
    keys = by or []
    return sessions.select(*keys, day).distinct().withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(day)))


def next_session_map(sessions: DataFrame, day: str = "trade_date", by: list[str] | None = None, first: DataFrame | None = None) -> DataFrame:
    """(group, target, session, ...): the first session at or after each day, to the group's last session.

    Days begin with the first session of any group, so that a group's own first session is found from there on. sessions
    are distinct, and may have more columns, which are spread with them.
    """
    keys = by or []
    more = [c for c in sessions.columns if c not in (*keys, day)]
    dated = sessions.crossJoin(F.broadcast(first_session(sessions, day) if first is None else first))
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    spans = dated.select(*keys, F.col(day).alias("session"), F.coalesce(F.date_add(before, 1), F.col("__first")).alias("from"), *more)
    return spans.where(F.col("from") <= F.col("session")).select(*keys, F.explode(F.sequence("from", "session")).alias("target"), "session", *more)


def first_session(sessions: DataFrame, day: str = "trade_date") -> DataFrame:
    """One row with the first day of all, which stands for all days before it."""
    return sessions.agg(F.min(day).alias("__first"))


def target_day(ts: Column, inclusive: bool) -> Column:
    """The day from which a session counts: the same day up to the open (or at it, if inclusive), else the next."""
    at, open_ = clock.micros_of_day(ts), clock.clock(9, 30)
    same = at <= open_ if inclusive else at < open_
    return F.when(same, clock.market_date(ts)).otherwise(F.date_add(clock.market_date(ts), 1))


def resolve(events: DataFrame, sessions: DataFrame, ts: str, out: str, inclusive: bool = False, day: str = "trade_date", by: list[str] | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Adds the first session whose open comes after ts (or at it); null after the last session.

    beside: the same sessions once each, as column `out`, with more columns, which come along: events are shuffled once,
    and sessions are read only for their first day.
    """
    keys, first = by or [], first_session(sessions, day)
    target = F.when(target_day(F.col(ts), inclusive).isNotNull(), F.greatest(target_day(F.col(ts), inclusive), F.col("__first")))
    known = events.crossJoin(F.broadcast(first)).withColumn("__target", target).drop("__first")
    spread = next_session_map(sessions.select(*keys, day).distinct(), day, by, first) if beside is None else next_session_map(beside, out, by, first)
    dense = spread.withColumnsRenamed({"target": "__target", "session": out})
    return known.join(dense, [*keys, "__target"], "left").drop("__target")


def next_session(events: DataFrame, sessions: DataFrame, ts: str = "publish_ts", out: str = "t0", **how) -> DataFrame:
    """The first session that opens strictly after the event: for labels."""
    return resolve(events, sessions, ts, out, inclusive=False, **how)


def entry_session(events: DataFrame, sessions: DataFrame, ts: str = "publish_ts", out: str = "entry_day", **how) -> DataFrame:
    """The first session that opens at or after the event: for trading."""
    return resolve(events, sessions, ts, out, inclusive=True, **how)


def offset_window(order: str, low: int, high: int, by: list[str] | None = None):
    """The frame of sessions [anchor + low, anchor + high) by ordinal; empty where the calendar has none."""
    return Window.partitionBy(*(by or [])).orderBy(order).rangeBetween(low, high - 1)


def ahead(value: str, steps: int, day: str = "trade_date", by: list[str] | None = None) -> Column:
    """A column of the session `steps` sessions later in the group; null beyond the last."""
    return F.lead(value, steps).over(Window.partitionBy(*(by or ["ticker"])).orderBy(day))


def densify(df: DataFrame, day: str, values: dict[str, float]) -> DataFrame:
    """A row for each Monday to Friday between the first and the last day; missing values filled."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = span.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias(day)).where(F.weekday(day) < 5)
    return days.join(df, day, "left").select(day, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in values.items()])
