"""Text expressions: cleaning of filing bodies, item mentions, prompts and responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that training data and answers are made of, and the cues at which a filing's substance begins.
SYSTEM_PROMPT = (
    "You are a financial event reaction predictor. Given a regulatory filing "
    "about a public company, predict the direction and materiality of the "
    "next-day stock-price reaction in factor-adjusted abnormal-return terms."
)
USER_SLOTS = (
    ("Ticker", "ticker"),
    ("Sector", "sector"),
    ("Filing date (UTC)", "publish_date"),
    ("Time relative to market", "time_label"),
    ("Same-day 8-K count for ticker", "n_same_day"),
    ("Days since previous 8-K", "days_since"),
    ("8-K items", "items"),
    ("Body", "body"),
)
BODY_CUES = ("ex-99", "ex99", "exhibit 99", "news release", "press release", "reports", "announces", "completes", "agrees")
BODY_CHARS = 1500
RESPONSE_PATTERN = r"(?i)Direction:\s*(down|neutral|up)\s*\n?Materiality:\s*(material|immaterial)"


def squeeze(text: Column) -> Column:
    """White space of any kind to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(text: Column) -> Column:
    """Tags and the non-breaking space to a space, the ampersand decoded; script bodies and other references stay."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"&nbsp;|&#160;", " ")
    return squeeze(F.replace(plain, F.lit("&amp;"), F.lit("&")))


def items_mentioned(text: Column) -> Column:
    """Distinct item numbers named in a body, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)Item\s+(\d+\.\d+)"), F.lit(1))))


def trim_body(text: Column, limit: int = BODY_CHARS) -> Column:
    """`limit` characters from the earliest cue (or the start), then white space squeezed; null gives ''."""
    low = F.lower(text)
    first = F.least(*[F.nullif(F.instr(low, cue), F.lit(0)) for cue in BODY_CUES])
    return F.coalesce(squeeze(F.substring(text, F.coalesce(first, F.lit(1)), F.lit(limit))), F.lit(""))


def excerpt(text: Column, limit: int = 600) -> Column:
    """Characters from the exhibit's heading (or the start), on one line."""
    at = F.greatest(F.instr(F.lower(text), "exhibit 99"), F.lit(1))
    return F.translate(F.substring(text, at, F.lit(limit)), "\n", " ")


def items_display(items: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(items), F.lit("")), F.lit("n/a"))


def materiality_text(material: Column) -> Column:
    return F.when(material, F.lit("material")).otherwise(F.lit("immaterial"))


def user_prompt(**slots: Column) -> Column:
    """The slots of USER_SLOTS by name; -1 days since the previous filing reads n/a."""
    slots = slots | {"days_since": F.when(slots["days_since"] < 0, F.lit("n/a")).otherwise(slots["days_since"].cast("string"))}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(slots[name].cast("string"), F.lit(""))) for label, name in USER_SLOTS])


def response(direction: Column, materiality: Column) -> Column:
    return F.concat(F.lit("Direction: "), F.coalesce(direction, F.lit("neutral")), F.lit("\nMateriality: "), F.coalesce(materiality, F.lit("immaterial")))


def parse_response(text: Column) -> tuple[Column, Column]:
    """Direction and materiality of the first well-formed answer; nulls without one."""
    return tuple(F.nullif(F.lower(F.regexp_extract(text, RESPONSE_PATTERN, i)), F.lit("")) for i in (1, 2))


def messages(user: Column, answer: Column | None = None) -> Column:
    """array<struct<role,content>>: system, user and, where there is one, the assistant's answer."""
    turns = [("system", F.lit(SYSTEM_PROMPT)), ("user", user)] + ([("assistant", answer)] if answer is not None else [])
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])


def chat_template(turns: Column, generation: bool = False) -> Column:
    """Turns between their markers, one after the other; with `generation` the assistant's turn is left open."""
    parts = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation else text


def accession_path(accession: Column, cik: Column) -> Column:
    """Folder of a filing: the number of its filer and its accession number without dashes."""
    return F.concat_ws("/", cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")))


def is_exhibit(name: Column, primary: Column) -> Column:
    low = F.lower(name)
    kind = reduce(lambda a, b: a | b, [low.endswith(e) for e in (".htm", ".html", ".txt")])
    named = reduce(lambda a, b: a | b, [low.contains(e) for e in ("ex99", "ex-99", "exhibit99")])
    return (name != primary) & kind & named


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * share)
