"""Row filters: completed-status, router contracts, inclusive date range."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta, timezone
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from bridgelens.config import SIMPLIFIED_STATUS_DONE, STATUS_DONE

DateLike = date | str | None


def completed() -> Column:
    """``status = 'executed' AND simplified_status = 'received'``."""
    return (F.col("status") == STATUS_DONE) & (F.col("simplified_status") == SIMPLIFIED_STATUS_DONE)


def router_pattern(routers: Iterable[str]) -> str:
    """Case-insensitive alternation of the literal router addresses."""
    routers = [r for r in routers]
    if not routers or "" in routers:
        raise ValueError("routers must not be empty")
    return "(?i)(" + "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", r) for r in routers) + ")"


def router_match(address: Column, routers: Iterable[str]) -> Column:
    """Case-insensitive "contains any of" over the router list.

    Same rows as ``address ILIKE '%r%'`` OR-ed over the list, but written as
    one regular expression so ``address`` is evaluated once per row; when it is
    a path into unparsed JSON, an OR of five tests would parse the document
    five times after Catalyst pushes the filter below the parse.  A NULL
    address never matches.
    """
    return F.coalesce(address.rlike(router_pattern(routers)), F.lit(False))


def to_date_value(d: DateLike) -> date | None:
    if d is None or isinstance(d, date) and not isinstance(d, datetime):
        return d
    if isinstance(d, datetime):
        return d.date()
    return datetime.fromisoformat(str(d)).date()  # a date, or a full date and time; anything else raises


def check_range(start: DateLike, end: DateLike) -> tuple[date | None, date | None]:
    s, e = to_date_value(start), to_date_value(end)
    if s is not None and e is not None and s > e:
        raise ValueError(f"start {s} is after end {e}")
    return s, e


def date_between(day: Column, start: DateLike, end: DateLike) -> Column:
    """Inclusive day-level range; an open side (None) is unbounded."""
    s, e = check_range(start, end)
    cond = F.lit(True)
    if s is not None:
        cond = cond & (day >= F.lit(s))
    if e is not None:
        cond = cond & (day <= F.lit(e))
    return cond


def created_day(df: DataFrame) -> Column:
    """Day of ``created_at``; of a zoned timestamp it is the UTC day, whatever the session's zone."""
    at = F.col("created_at")
    if isinstance(df.schema["created_at"].dataType, TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int"))
    return F.to_date(at)


def event_day(df: DataFrame) -> Column:
    """Day of an event: the saved day column when present, else the day of ``created_at``."""
    return F.col("event_date") if "event_date" in df.columns else created_day(df)


def created_between(df: DataFrame, start: DateLike, end: DateLike) -> Column:
    """The day range on ``created_at``, in a form that reaches the Parquet scan.

    Without a zone Catalyst turns the cast to a date into a range itself; a
    zoned timestamp is compared with the UTC bounds of the days.
    """
    if not isinstance(df.schema["created_at"].dataType, TimestampType):
        return date_between(created_day(df), start, end)
    s, e = check_range(start, end)
    cond = F.lit(True)
    if s is not None:
        cond = cond & (F.col("created_at") >= F.lit(datetime.combine(s, time(), timezone.utc)))
    if e is not None:
        cond = cond & (F.col("created_at") < F.lit(datetime.combine(e + timedelta(days=1), time(), timezone.utc)))
    return cond


def in_date_range(df: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Keep events whose day lies in [start, end].

    On the saved relation the same range is also stated on the month
    partition column, which prunes whole folders before any file is opened;
    the day predicate then skips row groups by their min/max statistics.
    """
    s, e = check_range(start, end)
    if s is None and e is None:
        return df
    cond = date_between(F.col("event_date"), s, e) if "event_date" in df.columns else created_between(df, s, e)
    if "event_month" in df.columns:
        cond = cond & date_between(
            F.col("event_month"),
            s.replace(day=1) if s is not None else None,
            e.replace(day=1) if e is not None else None,
        )
    return df.where(cond)
