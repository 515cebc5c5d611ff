"""Dates in several written forms."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

# Written forms of dates, in the order in which they are tried.
COMPACT = ("yyyyMMdd",)
LISTING = ("d MMMM yyyy", "MMMM d, yyyy", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy")
DETAIL = ("d MMMM yyyy", "d.MMMM.yyyy", "d.MMMM yyyy", "d MMM yyyy", "d.MMM.yyyy", "d.MMM yyyy")


def parse_date(col: Column, formats: tuple[str, ...]) -> Column:
    """The first form that fits, else null."""
    return F.coalesce(*[F.try_to_date(strip(col), f) for f in formats])


def parse_detail_date(col: Column) -> Column:
    """As :func:`parse_date` for detail pages: "Sept", and blanks around dots, are put right first."""
    text = F.regexp_replace(F.regexp_replace(col, r"(?i)\bsept\b", "Sep"), r"\s*\.\s*", ".")
    return parse_date(squeeze(text), DETAIL)


def date_or(col: Column, as_of: date) -> Column:
    """A missing date becomes the run's date, never the clock's."""
    return F.coalesce(col, F.lit(as_of))


def parse_since(since: str | datetime | None, now: datetime) -> datetime | None:
    """None, a time, an ISO text or days back ("30d"); a time without a zone is UTC."""
    if since is None:
        return None
    if isinstance(since, str):
        text = since.strip()
        if text[-1:] == "d" and text[:-1].isdigit():
            return now - timedelta(days=int(text[:-1]))
        since = datetime.fromisoformat(text)
    return since if since.tzinfo else since.replace(tzinfo=timezone.utc)
