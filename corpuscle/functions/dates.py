"""Date expressions: fallback chains, compact forms and the structural-break flag."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BREAK_DATE


def known(c) -> Column:
    """null, '' and 'unknown' as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | c.isin("", "unknown"), None).otherwise(c)


def first_known(*cs) -> Column:
    """First date that is told, 'unknown' when none."""
    return F.coalesce(*[known(c) for c in cs], F.lit("unknown"))


def after_break(c, day: str = BREAK_DATE) -> Column:
    """1 from the break date on by string order; unknown and null give 0."""
    return F.coalesce((known(c) >= day).cast("int"), F.lit(0))


def to_day(c) -> Column:
    """ISO day or null; never raises."""
    return F.try_to_date(c, "yyyy-MM-dd")


def unix_day(c) -> Column:
    return F.date_format(F.timestamp_seconds(F.expr(f"try_cast({c} AS bigint)")), "yyyy-MM-dd")


def compact_day(c) -> Column:
    """YYYYMMDD[HHMMSS] as YYYY-MM-DD."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{8}"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def path_day(c) -> Column:
    """A day in the path of an address: /2024/03/17/ or 2024-03-17."""
    d = F.regexp_extract(c, r"(\d{4})[/-](\d{2})[/-](\d{2})", 0)
    return F.when(d != "", F.translate(d, "/", "-"))


def written_day(c) -> Column:
    """'17 March 2024' or 'Mar 17, 2024'."""
    dmy, mdy = r"(\d{1,2}) ([A-Z][a-z]{2})[a-z]* (\d{4})", r"([A-Z][a-z]{2})[a-z]* (\d{1,2}), (\d{4})"
    a = F.concat_ws(" ", *[F.nullif(F.regexp_extract(c, dmy, i), F.lit("")) for i in (2, 1, 3)])
    b = F.concat_ws(" ", *[F.nullif(F.regexp_extract(c, mdy, i), F.lit("")) for i in (1, 2, 3)])
    both = F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    return F.date_format(F.try_to_timestamp(both, F.lit("MMM d yyyy")), "yyyy-MM-dd")
