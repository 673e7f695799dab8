"""Time arithmetic with the reference's pandas semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.functions.columns import CREATED
from civiclens.functions.text import strip

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_days(end, start) -> Column:
    """Whole elapsed 24h periods from ``start`` to ``end``, floored (-1h -> -1).

    Matches ``(end - start).dt.days``; ``datediff`` counts calendar boundaries
    and ``timestampdiff(DAY)`` truncates toward zero, so neither is used.
    Works on TIMESTAMP and TIMESTAMP_NTZ; null in, null out.
    """
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.floor(micros / F.lit(MICROS_PER_DAY))


def minus_days(ts, days: int) -> Column:
    """``ts - timedelta(days=n)`` (exact 24h periods, no calendar logic)."""
    return _c(ts) - F.make_dt_interval(F.lit(int(days)))


def as_of_max(df: DataFrame, col: str = CREATED) -> Column:
    """Reference "now" = max(created) as a scalar subquery.

    Spark evaluates the subquery once and inlines the value into the outer
    plan, so nothing is collected to the driver and no shuffle is added.
    """
    return df.select(F.max(col)).scalar()


def resolve_as_of(df: DataFrame, as_of=None, col: str = CREATED) -> Column:
    """An explicit ``as_of`` (string/datetime/Column) or the max of ``col``."""
    if as_of is None:
        return as_of_max(df, col)
    if isinstance(as_of, Column):
        return as_of
    if hasattr(as_of, "isoformat"):  # datetime: text keeps it free of time zones
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def year_month(ts) -> Column:
    """Monthly period label ``yyyy-MM`` (``to_period('M')``)."""
    return F.date_format(_c(ts), "yyyy-MM")


# The five accepted date layouts (ISO, month/day/year,
# day/month/year, ISO with time, month/day/year with time), tried in this
# order; the time part of the last two is discarded, so 1/2/2024 reads as
# January 2.  Single-letter fields accept one or two digits, as strptime does.
DATE_FORMATS = (
    "yyyy-M-d",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy-M-d H:m:s",
    "M/d/yyyy H:m:s",
)


# Shapes of the five layouts.  A string of one shape can only be parsed by
# the layouts of that shape, so testing the shape first gives the same
# first-match result with a single parse attempt per value (failed parse
# attempts are expensive: each one raises inside the JVM).
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_MDY = r"^\d{1,2}/\d{1,2}/\d{4}$"
_MONTH_FIRST = r"^(0?[1-9]|1[0-2])/"
_ISO_T = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_MDY_T = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"


def parse_date(col) -> Column:
    """First layout that parses wins; blanks and garbage become null.
    A text whose first number is no month is not tried as month first: a try
    that fails costs an exception per row."""
    s = strip(_c(col).cast("string"))
    iso, mdy, dmy, iso_t, mdy_t = DATE_FORMATS[0], DATE_FORMATS[1], DATE_FORMATS[2], \
        DATE_FORMATS[3], DATE_FORMATS[4]
    return (F.when(s.rlike(_ISO), F.try_to_date(s, iso))
             .when(s.rlike(_MDY), F.coalesce(F.when(s.rlike(_MONTH_FIRST), F.try_to_date(s, mdy)), F.try_to_date(s, dmy)))
             .when(s.rlike(_ISO_T), F.to_date(F.try_to_timestamp(s, F.lit(iso_t))))
             .when(s.rlike(_MDY_T), F.to_date(F.try_to_timestamp(s, F.lit(mdy_t)))))
