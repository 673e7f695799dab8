"""The three different "open" definitions of the reference, kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclens.functions.columns import CLOSED, STATUS

SOLVED = "Solved"
UNRESOLVED = "Unresolved"


def is_unresolved_strict(status: str = STATUS) -> Column:
    """status = 'Unresolved', for filters and conditions (null: not unresolved,
    as a filter or ``when`` drops it; the plain equality reaches the scan)."""
    return F.col(status) == F.lit(UNRESOLVED)


def is_open(status: str = STATUS) -> Column:
    """status != 'Solved' with pandas semantics: null status counts as open."""
    return ~F.col(status).eqNullSafe(F.lit(SOLVED))


def is_open_or_unclosed(status: str = STATUS, closed: str = CLOSED) -> Column:
    """status != 'Solved' (null counts) OR closed date missing."""
    return is_open(status) | F.col(closed).isNull()


def is_closed(status: str = STATUS, closed: str = CLOSED) -> Column:
    """status = 'Solved' AND closed date present."""
    return is_solved(status) & F.col(closed).isNotNull()


def is_solved(status: str = STATUS) -> Column:
    """status = 'Solved', for filters and conditions (null: not solved)."""
    return F.col(status) == F.lit(SOLVED)
