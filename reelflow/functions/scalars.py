"""Scalar column functions whose meaning needs care.

All of them are compositions of built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capitalise(c: ColumnLike) -> Column:
    """First character upper case, the rest lower case (unlike `initcap`, per value, not per word)."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def full_name(first: ColumnLike, last: ColumnLike, sep: str = " ") -> Column:
    """`first<sep>last`; NULL if either part is NULL."""
    return F.concat(_col(first), F.lit(sep), _col(last))


def byte_length(c: ColumnLike) -> Column:
    """Length in UTF-8 bytes, not characters."""
    return F.octet_length(_col(c))


def strict_greatest(*cols: ColumnLike) -> Column:
    """Greatest value, NULL as soon as one argument is NULL (Spark's `greatest` skips NULLs)."""
    parts = [_col(c) for c in cols]
    any_null = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    return F.when(~any_null, F.greatest(*parts))


def days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Calendar days from `start` to `end`."""
    return F.datediff(_col(end), _col(start))


def month_start(c: ColumnLike) -> Column:
    """First day of the month, as a date."""
    return F.trunc(_col(c), "MM")


def add_years(c: ColumnLike, years: int | Column) -> Column:
    """Shift by whole years; 29 February becomes 28 February outside leap years."""
    return _col(c) + F.make_ym_interval(F.lit(years), F.lit(0))


def ntz(value: datetime | date | str) -> Column:
    """Literal without time zone."""
    return F.lit(_text(value)).cast("timestamp_ntz")


def _text(value: datetime | date | str) -> str:
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    return value.isoformat() if isinstance(value, date) else value


def as_date(value: datetime | date | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value[:10])


def as_datetime(value: datetime | date | str) -> datetime:
    if isinstance(value, datetime):
        return value
    return datetime.fromisoformat(value) if isinstance(value, str) else datetime(value.year, value.month, value.day)


def within_days(c: ColumnLike, first: date | str, last: date | str) -> Column:
    """`date(c) BETWEEN first AND last`, written as a half-open range on the raw timestamp.

    The raw form reaches the parquet row-group statistics; a function around the column would not.
    """
    c = _col(c)
    return (c >= ntz(as_date(first))) & (c < ntz(as_date(last) + timedelta(days=1)))


def stable_uuid(seed: str, *parts: ColumnLike) -> Column:
    """UUID-shaped text that depends only on the seed and the key columns."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[_col(p).cast("string") for p in parts]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])


def stable_uniform(seed: str, *parts: ColumnLike) -> Column:
    """Repeatable number in [0, 1) from the seed and the key columns (52 random bits)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
