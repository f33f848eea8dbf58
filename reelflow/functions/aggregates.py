"""Aggregate expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_concat(value: str, sep: str = ", ", order_by: str | None = None, distinct: bool = False) -> Column:
    """Joined text of the non-NULL values of a group (a string column), in a stated order.

    The value of one group is one output cell, so its size is that of the result itself; values
    are gathered per map task first (`listagg` aggregates partially). With `distinct` the order
    column must be the value, as in SQL.
    """
    order = value if distinct or order_by is None else order_by
    what = f"distinct {value}" if distinct else value
    quoted = sep.replace("'", "\\'")
    return F.expr(f"listagg({what}, '{quoted}') within group (order by {order})")


def exact_mean(total: Column, n: Column) -> Column:
    """Mean as double from an exact decimal total, so that the order of summing cannot matter."""
    return total.cast("double") / n


def population_stddev(weight: Column, total: Column, square_total: Column, unit: float = 100.0) -> Column:
    """Population standard deviation from exact moments, one formula for groups of any size.

    The inputs are integer-valued decimals (amounts counted in cents): sum of weights, weighted
    sum and weighted sum of squares. Squares are taken about the mean's whole part `q`: their sum
    is `s2 - q * (2 * s1 - q * w)`, exact, and no larger than `s2`, so it fits 38 digits whenever
    `s2` does. What is left of the mean, `r / w`, is under one unit. Equal amounts give exactly 0,
    and the result does not depend on the order of summing.
    """
    wide = "decimal(38,0)"
    w, s1, s2 = weight.cast(wide), total.cast(wide), square_total.cast(wide)
    q = F.floor(s1 / w).cast(wide)
    about_q = (s2 - (q * (s1 * 2 - (q * w).cast(wide)).cast(wide)).cast(wide)).cast("double")
    r, n = (s1 - (q * w).cast(wide)).cast("double"), w.cast("double")
    return F.sqrt(F.greatest(about_q - r * r / n, F.lit(0.0)) / n) / F.lit(unit)
