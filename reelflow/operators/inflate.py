"""Data inflation: repeated self-append with shifted dates, as one narrow pass.

Appending a table to itself once per step doubles it each time, so after `k` steps every source
row has `2**k` copies, one for each subset of the steps. A copy is therefore numbered by its
step mask, and all copies come from one `explode` instead of `k` dependent passes. Whatever does not
depend on the mask is computed before it, and all that does is plain code of a few numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelflow.functions.scalars import add_years
from reelflow.operators.keys import first_copied_key

STEP_YEARS = (1, 2, 3, 4, 5)

#: Tasks over which the rentals of one customer are spread.
CUSTOMER_SLICES = 8


def _leap_day(column: str) -> Column:
    return (F.month(column) == 2) & (F.dayofmonth(column) == 29)


def _shifted(column: str, years: Sequence[int]) -> Column:
    """The date moved by the steps of `_mask`; month ends clamp at every step, which only 29 February can show."""
    moves = [F.when(F.col("_mask").bitwiseAND(1 << bit) != 0, F.lit(step)).otherwise(F.lit(0)) for bit, step in enumerate(years)]
    total, stepwise = F.lit(0), F.col(column)
    for move in moves:
        total, stepwise = total + move, add_years(stepwise, move)
    return F.when(_leap_day(column), stepwise).otherwise(add_years(column, total))


def _masks(years: Sequence[int]) -> list[int]:
    return list(range(1 << len(years)))


def _first_masks(years: Sequence[int]) -> list[int]:
    """The lowest mask of every distinct total shift."""
    first: dict[int, int] = {}
    for mask in _masks(years):
        first.setdefault(sum(y for bit, y in enumerate(years) if mask >> bit & 1), mask)
    return sorted(first.values())


def _array(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _copies(df: DataFrame, masks: Column, dates: Sequence[str], years: Sequence[int]) -> DataFrame:
    """A row for each mask, with the `dates` moved by its steps."""
    # an inner explode would have the optimizer repeat the array in a filter below it; there always is a mask
    return df.withColumn("_mask", F.explode_outer(masks)).withColumns({c: _shifted(c, years) for c in dates})


def _first_key(df: DataFrame, source: DataFrame, key: str, years: Sequence[int]) -> DataFrame:
    """The key of a row's first copy, before there are copies."""
    return df.withColumn("_first", first_copied_key(source, key, max(1, (1 << len(years)) - 1))) if key in df.columns else df


def _key(source: DataFrame, key: str) -> Column:
    """A source row's own key, or a new one for a copy: unique, and above all keys there are."""
    kind = source.schema[key].dataType
    number = (F.col("_mask") - 1).cast("decimal(10,0)" if isinstance(kind, T.DecimalType) else kind)
    return F.when(F.col("_mask") == 0, F.col(key)).otherwise((F.col("_first") + number).cast(kind))


def task_count(df: DataFrame) -> int:
    """Tasks for rows that are to be copied: the session's number, which adaptive execution does not lower by their size before."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def inflate_payment(payment: DataFrame, years: Sequence[int] = STEP_YEARS, as_of: str | None = None) -> DataFrame:
    """Payments grown by `2**len(years)`; copies belong to no rental.

    Source rows keep their keys, so other tables still meet them; copies get keys above. No row is exchanged, and
    columns that stay as they are keep their partitioning.
    """
    copy = F.col("_mask") != 0
    grown = _copies(_first_key(payment, payment, "payment_id", years), _array(_masks(years)), ["payment_date"], years)
    for name, value in {
        "payment_id": lambda: _key(payment, "payment_id"),
        "rental_id": lambda: F.when(~copy, F.col("rental_id")),
        "last_update": lambda: F.when(copy, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_update")),
    }.items():
        if name in payment.columns:
            grown = grown.withColumn(name, value())
    return grown.select(*payment.columns)


def inflate_rental(
    rental: DataFrame,
    years: Sequence[int] = STEP_YEARS,
    on_conflict: str = "skip",
    as_of: str | None = None,
) -> DataFrame:
    """Rentals grown by date-shifted copies under the unique (date, copy, customer) key.

    Step sums coincide (1 + 2 = 3), so copies collide. `on_conflict="skip"` keeps the earliest
    made row, i.e. the lowest (mask, source key); `"error"` fails the query at the first conflict.
    Source rows are never skipped, as they are in the table already, and keep their keys.

    Only rentals of one copy and customer on the same day of the year can collide. The source rows are
    exchanged and counted by those before they are copied: the exchange carries each rental once, not
    once per mask. In skip mode, masks whose total shift a lower mask already gives are left out, except for
    29 February, where steps with one total can end on two days. So a rental that is alone on its day of the year meets no
    other row, and only copies of the others are sorted and compared. A customer's rentals come to at most
    `CUSTOMER_SLICES` tasks, so that sums by customer over the copies shrink before they are exchanged.
    """
    if on_conflict not in ("skip", "error"):
        raise ValueError("on_conflict must be 'skip' or 'error'")
    leap_day = _leap_day("rental_date")
    day = F.month("rental_date") * 100 + F.when(leap_day, F.lit(28)).otherwise(F.dayofmonth("rental_date"))
    every = _array(_masks(years))
    place = ["customer_id", "_slice"]
    group = [*place, "inventory_id", "_day"]
    source = rental.withColumn("_day", day).withColumn("_slice", F.pmod(F.xxhash64("inventory_id"), F.lit(CUSTOMER_SLICES)))
    source = _first_key(source.repartition(task_count(rental), *place), rental, "rental_id", years)
    copy = F.col("_mask") != 0

    def grown(rows: DataFrame, masks: Column) -> DataFrame:
        out = _copies(rows.withColumn("_source", F.col("rental_id")), masks, ["rental_date", "return_date"], years)
        out = out.withColumn("rental_id", _key(rental, "rental_id"))
        if "last_update" in rental.columns:
            out = out.withColumn("last_update", F.when(copy, F.lit(as_of).cast("timestamp")).otherwise(F.col("last_update")))
        return out

    def compared(rows: DataFrame, masks: Column) -> DataFrame:
        w = Window.partitionBy(*group, "rental_date").orderBy("_mask", "_source")
        ranked = grown(rows, masks).withColumn("_rn", F.row_number().over(w))
        stays = (F.col("_rn") == 1) | ~copy
        if on_conflict == "error":
            conflict = F.raise_error(F.lit("duplicate (rental_date, inventory_id, customer_id)")).cast("boolean")
            stays = F.when(stays, F.lit(True)).otherwise(conflict)
        return ranked.filter(stays).select(*rental.columns)

    if on_conflict == "error":
        return compared(source, every)
    firsts = _array(_first_masks(years))
    alone = (F.count(F.lit(1)).over(Window.partitionBy(*group)) == 1) & ~F.coalesce(leap_day, F.lit(False))
    counted = source.withColumn("_alone", alone)
    free = grown(counted.where("_alone"), firsts).select(*rental.columns)
    return free.unionByName(compared(counted.where("not _alone"), F.when(leap_day, every).otherwise(firsts)))
