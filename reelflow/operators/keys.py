"""Key generation without a global sort and null-safe join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense_index(df: DataFrame, key: str, name: str = "idx", slices: int = 8191) -> DataFrame:
    """Number all rows 0..n-1 by (`key % slices`, `key`) without gathering them in one task.

    Each slice is numbered by its own window task; the slice offsets come from one running sum
    over at most `slices` rows. The key must be an integer column and unique; a prime number of slices keeps
    them even for keys built with a stride. Raise `slices` with the table so that one slice fits a task.
    """
    slice_no = F.pmod(F.col(key), F.lit(slices))
    sliced = df.where(F.col(key).isNotNull()).withColumn("_slice", slice_no)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice").orderBy(key)))
    # a left join, as an inner one would push a filter into one side only, and `df` be computed for each side
    return (
        local.join(offsets, "_slice", "left")
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_slice", "_offset", "_rn")
    )


def first_copied_key(source: DataFrame, key: str, copies: int, above: DataFrame | None = None) -> Column:
    """The key of the first one of `copies` copies of a row of `source`; the others follow it without a gap.

    New keys are above every key of `above`, the table the copies are appended to, `source` itself by default. The
    smallest and largest key are scalar subqueries, so the expression is narrow and gives the same keys whenever
    it is computed; as keys of `source` are unique, so are the new ones, and none meets an old one. New
    keys span `copies` times the span of the old ones; where that does not fit the key's type, as with
    hashed ids, the job fails and says so (number the rows with `dense_index` first).
    """
    kind = source.schema[key].dataType
    wide = "decimal(38,0)"
    top = (source if above is None else above).agg(F.max(key)).scalar().cast(wide)
    low = source.agg(F.min(key)).scalar().cast(wide)
    new = (F.coalesce(top, low - 1) + 1 + (F.col(key).cast(wide) - low) * F.lit(copies).cast("decimal(10,0)")).cast(wide)
    if isinstance(kind, T.DecimalType):
        return new.cast(kind)
    last = (new + F.lit(copies - 1).cast("decimal(10,0)")).cast(wide)
    fits = F.when(last.try_cast(kind).isNotNull(), new.try_cast(kind))
    too_wide = F.raise_error(F.lit(f"new keys of {key} do not fit its type; give the rows dense keys first")).cast(kind)
    return F.when(new.isNull() | fits.isNotNull(), fits).otherwise(too_wide)


def append_with_keys(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append `rows`, whose own values of `key` are unique, under new keys above all of the target's.

    Rows that exist keep their keys, so everything that refers to them stays right.
    """
    new = rows.withColumn(key, first_copied_key(rows, key, 1, above=target))
    return target.unionByName(new.select(*target.columns))


def left_join_spread_nulls(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on an integer key in which rows with a NULL key are spread over many tasks.

    NULL keys never match, yet a plain shuffle sends all of them to one task. Here both sides are
    joined on a second key as well: the key itself, or for a NULL key a number taken from
    `spread_by`. The first key keeps NULLs from matching, the second one spreads them.
    """
    stand_in = -1 - F.pmod(F.xxhash64(spread_by), F.lit(1 << 40))
    marked = left.withColumn("_place", F.coalesce(F.col(key), stand_in)).alias("l")
    other = right.withColumn("_place", F.col(key)).alias("r")
    joined = marked.join(other, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._place") == F.col("r._place")), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c != key]).drop("_place")


def fresh_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join in which both sides are exchanged anew, so that adaptive execution can split a hot `left` key.

    For a right side that is itself the result of joins on the same key: its partitioning would be
    reused as it is, and adaptive execution splits a hot key only between two fresh exchanges. A second
    key, made of the first one, asks for a partitioning that neither side has; no row is repeated. It has two
    values only, so that it takes next to nothing in the compressed exchange, where a hash would take its eight bytes.
    """
    if how not in ("inner", "left"):
        raise ValueError("fresh_join supports inner and left joins")
    place = F.pmod(F.xxhash64(key), F.lit(2)).cast("byte")
    return left.withColumn("_place", place).join(right.withColumn("_place", place), [key, "_place"], how).drop("_place")
