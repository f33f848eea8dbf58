"""Distinct counts in a stored rollup that stay exact over any range of months.

A count of distinct customers cannot be added up over months, a set of them can be united. The rollup holds the sets by
month, store, category and bucket of 32,768 ids: up to `FEW` ids of a bucket as their positions, more as a bitmap of
4 KB, so a set is never much larger than its ids. A count over any months, stores and categories unites the sets
by bucket and counts bits, from the rollup alone. Ids are non-negative integers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.functions.scalars import as_date, month_start, within_days
from reelflow.sources.tables import RentalTables

KEYS = ("sales_month", "store_id", "category_id")

#: Ids of a bucket that are kept as positions; a bitmap takes the room of 2,048.
FEW = 1024


def distinct_rollup(t: RentalTables, start: date | str, end: date | str) -> DataFrame:
    """(sales_month, store_id, category_id, kind, bucket, few, ids): rentals and customers paid for, `kind` `rental` or `customer`.

    A set is in `few`, its positions, or in `ids`, its bitmap; the other one is NULL. Payments without a rental, and films
    without a category, are left out, as in the revenue report. The facts are joined once for both kinds, and sets
    are united before the one exchange, so a hot group reaches it as one set from each task.
    """
    categories = t.film_category.select("film_id", "category_id").hint("merge")  # grow with the films: never built on the driver
    copies = t.inventory.select("inventory_id", "film_id", "store_id").join(categories, "film_id")
    sold = t.payment.filter(within_days("payment_date", start, end) & F.col("rental_id").isNotNull())
    sold = sold.select("rental_id", month_start("payment_date").alias("sales_month")).distinct()
    rows = sold.join(t.rental.select("rental_id", "customer_id", "inventory_id"), "rental_id").join(copies, "inventory_id")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id")) for k in ("rental", "customer")]))
    ids = rows.select(*KEYS, both.alias("e")).select(*KEYS, "e.kind", "e.id").where("id is not null")
    place = ids.select(*KEYS, "kind", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").cast("short").alias("at"))
    group = [*KEYS, "kind", "bucket"]
    sets = place.groupBy(*group).agg(F.collect_set("at").alias("few"))
    many = sets.where(F.size("few") > FEW).select(*group, F.explode("few").alias("at"))
    maps = many.groupBy(*group).agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("ids"))
    return sets.where(F.size("few") <= FEW).unionByName(maps, allowMissingColumns=True)


def distinct_counts(rollup: DataFrame, first_month: date | str, last_month: date | str, by: Sequence[str] = ("store_id", "category_id")) -> DataFrame:
    """(by..., rentals, customers): exact distinct counts over all months of the range, from the rollup alone."""
    lo, hi = as_date(first_month).replace(day=1), as_date(last_month).replace(day=1)
    chosen = rollup.where(F.col("sales_month").between(F.lit(lo), F.lit(hi)))
    group = [*by, "kind", "bucket"]
    # positions are exchanged as they are: a bitmap from each task would be 4 KB for a few ids
    places = chosen.where("few is not null").select(*group, F.explode("few").alias("at")).repartition(*group)
    maps = places.groupBy(*group).agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("ids"))
    united = maps.unionByName(chosen.where("ids is not null").select(*group, "ids")).groupBy(*group).agg(F.bitmap_or_agg("ids").alias("ids"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("ids"))), F.lit(0)).cast("long")
    return united.groupBy(*by).agg(count("rental").alias("rentals"), count("customer").alias("customers"))
