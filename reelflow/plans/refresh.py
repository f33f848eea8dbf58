"""Derived tables: daily sales, customer indicators, copy status, and their upkeep.

Each function returns the new content; `reelflow.sources.sinks` writes it.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.functions.scalars import as_date, as_datetime, ntz, strict_greatest, within_days
from reelflow.operators.changes import delete_where, deleted_keys, replace_range, update_join
from reelflow.operators.keys import fresh_join, left_join_spread_nulls
from reelflow.sources.tables import RentalTables


def _stamp(as_of: datetime | str | None) -> Column:
    value = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(value).cast("timestamp").alias("last_update")


def refresh_sales_rollup(
    t: RentalTables, start: date | str, end: date | str, as_of: datetime | str | None = None
) -> DataFrame:
    """Daily sales and payment count by store and category for `start..end`, both inclusive.

    Payments of films without a category go to category 0. The copy side (copy, store, category)
    is prepared on its own, so the facts pass through two joins and one aggregate.
    """
    # films and their categories grow, and their size is estimated from compressed files: never built on the driver
    categories = t.film_category.select("film_id", "category_id").join(t.film.select("film_id").hint("merge"), "film_id", "left_semi")
    stocked = t.inventory.select("inventory_id", "film_id", "store_id").join(t.store.select("store_id"), "store_id", "left_semi")
    copies = fresh_join(stocked, categories.hint("merge"), "film_id", "left").select(
        "inventory_id", "store_id", F.coalesce("category_id", F.lit(0)).cast("long").alias("category_id")
    )
    sold = t.payment.filter(within_days("payment_date", start, end) & F.col("rental_id").isNotNull()).select(
        "rental_id", "amount", F.to_date("payment_date").alias("sales_date")
    )
    return (
        sold.join(t.rental.select("rental_id", "inventory_id"), "rental_id")
        .join(copies, "inventory_id")
        .groupBy("sales_date", "store_id", "category_id")
        .agg(F.sum("amount").cast("decimal(18,2)").alias("total_sales"), F.count(F.lit(1)).alias("tx_count"))
        .withColumn("last_update", _stamp(as_of))
    )


def refresh_customer_kpis(t: RentalTables, as_of: datetime | str | None = None) -> DataFrame:
    """Rentals, open rentals, spending and last dates of every customer."""
    rentals = t.rental.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rentals_count"),
        F.count_if(F.col("return_date").isNull()).alias("active_rentals"),
        F.max("rental_date").alias("last_rental"),
    )
    payments = t.payment.groupBy("customer_id").agg(
        F.sum("amount").alias("spent"), F.max("payment_date").alias("last_payment")
    )
    spent = F.coalesce("spent", F.lit(0)).cast("decimal(18,2)")
    return (
        t.customer.select("customer_id")
        .join(rentals, "customer_id", "left")
        .join(payments, "customer_id", "left")
        .select(
            "customer_id",
            F.coalesce("rentals_count", F.lit(0)).cast("long").alias("rentals_count"),
            F.coalesce("active_rentals", F.lit(0)).cast("long").alias("active_rentals"),
            spent.alias("total_spent"),
            "last_payment",
            "last_rental",
            spent.alias("balance_cached"),
            _stamp(as_of),
        )
    )


def refresh_inventory_status(t: RentalTables, as_of: datetime | str | None = None) -> DataFrame:
    """Stock flag, number of rentals and last rental of every copy."""
    rentals = t.rental.groupBy("inventory_id").agg(
        F.count_if(F.col("return_date").isNull()).alias("n_open"),
        F.count(F.lit(1)).alias("n_rentals"),
        F.max("rental_date").alias("last_rental"),
    )
    return (
        t.inventory.select("inventory_id", "film_id", "store_id")
        .join(rentals, "inventory_id", "left")
        .select(
            "inventory_id",
            "film_id",
            "store_id",
            (F.coalesce("n_open", F.lit(0)) == 0).alias("is_in_stock"),
            F.coalesce("n_rentals", F.lit(0)).cast("long").alias("total_rentals"),
            "last_rental",
            _stamp(as_of),
        )
    )


def populate_extended_tables(
    t: RentalTables, start: date | str, end: date | str, as_of: datetime | str | None = None
) -> dict[str, DataFrame]:
    """The three derived tables, in refresh order."""
    return {
        "customer_kpis": refresh_customer_kpis(t, as_of),
        "inventory_status": refresh_inventory_status(t, as_of),
        "sales_rollup_daily": refresh_sales_rollup(t, start, end, as_of),
    }


def recompute_balances(customer_kpis: DataFrame) -> DataFrame:
    """Set the cached balance to the total spent."""
    return customer_kpis.withColumn("balance_cached", F.col("total_spent"))


def cleanup_recent(t: RentalTables, days: int, as_of: datetime | str) -> RentalTables:
    """Remove payments and rentals of the last `days` days and refresh the derived tables.

    A surviving payment of a removed rental keeps its row and loses its rental_id. The daily sales
    are recomputed from `as_of - days` on if `t` has them; the other two are rebuilt.
    """
    now = as_datetime(as_of)
    since = now - timedelta(days=days)
    recent_rental = F.col("rental_date") >= ntz(since)
    removed = deleted_keys(t.rental, recent_rental, "rental_id").withColumn("gone", F.lit(True))
    payment = left_join_spread_nulls(
        delete_where(t.payment, F.col("payment_date") >= ntz(since)), removed, "rental_id", "payment_id"
    )
    payment = payment.withColumn("rental_id", F.when(F.col("gone").isNull(), F.col("rental_id"))).select(*t.payment.columns)
    left = t.replacing(payment=payment, rental=delete_where(t.rental, recent_rental))
    first, last = as_date(since), as_date(now)
    rollup = refresh_sales_rollup(left, first, last, as_of)
    if "sales_rollup_daily" in t.names():
        rollup = replace_range(t.sales_rollup_daily, rollup, "sales_date", first, last)
    return left.replacing(
        sales_rollup_daily=rollup,
        customer_kpis=refresh_customer_kpis(left, as_of),
        inventory_status=refresh_inventory_status(left, as_of),
    )


def fold_kpi_window(
    t: RentalTables, batch: int, limit_days: int, as_of: datetime | str
) -> DataFrame:
    """Add a recent window onto the indicators of the first `batch` customers (at least one).

    Not idempotent, as the window is added to running totals each time. The balance becomes the
    new total plus the window amount once more; a customer without payments gets a NULL last
    payment. Needs `t.customer_kpis`.
    """
    since = ntz(as_datetime(as_of) - timedelta(days=limit_days))
    first = t.customer.select("customer_id").orderBy("customer_id").limit(max(batch, 1))
    inside = F.col("customer_id") <= first.agg(F.max("customer_id")).scalar()  # the batch as a range, found once
    chosen = t.customer.select("customer_id").where(inside)
    rentals = (
        t.rental.where(inside)
        .groupBy("customer_id")
        .agg(
            F.count_if(F.col("rental_date") >= since).alias("rentals_w"),
            F.count_if(F.col("return_date").isNull()).alias("active_now"),
            F.max("rental_date").alias("last_rent"),
        )
    )
    payments = (
        t.payment.where(inside)
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(F.col("payment_date") >= since, F.col("amount"))).alias("amount_w"),
            F.max("payment_date").alias("last_pay"),
        )
    )
    window = (
        chosen.join(rentals, "customer_id", "left")
        .join(payments, "customer_id", "left")
        .withColumn("amount_w", F.coalesce("amount_w", F.lit(0)).cast("decimal(18,2)"))
        .fillna(0, ["rentals_w", "active_now"])
    )
    never = ntz("1000-01-01 00:00:00")
    spent = F.col("total_spent") + F.col("amount_w")
    return update_join(
        t.customer_kpis,
        window,
        "customer_id",
        {
            "rentals_count": F.col("rentals_count") + F.col("rentals_w"),
            "active_rentals": F.col("active_now"),
            "total_spent": spent,
            "last_payment": strict_greatest(F.coalesce(F.col("last_payment"), never), F.col("last_pay")),
            "last_rental": strict_greatest(F.coalesce(F.col("last_rental"), never), F.col("last_rent")),
            "balance_cached": spent + F.col("amount_w"),
        },
        stamp=as_of,
        matched_is_unique=True,
    )
