"""Derived tables kept up by changes instead of full refreshes.

Input are the stored derived table, the base tables after the changes, and the change logs of rentals and
payments (`operators.changes.audit_changes`). What a changed row added before is taken away and what it
adds now is put in; minima and maxima cannot be taken back, so they are computed again for the keys that lost the
row that held them. Each function gives the new rows of the touched keys alone, `merged` puts them into the
stored table. No untouched key is joined, aggregated or shuffled, whatever the size of the base tables: they are
reduced to touched keys by a semi join first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.functions.scalars import ntz, within_days
from reelflow.operators.changes import net_changes
from reelflow.plans.refresh import refresh_inventory_status, refresh_sales_rollup
from reelflow.sources import sinks
from reelflow.sources.tables import RentalTables


def _stamped(as_of: datetime | str | None) -> Column:
    return (ntz(as_of) if as_of is not None else F.lit(None)).cast("timestamp").alias("last_update")


def _images(net: DataFrame, side: str) -> DataFrame:
    return net.where(F.col(side).isNotNull()).select(f"{side}.*")


def _signed(net: DataFrame) -> DataFrame:
    """Rows before, with `sign` -1, and rows after, with 1; a row that is the same on both sides is left out."""
    moved = net.where(~F.col("before").eqNullSafe(F.col("after")))
    return _images(moved, "before").withColumn("sign", F.lit(-1)).unionByName(_images(moved, "after").withColumn("sign", F.lit(1)))


def merged(stored: DataFrame, changed: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """The stored table with the changed keys' rows; a changed row without `n_left` (see below) is left out.

    `changed` has the columns of `stored` and may have `n_left`: 0 there means that the key has gone. It is written once, as it
    is used for the keys and for the rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    changed = sinks.stored(changed)
    alive = changed.where("n_left > 0") if "n_left" in changed.columns else changed
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(alive.select(*stored.columns))


def changed_kpis(stored: DataFrame, t: RentalTables, rental_log: DataFrame, payment_log: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """New indicators of the customers whose rentals or payments changed.

    Counts and sums are the stored ones and signed differences. A last date is the later one of the stored and
    the new dates; it is looked up in the base table only for customers who lost a row with the stored last date. Customers
    that are not stored yet start from nothing.
    """
    rentals = _signed(net_changes(rental_log, "rental_id", t.rental))
    payments = _signed(net_changes(payment_log, "payment_id", t.payment))
    sign, added = F.col("sign"), F.col("sign") > 0

    def dates(c: str, name: str) -> list[Column]:
        return [F.max(F.when(added, F.col(c))).alias(f"new_{name}"), F.max(F.when(~added, F.col(c))).alias(f"gone_{name}")]

    by_rental = rentals.groupBy("customer_id").agg(
        F.sum(sign).alias("d_rentals"), F.sum(F.when(F.col("return_date").isNull(), sign).otherwise(F.lit(0))).alias("d_active"), *dates("rental_date", "last_rental"))
    by_payment = payments.groupBy("customer_id").agg(F.sum(F.col("amount") * sign).alias("d_spent"), *dates("payment_date", "last_payment"))
    delta = by_rental.join(by_payment, "customer_id", "full")
    known = sinks.stored(delta.join(stored, "customer_id", "left"))  # used for each last date and for the result

    def latest(source: DataFrame, c: str, name: str) -> DataFrame:
        """Last dates of the customers who lost theirs."""
        lost = known.where(F.col(f"gone_{name}") >= F.col(name)).select("customer_id")
        return source.select("customer_id", c).join(lost, "customer_id", "left_semi").groupBy("customer_id").agg(F.max(c).alias(f"found_{name}"))

    out = known.join(latest(t.rental, "rental_date", "last_rental"), "customer_id", "left").join(latest(t.payment, "payment_date", "last_payment"), "customer_id", "left")

    def last(name: str) -> Column:
        lost = F.coalesce(F.col(f"gone_{name}") >= F.col(name), F.lit(False))
        return F.when(lost, F.col(f"found_{name}")).otherwise(F.greatest(name, f"new_{name}")).alias(name)

    whole = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).cast("long").alias(c)
    spent = (F.coalesce("total_spent", F.lit(0)) + F.coalesce("d_spent", F.lit(0))).cast("decimal(18,2)")
    return out.select(
        "customer_id", whole("rentals_count", "d_rentals"), whole("active_rentals", "d_active"), spent.alias("total_spent"),
        last("last_payment"), last("last_rental"), spent.alias("balance_cached"), _stamped(as_of))


def changed_status(t: RentalTables, rental_log: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """New status of the copies whose rentals changed, computed from these copies' rentals alone."""
    touched = sinks.stored(_signed(net_changes(rental_log, "rental_id", t.rental)).select("inventory_id").distinct())
    own = t.replacing(
        inventory=t.inventory.join(touched, "inventory_id", "left_semi"),
        rental=t.rental.select("rental_id", "inventory_id", "rental_date", "return_date").join(touched, "inventory_id", "left_semi"),
    )
    return refresh_inventory_status(own, as_of)


def changed_rollup(
    stored: DataFrame, t: RentalTables, rental_log: DataFrame, payment_log: DataFrame, start: date | str, end: date | str, as_of: datetime | str | None = None
) -> DataFrame:
    """New daily sales of the (day, store, category) keys that the changes touch, with `n_left`, their payments.

    Touched are changed payments and unchanged payments of changed rentals. Their share before, with rentals as
    they were, is taken from the stored sums, their share now is added.
    """
    payments = net_changes(payment_log, "payment_id", t.payment)
    rentals = net_changes(rental_log, "rental_id", t.rental)
    changed = rentals.select("rental_id")
    moved = t.payment.join(changed, "rental_id", "left_semi").join(payments.select("payment_id"), "payment_id", "left_anti")
    columns = ["rental_id", "amount", "payment_date"]
    parts = [rows.select(F.lit(side).alias("side"), *columns) for side, rows in (("before", _images(payments, "before")), ("after", _images(payments, "after")), ("both", moved))]
    inside = within_days("payment_date", start, end) & F.col("rental_id").isNotNull()
    touched = sinks.stored(reduce(DataFrame.unionByName, parts).where(inside))

    def share(side: str, rental: DataFrame, sign: int) -> DataFrame:
        paid = touched.where(F.col("side").isin(side, "both")).select(*columns)
        rows = refresh_sales_rollup(t.replacing(payment=paid, rental=rental), start, end)
        return rows.select("sales_date", "store_id", "category_id", (F.col("total_sales") * sign).alias("d_sales"), (F.col("tx_count") * sign).alias("d_count"))

    needed = touched.select("rental_id").distinct()
    now = t.rental.join(needed, "rental_id", "left_semi").select(*t.rental.columns)
    before = now.join(changed, "rental_id", "left_anti").unionByName(_images(rentals, "before"))
    keys = ["sales_date", "store_id", "category_id"]
    delta = share("before", before, -1).unionByName(share("after", now, 1)).groupBy(*keys).agg(F.sum("d_sales").alias("d_sales"), F.sum("d_count").alias("d_count"))
    known = delta.where("d_sales <> 0 or d_count <> 0").join(stored.select(*keys, "total_sales", "tx_count"), keys, "left")
    count = (F.coalesce("tx_count", F.lit(0)) + F.col("d_count")).cast("long")
    return known.select(
        *keys, (F.coalesce("total_sales", F.lit(0)) + F.col("d_sales")).cast("decimal(18,2)").alias("total_sales"), count.alias("tx_count"), _stamped(as_of), count.alias("n_left"))
