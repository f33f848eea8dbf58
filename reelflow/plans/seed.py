"""Synthetic customers, rentals and payments.

Random picks are a function of (seed, row number), so a lost executor recomputes the same rows.
Picking a random copy, customer or staff member is an equi-join on a dense row number instead of
a sort of the whole table per pick. What two results or steps share is written once to a shared folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.functions.scalars import ntz, stable_uniform, stable_uuid
from reelflow.operators.keys import dense_index
from reelflow.sources.sinks import stored
from reelflow.sources.tables import RentalTables


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _next_key(df: DataFrame, key: str) -> Column:
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("k")).scalar()


def seed_customers(t: RentalTables, spark: SparkSession, customers: int, seed: str, as_of: datetime | str) -> dict[str, DataFrame]:
    """New `address` and `customer` rows; keys continue after the largest existing key."""
    n = F.col("id")
    base = spark.range(customers).select(
        n.alias("n"),
        (_next_key(t.address, "address_id") + n).alias("address_id"),
        (_next_key(t.customer, "customer_id") + n).alias("customer_id"),
    )
    address = base.select(
        "address_id",
        F.concat(F.lit("Addr "), stable_uuid(seed + "/address", "n")).alias("address"),
        F.lit("NA").alias("district"),
        F.lit(1).cast("long").alias("city_id"),
        F.lit("000").alias("phone"),
    )
    customer = base.select(
        "customer_id",
        F.lit(1).cast("long").alias("store_id"),
        F.concat(F.lit("C"), stable_uuid(seed + "/name", "n")).alias("first_name"),
        F.lit("X").alias("last_name"),
        F.concat(stable_uuid(seed + "/email", "n"), F.lit("@ex.com")).alias("email"),
        "address_id",
        F.lit(True).alias("active"),
        ntz(as_of).alias("create_date"),
    )
    return {"address": address, "customer": customer}


def seed_synthetic_data(
    t: RentalTables,
    spark: SparkSession,
    customers: int,
    days: int,
    per_day: int,
    seed: str,
    as_of: datetime | str,
) -> dict[str, DataFrame]:
    """New `address`, `customer`, `rental` and `payment` rows.

    `per_day` rentals on each of the last `days` days; half of them returned after 0 to 2 days;
    one payment of 2.99 to 9.99 each. Rentals may go to the new customers as well. The numbered copies and the picked
    rows are written once: the copies are both counted and joined, the rows give both rentals and payments.
    """
    new = seed_customers(t, spark, customers, seed, as_of)
    everyone = t.customer.select("customer_id").unionByName(new["customer"].select("customer_id"))
    copies = stored(dense_index(t.inventory.select("inventory_id"), "inventory_id", "copy_idx"))

    def pick(what: str, size: Column) -> Column:
        # a number that is never NULL, as the join would compute a key that may be NULL once more to filter it
        return F.coalesce(F.floor(stable_uniform(f"{seed}/{what}", "id") * size), F.lit(-1).cast("long"))

    # rows carry their number and what is picked so far; a pick is made where it is joined, all else after the last join
    picked = (
        spark.range(days * per_day)
        .select("id", pick("copy", _count(copies)).alias("copy_idx"))
        .join(copies, "copy_idx")
        .select("id", "inventory_id", pick("customer", _count(everyone)).alias("customer_idx"))
        .join(dense_index(everyone, "customer_id", "customer_idx"), "customer_idx")
        .select("id", "inventory_id", "customer_id", pick("staff", _count(t.staff)).alias("staff_idx"))
        .join(dense_index(t.staff.select("staff_id"), "staff_id", "staff_idx"), "staff_idx")
    )
    began = ntz(as_of) - F.make_dt_interval(F.floor(F.col("id") / per_day).cast("int"))
    out_days = F.floor(stable_uniform(f"{seed}/days", "id") * 3).cast("int")
    rented = stored(picked.select(
        (_next_key(t.rental, "rental_id") + F.col("id")).alias("rental_id"),
        (_next_key(t.payment, "payment_id") + F.col("id")).alias("payment_id"),
        "inventory_id",
        "customer_id",
        "staff_id",
        began.alias("rental_date"),
        F.when(stable_uniform(f"{seed}/returned", "id") > 0.5, began + F.make_dt_interval(out_days)).alias("return_date"),
        (F.lit(2.99) + stable_uniform(f"{seed}/amount", "id") * 7).cast("decimal(5,2)").alias("amount"),
    ))
    new["rental"] = rented.select("rental_id", "rental_date", "inventory_id", "customer_id", "return_date", "staff_id")
    new["payment"] = rented.select(
        "payment_id", "customer_id", "staff_id", "rental_id", "amount", F.col("rental_date").alias("payment_date")
    )
    return new
