"""Stock questions: who holds a copy, which copies are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.sources.tables import RentalTables


def _open_rentals(t: RentalTables) -> DataFrame:
    return t.rental.filter(F.col("return_date").isNull())


def inventory_held_by_customer(t: RentalTables) -> DataFrame:
    """(inventory_id, customer_id, n_open) for every copy that is out.

    With several open rentals of one copy the one with the lowest rental_id decides.
    """
    return (
        _open_rentals(t)
        .groupBy("inventory_id")
        .agg(F.min_by("customer_id", "rental_id").alias("customer_id"), F.count(F.lit(1)).alias("n_open"))
    )


def inventory_in_stock(t: RentalTables) -> DataFrame:
    """(inventory_id, film_id, store_id, in_stock): in stock if no rental of the copy is open."""
    out = _open_rentals(t).groupBy("inventory_id").agg(F.count("rental_id").alias("n_out"))
    return (
        t.inventory.select("inventory_id", "film_id", "store_id")
        .join(out, "inventory_id", "left")
        .select("inventory_id", "film_id", "store_id", (F.coalesce("n_out", F.lit(0)) == 0).alias("in_stock"))
    )


def _stock(t: RentalTables, wanted: Column, film_id: int | None, store_id: int | None) -> DataFrame:
    copies = inventory_in_stock(t)
    if film_id is not None:
        copies = copies.filter(F.col("film_id") == film_id)
    if store_id is not None:
        copies = copies.filter(F.col("store_id") == store_id)
    return copies.filter(wanted).select("film_id", "store_id", "inventory_id")


def film_in_stock(t: RentalTables, film_id: int | None = None, store_id: int | None = None) -> DataFrame:
    """Copies in stock, of one film in one store or of all; count them with `film_stock_counts`."""
    return _stock(t, F.col("in_stock"), film_id, store_id)


def film_not_in_stock(t: RentalTables, film_id: int | None = None, store_id: int | None = None) -> DataFrame:
    """Copies that are out, of one film in one store or of all."""
    return _stock(t, ~F.col("in_stock"), film_id, store_id)


def film_stock_counts(t: RentalTables) -> DataFrame:
    """Copies in and out per film and store, in one aggregate."""
    return (
        inventory_in_stock(t)
        .groupBy("film_id", "store_id")
        .agg(F.count_if("in_stock").alias("n_in"), F.count_if(~F.col("in_stock")).alias("n_out"))
    )
