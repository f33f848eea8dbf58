"""Join shapes shared by the reports.

Facts are summed on the key of the next join before they are joined. The join then meets one row
per key on either side, so a key that holds a large share of the facts cannot overload a task; the
sums combine on the map side, and the exchange they need is the one the join needs anyway.

No side is broadcast by hint: Catalyst and adaptive execution broadcast what they measure to be
small and use a (skew-splitting) shuffle join for everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.sources.tables import RentalTables


def paid_per_rental(t: RentalTables) -> DataFrame:
    """(rental_id, amount): payments summed per rental."""
    return (
        t.payment.filter(F.col("rental_id").isNotNull())
        .groupBy("rental_id")
        .agg(F.sum("amount").alias("amount"))
    )


def paid_per_copy(t: RentalTables) -> DataFrame:
    """(inventory_id, amount): payments summed per rented copy."""
    return (
        paid_per_rental(t)
        .join(t.rental.select("rental_id", "inventory_id"), "rental_id")
        .groupBy("inventory_id")
        .agg(F.sum("amount").alias("amount"))
    )


def place(t: RentalTables) -> DataFrame:
    """(address_id, address, postal_code, phone, city, country) of every address.

    Cities get their country first, so the addresses, the largest of the three, are joined once.
    """
    cities = t.city.select("city_id", "city", "country_id").join(t.country.select("country_id", "country"), "country_id")
    return t.address.join(cities, "city_id").select("address_id", "address", "postal_code", "phone", "city", "country")


def category_names(t: RentalTables) -> DataFrame:
    """(film_id, category, times): names per film; `times` > 1 if two categories share a name."""
    return (
        t.film_category.join(t.category.select("category_id", F.col("name").alias("category")), "category_id")
        .groupBy("film_id", "category")
        .agg(F.count(F.lit(1)).alias("times"))
    )
