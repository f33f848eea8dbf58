"""The seven reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.functions.aggregates import group_concat
from reelflow.functions.scalars import capitalise, full_name
from reelflow.operators.keys import fresh_join
from reelflow.plans._facts import category_names, paid_per_copy, place
from reelflow.sources.tables import RentalTables


def customer_list(t: RentalTables) -> DataFrame:
    """Customers with name, address, city, country and an active note."""
    return t.customer.join(place(t), "address_id").select(
        F.col("customer_id").alias("ID"),
        full_name("first_name", "last_name").alias("name"),
        "address",
        F.col("postal_code").alias("zip code"),
        "phone",
        "city",
        "country",
        F.when(F.col("active"), F.lit("active")).otherwise(F.lit("")).alias("notes"),
        F.col("store_id").alias("SID"),
    )


def staff_list(t: RentalTables) -> DataFrame:
    """Staff with name, address, city and country."""
    return t.staff.join(place(t), "address_id").select(
        F.col("staff_id").alias("ID"),
        full_name("first_name", "last_name").alias("name"),
        "address",
        F.col("postal_code").alias("zip code"),
        "phone",
        "city",
        "country",
        F.col("store_id").alias("SID"),
    )


def _film_cast(t: RentalTables, name: Column) -> DataFrame:
    """One row per film and category name with the ordered list of its actors.

    Actor names are gathered per film from the narrow bridge, before film texts and categories
    are joined. Films without actors or without category do not appear. If a film has two
    categories of one name, each actor is listed twice, as the row grouping demands.
    """
    names = (
        t.film_actor.select("film_id", "actor_id")
        .join(t.actor.select("actor_id", name.alias("actor_name")), "actor_id")
        .groupBy("film_id")
        .agg(F.sort_array(F.collect_list("actor_name")).alias("cast"))
    )
    listed = F.when(F.col("times") == 1, F.col("cast")).otherwise(
        F.flatten(F.transform("cast", lambda n: F.array_repeat(n, F.col("times").cast("int"))))
    )
    return (
        t.film.join(names, "film_id")
        .join(category_names(t), "film_id")
        .select(
            F.col("film_id").alias("FID"),
            "title",
            "description",
            "category",
            F.col("rental_rate").alias("price"),
            "length",
            "rating",
            F.when(F.size("cast") > 0, F.array_join(listed, ", ")).alias("actors"),
        )
    )


def film_list(t: RentalTables) -> DataFrame:
    """Films with category and actor names."""
    return _film_cast(t, full_name("first_name", "last_name"))


def nicer_but_slower_film_list(t: RentalTables, sep: str = " ") -> DataFrame:
    """`film_list` with capitalised actor names; names are formatted once per actor."""
    return _film_cast(t, full_name(capitalise("first_name"), capitalise("last_name"), sep))


def sales_by_store(t: RentalTables, ordered: bool = True) -> DataFrame:
    """Total sales per store with "city,country" and the manager's name."""
    per_store = (
        paid_per_copy(t)
        .join(t.inventory.select("inventory_id", "store_id"), "inventory_id")
        .groupBy("store_id")
        .agg(F.sum("amount").alias("amount"))
    )
    manager = t.staff.select(
        F.col("staff_id").alias("manager_staff_id"), full_name("first_name", "last_name").alias("manager")
    )
    stores = (
        t.store.select("store_id", "manager_staff_id", "address_id")
        .join(place(t), "address_id")
        .join(manager, "manager_staff_id")
    )
    rows = per_store.join(stores, "store_id")
    if ordered:
        rows = rows.orderBy("country", "city", "store_id")
    return rows.select(
        F.concat("city", F.lit(","), "country").alias("store"),
        "manager",
        F.col("amount").cast("decimal(38,2)").alias("total_sales"),
    )


def sales_by_film_category(t: RentalTables, ordered: bool = True) -> DataFrame:
    """Total sales per category name; a film in several categories counts in each of them."""
    per_film = (
        paid_per_copy(t)
        .join(t.inventory.select("inventory_id", "film_id"), "inventory_id")
        .groupBy("film_id")
        .agg(F.sum("amount").alias("amount"))
        .join(t.film.select("film_id"), "film_id", "left_semi")
    )
    per_category = (
        per_film.join(t.film_category.select("film_id", "category_id"), "film_id")
        .groupBy("category_id")
        .agg(F.sum("amount").alias("amount"))
    )
    rows = (
        per_category.join(t.category.select("category_id", F.col("name").alias("category")), "category_id")
        .groupBy("category")
        .agg(F.sum("amount").cast("decimal(38,2)").alias("total_sales"))
    )
    return rows.orderBy(F.desc("total_sales"), "category") if ordered else rows


def actor_info(t: RentalTables) -> DataFrame:
    """Actors with "category: title, title; category: ..."; NULL for an actor without films.

    Titles are gathered per actor and category, then categories per actor. The bridge keys are
    unique, so a film is listed once per category without a distinct; equal titles of different
    films stay separate entries.
    """
    categories = t.film_category.join(t.category.select("category_id", F.col("name").alias("category")), "category_id")
    films = t.film.select("film_id", "title").join(categories.select("film_id", "category_id", "category"), "film_id")
    per_category = (
        fresh_join(t.film_actor.select("actor_id", "film_id"), films, "film_id")
        .groupBy("actor_id", "category_id", "category")
        .agg(group_concat("title").alias("titles"))
    )
    info = (
        per_category.select("actor_id", "category", F.concat("category", F.lit(": "), "titles").alias("entry"))
        .groupBy("actor_id")
        .agg(F.sort_array(F.collect_set(F.struct("category", "entry"))).alias("entries"))
        .select("actor_id", F.array_join(F.transform("entries", lambda e: e["entry"]), "; ").alias("film_info"))
    )
    return t.actor.select("actor_id", "first_name", "last_name").join(info, "actor_id", "left")
