"""Revenue analytics, customer profiles and activity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.functions.aggregates import exact_mean, population_stddev
from reelflow.functions.scalars import byte_length, days_between
from reelflow.operators.keys import fresh_join
from reelflow.plans._facts import category_names, place
from reelflow.sources.tables import RentalTables


def _copy_weights(t: RentalTables) -> DataFrame:
    """(inventory_id, store_id, category, weight): joined rows per payment of one copy.

    The many-to-many actor bridge repeats each payment once per actor of the film. Counting the
    actors per film gives that factor as a number, so the facts are not multiplied.
    """
    actors = (
        t.film_actor.select("film_id", "actor_id")
        .join(t.actor.select("actor_id"), "actor_id", "left_semi")
        .groupBy("film_id")
        .agg(F.count(F.lit(1)).alias("n_actors"))
    )
    films = (
        actors.join(t.film.select("film_id"), "film_id", "left_semi")
        .join(category_names(t), "film_id")
        .select("film_id", "category", (F.col("n_actors") * F.col("times")).alias("weight"))
    )
    copies = t.inventory.select("inventory_id", "film_id", "store_id")
    return fresh_join(copies, films, "film_id").drop("film_id")


def financial_performance(t: RentalTables, min_rentals: int = 5, ordered: bool = True) -> DataFrame:
    """Revenue by country, city, store, category, year and month.

    Sums, mean and population deviation weigh a payment by the number of the film's actors, as the
    twelve-way join does. Payments are reduced to exact moments per rental first; each rental then
    meets its copy once per category name, so counting rows counts distinct rentals. Rentals are
    combined per customer, and the number of those rows is the distinct customer count. Facts stored by
    `sources.colocated.store_facts` are joined by slice where they lie; there the leading slice of a rental counts.
    """
    sliced = "slice" in t.payment.columns and "slice" in t.rental.columns
    meeting = ["rental_id", "slice"] if sliced else ["rental_id"]
    leads = [F.max("leads").alias("leads")] if sliced else []
    counted = F.count_if("leads") if sliced else F.count(F.lit(1))
    cents = (F.col("amount") * 100).cast("decimal(18,0)")
    paid = (
        t.payment.filter(F.col("rental_id").isNotNull())
        .select(*meeting, cents.alias("c"), *(["leads"] if sliced else []))
        .groupBy(*meeting)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"), *leads)
    )
    rentals = t.rental.select(
        *meeting, "inventory_id", "customer_id", F.year("rental_date").alias("year"), F.month("rental_date").alias("month")
    )
    keys = ["store_id", "category", "year", "month"]
    w = F.col("weight")

    def weighted(c: str) -> F.Column:
        return F.sum(F.col(c).cast("decimal(28,0)") * w.cast("decimal(9,0)")).cast("decimal(38,0)")

    per_customer = (
        paid.join(rentals, meeting)
        .join(_copy_weights(t), "inventory_id")
        .groupBy(*keys, "customer_id")
        .agg(
            counted.alias("rentals"),
            F.sum(F.col("n") * w).alias("w"),
            weighted("s1").alias("s1"),
            weighted("s2").alias("s2"),
        )
        .join(t.customer.select("customer_id"), "customer_id", "left_semi")
    )
    grouped = (
        per_customer.groupBy(*keys)
        .agg(
            F.sum("rentals").alias("rental_count"),
            F.count(F.lit(1)).alias("unique_customers"),
            F.sum("w").alias("w"),
            F.sum("s1").alias("s1"),
            F.sum("s2").alias("s2"),
        )
        .filter(F.col("rental_count") > min_rentals)
    )
    stores = t.store.select("store_id", "address_id").join(place(t), "address_id").select("store_id", "city", "country")
    revenue = (F.col("s1").cast("decimal(38,0)") * F.expr("0.01BD")).cast("decimal(38,2)")
    rows = grouped.join(stores, "store_id").select(
        "country",
        "city",
        "store_id",
        "category",
        "year",
        "month",
        "rental_count",
        "unique_customers",
        revenue.alias("total_revenue"),
        exact_mean(revenue, F.col("w")).alias("avg_payment"),
        population_stddev(F.col("w"), F.col("s1"), F.col("s2")).alias("payment_volatility"),
        F.concat("country", F.lit(" - "), "city", F.lit(" ("), "category", F.lit(")")).alias("location_tag"),
    )
    if not ordered:
        return rows
    return rows.orderBy(
        F.desc("total_revenue"), F.desc("rental_count"), "country", "city", "store_id", "category", "year", "month"
    )


def customer_profile(t: RentalTables, ordered: bool = True) -> DataFrame:
    """Active customers: profile text, lifetime value, longest film, category variety, mean return time.

    One aggregate per question instead of one subquery per customer. All are keyed by customer,
    so the final joins share one partitioning. The longest film is the minimum of an ordering
    struct, which combines on the map side, where a ranking window would gather a customer's
    whole history in one task.
    """
    value = t.payment.groupBy("customer_id").agg(F.sum("amount").cast("decimal(38,2)").alias("total_lifetime_value"))
    returns = (
        t.rental.filter(F.col("return_date").isNotNull())
        .groupBy("customer_id")
        .agg(F.sum(days_between("rental_date", "return_date")).alias("days"), F.count(F.lit(1)).alias("n"))
        .select("customer_id", (F.col("days").cast("double") / F.col("n")).alias("avg_return_delay_days"))
    )
    seen = (
        t.rental.select("customer_id", "inventory_id")
        .join(t.inventory.select("inventory_id", "film_id"), "inventory_id")
        .select("customer_id", "film_id")
        .distinct()
    )
    named = t.film.select("film_id", "length", "title", F.lit(True).alias("known"))
    sorts = t.film_category.groupBy("film_id").agg(F.array_sort(F.collect_set("category_id")).alias("categories"))
    rank = F.struct(F.col("length").isNull().alias("unknown"), (-F.col("length")).alias("shortness"), F.col("title"))
    # films share few category lists, so the set of lists stays small however long a history is
    tastes = F.size(F.array_distinct(F.flatten(F.collect_set("categories"))))
    watched = (
        seen.join(named.join(sorts, "film_id", "full"), "film_id")
        .groupBy("customer_id")
        .agg(F.min(F.when(F.col("known"), rank)).alias("best"), tastes.alias("category_diversity_index"))
        .select("customer_id", F.col("best.title").alias("longest_rental_choice"), "category_diversity_index")
    )
    profile = F.concat(
        F.upper("last_name"), F.lit(", "), "first_name", F.lit(" ["), byte_length("email").cast("string"), F.lit("]")
    )
    rows = (
        t.customer.filter("active")
        .select("customer_id", profile.alias("client_profile"))
        .join(value, "customer_id", "left")
        .join(watched, "customer_id", "left")
        .join(returns, "customer_id", "left")
        .select(
            "customer_id",
            "client_profile",
            "total_lifetime_value",
            "longest_rental_choice",
            F.coalesce("category_diversity_index", F.lit(0)).cast("long").alias("category_diversity_index"),
            "avg_return_delay_days",
        )
    )
    return rows.orderBy(F.desc_nulls_last("total_lifetime_value"), "customer_id") if ordered else rows


def customer_activity_top(t: RentalTables, n: int = 200) -> DataFrame:
    """The `n` customers with the highest amount, under the double fan-out of rentals and payments.

    Joining rentals and payments to a customer at once repeats each rental once per payment and
    each payment once per rental. Both factors are group sizes, so they are multiplied instead.
    """
    rentals = t.rental.groupBy("customer_id").agg(F.count("rental_id").alias("n_rentals"))
    payments = t.payment.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_payments"), F.sum("amount").alias("paid"))
    n_r = F.coalesce("n_rentals", F.lit(0))
    n_p = F.coalesce("n_payments", F.lit(0))
    times = F.greatest(n_r, F.lit(1)).cast("decimal(12,0)")
    return (
        t.customer.select("customer_id")
        .join(rentals, "customer_id", "left")
        .join(payments, "customer_id", "left")
        .select(
            "customer_id",
            (n_r * F.greatest(n_p, F.lit(1))).alias("cnt"),
            (F.coalesce("paid", F.lit(0)).cast("decimal(25,2)") * times).cast("decimal(38,2)").alias("amt"),
        )
        .orderBy(F.desc("amt"), "customer_id")
        .limit(n)
    )
