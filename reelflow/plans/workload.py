"""The write-heavy and mixed workload: bulk price update, search by rate, bumping payments, counts."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.operators.changes import update_join
from reelflow.operators.search import STOPWORDS, matching_documents, score_documents
from reelflow.sources.tables import RentalTables


def bulk_price_update(
    t: RentalTables,
    country_lo: int,
    country_hi: int,
    as_of: datetime | str,
    factor: Decimal | str = "1.05",
) -> DataFrame:
    """New version of `payment`: amounts of active customers in a country range are raised.

    All joins are many-to-one, so every payment changes at most once. The factor is a decimal, and
    the result rounds half up to the column's scale.
    """
    cities = t.city.filter(F.col("country_id").between(country_lo, country_hi)).select("city_id")
    addresses = t.address.join(cities, "city_id", "left_semi").select("address_id")
    matched = t.customer.filter("active").join(addresses, "address_id", "left_semi").select("customer_id")
    raised = F.col("amount") * F.lit(Decimal(str(factor)))
    return update_join(t.payment, matched, "customer_id", {"amount": raised}, stamp=as_of, matched_is_unique=True)


def bump_latest_payments(
    t: RentalTables, n: int = 10, delta: Decimal | str = "0.01", iterations: int = 1
) -> DataFrame:
    """New version of `payment`: the `n` payments with the highest id grow by `delta` per iteration.

    Ids do not change, so every iteration meets the same rows and the loop is one multiplication.
    """
    latest = t.payment.select("payment_id").orderBy(F.desc("payment_id")).limit(n)
    step = Decimal(str(delta)) * iterations
    return update_join(t.payment, latest, "payment_id", {"amount": F.col("amount") + F.lit(step)}, matched_is_unique=True)


def fulltext_search(
    t: RentalTables,
    query: str,
    stopwords=STOPWORDS,
    min_len: int = 4,
    max_doc_share: float = 0.5,
    ordered: bool = True,
) -> DataFrame:
    """Ranked films for a query, with content signature, reversed excerpt and number of copies."""
    found = score_documents(
        t.film_text.select("film_id", F.col("title").alias("text_title"), "description"),
        ("text_title", "description"),
        query,
        stopwords,
        min_len,
        max_doc_share,
    )
    if ordered:
        # The final sort samples its input first; the exchange keeps that from scoring twice.
        found = found.repartition("film_id")
    hits = found.join(t.film.select("film_id", "title"), "film_id").select(
        "film_id",
        "title",
        F.round("score", 6).alias("relevance_score"),
        F.sha1(F.concat("title", "description")).alias("content_signature"),
        F.reverse(F.substring("description", 5, 20)).alias("nonsense_processing"),
    )
    copies = t.inventory.groupBy("film_id").agg(F.count(F.lit(1)).alias("physical_copies_count"))
    rows = hits.join(copies, "film_id", "left").withColumn(
        "physical_copies_count", F.coalesce("physical_copies_count", F.lit(0)).cast("long")
    )
    return rows.orderBy(F.desc("relevance_score"), "content_signature", "film_id") if ordered else rows


def search_top_by_rate(t: RentalTables, query: str, n: int = 100, stopwords=STOPWORDS, min_len: int = 4) -> DataFrame:
    """The `n` matching films with the highest rental rate."""
    found = matching_documents(t.film_text, ("title", "description"), query, stopwords, min_len).select("film_id")
    return (
        t.film.select("film_id", "title", "rental_rate")
        .join(found, "film_id", "left_semi")
        .orderBy(F.desc("rental_rate"), "film_id")
        .limit(n)
    )


def table_counts(t: RentalTables) -> DataFrame:
    """One row with the number of rentals and payments."""
    rentals = t.rental.agg(F.count(F.lit(1)).alias("total_rentals"))
    payments = t.payment.agg(F.count(F.lit(1)).alias("total_payments"))
    return rentals.withColumn("total_payments", payments.scalar())
