"""SQL surface: the tables, the views and the routines under their SQL names.

The routines that return one value per key are SQL functions with a scalar subquery. Spark
decorrelates them when they are used over a column, so `SELECT inventory_in_stock(inventory_id)
FROM inventory` runs as one aggregate and one join. `get_customer_balance` is for single customers: a
date that may differ from row to row would be joined to all charges. `customer_balances` gives
all customers' balances of one date. For whole tables the DataFrame functions in this package say the
same with fewer scans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from reelflow.plans import views
from reelflow.sources.tables import RentalTables

VIEWS = {
    "customer_list": views.customer_list,
    "film_list": views.film_list,
    "nicer_but_slower_film_list": views.nicer_but_slower_film_list,
    "staff_list": views.staff_list,
    "sales_by_store": views.sales_by_store,
    "sales_by_film_category": views.sales_by_film_category,
    "actor_info": views.actor_info,
}

CHARGES = """
    SELECT r.customer_id AS who, r.rental_date AS due, CAST(f.rental_rate + coalesce(greatest(
             datediff(r.return_date, r.rental_date) - f.rental_duration, 0), 0) AS DECIMAL(18,2)) AS charge
    FROM rental r JOIN inventory i ON i.inventory_id = r.inventory_id JOIN film f ON f.film_id = i.film_id
    UNION ALL
    SELECT customer_id, payment_date, CAST(-amount AS DECIMAL(18,2)) FROM payment"""

FUNCTIONS = [
    """
    inventory_in_stock(p_inventory_id BIGINT) RETURNS BOOLEAN RETURN
      (SELECT count(*) = 0 FROM rental WHERE inventory_id = p_inventory_id AND return_date IS NULL)
    """,
    """
    inventory_held_by_customer(p_inventory_id BIGINT) RETURNS BIGINT RETURN
      (SELECT min_by(customer_id, rental_id) FROM rental
       WHERE inventory_id = p_inventory_id AND return_date IS NULL)
    """,
    f"""
    get_customer_balance(p_customer_id BIGINT, p_effective_date TIMESTAMP_NTZ) RETURNS DECIMAL(18,2) RETURN
      (SELECT CAST(coalesce(sum(charge), 0) AS DECIMAL(18,2)) FROM ({CHARGES})
       WHERE who = p_customer_id AND due <= p_effective_date)
    """,
    f"""
    customer_balances(p_effective_date TIMESTAMP_NTZ) RETURNS TABLE (customer_id BIGINT, balance DECIMAL(18,2)) RETURN
      SELECT who, CAST(sum(charge) AS DECIMAL(18,2)) FROM ({CHARGES}) WHERE due <= p_effective_date GROUP BY who
    """,
    """
    film_in_stock(p_film_id BIGINT, p_store_id BIGINT) RETURNS TABLE (inventory_id BIGINT) RETURN
      SELECT i.inventory_id FROM inventory i
      WHERE i.film_id = p_film_id AND i.store_id = p_store_id AND NOT EXISTS
        (SELECT 1 FROM rental r WHERE r.inventory_id = i.inventory_id AND r.return_date IS NULL)
    """,
    """
    film_not_in_stock(p_film_id BIGINT, p_store_id BIGINT) RETURNS TABLE (inventory_id BIGINT) RETURN
      SELECT i.inventory_id FROM inventory i
      WHERE i.film_id = p_film_id AND i.store_id = p_store_id AND EXISTS
        (SELECT 1 FROM rental r WHERE r.inventory_id = i.inventory_id AND r.return_date IS NULL)
    """,
]


def _rewards(columns: dict[str, str]) -> str:
    """The rewards routine: whole customer rows, one calendar month back or as many as are given."""
    listed = ", ".join(f"c.{name}" for name in columns)
    return f"""
    rewards_report(p_min_purchases INT, p_min_amount DECIMAL(10,2), p_as_of DATE, p_months INT DEFAULT 1)
      RETURNS TABLE ({", ".join(f"{name} {kind}" for name, kind in columns.items())}) RETURN
      SELECT {listed} FROM payment p JOIN customer c ON c.customer_id = p.customer_id
      WHERE CASE WHEN p_min_purchases > 0 AND p_min_amount > 0 THEN true
                 ELSE CAST(raise_error('both limits must be positive') AS BOOLEAN) END
        AND p.payment_date >= CAST(trunc(add_months(p_as_of, -p_months), 'MM') AS TIMESTAMP_NTZ)
        AND p.payment_date < CAST(add_months(trunc(add_months(p_as_of, -p_months), 'MM'), 1) AS TIMESTAMP_NTZ)
      GROUP BY {listed}
      HAVING sum(p.amount) > p_min_amount AND count(p.customer_id) > p_min_purchases
    """


def install(spark: SparkSession, t: RentalTables) -> None:
    """Register temporary views for every table and report, and the SQL functions over them."""
    for name in t.names():
        t[name].createOrReplaceTempView(name)
    for name, view in VIEWS.items():
        view(t).createOrReplaceTempView(name)
    columns = {f"`{f.name}`": f.dataType.simpleString() for f in t.customer.schema.fields}
    for body in [*FUNCTIONS, _rewards(columns)]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body.strip()}")
