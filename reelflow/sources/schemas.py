"""Declared schemas and constraints of the rental star schema.

Everything here is a fixed value: column names, types, keys and value domains.
Ids are LONG because the source ids are unsigned 32-bit numbers. Event times carry no
zone (TIMESTAMP_NTZ); `last_update` and `changed_at` are points in time (TIMESTAMP).
"""

from __future__ import annotations

from pyspark.sql import types as T

DDL: dict[str, str] = {
    "actor": "actor_id LONG NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, last_update TIMESTAMP NOT NULL",
    "address": "address_id LONG NOT NULL, address STRING NOT NULL, address2 STRING, district STRING NOT NULL, "
    "city_id LONG NOT NULL, postal_code STRING, phone STRING NOT NULL, last_update TIMESTAMP NOT NULL",
    "category": "category_id LONG NOT NULL, name STRING NOT NULL, last_update TIMESTAMP NOT NULL",
    "city": "city_id LONG NOT NULL, city STRING NOT NULL, country_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "country": "country_id LONG NOT NULL, country STRING NOT NULL, last_update TIMESTAMP NOT NULL",
    "customer": "customer_id LONG NOT NULL, store_id LONG NOT NULL, first_name STRING NOT NULL, "
    "last_name STRING NOT NULL, email STRING, address_id LONG NOT NULL, active BOOLEAN NOT NULL, "
    "create_date TIMESTAMP_NTZ NOT NULL, last_update TIMESTAMP",
    "film": "film_id LONG NOT NULL, title STRING NOT NULL, description STRING, release_year INT, "
    "language_id LONG NOT NULL, original_language_id LONG, rental_duration INT NOT NULL, "
    "rental_rate DECIMAL(4,2) NOT NULL, length INT, replacement_cost DECIMAL(5,2) NOT NULL, rating STRING, "
    "special_features ARRAY<STRING>, last_update TIMESTAMP NOT NULL",
    "film_actor": "actor_id LONG NOT NULL, film_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "film_category": "film_id LONG NOT NULL, category_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "film_text": "film_id LONG NOT NULL, title STRING NOT NULL, description STRING",
    "inventory": "inventory_id LONG NOT NULL, film_id LONG NOT NULL, store_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "language": "language_id LONG NOT NULL, name STRING NOT NULL, last_update TIMESTAMP NOT NULL",
    "payment": "payment_id LONG NOT NULL, customer_id LONG NOT NULL, staff_id LONG NOT NULL, rental_id LONG, "
    "amount DECIMAL(5,2) NOT NULL, payment_date TIMESTAMP_NTZ NOT NULL, last_update TIMESTAMP",
    "rental": "rental_id LONG NOT NULL, rental_date TIMESTAMP_NTZ NOT NULL, inventory_id LONG NOT NULL, "
    "customer_id LONG NOT NULL, return_date TIMESTAMP_NTZ, staff_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "staff": "staff_id LONG NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, "
    "address_id LONG NOT NULL, picture BINARY, email STRING, store_id LONG NOT NULL, active BOOLEAN NOT NULL, "
    "username STRING NOT NULL, password STRING, last_update TIMESTAMP NOT NULL",
    "store": "store_id LONG NOT NULL, manager_staff_id LONG NOT NULL, address_id LONG NOT NULL, last_update TIMESTAMP NOT NULL",
    "audit_rental": "audit_id LONG NOT NULL, rental_id LONG, action STRING NOT NULL, changed_at TIMESTAMP NOT NULL, "
    "actor_user STRING, before_json STRING, after_json STRING",
    "audit_payment": "audit_id LONG NOT NULL, payment_id LONG, action STRING NOT NULL, changed_at TIMESTAMP NOT NULL, "
    "actor_user STRING, before_json STRING, after_json STRING",
    "sales_rollup_daily": "sales_date DATE NOT NULL, store_id LONG NOT NULL, category_id LONG NOT NULL, "
    "total_sales DECIMAL(18,2) NOT NULL, tx_count LONG NOT NULL, last_update TIMESTAMP",
    "customer_kpis": "customer_id LONG NOT NULL, rentals_count LONG NOT NULL, active_rentals LONG NOT NULL, "
    "total_spent DECIMAL(18,2) NOT NULL, last_payment TIMESTAMP_NTZ, last_rental TIMESTAMP_NTZ, "
    "balance_cached DECIMAL(18,2) NOT NULL, last_update TIMESTAMP",
    "inventory_status": "inventory_id LONG NOT NULL, film_id LONG NOT NULL, store_id LONG NOT NULL, "
    "is_in_stock BOOLEAN NOT NULL, total_rentals LONG NOT NULL, last_rental TIMESTAMP_NTZ, last_update TIMESTAMP",
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "actor": ["actor_id"],
    "address": ["address_id"],
    "category": ["category_id"],
    "city": ["city_id"],
    "country": ["country_id"],
    "customer": ["customer_id"],
    "film": ["film_id"],
    "film_actor": ["actor_id", "film_id"],
    "film_category": ["film_id", "category_id"],
    "film_text": ["film_id"],
    "inventory": ["inventory_id"],
    "language": ["language_id"],
    "payment": ["payment_id"],
    "rental": ["rental_id"],
    "staff": ["staff_id"],
    "store": ["store_id"],
    "audit_rental": ["audit_id"],
    "audit_payment": ["audit_id"],
    "sales_rollup_daily": ["sales_date", "store_id", "category_id"],
    "customer_kpis": ["customer_id"],
    "inventory_status": ["inventory_id"],
}

UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "rental": [["rental_date", "inventory_id", "customer_id"]],
    "store": [["manager_staff_id"]],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("address", "city_id", "city", "city_id"),
    ("city", "country_id", "country", "country_id"),
    ("customer", "address_id", "address", "address_id"),
    ("customer", "store_id", "store", "store_id"),
    ("film", "language_id", "language", "language_id"),
    ("film", "original_language_id", "language", "language_id"),
    ("film_actor", "actor_id", "actor", "actor_id"),
    ("film_actor", "film_id", "film", "film_id"),
    ("film_category", "film_id", "film", "film_id"),
    ("film_category", "category_id", "category", "category_id"),
    ("inventory", "store_id", "store", "store_id"),
    ("inventory", "film_id", "film", "film_id"),
    ("payment", "rental_id", "rental", "rental_id"),
    ("payment", "customer_id", "customer", "customer_id"),
    ("payment", "staff_id", "staff", "staff_id"),
    ("rental", "staff_id", "staff", "staff_id"),
    ("rental", "inventory_id", "inventory", "inventory_id"),
    ("rental", "customer_id", "customer", "customer_id"),
    ("staff", "store_id", "store", "store_id"),
    ("staff", "address_id", "address", "address_id"),
    ("store", "manager_staff_id", "staff", "staff_id"),
    ("store", "address_id", "address", "address_id"),
    ("sales_rollup_daily", "store_id", "store", "store_id"),
    ("sales_rollup_daily", "category_id", "category", "category_id"),
    ("customer_kpis", "customer_id", "customer", "customer_id"),
    ("inventory_status", "inventory_id", "inventory", "inventory_id"),
    ("inventory_status", "film_id", "film", "film_id"),
    ("inventory_status", "store_id", "store", "store_id"),
]

# Value domains.
RATINGS = ["G", "PG", "PG-13", "R", "NC-17"]
AUDIT_ACTIONS = ["INSERT", "UPDATE", "DELETE"]
YEAR_RANGE = (1901, 2155)

# (table, column, allowed values or None, closed range or None)
DOMAINS: list[tuple[str, str, list[str] | None, tuple[int, int] | None]] = [
    ("film", "rating", RATINGS, None),
    ("film", "release_year", None, YEAR_RANGE),
    ("audit_rental", "action", AUDIT_ACTIONS, None),
    ("audit_payment", "action", AUDIT_ACTIONS, None),
]

# Tables whose rows are stamped on every update.
STAMPED_TABLES = [
    "actor", "address", "category", "city", "country", "customer", "film", "film_actor",
    "film_category", "inventory", "language", "rental", "staff", "store",
]


def schema(table: str) -> T.StructType:
    """Declared `StructType` of a table."""
    return T.StructType.fromDDL(DDL[table])


def required_columns(table: str) -> list[str]:
    """Columns declared NOT NULL."""
    return [f.name for f in schema(table).fields if not f.nullable]
