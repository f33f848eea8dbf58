"""Every registered query against its SQL counterpart, over whole tables."""

import pytest

import check
import __spark_entry__ as entry
from reelflow.plans import analytics
from verification.queries import queries as verification_queries
from tests.conftest import SF

NAMES = list(verification_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_reports_come_in_order(spark, tables):
    """What a comparison of row sets cannot see."""
    low = lambda v: (v is None, -(v or 0))
    rows = analytics.customer_profile(tables).collect()
    assert rows == sorted(rows, key=lambda r: (low(r.total_lifetime_value), r.customer_id))
    rows = analytics.financial_performance(tables, min_rentals=0).collect()
    place = lambda r: (r.country, r.city, r.store_id, r.category, r.year, r.month)
    assert rows == sorted(rows, key=lambda r: (-r.total_revenue, -r.rental_count, place(r))) and len(rows) > 100
    rows = analytics.customer_activity_top(tables).collect()
    assert rows == sorted(rows, key=lambda r: (-r.amt, r.customer_id))
