"""Relations between operators that must hold on the whole test tables."""

from pyspark.sql import functions as F

from reelflow.operators import inflate
from reelflow.operators.changes import audit_changes
from reelflow.plans import analytics, refresh, stock, views, workload


def grown(t):
    return t.replacing(payment=inflate.inflate_payment(t.payment), rental=inflate.inflate_rental(t.rental))


def test_inflation_leaves_revenue_and_multiplies_lifetime_value(tables):
    before = analytics.financial_performance(tables, min_rentals=0, ordered=False)
    after = analytics.financial_performance(grown(tables), min_rentals=0, ordered=False)
    assert sorted(before.collect()) == sorted(after.collect())
    small = {r.customer_id: r.total_lifetime_value for r in analytics.customer_profile(tables).collect()}
    large = {r.customer_id: r.total_lifetime_value for r in analytics.customer_profile(grown(tables)).collect()}
    assert large == {k: v and v * 32 for k, v in small.items()}


def test_category_totals_cover_categorised_payments(tables):
    total = views.sales_by_film_category(tables).agg(F.sum("total_sales")).first()[0]
    categorised = (
        tables.payment.join(tables.rental, "rental_id")
        .join(tables.inventory, "inventory_id")
        .join(tables.film_category.select("film_id").distinct(), "film_id", "left_semi")
        .agg(F.sum("amount"))
        .first()[0]
    )
    assert total >= categorised > 0


def test_stock_splits_the_inventory(tables):
    held_in, out = stock.film_in_stock(tables), stock.film_not_in_stock(tables)
    assert held_in.intersect(out).count() == 0
    assert held_in.count() + out.count() == tables.inventory.count()
    assert out.count() == stock.inventory_held_by_customer(tables).count()


def test_refreshes_repeat(tables):
    for build in (refresh.refresh_customer_kpis, refresh.refresh_inventory_status):
        assert build(tables).exceptAll(build(tables)).count() == 0


def test_update_is_audited_exactly(tables):
    after = workload.bulk_price_update(tables, 1, 3, "2001-01-01 00:00:00")
    stamped = after.filter(F.col("last_update").isNotNull()).count()
    log = audit_changes(tables.payment, after, "payment_id", "2001-01-01 00:00:00")
    assert log.filter("action = 'UPDATE'").count() == stamped == log.count()


def test_keys_of_the_role_views_are_unique(tables):
    for name, key in [("payment", "payment_id"), ("rental", "rental_id"), ("inventory", "inventory_id")]:
        df = tables[name]
        assert df.select(key).distinct().count() == df.count()
