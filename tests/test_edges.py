"""Hand-made rows for the cases the test tables do not contain."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from reelflow.operators import changes, checks, inflate, keys, search
from reelflow.plans import analytics, finance, refresh, stock, views, workload
from reelflow.functions import scalars as S
from tests.conftest import by, make, small, ts


def chain(spark, **extra):
    """Three films with 0, 1 and 3 actors; one copy, rental and payment each."""
    given = {
        "country": [{"country_id": 1, "country": "Peru"}],
        "city": [{"city_id": 1, "city": "Lima", "country_id": 1}],
        "address": [{"address_id": 1, "address": "Road 1", "city_id": 1}],
        "store": [{"store_id": 1, "manager_staff_id": 1, "address_id": 1}],
        "staff": [{"staff_id": 1, "first_name": "Ann", "last_name": "Bo", "address_id": 1, "store_id": 1}],
        "customer": [{"customer_id": 1, "store_id": 1, "first_name": "Eva", "last_name": "Öz", "email": "é@x", "address_id": 1}],
        "category": [{"category_id": 1, "name": "Action"}, {"category_id": 2, "name": "Drama"}],
        "film": [
            {"film_id": i, "title": t, "rental_duration": 3, "rental_rate": D("2.99"), "length": n, "replacement_cost": D("20.00")}
            for i, t, n in [(1, "ZULU", 90), (2, "ALPHA", 90), (3, "BRAVO", None)]
        ],
        "film_category": [{"film_id": 1, "category_id": 1}, {"film_id": 2, "category_id": 1}, {"film_id": 3, "category_id": 1},
                          {"film_id": 3, "category_id": 2}],
        "actor": [{"actor_id": i, "first_name": f, "last_name": "X"} for i, f in [(1, "AL"), (2, "BE"), (3, "CY"), (4, "DI")]],
        "film_actor": [{"film_id": 2, "actor_id": 1}] + [{"film_id": 3, "actor_id": a} for a in (1, 2, 3)],
        "inventory": [{"inventory_id": 10 + i, "film_id": i, "store_id": 1} for i in (1, 2, 3)],
        "rental": [
            {"rental_id": 100 + i, "rental_date": ts("2001-03-01 10:00:00"), "inventory_id": 10 + i, "customer_id": 1,
             "return_date": ts("2001-03-05 09:00:00")}
            for i in (1, 2, 3)
        ],
        "payment": [
            {"payment_id": i, "customer_id": 1, "rental_id": 100 + i, "amount": D(a), "payment_date": ts("2001-03-02 00:00:00")}
            for i, a in [(1, "5.00"), (2, "1.00"), (3, "2.00")]
        ],
    }
    given.update(extra)
    return small(spark, **given)


def test_payments_count_once_per_actor(spark):
    rows = by(analytics.financial_performance(chain(spark), min_rentals=0), "category")
    action = rows["Action"]  # film 1 has no actor and vanishes; film 2 weighs 1, film 3 weighs 3
    assert (action.rental_count, action.unique_customers) == (2, 1)
    assert action.total_revenue == D("7.00")
    assert action.avg_payment == pytest.approx(7 / 4)
    assert action.payment_volatility == pytest.approx((3 / 16) ** 0.5)  # population form of 1, 2, 2, 2
    assert rows["Drama"].total_revenue == D("6.00")
    assert action.location_tag == "Peru - Lima (Action)"
    assert analytics.financial_performance(chain(spark), min_rentals=2).count() == 0


def test_customer_profile_ties_nulls_and_bytes(spark):
    t = chain(
        spark,
        customer=[
            {"customer_id": 1, "first_name": "Eva", "last_name": "Öz", "email": "é@x"},
            {"customer_id": 2, "first_name": "Max", "last_name": "Ox"},
            {"customer_id": 3, "first_name": "Off", "last_name": "Ox", "active": False},
        ],
    )
    rows = by(analytics.customer_profile(t), "customer_id")
    assert set(rows) == {1, 2}
    assert rows[1].client_profile == "ÖZ, Eva [4]"  # bytes, not characters
    assert rows[1].longest_rental_choice == "ALPHA"  # equal length: first title; unknown length last
    assert rows[1].category_diversity_index == 2
    assert rows[1].avg_return_delay_days == 4.0
    assert rows[2].client_profile is None  # no email
    assert rows[2].total_lifetime_value is None and rows[2].category_diversity_index == 0


def test_film_with_two_categories_counts_in_both(spark):
    rows = by(views.sales_by_film_category(chain(spark)), "category")
    assert rows["Action"].total_sales == D("8.00") and rows["Drama"].total_sales == D("2.00")


def test_views_over_small_chain(spark):
    t = chain(spark)
    films = {(r.FID, r.category): r.actors for r in views.film_list(t).collect()}
    assert films == {(2, "Action"): "AL X", (3, "Action"): "AL X, BE X, CY X", (3, "Drama"): "AL X, BE X, CY X"}
    nice = {r.FID: r.actors for r in views.nicer_but_slower_film_list(t, sep="").collect()}
    assert nice[2] == "AlX"
    info = by(views.actor_info(t), "actor_id")
    assert info[1].film_info == "Action: ALPHA, BRAVO; Drama: BRAVO"
    assert info[4].film_info is None
    store = views.sales_by_store(t).first()
    assert (store.store, store.manager, store.total_sales) == ("Lima,Peru", "Ann Bo", D("8.00"))
    row = views.customer_list(t).first()
    assert row["zip code"] is None and row.notes == "active"


def test_two_categories_of_one_name_repeat_the_actors(spark):
    t = chain(spark, category=[{"category_id": 1, "name": "Action"}, {"category_id": 2, "name": "Action"}])
    films = by(views.film_list(t), "FID")
    assert films[3].actors == "AL X, AL X, BE X, BE X, CY X, CY X"
    rows = by(analytics.financial_performance(t, min_rentals=0), "category")
    assert rows["Action"].rental_count == 2 and rows["Action"].total_revenue == D("13.00")


def source_and_mask(key: int, low: int, top: int) -> tuple[int, int]:
    """Which source row, and by which steps, a key of an inflated table stands for."""
    return (key, 0) if key <= top else (low + (key - top - 1) // 31, (key - top - 1) % 31 + 1)


def test_inflation_conflicts_and_leap_days(spark):
    rental = make(
        spark, "rental",
        {"rental_id": 1, "rental_date": ts("2004-02-29 08:00:00"), "inventory_id": 1, "customer_id": 1},
        {"rental_id": 2, "rental_date": ts("2001-01-01"), "inventory_id": 2, "customer_id": 2, "return_date": ts("2001-01-03")},
        {"rental_id": 3, "rental_date": ts("2004-01-01"), "inventory_id": 2, "customer_id": 2, "return_date": ts("2004-01-09")},
    )
    rows = inflate.inflate_rental(rental).collect()
    dates = {}
    for r in rows:
        dates.setdefault(source_and_mask(r.rental_id, 1, 3)[0], []).append(r)
    assert len(dates[1]) == len({r.rental_date for r in dates[1]})
    # +1 clamps to 28 February and +3 keeps it: never 29 February 2008 by that path, but +4 alone is.
    assert {r.rental_date for r in dates[1] if source_and_mask(r.rental_id, 1, 3)[1] == 8} == {ts("2008-02-29 08:00:00")}
    assert ts("2008-02-28 08:00:00") in {r.rental_date for r in dates[1]}
    keys_seen = [(r.rental_date, r.inventory_id, r.customer_id) for r in rows]
    assert len(keys_seen) == len(set(keys_seen))
    # 2004-01-01 existed before any copy of rental 2 reached it.
    kept = [r for r in rows if r.rental_date == ts("2004-01-01")]
    assert [r.rental_id for r in kept] == [3] and kept[0].return_date == ts("2004-01-09")
    assert len([r for r in rows if r.customer_id == 2]) == 16 + 3  # offsets 0..15 of 2001 and of 2004
    with pytest.raises(Exception, match="duplicate"):
        inflate.inflate_rental(rental, on_conflict="error").collect()
    assert inflate.inflate_rental(rental.limit(1), years=(1, 2), on_conflict="error").count() == 4
    with pytest.raises(ValueError):
        inflate.inflate_rental(rental, on_conflict="ignore")


def test_inflated_rentals_equal_step_by_step_appends(spark):
    """The single pass against the reference procedure: append, then drop later duplicates."""
    start = [(1, ts("2003-02-28"), 5, 5), (2, ts("2004-02-29"), 5, 5), (3, ts("2007-02-28"), 5, 5), (4, ts("2001-07-01"), 6, 5)]
    rental = make(spark, "rental", *[dict(zip(("rental_id", "rental_date", "inventory_id", "customer_id"), r)) for r in start])
    have = {(d, i, c): (k, 0) for k, d, i, c in start}

    def later(d, years):
        try:
            return d.replace(year=d.year + years)
        except ValueError:
            return d.replace(year=d.year + years, day=28)

    for bit, years in enumerate((1, 2, 3, 4, 5)):
        new = {}
        for (d, i, c), (k, mask) in sorted(have.items(), key=lambda e: (e[1][1], e[1][0])):
            key = (later(d, years), i, c)
            if key not in have:
                new.setdefault(key, (k, mask + (1 << bit)))
        have.update(new)
    got = {(r.rental_date, r.inventory_id, r.customer_id): source_and_mask(r.rental_id, 1, 4)
           for r in inflate.inflate_rental(rental).collect()}
    assert got == have


def test_payment_copies_lose_their_rental(spark):
    payment = make(spark, "payment", {"payment_id": 7, "rental_id": 5, "amount": D("1.00"), "payment_date": ts("2001-01-31")})
    rows = inflate.inflate_payment(payment, as_of="2020-01-01 00:00:00").collect()
    assert len(rows) == 32
    assert [r.payment_id for r in rows if r.rental_id is not None] == [7]
    assert len({r.payment_id for r in rows}) == 32
    assert {r.payment_date.year for r in rows} == set(range(2001, 2017))


def test_balance_late_fees_and_large_sums(spark):
    late = {"rental_id": 1, "rental_date": ts("2001-01-01"), "inventory_id": 11, "customer_id": 1, "return_date": ts("2001-02-03")}
    still_out = {"rental_id": 2, "rental_date": ts("2001-01-01"), "inventory_id": 12, "customer_id": 1}
    future = {"rental_id": 3, "rental_date": ts("2002-01-01"), "inventory_id": 12, "customer_id": 1}
    t = chain(
        spark,
        rental=[late, still_out, future],
        payment=[{"payment_id": i, "customer_id": 1, "amount": D("999.99"), "payment_date": ts("2001-01-01")} for i in range(3)],
        customer=[{"customer_id": 1}, {"customer_id": 2}],
    )
    rows = by(finance.customer_balance(t, "2001-06-01"), "customer_id")
    assert (rows[1].rent_fees, rows[1].late_fees, rows[1].payments) == (D("5.98"), D("30.00"), D("2999.97"))
    assert rows[1].balance == D("5.98") + 30 - D("2999.97")
    assert rows[2].balance == 0
    charged = by(finance.customer_balance(t, "2001-06-01", charge_replacement=True), "customer_id")
    assert charged[1].balance == rows[1].balance + D("20.00")


def test_rewards_month_bounds_and_limits(spark):
    def pay(i, customer, day, amount="10.00"):
        return {"payment_id": i, "customer_id": customer, "amount": D(amount), "payment_date": ts(day)}

    t = chain(
        spark,
        customer=[{"customer_id": i} for i in (1, 2, 3)],
        payment=[
            pay(1, 1, "2000-12-01 00:00:00"), pay(2, 1, "2000-12-31 23:59:59"), pay(3, 1, "2000-12-15"),
            pay(4, 2, "2000-12-01"), pay(5, 2, "2000-12-02"), pay(6, 2, "2001-01-01 00:00:00"),  # one too late
            pay(7, 3, "2000-12-01", "5.00"), pay(8, 3, "2000-12-02", "5.00"), pay(9, 3, "2000-12-03", "10.00"),  # exactly at the limit
        ],
    )
    got = finance.rewards_report(t, 2, "20.00", date(2001, 1, 20))
    assert [r.customer_id for r in got.collect()] == [1]
    assert got.columns == t.customer.columns
    assert finance.count_rewardees(got).first()[0] == 1
    assert finance.reward_month("2001-01-20") == (date(2000, 12, 1), date(2000, 12, 31))
    assert finance.reward_month("2001-02-20", 3) == (date(2000, 11, 1), date(2000, 11, 30))
    for bad in [(0, "1.00"), (1, "0.00")]:
        with pytest.raises(ValueError):
            finance.rewards_report(t, *bad, "2001-01-20")


def test_stock_with_several_open_rentals(spark):
    t = chain(spark, rental=[
        {"rental_id": 5, "inventory_id": 11, "customer_id": 50},
        {"rental_id": 4, "inventory_id": 11, "customer_id": 40},
        {"rental_id": 6, "inventory_id": 12, "customer_id": 60, "return_date": ts("2001-01-01")},
    ])
    held = by(stock.inventory_held_by_customer(t), "inventory_id")
    assert set(held) == {11} and (held[11].customer_id, held[11].n_open) == (40, 2)
    assert [r.inventory_id for r in stock.film_not_in_stock(t, 1, 1).collect()] == [11]
    assert sorted(r.inventory_id for r in stock.film_in_stock(t).collect()) == [12, 13]
    assert stock.film_in_stock(t, 2, 9).count() == 0


def test_rollup_without_category_and_kpis_without_rows(spark):
    t = chain(spark, film_category=[{"film_id": 1, "category_id": 1}], customer=[{"customer_id": 1}, {"customer_id": 9}])
    rows = {(str(r.sales_date), r.category_id): r for r in refresh.refresh_sales_rollup(t, "2001-03-02", "2001-03-02").collect()}
    assert rows[("2001-03-02", 0)].total_sales == D("3.00") and rows[("2001-03-02", 0)].tx_count == 2
    assert refresh.refresh_sales_rollup(t, "2001-03-03", "2001-03-09").count() == 0
    kpi = by(refresh.refresh_customer_kpis(t), "customer_id")[9]
    assert (kpi.rentals_count, kpi.active_rentals, kpi.total_spent, kpi.last_payment) == (0, 0, 0, None)


@pytest.mark.parametrize("batch, changed", [(0, {1}), (1, {1}), (2, {1, 2}), (99, {1, 2, 4})])
def test_fold_window_batches(spark, batch, changed):
    t = chain(
        spark,
        customer=[{"customer_id": i} for i in (1, 2, 3, 4)],
        rental=[{"rental_id": 1, "customer_id": 1, "rental_date": ts("2001-06-01")},
                {"rental_id": 2, "customer_id": 2, "rental_date": ts("2001-06-01"), "return_date": ts("2001-06-02")}],
        payment=[{"payment_id": 1, "customer_id": 1, "amount": D("4.00"), "payment_date": ts("2001-06-01")},
                 {"payment_id": 2, "customer_id": 1, "amount": D("9.00"), "payment_date": ts("1999-06-01")}],
        customer_kpis=[{"customer_id": i, "rentals_count": 10, "active_rentals": 7, "total_spent": D("100.00")} for i in (1, 2, 4)],
    )
    rows = by(refresh.fold_kpi_window(t, batch, 30, "2001-06-15 00:00:00"), "customer_id")
    assert set(rows) == {1, 2, 4}  # no row appears for a customer without one
    assert {k for k, r in rows.items() if r.last_update is not None} == changed
    one = rows[1]
    assert (one.rentals_count, one.active_rentals, one.total_spent, one.balance_cached) == (11, 1, D("104.00"), D("108.00"))
    assert one.last_payment == ts("2001-06-01")
    if 2 in changed:  # rentals but no payments: the strict greatest gives NULL
        assert (rows[2].rentals_count, rows[2].active_rentals, rows[2].last_payment) == (11, 0, None)
        assert rows[2].last_rental == ts("2001-06-01")


def test_double_fan_out(spark):
    t = chain(
        spark,
        customer=[{"customer_id": i} for i in (1, 2, 3, 4)],
        rental=[{"rental_id": i, "customer_id": c} for i, c in [(1, 2), (2, 2), (3, 3), (4, 3)]],
        payment=[{"payment_id": i, "customer_id": c, "amount": D("1.50")} for i, c in [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]],
    )
    got = {r.customer_id: (r.cnt, r.amt) for r in analytics.customer_activity_top(t, 10).collect()}
    assert got == {1: (0, D("3.00")), 2: (2, 0), 3: (6, D("9.00")), 4: (0, 0)}
    assert [r.customer_id for r in analytics.customer_activity_top(t, 2).collect()] == [3, 1]


def test_film_text_sync_cases(spark):
    film_text = make(spark, "film_text", *[{"film_id": i, "title": f"T{i}", "description": d}
                                           for i, d in [(1, None), (2, "two"), (3, "three"), (4, "four"), (5, "five")]])
    cases = [
        ("update", 1, "T1", None, 1, "T1", "now"),        # from NULL alone
        ("update", 2, "T2", "two", 2, "T2", None),        # to NULL alone
        ("update", 3, "T3", "three", 3, "T3", "III"),     # other text
        ("update", 4, "T4", "four", 44, "T44", None),     # new title carries the rest along
        ("delete", 5, "T5", "five", None, None, None),
        ("insert", None, None, None, 6, "T6", "six"),
        ("update", 9, "T9", "nine", 9, "X", "nine"),      # not in the copy: nothing happens
    ]
    changeset = spark.createDataFrame(
        cases, "op string, old_film_id long, old_title string, old_description string, "
               "new_film_id long, new_title string, new_description string")
    plain = {r.film_id: (r.title, r.description) for r in changes.sync_film_text(film_text, changeset).collect()}
    assert plain == {1: ("T1", None), 2: ("T2", "two"), 3: ("T3", "III"), 44: ("T44", None), 6: ("T6", "six")}
    safe = {r.film_id: r.description for r in changes.sync_film_text(film_text, changeset, null_safe=True).collect()}
    assert safe[1] == "now" and safe[2] is None


def test_cleanup_keeps_old_payment_of_recent_rental(spark):
    t = chain(
        spark,
        rental=[{"rental_id": 1, "inventory_id": 11, "customer_id": 1, "rental_date": ts("2001-06-10")},
                {"rental_id": 2, "inventory_id": 11, "customer_id": 1, "rental_date": ts("2001-01-01")}],
        payment=[{"payment_id": 1, "customer_id": 1, "rental_id": 1, "amount": D("1.00"), "payment_date": ts("2001-05-01")},
                 {"payment_id": 2, "customer_id": 1, "rental_id": 2, "amount": D("2.00"), "payment_date": ts("2001-05-01")},
                 {"payment_id": 3, "customer_id": 1, "rental_id": 2, "amount": D("4.00"), "payment_date": ts("2001-06-14")},
                 {"payment_id": 4, "customer_id": 1, "amount": D("8.00"), "payment_date": ts("2001-05-01")}],
        sales_rollup_daily=[{"sales_date": date(2001, 6, 14), "store_id": 1, "category_id": 1},
                            {"sales_date": date(2001, 5, 1), "store_id": 1, "category_id": 1, "tx_count": 5}],
    )
    left = refresh.cleanup_recent(t, 10, "2001-06-15 00:00:00")
    assert {r.payment_id: r.rental_id for r in left.payment.collect()} == {1: None, 2: 2, 4: None}
    assert [r.rental_id for r in left.rental.collect()] == [2]
    assert [r.tx_count for r in left.sales_rollup_daily.collect()] == [5]
    assert left.customer_kpis.first().total_spent == D("11.00")


def test_update_rounds_half_up_and_stamps_matches_only(spark):
    t = chain(spark, payment=[{"payment_id": 1, "customer_id": 1, "amount": D("2.50")}, {"payment_id": 2, "customer_id": 8, "amount": D("2.50")}])
    rows = by(workload.bulk_price_update(t, 1, 100, "2001-01-01 00:00:00"), "payment_id")
    assert rows[1].amount == D("2.63") and rows[1].last_update == ts("2001-01-01")
    assert rows[2].amount == D("2.50") and rows[2].last_update is None
    assert workload.bulk_price_update(t, 2, 100, "2001-01-01").filter("amount <> 2.50").count() == 0


def test_stamps_only_changed_rows_of_all_tables(spark):
    old = chain(spark)
    new = old.replacing(city=old.city.withColumn("city", F.upper("city")), category=old.category.withColumn(
        "name", F.when(F.col("category_id") == 2, "Noir").otherwise(F.col("name"))))
    got = changes.stamp_tables(old, new, "2001-01-01 00:00:00")
    assert [r.last_update for r in got.city.collect()] == [ts("2001-01-01")]
    assert {r.category_id: r.last_update for r in got.category.collect()} == {1: ts("2000-01-01"), 2: ts("2001-01-01")}
    assert got.actor.filter("last_update <> timestamp'2000-01-01'").count() == 0
    assert got.film_actor.count() == old.film_actor.count()


def test_delete_keeps_unknown_rows(spark):
    film = make(spark, "film", *[{"film_id": i, "length": n} for i, n in [(1, 10), (2, 90), (3, None)]])
    assert sorted(r.film_id for r in changes.delete_where(film, F.col("length") > 50).collect()) == [1, 3]


def test_replace_range_drops_days_without_rows(spark):
    rollup = make(spark, "sales_rollup_daily", *[{"sales_date": date(2001, 1, d), "store_id": 1, "category_id": 1} for d in (1, 2, 3, 4)])
    new = make(spark, "sales_rollup_daily", {"sales_date": date(2001, 1, 2), "store_id": 7, "category_id": 1})
    got = changes.replace_range(rollup, new, "sales_date", "2001-01-02", "2001-01-03").collect()
    assert sorted((r.sales_date.day, r.store_id) for r in got) == [(1, 1), (2, 7), (4, 1)]


def test_audit_actions(spark):
    before = make(spark, "payment", *[{"payment_id": i, "amount": D("1.00")} for i in (1, 2, 3)])
    after = make(spark, "payment", {"payment_id": 1, "amount": D("1.00")}, {"payment_id": 2, "amount": D("2.00")}, {"payment_id": 4})
    log = by(changes.audit_changes(before, after, "payment_id", "2001-01-01 00:00:00"), "payment_id")
    assert {k: r.action for k, r in log.items()} == {2: "UPDATE", 3: "DELETE", 4: "INSERT"}
    assert log[4].before_json is None and '"amount":2.00' in log[2].after_json


def test_checks_find_planted_faults(spark):
    rows = make(spark, "film", {"film_id": 1, "rating": "X", "release_year": 1900}, {"film_id": 1, "rating": "PG-13", "release_year": 2155}, {"film_id": 2})
    assert [(r.film_id, r.n) for r in checks.check_unique(rows, ["film_id"]).collect()] == [(1, 2)]
    assert [(r.rating, r.n) for r in checks.check_domain(rows, "rating", allowed=["PG-13"]).collect()] == [("X", 1)]
    assert checks.check_domain(rows, "release_year", between=(1901, 2155)).count() == 1
    child = make(spark, "payment", {"payment_id": 1, "rental_id": 5}, {"payment_id": 2, "rental_id": 5}, {"payment_id": 3})
    parent = make(spark, "rental", {"rental_id": 6})
    assert [(r.rental_id, r.n) for r in checks.check_foreign_key(child, "rental_id", parent, "rental_id").collect()] == [(5, 2)]
    nulls = {r.column_name: r.n_null for r in checks.check_not_null(child, ["rental_id", "payment_id"]).collect()}
    assert nulls == {"rental_id": 1, "payment_id": 0}


def brute_force_scores(docs, query, min_len=4, share=0.5):
    import math
    import re
    from collections import Counter

    def words(text):
        return [w for w in re.findall(r"\w+", text.lower()) if len(w) >= min_len and w not in search.STOPWORDS]

    counts = {k: Counter(words(text)) for k, text in docs.items()}
    n, out = len(docs), {}
    for k, c in counts.items():
        total = 0.0
        for term, qf in Counter(words(query)).items():
            nf = sum(term in other for other in counts.values())
            if c[term] and nf < share * n:
                norm = sum(math.log(v) + 1 for v in c.values())
                total += qf * (math.log(c[term]) + 1) / norm * len(c) / (1 + 0.0115 * len(c)) * math.log((n - nf) / nf)
        if total > 0:
            out[k] = total
    return out


def test_search_against_brute_force(spark):
    texts = {
        1: "War and love, LOVE and robots", 2: "a drama of robots robots robots", 3: None, 4: "common love", 5: "common drama",
        6: "common common thing", 7: "common word lovely", 8: "dramas are common",
    }
    docs = make(spark, "film_text", *[{"film_id": k, "title": f"title{k}", "description": d} for k, d in texts.items()])
    query = "love war drama common love robots"
    got = {r.film_id: r.score for r in search.score_documents(docs, ("title", "description"), query).collect()}
    want = brute_force_scores({k: f"title{k} {d or ''}" for k, d in texts.items()}, query)
    assert got.keys() == want.keys() and 6 not in got  # `common` is in at least half of the documents
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)
    matched = {r.film_id for r in search.matching_documents(docs, ("title", "description"), query).collect()}
    assert matched == set(want)
    loose = search.score_documents(docs, ("title", "description"), query, min_len=3, max_doc_share=0.9)
    assert {r.film_id for r in loose.collect()} == set(brute_force_scores({k: f"title{k} {d or ''}" for k, d in texts.items()}, query, 3, 0.9))
    assert search.score_documents(docs, ("title",), "of war").count() == 0
    assert search.matching_documents(docs, ("title",), "of war").count() == 0


def test_term_vectors_and_index(spark):
    docs = make(spark, "film_text", {"film_id": 1, "title": "To be", "description": "or not to be"}, {"film_id": 2, "title": "!"})
    got = {r.film_id: r.fulltext for r in search.build_term_vectors(docs).collect()}
    assert got == {1: {"to": [1, 5], "be": [2, 6], "or": [3], "not": [4]}, 2: {}}
    index = search.build_term_index(docs, stopwords=(), min_len=2)
    assert [(r.film_id, r.dtf, r.u) for r in search.lookup_terms(index, ["Be"]).collect()] == [(1, 2, 4)]


def test_index_gives_the_same_ranking_and_reads_its_buckets_only(spark, tables, tmp_path):
    docs, cols, query = tables.film_text, ("title", "description"), "license data ther data"
    path = str(tmp_path / "index")
    search.write_term_index(search.build_term_index(docs, cols, buckets=8), path)
    stored = spark.read.parquet(path)
    got = search.score_with_index(stored, docs.agg(F.count(F.lit(1)).alias("n")), query, buckets=8)
    scan = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "dtf" in x]
    assert scan and all("PartitionFilters: [isnotnull(bucket" in x or "PartitionFilters: [bucket" in x for x in scan)
    ranked = {r.film_id: r.score for r in search.score_documents(docs, cols, query).collect()}
    assert {r.film_id: pytest.approx(r.score, abs=1e-9) for r in got.collect()} == ranked and ranked
    assert search.score_with_index(stored, docs.limit(1).select("film_id"), "of war").count() == 0


def test_scalar_functions(spark):
    row = spark.sql("select 'mARY ann' a, cast(null as int) n, 3 m, timestamp_ntz'2004-02-29 10:00:00' d").select(
        S.capitalise("a").alias("c"), S.strict_greatest("n", "m").alias("g"), S.strict_greatest(F.lit(1), "m").alias("h"),
        S.add_years("d", 1).alias("y"), S.month_start("d").alias("s"), S.byte_length(F.lit("né")).alias("b"),
        S.full_name("a", F.lit(None).cast("string")).alias("f"),
    ).first()
    assert (row.c, row.g, row.h, row.y, row.s, row.b, row.f) == (
        "Mary ann", None, 3, ts("2005-02-28 10:00:00"), date(2004, 2, 1), 3, None)


def test_dense_index_is_gapless(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = sorted(r.idx for r in keys.dense_index(df, "k", slices=13).collect())
    assert got == list(range(df.count()))


def test_null_keys_never_match_and_are_kept(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 6)], "id long, k long")
    right = spark.createDataFrame([(5, "x")], "k long, v string")
    got = {r.id: r.v for r in keys.left_join_spread_nulls(left, right, "k", "id").collect()}
    assert got == {1: "x", 2: None, 3: None, 4: None}


def test_bumped_payments(spark):
    t = chain(spark)
    rows = by(workload.bump_latest_payments(t, 2, "0.01", 3), "payment_id")
    assert [rows[i].amount for i in (1, 2, 3)] == [D("5.00"), D("1.03"), D("2.03")]


def test_deviation_is_exact_for_large_groups(spark):
    """25,000 times each of 10^16 and the next three cents: weight times squares has 43 digits."""
    from reelflow.functions.aggregates import population_stddev

    values = [10**16 + k for k in range(4)]
    s1, s2 = 25_000 * sum(values), 25_000 * sum(v * v for v in values)
    big = spark.sql(f"select 100000L w, cast('{s1}' as decimal(38,0)) s1, cast('{s2}' as decimal(38,0)) s2")
    assert big.select(population_stddev(F.col("w"), F.col("s1"), F.col("s2")).alias("v")).first().v == 1.25**0.5 / 100
    same = spark.sql(f"select 3L w, cast('{3 * values[1]}' as decimal(38,0)) s1, cast('{3 * values[1] ** 2}' as decimal(38,0)) s2")
    assert same.select(population_stddev(F.col("w"), F.col("s1"), F.col("s2")).alias("v")).first().v == 0


def test_update_of_repeated_matches_adds_no_row(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    matched = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (None, 1, "z"), (3, 1, "w")], "k long, n long, w string")
    rows = changes.update_join(target, matched, "k", {"v": F.col("w")}).collect()
    assert sorted((r.v, r.k) for r in rows) == [("b", 2), ("c", None), ("y", 1)]


def test_audit_ids_are_unique_and_go_on_from_a_log(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    after = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    log = changes.audit_changes(before, after, "k", "2001-01-01")
    assert sorted((r.audit_id, r.action) for r in log.collect()) == [(1, "DELETE"), (2, "UPDATE"), (3, "INSERT")]
    more = changes.audit_changes(after, before, "k", "2001-01-02", log=log)
    assert sorted(r.audit_id for r in more.collect()) == [4, 5, 6]
    assert more.first().changed_at == ts("2001-01-02")
    pairs = spark.createDataFrame([(1, 23), (12, 3)], "a long, b long")
    ids = [r.audit_id for r in changes.audit_changes(pairs, pairs.limit(0), ["a", "b"], "2001-01-01").collect()]
    assert len(set(ids)) == 2


def test_appended_keys_lie_above_all_others(spark):
    target = spark.createDataFrame([(7, "a"), (2**33, "b")], "k long, v string")
    rows = spark.createDataFrame([(1, "c"), (40, "d")], "k long, v string")
    got = {r.v: r.k for r in keys.append_with_keys(target, rows, "k").collect()}
    assert got["a"] == 7 and got["b"] == 2**33 and 2**33 < got["c"] < got["d"]
    assert {r.k for r in keys.append_with_keys(target.limit(0), rows, "k").collect()} == {1, 40}


def test_missing_constraint_columns_are_reported(spark):
    t = small(spark, film=[{"film_id": 1, "language_id": 3}], language=[{"language_id": 4}])
    t = t.replacing(film=t.film.drop("original_language_id"))
    report = {(r.table_name, r.constraint_columns): r for r in checks.foreign_key_report(t).collect()}
    assert len(report) == 28
    assert not report["film", "original_language_id"].checked and report["film", "original_language_id"].bad_rows is None
    assert (report["film", "language_id"].bad_keys, report["film", "language_id"].bad_rows) == (1, 1)
    assert report["inventory", "film_id"].bad_rows == 0
