"""The SQL surface answers like the DataFrame functions."""

import pytest

from reelflow.plans import finance, sql_api, stock


def test_sql_routines(spark, tables):
    sql_api.install(spark, tables)
    flags = spark.sql("select inventory_id, inventory_in_stock(inventory_id) in_stock from inventory")
    want = stock.inventory_in_stock(tables).select("inventory_id", "in_stock")
    assert flags.exceptAll(want).count() == 0 and flags.count() == want.count()

    held = spark.sql("select inventory_id, inventory_held_by_customer(inventory_id) c from inventory").filter("c is not null")
    assert held.exceptAll(stock.inventory_held_by_customer(tables).select("inventory_id", "customer_id")).count() == 0

    day = "2000-06-30 00:00:00"
    balances = {r.customer_id: r.balance for r in finance.customer_balance(tables, day).collect()}
    some = sorted(balances)[:3]
    for customer in some:
        got = spark.sql(f"select get_customer_balance({customer}, timestamp_ntz'{day}') b").first().b
        assert got == balances[customer]

    film = stock.film_not_in_stock(tables).first()
    out = spark.sql(f"select * from film_not_in_stock({film.film_id}, {film.store_id})")
    assert film.inventory_id in {r.inventory_id for r in out.collect()}
    inside = spark.sql(f"select * from film_in_stock({film.film_id}, {film.store_id})")
    assert inside.count() == stock.film_in_stock(tables, film.film_id, film.store_id).count()

    best = spark.sql("select customer_id from rewards_report(1, 50000.00, date'2000-03-15')")
    assert sorted(r[0] for r in best.collect()) == sorted(
        r.customer_id for r in finance.rewards_report(tables, 1, "50000.00", "2000-03-15").collect())
    assert best.columns == ["customer_id"] and spark.sql("select * from rewards_report(1, 50000.00, date'2000-03-15', 3)").columns == tables.customer.columns
    with pytest.raises(Exception, match="must be positive"):
        spark.sql("select * from rewards_report(0, 50000.00, date'2000-03-15')").collect()
    assert spark.sql("select `zip code` from customer_list").count() == tables.customer.count()
    for name in sql_api.VIEWS:
        assert spark.table(name).limit(1).count() == 1
