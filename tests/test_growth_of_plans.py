"""What must not grow with the tables: what the driver holds, rows that are compared, rows that are exchanged."""

import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelflow.operators import changes, checks, inflate, keys, search, text_index
from reelflow.plans import finance, refresh
from reelflow.sources import colocated, sinks
from tests.conftest import SF, make, small, ts
from verification import queries


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_fresh_join_repeats_no_row_and_exchanges_both_sides(spark):
    left = spark.range(6).selectExpr("id % 4 film_id", "id inventory_id")
    right = spark.range(3).selectExpr("id film_id", "id * 10 weight").groupBy("film_id").sum("weight")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keys.fresh_join(left, right, "film_id", "left")
        text = joined._jdf.queryExecution().executedPlan().toString()
        exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning(film_id" in line and "_place" in line]
        assert len(exchanged) == 2 and "explode" not in text
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(
            [(0, 0, 0), (1, 1, 10), (2, 2, 20), (3, 3, None), (0, 4, 0), (1, 5, 10)], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        keys.fresh_join(left, right, "film_id", "full")


def test_categories_of_copies_never_reach_the_driver(spark, tables):
    text = final_plan(refresh.refresh_sales_rollup(tables, queries.FIRST_DAY, queries.LAST_DAY))
    assert "_place" in text and not any("_place" in line for line in text.splitlines() if "Broadcast" in line)


def test_films_of_the_daily_sales_never_reach_the_driver(spark, tables):
    rollup = refresh.refresh_sales_rollup(tables, queries.FIRST_DAY, queries.LAST_DAY)
    for text in (initial_plan(rollup), final_plan(rollup)):
        joins = [line for line in text.splitlines() if "LeftSemi" in line and "[p_partkey" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("name", ["rental", "payment"])
def test_orders_never_reach_the_driver(spark, tables, name):
    rows = tables[name].drop("payment_id")
    for text in (initial_plan(rows), final_plan(rows)):
        joins = [line for line in text.splitlines() if "Join [" in line and "[o_orderkey" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_rentals_that_share_a_day_of_the_year_are_compared(spark):
    day = {"inventory_id": 1, "customer_id": 1, "rental_date": ts("2001-05-05 00:00:00")}
    shared = [{"rental_id": 1, **day}, {"rental_id": 2, **day, "rental_date": ts("2003-05-05 00:00:00")}]
    alone = [{"rental_id": k, **day, "customer_id": k, "return_date": ts("2001-05-09 00:00:00")} for k in range(3, 9)]
    grown = inflate.inflate_rental(make(spark, "rental", *shared, *alone))
    text = initial_plan(grown)
    assert "Union" in text and "lambda" not in text and "REPARTITION_BY_NUM" in text
    assert text.count("row_number() windowspecdefinition") == 1 and text.count("count(1) windowspecdefinition") == 2
    rows = grown.collect()
    assert len(rows) == 16 + 2 + 6 * 16 and len({(r.rental_date, r.customer_id) for r in rows}) == len(rows)
    assert len({r.rental_id for r in rows}) == len(rows) and {r.rental_id for r in rows} >= set(range(1, 9))


def test_copies_of_payments_are_summed_where_they_are_made(spark):
    text = initial_plan(entry.queries()["inflate_payment"](spark, SF))
    assert "lambda" not in text and "Exchange" not in text[: text.index("Generate")] and "REPARTITION_BY_NUM" in text


def test_inflated_keys_are_grouped_before_the_exchange(spark):
    text = initial_plan(entry.queries()["inflated_keys"](spark, SF))
    assert text.count("hashpartitioning(block") == 2


def test_facts_of_the_inflated_keys_are_computed_once(spark):
    text = entry.queries()["inflated_keys"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in text


@pytest.mark.parametrize("kind", ["decimal(38,0)", "bigint"])
def test_a_key_has_the_same_block_with_and_without_a_near_one(spark, kind):
    """Keys in, below, just above and far from the near block, negative ones, and NULLs."""
    near = [None, -128, 0, 64, 6400] + [10**30 // 64 * 64] * (kind != "bigint")
    given = [(k + d, k, new) for k in near if k is not None for d in (-65, -1, 0, 1, 63, 64, 127, 128, 10**9) for new in (True, False)]
    wide = [(10**38 - 1, -(10**38 - 64), True)] * (kind != "bigint") + [(2**63 - 1, -(2**63) + 64, True)]
    rows = given + wide + [(5, None, True), (-5, None, False), (None, 64, True), (None, None, False)]
    data = spark.createDataFrame([(None if k is None else str(k), None if n is None else str(n), new) for k, n, new in rows], "k string, near string, new boolean")
    data = data.select(F.col("k").cast(kind).alias("k"), F.col("near").cast(kind).alias("near"), "new")
    got = [(r.new, None if r.block is None else int(r.block), r.at) for r in queries._in_blocks(data, "k").collect()]
    want = [(new, None if k is None else k // 64 * 64, None if k is None else k % 64) for k, _, new in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_change_log_is_parsed_once(spark):
    text = initial_plan(entry.queries()["audit_changes"](spark, SF))
    assert text.count("from_json(") == 2 and "get_json_object" not in text


def test_facts_and_logs_of_the_upkeep_are_computed_once(spark):
    for name in ("upkeep_kpis", "upkeep_status", "log_read_back"):
        text = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "to_json(" not in text and "row_number" not in text


def test_the_kept_up_rollup_is_computed_once(spark):
    text = entry.queries()["upkeep_rollup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in text and "p_partkey" not in text


def test_files_of_exchanges_go_when_a_table_is_stored(spark):
    def files():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return {n for n in env.blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in n}

    before, setting = files(), spark.conf.get(sinks.FREE_EXCHANGES, None)
    assert sinks.stored(spark.range(1000).groupBy((F.col("id") % 300).alias("k")).count()).count() == 300
    assert spark.conf.get(sinks.FREE_EXCHANGES, None) == setting
    for _ in range(50):
        left = {n for n in files() - before if n.endswith((".data", ".index"))}
        if len(left) <= 2:  # those of the count of the stored rows
            break
        time.sleep(0.2)
    assert len(left) <= 2


@pytest.mark.parametrize("name", ["check_unique_report", "check_foreign_key"])
def test_reports_compute_rentals_and_daily_sales_once_and_keep_the_keys_types(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json(" not in text and not any("Aggregate [l_orderkey" in line for line in text.splitlines())


def test_rows_that_their_key_places_are_not_exchanged_by_the_unique_report(spark, tables):
    pairs = checks.check_unique(tables.film_actor, ["actor_id", "film_id"])
    assert initial_plan(pairs).count("Exchange hashpartitioning(") == 1
    report = initial_plan(checks.unique_report(tables))
    lines = [line for line in report.splitlines() if "Exchange hashpartitioning(actor_id" in line and "film_id" in line]
    assert len(lines) == 1 and "to_json(" not in report


def test_unique_report_tells_times_within_a_millisecond(spark):
    at = {"inventory_id": 1, "customer_id": 1, "rental_date": ts("2001-01-01 00:00:00.000001")}
    later = {**at, "rental_date": ts("2001-01-01 00:00:00.000002")}
    t = small(spark, rental=[{"rental_id": 1, **at}, {"rental_id": 2, **later}, {"rental_id": 3, **at}, {"rental_id": 3, **later, "customer_id": 2}],
              store=[{"store_id": 1, "manager_staff_id": 5}, {"store_id": 2, "manager_staff_id": 5}])
    t = t.replacing(customer_kpis=t.customer_kpis.drop("customer_id"), store=t.store.withColumn("store_id", F.when(F.col("store_id") == 1, 1)))
    report = {(r.table_name, r.constraint_columns): (r.checked, r.bad_keys, r.bad_rows) for r in checks.unique_report(t).collect()}
    assert len(report) == 23
    assert report["rental", "rental_id"] == (True, 1, 2) and report["rental", "rental_date,inventory_id,customer_id"] == (True, 1, 2)
    assert report["store", "store_id"] == (True, 0, 0) and report["store", "manager_staff_id"] == (True, 1, 2)
    assert report["customer_kpis", "customer_id"] == (False, None, None)


def test_foreign_keys_of_two_types_meet_as_text(spark):
    t = small(spark, staff=[{"staff_id": 1, "store_id": 1}, {"staff_id": 2, "store_id": 9}, {"staff_id": 3, "store_id": 9}], store=[{"store_id": 1, "manager_staff_id": 2}])
    t = t.replacing(staff=t.staff.withColumn("store_id", F.col("store_id").cast("decimal(38,0)")))
    report = {(r.table_name, r.constraint_columns): (r.bad_keys, r.bad_rows) for r in checks.foreign_key_report(t).collect()}
    assert report["staff", "store_id"] == (1, 2) and report["store", "manager_staff_id"] == (0, 0) and report["store", "address_id"] == (1, 1)


def test_a_key_is_exchanged_once_in_a_comparison(spark, tables):
    pairs = tables.film_actor
    log = changes.audit_changes(pairs, pairs.where("film_id % 2 = 0"), ["actor_id", "film_id"], queries.AS_OF)
    below = log._jdf.queryExecution().optimizedPlan().toString().split("FullOuter")[1]
    assert "_old" in below and "struct(actor_id" not in below
    one = log.orderBy("audit_id").first()
    assert one.before_json == one.audit_id and one.after_json is None


def test_stored_payments_are_not_exchanged_by_their_id(spark, tables, monkeypatch):
    plans = []
    monkeypatch.setattr(colocated, "_bucketed", lambda df, name, buckets: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    colocated.store_facts(tables, 4)
    assert "row_number" not in plans[0] and plans[0].count("Join") == 1 and "payment_id = payment_id" not in plans[0]


def test_seeded_rows_are_picked_once_and_copies_numbered_once(spark):
    text = entry.queries()["seed_synthetic_data"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in text and "row_number" not in text


def test_rows_to_number_are_computed_once(spark, tables):
    rows = keys.dense_index(tables.inventory.select("inventory_id"), "inventory_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ReusedExchange" in final_plan(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    numbers = sorted(r.idx for r in rows.collect())
    assert numbers == list(range(tables.inventory.count()))
    assert keys.dense_index(spark.sql("select * from values (5L), (null) as v(k)"), "k").count() == 1


def test_only_slots_with_a_probe_carry_sums_and_sums_are_exchanged_as_money(spark):
    text = initial_plan(entry.queries()["balances_at"](spark, SF))
    assert any("Filter" in line and "asked" in line for line in text.splitlines())
    day = lambda k: ts(f"2001-01-0{k} 00:00:00")
    paid = [{"payment_id": k, "customer_id": 1, "amount": Decimal(k), "payment_date": day(k)} for k in (1, 2, 4, 5)]
    t = small(spark, payment=paid)
    got = finance.balances_at(t, spark.createDataFrame([(1, day(3)), (1, day(5)), (2, day(5))], "customer_id long, as_of timestamp_ntz"))
    assert {(r.customer_id, r.as_of): int(r.payments) for r in got.collect()} == {(1, day(3)): 3, (1, day(5)): 12, (2, day(5)): 0}


def test_a_table_on_both_sides_of_a_stamp_is_computed_once(spark, tables):
    rental = tables.rental.withColumn("last_update", F.lit("1995-01-01 00:00:00").cast("timestamp"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = changes.stamp_last_update(rental, rental, "rental_id", queries.AS_OF).groupBy("last_update").count()
        assert final_plan(got).count("FileScan parquet [l_orderkey") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r["count"] for r in got.collect()] == [tables.rental.count()]


def test_rows_without_a_key_keep_their_stamp_and_are_not_repeated(spark):
    rows = lambda name: spark.sql(f"select k, '{name}' name, timestamp'1995-01-01' last_update from values (1L), (null), (null) v(k)")
    got = changes.stamp_last_update(rows("a"), rows("b"), "k", "2001-01-01 00:00:00").collect()
    assert sorted((r.k or 0, r.last_update.year) for r in got) == [(0, 1995), (0, 1995), (1, 2001)]


def test_terms_are_sorted_without_a_comparator_function(spark, tables):
    vectors = search.build_term_vectors(tables.film_text)
    index = text_index.positional_postings(tables.film_text)
    for df in (vectors, index):
        assert "sort_array(" in initial_plan(df) and "array_sort(" not in initial_plan(df)


def test_positions_of_a_term_are_one_slice(spark):
    docs = spark.sql("select * from values (1L, 'b a', 'B c a b'), (2L, '', null) as v(film_id, title, description)")
    got = search.term_positions(docs, ("title", "description"))
    assert "slice(" in initial_plan(got) and "transform(slice(" not in initial_plan(got)
    assert {(r.film_id, r.term): r.positions for r in got.collect()} == {(1, "a"): [2, 5], (1, "b"): [1, 3, 6], (1, "c"): [4]}


def test_the_second_key_of_a_fresh_join_has_two_values(spark):
    left = spark.range(6).selectExpr("id % 4 film_id", "id inventory_id")
    text = keys.fresh_join(left, spark.range(3).selectExpr("id film_id"), "film_id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("as tinyint) AS _place") == 2
