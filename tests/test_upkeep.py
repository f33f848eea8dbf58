"""Balances at dates that differ by row, derived tables kept up by changes, logs read back, deletes over all keys."""

import random
from datetime import timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from reelflow.operators import cascade, changes, checks
from reelflow.plans import finance, refresh, upkeep
from reelflow.sources.roles import role_tables
from tests.conftest import make, small, ts
from verification import queries

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def facts(spark):
    """Random rentals and payments over few days, customers and copies; customer 1 has most of them."""
    r = random.Random(8)
    rentals = [
        {"rental_id": k, "rental_date": ts("2001-01-01 10:00:00") + r.randrange(6) * DAY, "inventory_id": r.randrange(1, 5), "customer_id": r.choice([1, 1, 1, 2, 3]),
         "return_date": None if r.random() < 0.4 else ts("2001-01-09 00:00:00") + r.randrange(9) * DAY}
        for k in range(1, 60)
    ]
    payments = [
        {"payment_id": k, "rental_id": r.choice([None, r.randrange(1, 60)]), "customer_id": r.choice([1, 1, 2, 3]), "amount": D(r.randrange(1, 900)) / 100,
         "payment_date": ts("2001-01-01 00:00:00") + r.randrange(9) * DAY + timedelta(microseconds=r.randrange(10**6))}
        for k in range(1, 80)
    ]
    return small(
        spark, rental=rentals, payment=payments,
        customer=[{"customer_id": c, "store_id": 1, "address_id": 1} for c in (1, 2, 3, 4)],
        store=[{"store_id": s, "manager_staff_id": s, "address_id": 1} for s in (1, 2)],
        film=[{"film_id": f, "title": str(f), "rental_duration": 2 + f, "rental_rate": D("0.99"), "replacement_cost": D("9.00")} for f in (1, 2)],
        film_category=[{"film_id": 1, "category_id": 1}, {"film_id": 1, "category_id": 2}],
        inventory=[{"inventory_id": i, "film_id": 1 + i % 2, "store_id": 1 + i % 2} for i in (1, 2, 3, 4)],
    )


@pytest.mark.parametrize("lost", [False, True])
@pytest.mark.parametrize("slot", ["DAY", "YEAR"])
def test_balances_at_equal_one_balance_after_the_other(spark, facts, lost, slot):
    moments = [ts("2000-12-31 00:00:00"), ts("2001-01-01 10:00:00"), ts("2001-01-03 09:59:59"), ts("2001-01-03 10:00:00"), ts("2002-01-01 00:00:00")]
    probes = spark.createDataFrame([(c, m) for c in (1, 2, 4) for m in moments] * 2 + [(None, moments[0]), (1, None)], "customer_id long, as_of timestamp_ntz")
    got = {(r.customer_id, r.as_of): tuple(r)[2:] for r in finance.balances_at(facts, probes, lost, slot).collect()}
    assert len(got) == 15
    for m in moments:
        for r in finance.customer_balance(facts, m, lost).collect():
            if r.customer_id != 3:
                assert got[r.customer_id, m] == tuple(r)[1:], (r.customer_id, m)


def test_balances_at_join_no_charge_to_a_probe(spark, tables):
    """Charges meet copies and films, then events are only sorted; both uses of the stream read one exchange."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = finance.balances_at(tables, tables.rental.select("customer_id", F.col("rental_date").alias("as_of")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "NestedLoop" not in text and "Cartesian" not in text
    keys = [line.split("Join")[1] for line in text.splitlines() if "Join" in line and "customer_id" in line.split("Join")[1]]
    assert len(keys) == 1 and "slot" in keys[0]
    reused = [line for line in text.splitlines() if "ReusedExchange" in line]
    assert any("customer_id" in line and "slot" in line and "probe" in line for line in reused)


def changed(facts, seed):
    """A later version of the facts and the change logs between them."""
    r = random.Random(seed)
    rental, payment = facts.rental, facts.payment
    some = lambda n: [r.randrange(1, 80) for _ in range(n)]
    rental = rental.where(~F.col("rental_id").isin(some(8)))
    rental = rental.withColumn("return_date", F.when(F.col("rental_id").isin(some(9)), F.lit(None)).otherwise(F.col("return_date")))
    rental = rental.withColumn("customer_id", F.when(F.col("rental_id").isin(some(5)), F.lit(4)).otherwise(F.col("customer_id")))
    rental = rental.withColumn("inventory_id", F.when(F.col("rental_id").isin(some(9)), F.lit(2)).otherwise(F.col("inventory_id")))
    rental = rental.unionByName(facts.rental.where(F.col("rental_id").isin(some(6))).withColumn("rental_id", F.col("rental_id") + 1000).withColumn("rental_date", F.col("rental_date") + F.expr("interval '2' day")))
    payment = payment.where(~F.col("payment_id").isin(some(15)))
    payment = payment.withColumn("amount", F.when(F.col("payment_id").isin(some(9)), F.lit(D("1.23"))).otherwise(F.col("amount")).cast("decimal(5,2)"))
    payment = payment.withColumn("payment_date", F.when(F.col("payment_id").isin(some(9)), F.col("payment_date") - F.expr("interval '3' day")).otherwise(F.col("payment_date")))
    payment = payment.withColumn("rental_id", F.when(F.col("payment_id").isin(some(9)), F.lit(1007)).otherwise(F.col("rental_id")))
    after = facts.replacing(rental=rental, payment=payment)
    logs = [changes.audit_changes(facts[n], after[n], f"{n}_id", "2001-02-01 00:00:00", microseconds=True) for n in ("rental", "payment")]
    return after, *logs


@pytest.mark.parametrize("seed", range(3))
def test_upkeep_equals_full_refresh(spark, facts, seed):
    after, rental_log, payment_log = changed(facts, seed)
    same = lambda a, b: sorted(map(str, a.drop("last_update").collect())) == sorted(map(str, b.drop("last_update").collect()))
    kpis = refresh.refresh_customer_kpis(facts)
    assert same(upkeep.merged(kpis, upkeep.changed_kpis(kpis, after, rental_log, payment_log), "customer_id"), refresh.refresh_customer_kpis(after))
    status = upkeep.changed_status(after, rental_log)
    assert same(upkeep.merged(refresh.refresh_inventory_status(facts), status, "inventory_id"), refresh.refresh_inventory_status(after))
    span = ("2000-01-01", "2002-01-01")
    rollup = refresh.refresh_sales_rollup(facts, *span)
    delta = upkeep.changed_rollup(rollup, after, rental_log, payment_log, *span)
    assert same(upkeep.merged(rollup, delta, ["sales_date", "store_id", "category_id"]), refresh.refresh_sales_rollup(after, *span))


def test_upkeep_of_nothing_changes_nothing(spark, facts):
    logs = [changes.audit_changes(facts[n], facts[n], f"{n}_id", "2001-02-01 00:00:00") for n in ("rental", "payment")]
    kpis = refresh.refresh_customer_kpis(facts)
    assert upkeep.changed_kpis(kpis, facts, *logs).count() == upkeep.changed_status(facts, logs[0]).count() == 0
    assert upkeep.changed_rollup(refresh.refresh_sales_rollup(facts, "2001-01-01", "2001-12-31"), facts, *logs, "2001-01-01", "2001-12-31").count() == 0


def test_log_gives_every_version_back(spark, facts):
    """Several changes of one key: the last one up to a moment counts, the first one after it on the way back."""
    versions = [facts.payment]
    log = None
    for n in range(1, 4):
        after = changed(facts.replacing(payment=versions[-1]), 20 + n)[0].payment
        own = changes.audit_changes(versions[-1], after, "payment_id", f"2001-03-0{n} 00:00:00", microseconds=True)
        log = own if log is None else log.unionByName(own)
        versions.append(after)
    rows = [sorted(map(str, v.collect())) for v in versions]
    assert len({str(r) for r in rows}) == 4
    for n in range(4):
        moment = f"2001-03-0{n or 1} 00:00:00" if n else "2001-02-01 00:00:00"
        assert sorted(map(str, changes.replay(versions[0], log, "payment_id", moment).collect())) == rows[n]
        assert sorted(map(str, changes.rewind(versions[3], log, "payment_id", moment).collect())) == rows[n]
    bridge = make(spark, "film_actor", *[{"actor_id": a, "film_id": f} for a in (1, 2) for f in (1, 2)])
    kept = bridge.where("actor_id <> film_id")
    cut = changes.audit_changes(bridge, kept, ["actor_id", "film_id"], "2001-01-01 00:00:00", microseconds=True)
    assert changes.rewind(kept, cut, ["actor_id", "film_id"]).count() == 4 and changes.replay(bridge, cut, ["actor_id", "film_id"]).count() == 2


@pytest.fixture(scope="module")
def ring(spark):
    """Stores and staff refer to each other in a ring of three; the fourth pair stands alone."""
    manager, shop = {1: 12, 2: 13, 3: 11, 4: 14}, {11: 1, 12: 2, 13: 3, 14: 4}
    return small(
        spark,
        store=[{"store_id": s, "manager_staff_id": m, "address_id": s} for s, m in manager.items()],
        staff=[{"staff_id": p, "store_id": s, "address_id": s} for p, s in shop.items()],
        address=[{"address_id": a, "city_id": 1} for a in (1, 2, 3, 4)],
        city=[{"city_id": 1, "country_id": 1}], country=[{"country_id": 1}], language=[{"language_id": n} for n in (1, 2)],
        film=[{"film_id": 1, "language_id": 1, "original_language_id": 2}, {"film_id": 2, "language_id": 2}],
        film_actor=[{"film_id": f, "actor_id": 1} for f in (1, 2)], actor=[{"actor_id": 1}],
        customer=[{"customer_id": s, "store_id": s, "address_id": s} for s in (1, 4)],
        inventory=[{"inventory_id": s, "film_id": 1, "store_id": s} for s in (1, 4)],
        rental=[{"rental_id": 1, "inventory_id": 4, "customer_id": 4, "staff_id": 11}, {"rental_id": 2, "inventory_id": 4, "customer_id": 4, "staff_id": 14}],
        payment=[{"payment_id": k, "rental_id": x, "customer_id": 4, "staff_id": 14} for k, x in ((1, 1), (2, 2), (3, None))],
    )


def orphans(t):
    return {(r.table_name, r.constraint_columns): r.bad_keys for r in checks.foreign_key_report(t).collect()}


def test_deletes_follow_the_ring(spark, ring):
    left = cascade.delete_cascading(ring, "staff", F.col("staff_id") == 11)
    assert [r.store_id for r in left.store.collect()] == [4] and [r.staff_id for r in left.staff.collect()] == [14]
    assert left.address.count() == 4 and [r.customer_id for r in left.customer.collect()] == [4]
    assert {r.payment_id: r.rental_id for r in left.payment.collect()} == {1: None, 2: 2, 3: None}
    assert left.payment.columns == ring.payment.columns
    assert orphans(left) == orphans(ring)


@pytest.mark.parametrize("table", ["address", "city", "country", "language", "film", "actor", "customer", "inventory", "rental", "store", "staff", "payment"])
def test_no_delete_leaves_an_orphan(spark, ring, table):
    key = ring[table].columns[0]
    left = cascade.delete_cascading(ring, table, F.col(key) == (11 if table == "staff" else 1))
    assert left[table].where(F.col(key) == (11 if table == "staff" else 1)).count() == 0
    assert orphans(left) == orphans(ring)


def test_deleting_nothing_and_unknown(spark, ring):
    left = cascade.delete_cascading(ring, "store", F.lit(None).cast("boolean"))
    assert left.store.count() == 4 and left.payment.count() == 3
    left = cascade.delete_cascading(ring, "language", F.col("language_id") == 2)
    assert {r.film_id: r.original_language_id for r in left.film.collect()} == {1: None}


def test_a_table_outside_the_cycle_is_followed_once(spark, ring, monkeypatch):
    """Rentals refer to staff, copies and customers, which are found in different rounds; they were read for each."""
    seen, plain = [], cascade.stored

    def stored(df):
        seen.append({a for a in ("staff_id", "inventory_id", "customer_id", "rental_id") if f"{a}#" in df._jdf.queryExecution().analyzed().toString()})
        return plain(df)

    monkeypatch.setattr(cascade, "stored", stored)
    gone = cascade.removed_keys(ring, "staff", F.col("staff_id") == 11)
    assert sorted(r.key for r in gone["rental"].collect()) == [1]
    assert sum("rental_id" in names for names in seen) == 2  # its columns that refer, and its keys


def test_rows_without_a_key_go_with_what_they_refer_to(spark, ring):
    nameless = [{"rental_id": 9, "inventory_id": 4, "customer_id": 4, "staff_id": p} for p in (11, 14)]
    more = make(spark, "rental", *nameless).withColumn("rental_id", F.lit(None).cast("long"))
    rental = ring.rental.unionByName(more.select(*ring.rental.columns))
    left = cascade.delete_cascading(ring.replacing(rental=rental), "staff", F.col("staff_id") == 11)
    assert sorted((r.rental_id or 0, r.staff_id) for r in left.rental.collect()) == [(0, 14), (2, 14)]
    left = cascade.delete_cascading(ring.replacing(rental=rental), "rental", F.col("staff_id") == 11)
    assert sorted((r.rental_id or 0, r.staff_id) for r in left.rental.collect()) == [(0, 14), (2, 14)]


def test_batches_of_a_stream_do_not_grow_with_the_table(spark, monkeypatch, tmp_path):
    """A batch held half of all events before, whatever their number."""
    folder = tmp_path / "stream"
    monkeypatch.setattr(queries, "EVENTS_PER_FILE", 300)
    monkeypatch.setattr(queries.sinks, "shared_dir", lambda spark: str(folder))
    t = role_tables(spark, "/root/testdata/sf0.001")
    got = queries.streamed_status_query(spark, "/root/testdata/sf0.001", t)
    events = spark.read.parquet(f"{folder}/events").groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert events[0] <= 300 and events[1] > 300 * queries.FILES_PER_BATCH
    assert len(list((folder / "status").glob("batch=*"))) >= events[1] / (300 * queries.FILES_PER_BATCH)
    assert got.agg(F.sum("total_rentals")).first()[0] == t.rental.count()
