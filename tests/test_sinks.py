"""Month routing, full and range overwrite, streaming reactions."""

from datetime import date
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelflow.plans import refresh
from reelflow.sources import schemas, sinks
from reelflow.sources.tables import RentalTables, load_table
from reelflow.streaming import reactions
from tests.conftest import make, small, ts


def payments(spark):
    days = ["2007-01-01 00:00:00", "2007-01-31 23:59:59", "2007-02-01 00:00:00", "2006-12-31 23:59:59", "2007-07-01 00:00:00"]
    return make(spark, "payment", *[{"payment_id": i, "amount": D("1.00"), "payment_date": ts(d)} for i, d in enumerate(days)])


def test_month_routing_and_pruned_read(spark, tmp_path):
    path = str(tmp_path / "payment")
    sinks.write_payments_by_month(payments(spark), path, "2007-01-01", "2007-06-01")
    got = {r.payment_id: r.payment_month for r in spark.read.parquet(path).collect()}
    assert got == {0: date(2007, 1, 1), 1: date(2007, 1, 1), 2: date(2007, 2, 1), 3: None, 4: None}
    january = sinks.read_payments(spark, path, "2006-12-31", "2007-01-31")
    assert sorted(r.payment_id for r in january.collect()) == [0, 1, 3]
    plan = january._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [((payment_month" in scan or "PartitionFilters: [(isnull(payment_month" in scan
    assert "GreaterThanOrEqual(payment_date" in scan and "LessThan(payment_date" in scan


def test_month_routing_without_bounds(spark, tmp_path):
    path = str(tmp_path / "payment")
    sinks.write_payments_by_month(payments(spark), path)
    assert spark.read.parquet(path).filter("payment_month is null").count() == 0


def test_full_overwrite_keeps_old_version_readable(spark, tmp_path):
    first = sinks.overwrite_full(make(spark, "film_text", {"film_id": 1, "title": "a"}), str(tmp_path))
    old = spark.read.parquet(first)
    second = sinks.overwrite_full(old.withColumn("title", F.upper("title")), str(tmp_path))
    assert first != second and old.first().title == "a" and spark.read.parquet(second).first().title == "A"


def rollup(spark, *days):
    return make(spark, "sales_rollup_daily", *[
        {"sales_date": date.fromisoformat(d), "store_id": 1, "category_id": 1, "tx_count": n} for d, n in days])


@pytest.mark.parametrize("tasks", [None, 3])
def test_range_overwrite(spark, tmp_path, tasks):
    path = str(tmp_path / "rollup")
    sinks.overwrite_range(path, rollup(spark, ("2001-01-30", 1), ("2001-01-31", 1), ("2001-02-01", 1), ("2001-02-02", 1)), "2001-01-01", "2001-12-31")
    new = rollup(spark, ("2001-02-01", 9))
    for _ in range(2):  # a repeated refresh changes nothing
        sinks.overwrite_range(path, new, "2001-01-31", "2001-02-01", tasks=tasks)
    got = sinks.read_daily(spark, path, "2001-01-01", "2001-12-31")
    assert {str(r.sales_date): r.tx_count for r in got.collect()} == {"2001-01-30": 1, "2001-02-01": 9, "2001-02-02": 1}
    assert sinks.read_daily(spark, path, "2001-02-02", "2001-02-09").count() == 1
    with pytest.raises(Exception, match="outside"):
        sinks.overwrite_range(path, new, "2001-03-01", "2001-03-02")
    sinks.overwrite_range(path, new.limit(0), "2001-01-01", "2001-01-31")
    assert {str(r.sales_date) for r in spark.read.parquet(path).collect()} == {"2001-02-01", "2001-02-02"}


def test_shared_dir_follows_the_session(spark):
    assert sinks.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_declared_schema_is_used(spark, tmp_path):
    make(spark, "film", {"film_id": 1, "title": "x"}).write.parquet(str(tmp_path / "film.parquet"))
    t = RentalTables.from_dir(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in t.film.schema] == [(f.name, f.dataType) for f in schemas.schema("film")]
    assert load_table(spark, str(tmp_path), "film").count() == 1
    with pytest.raises(KeyError):
        t["nothing"]


def test_film_changes_stream(spark, tmp_path):
    ddl = ("op string, old_film_id long, old_title string, old_description string, "
           "new_film_id long, new_title string, new_description string")
    folder, arrivals = str(tmp_path / "copy"), str(tmp_path / "in")
    make(spark, "film_text", {"film_id": 1, "title": "a"}).write.parquet(f"{folder}/0")
    Path(arrivals).mkdir()
    stream = spark.readStream.schema(ddl).parquet(arrivals)
    for n, row in enumerate([("insert", None, None, None, 2, "b", None), ("delete", 1, "a", None, None, None, None)]):
        spark.createDataFrame([row], ddl).write.mode("append").parquet(arrivals)
        reactions.start(stream, reactions.keep_film_text(spark, folder), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(f"{folder}/{n + 1}").count() == 2 - n
    assert [r.film_id for r in spark.read.parquet(f"{folder}/2").collect()] == [2]


def test_payment_stream_feeds_months_and_rollup(spark, tmp_path):
    arrivals, months, target = str(tmp_path / "in"), str(tmp_path / "months"), str(tmp_path / "rollup")
    t = small(
        spark,
        store=[{"store_id": 1}],
        inventory=[{"inventory_id": 5, "film_id": 1, "store_id": 1}],
        rental=[{"rental_id": 9, "inventory_id": 5}],
    )
    rows = make(spark, "payment", *[{"payment_id": i, "rental_id": 9, "amount": D("2.00"), "payment_date": ts(f"2001-01-0{i}")} for i in (1, 2)])
    rows.write.parquet(arrivals)
    stream = spark.readStream.schema(schemas.schema("payment")).parquet(arrivals)
    reactions.start(stream, reactions.store_payments(months), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(months).filter("payment_month = date'2001-01-01'").count() == 2
    so_far = lambda: t.replacing(payment=spark.read.schema(schemas.schema("payment")).parquet(arrivals))
    reactions.start(stream, reactions.keep_sales_rollup(so_far, target), str(tmp_path / "c2")).awaitTermination(120)
    got = sinks.read_daily(spark, target, "2001-01-01", "2001-01-31").select(*t.sales_rollup_daily.columns)
    want = refresh.refresh_sales_rollup(so_far(), "2001-01-01", "2001-01-31")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() == 2
