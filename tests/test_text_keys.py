"""Text keys that ignore case and trailing blanks, distinct counts from stored sets, stock from a stream."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from reelflow.functions import collation as C
from reelflow.operators import changes
from reelflow.plans import distinct, refresh
from reelflow.streaming import status
from tests.conftest import make, small, ts


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Ann", 1), ("ANN ", 2), ("ann  ", 3), (" ann", 4), ("Bo", 5), (None, 6), (None, 7), ("Äb", 8), ("äB ", 9), ("", 10), ("  ", 11)], "name string, n long")


def test_grouping_shows_one_spelling(spark, names):
    got = {r.name: r.s for r in C.group_by_text(names, ["name"], F.sum("n").alias("s")).collect()}
    assert got == {"ANN ": 6, " ann": 4, "Bo": 5, None: 13, "Äb": 17, "": 21}
    assert C.distinct_by_text(names, ["name"]).count() == 6
    assert C.group_by_text(names, ["name"], F.sum("n").alias("s"), collation=C.PLAIN).count() == 10
    assert C.group_by_text(names.limit(0), ["name"], F.sum("n").alias("s")).collect() == []


def test_joins_keep_the_left_spelling(spark, names):
    right = spark.createDataFrame([("aNN", "x"), ("bo   ", "y"), (None, "z")], "name string, mark string")
    got = sorted((r.name, r.mark) for r in C.join_by_text(names, right, ["name"]).collect())
    assert got == [("ANN ", "x"), ("Ann", "x"), ("Bo", "y"), ("ann  ", "x")]
    left = C.join_by_text(names, right, ["name"], "left")
    assert left.count() == 11 and left.columns == ["name", "n", "mark"]
    assert C.join_by_text(names, right, ["name"], "left_anti").count() == 7


def test_a_change_of_case_is_none(spark):
    copy = make(spark, "film_text", *[{"film_id": k, "title": t} for k, t in ((1, "One"), (2, "Two"))])
    ddl = "op string, old_film_id long, old_title string, old_description string, new_film_id long, new_title string, new_description string"
    batch = spark.createDataFrame([("update", 1, "One", None, 1, "ONE  ", None), ("update", 2, "Two", None, 2, "Three", None)], ddl)
    titles = lambda **kw: {r.film_id: r.title for r in changes.sync_film_text(copy, batch, **kw).collect()}
    assert titles() == {1: "ONE  ", 2: "Three"} and titles(collation=C.IGNORE_CASE_AND_BLANKS) == {1: "One", 2: "Three"}


@pytest.fixture(scope="module")
def sales(spark):
    r = random.Random(3)
    rentals = [{"rental_id": k * 7000, "customer_id": r.randrange(5) * 40_000, "inventory_id": r.randrange(1, 5), "rental_date": ts("2001-01-01 00:00:00")} for k in range(40)]
    payments = [{"payment_id": k, "rental_id": r.choice([None, r.randrange(40) * 7000]), "payment_date": ts("2001-01-05 00:00:00") + r.randrange(200) * timedelta(days=1)} for k in range(300)]
    return small(spark, rental=rentals, payment=payments, inventory=[{"inventory_id": i, "film_id": i % 3, "store_id": i % 2} for i in range(1, 5)],
                 film_category=[{"film_id": 0, "category_id": 1}, {"film_id": 1, "category_id": 1}, {"film_id": 1, "category_id": 2}])


@pytest.mark.parametrize("by", [["store_id"], ["category_id"], ["store_id", "category_id"], []])
@pytest.mark.parametrize("span", [("2001-01-01", "2001-07-31"), ("2001-02-10", "2001-04-02"), ("2002-01-01", "2002-02-01")])
def test_distinct_counts_over_any_months(spark, sales, by, span):
    rollup = distinct.distinct_rollup(sales, "2001-01-01", "2001-12-31")
    first, last = (s[:7] + "-01" for s in span)
    facts = sales.payment.join(sales.rental, "rental_id").join(sales.inventory, "inventory_id").join(sales.film_category, "film_id")
    inside = facts.where(F.trunc("payment_date", "MM").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    want = inside.groupBy(*by).agg(F.countDistinct("rental_id").alias("rentals"), F.countDistinct(sales.rental.customer_id).alias("customers"))
    got = distinct.distinct_counts(rollup, *span, by)
    key = lambda df: sorted(map(tuple, df.select(*by, "rentals", "customers").collect()))
    assert key(got) == key(want)


def test_sets_are_no_larger_than_their_ids(spark):
    """A bucket of one id takes a few bytes, 2,000 close ones take a bitmap."""
    close = [{"rental_id": k, "customer_id": k * 40_000, "inventory_id": 1, "rental_date": ts("2001-01-01 00:00:00")} for k in range(1, 2001)]
    payments = [{"payment_id": k, "rental_id": k, "payment_date": ts("2001-01-05 00:00:00")} for k in range(1, 2001)]
    t = small(spark, rental=close, payment=payments, inventory=[{"inventory_id": 1, "film_id": 1, "store_id": 1}], film_category=[{"film_id": 1, "category_id": 1}])
    rollup = distinct.distinct_rollup(t, "2001-01-01", "2001-12-31")
    size = {r.kind: r.n for r in rollup.groupBy("kind").agg(F.sum(F.coalesce(F.size("few") * 2, F.length("ids"))).alias("n")).collect()}
    assert size == {"rental": 4096, "customer": 4000}
    assert list(map(tuple, distinct.distinct_counts(rollup, "2001-01-01", "2001-12-01", []).collect())) == [(2000, 2000)]


def test_status_from_a_stream_and_its_replay(spark, tmp_path):
    r = random.Random(9)
    rentals = [{"rental_id": k, "inventory_id": r.randrange(6), "rental_date": ts("2001-01-01 00:00:00") + k * timedelta(hours=5), "return_date": r.choice([None, ts("2001-03-01 00:00:00")])} for k in range(50)]
    t = small(spark, rental=rentals, inventory=[{"inventory_id": i, "film_id": 1, "store_id": 1} for i in range(8)])
    arrivals, folder, checkpoint = (str(tmp_path / x) for x in ("in", "status", "checkpoint"))
    (tmp_path / "in").mkdir()
    events = status.rental_events(t.rental)
    want = sorted(map(str, refresh.refresh_inventory_status(t).drop("last_update").collect()))
    stream = spark.readStream.schema(status.EVENTS).option("maxFilesPerTrigger", 1).parquet(arrivals)
    for part in (0, 1, 2):  # returns may arrive before their rentals
        events.where(F.pmod(F.col("rental_id") + F.when(F.col("kind") == "return", 1).otherwise(0), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(arrivals)
        status.keep_status(stream, folder, checkpoint).awaitTermination(120)
    assert sorted(map(str, status.read_status(spark, folder, t).collect())) == want
    # the last batch again: its folder is written once more with the same rows
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    status.keep_status(stream, folder, checkpoint).awaitTermination(120)
    assert sorted(map(str, status.read_status(spark, folder, t).collect())) == want
