"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from reelflow.operators import search
from reelflow.plans import analytics, finance, refresh
from reelflow.sources import colocated
from tests.conftest import SF
from verification.queries import queries as verification_queries

WRITING = {
    "load_table", "load_tables", "write_payments_by_month", "overwrite_full", "overwrite_range", "populate_extended_tables", "indexed_search",
    "phrase_search", "segmented_search", "merged_search", "delete_cascading", "orphans_after_delete",
    "distinct_over_months", "streamed_status", "performance_of_stored_facts",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffle_joins(spark):
    """Nothing is small enough to broadcast, as with large dimensions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(verification_queries()) - WRITING))
def test_no_cartesian_product_no_python_and_no_forced_broadcast(spark, shuffle_joins, name):
    text = plan(entry.queries()[name](spark, SF))
    for word in ("CartesianProduct", "NestedLoopJoin", "BroadcastHashJoin", "Python"):
        assert word not in text, word


def test_time_filters_reach_the_scan(spark, tables):
    text = plan(finance.rewards_report(tables, 1, "10.00", "2000-03-15"))
    assert "GreaterThanOrEqual(l_shipdate,2000-02-01" in text and "LessThan(l_shipdate,2000-03-01" in text


def test_unused_columns_are_not_read_and_numbering_disappears(spark, tables):
    text = plan(refresh.refresh_customer_kpis(tables))
    assert "Window" not in text
    assert not re.search(r"ReadSchema: struct<[^>]*l_tax", text)


def test_revenue_is_never_multiplied_by_the_actor_bridge(spark, shuffle_joins):
    """The facts meet a per-copy weight; the bridge is aggregated on its own side first."""
    text = plan(entry.queries()["financial_performance"](spark, SF))
    assert "Expand" not in text
    assert text.count("Window") == 0


def test_no_ranking_window_per_customer(spark, shuffle_joins):
    assert "Window" not in plan(entry.queries()["customer_profile"](spark, SF))


def test_term_vectors_shuffle_nothing(spark, tables, shuffle_joins):
    text = plan(search.build_term_vectors(tables.film_text))
    assert text.count("Exchange") == 0


def test_term_positions_shuffle_nothing(spark, tables, shuffle_joins):
    text = plan(search.term_positions(tables.film_text, ("title", "description")))
    assert text.count("Exchange") == 0


def test_term_index_shuffles_nothing(spark, tables, shuffle_joins):
    text = plan(search.build_term_index(tables.film_text))
    assert text.count("Exchange") == 0


def test_ranking_scans_text_without_exploding_it(spark, tables):
    text = plan(search.score_documents(tables.film_text, ("title", "description"), "license data"))
    assert "Exchange hashpartitioning" not in text


def test_stored_facts_meet_without_an_exchange(spark, tables, shuffle_joins):
    """Payments and rentals are read by bucket, summed and joined where they lie; the first exchange is for the copies."""
    text = plan(analytics.financial_performance(colocated.store_facts(tables, 4), ordered=False))
    lines = text.splitlines()
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "SelectedBucketsCount: 4 out of 4" in line]
    assert len(scans) == 2
    join = max(k for k, line in enumerate(lines[: scans[0]]) if "SortMergeJoin [rental_id" in line)
    assert "slice" in lines[join] and not any("Exchange" in line for line in lines[join : scans[1] + 1])


def test_hot_rentals_lie_in_several_buckets(spark, tables):
    """A rental with most payments is cut into slices, and the report stays the same."""
    from pyspark.sql import functions as F

    busy = tables.rental.agg(F.min("rental_id")).first()[0]
    payment = tables.payment.withColumn("rental_id", F.when(F.col("payment_date") < "1998-01-01", F.lit(busy)).otherwise(F.col("rental_id")))
    given = tables.replacing(payment=payment)
    stored = colocated.store_facts(given, 4, slice_rows=200)
    sizes = stored.payment.groupBy("rental_id", "slice").count()
    assert sizes.where(F.col("rental_id") == busy).count() > 3 and sizes.agg(F.max("count")).first()[0] < 400
    assert stored.payment.where("leads").count() == given.payment.select("rental_id").where("rental_id is not null").distinct().count()
    rows = lambda t: sorted(map(str, analytics.financial_performance(t, 0, ordered=False).collect()))
    assert rows(stored) == rows(given)
