"""A third of the rows on one order, one copy and one customer: results stay whole and tasks split."""

import shutil

import duckdb
import pytest

import check
import __spark_entry__ as entry
from tests.conftest import SF

AFFECTED = [
    "financial_performance", "customer_profile", "customer_activity_top", "sales_by_store", "sales_by_film_category",
    "film_list", "actor_info", "bulk_price_update", "bump_latest_payments", "customer_balance", "inventory_held_by_customer",
    "refresh_sales_rollup", "refresh_customer_kpis", "refresh_inventory_status", "cleanup_recent", "fold_kpi_window",
    "audit_changes", "check_unique",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    for name in check.TABLES:
        if name not in ("orders", "lineitem"):
            shutil.copy(f"{SF}/{name}.parquet", target / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(
        f"copy (select case when o_orderkey % 3 = 0 then 7 else o_custkey end o_custkey, * exclude o_custkey "
        f"from '{SF}/orders.parquet') to '{target}/orders.parquet'"
    )
    con.execute(
        f"""copy (select case when n % 3 = 0 then 42 else l_orderkey end l_orderkey,
                         case when n % 3 = 1 then 11 else l_partkey end l_partkey,
                         case when n % 3 = 1 then 5 else l_suppkey end l_suppkey,
                         * exclude (l_orderkey, l_partkey, l_suppkey, n)
                  from (select *, row_number() over () n from '{SF}/lineitem.parquet'))
            to '{target}/lineitem.parquet' (row_group_size 2048)"""
    )
    return str(target)


@pytest.fixture(scope="module")
def skewed_con(skewed):
    return check.database(skewed)


@pytest.fixture()
def many_small_partitions(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.files.maxPartitionBytes": "16KB",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", AFFECTED)
def test_results_stay_whole(spark, skewed, skewed_con, name):
    ok, note = check.compare(spark, skewed_con, skewed, name)
    assert ok, note


@pytest.mark.parametrize("name, key", [("bulk_price_update", "customer_id"), ("refresh_sales_rollup", "inventory_id")])
def test_hot_keys_are_split_at_run_time(spark, skewed, many_small_partitions, name, key):
    df = entry.queries()[name](spark, skewed)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    split = [line for line in final.splitlines() if "skew=true" in line]
    assert any(key in line for line in split), final
