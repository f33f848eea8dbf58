"""Role views: the star schema expressed over the TPC-H-like test tables.

The test tables stand in for the rental tables: a part is a film, a supplier is an actor, a store
and a staff member, an order line is a rental, every physical line row is a payment. FIXTURES.md
lists the same mapping as SQL. All views are narrow except `inventory`, `film_actor`, `category`,
`language` (a distinct), `rental` (one hash aggregate with map-side combine) and
`payment.payment_id`.

The mapping plants gaps that a rental business has and the test tables lack: films without a
category or with two, films without actors, actors without films, NULLs, two domain faults. They
are there to be met by the queries; no table is thinned out to make it smaller.

`payment_id` numbers the lines that share an order and line number. The numbering window is split
by `l_partkey % 1024` so that one hot order is spread over many tasks; the slice number is part of
the id. Position, slice and order line together need more than 63 bits when one order holds a large
share of a very large table, so this id is a DECIMAL(38,0). Catalyst drops the window from every
query that does not read `payment_id`. `inventory_id` fits a LONG up to nine billion parts.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelflow.sources.tables import RentalTables

DRIVER_DDL: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
}

PART_STRIDE = 1_000_000_000  # inventory_id = part * stride + supplier
RENTAL_STRIDE = "1000000000000000BD"  # payment_id = (position * slices + slice) * stride + order line
NUMBERING_SLICES = 1024
STORES = 10


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read with its declared schema."""
    return spark.read.schema(DRIVER_DDL[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def role_tables(spark: SparkSession, sf_dir: str) -> RentalTables:
    """The whole star schema over the test tables in `sf_dir`."""

    @cache
    def src(name: str) -> DataFrame:
        return driver_table(spark, sf_dir, name)

    def orders() -> DataFrame:
        # orders grow with the lines, and their size is estimated from compressed files: never built on the driver
        return src("orders").hint("merge")

    def country() -> DataFrame:
        return src("region").select(F.col("r_regionkey").cast("long").alias("country_id"), F.col("r_name").alias("country"))

    def city() -> DataFrame:
        return src("nation").select(
            F.col("n_nationkey").cast("long").alias("city_id"),
            F.col("n_name").alias("city"),
            F.col("n_regionkey").cast("long").alias("country_id"),
        )

    def address() -> DataFrame:
        def side(df: DataFrame, key: str, nation: str, odd: int, street: str) -> DataFrame:
            k = F.col(key)
            return df.select(
                (k * 2 + odd).alias("address_id"),
                F.concat((k % 997).cast("string"), F.lit(street)).alias("address"),
                F.lit("NA").alias("district"),
                F.col(nation).cast("long").alias("city_id"),
                F.when(k % 5 != 0, (k % 90000 + 10000).cast("string")).alias("postal_code"),
                F.concat(F.lit("555-"), (k % 10000).cast("string")).alias("phone"),
            )

        return side(src("customer"), "c_custkey", "c_nationkey", 0, " Market Street").unionByName(
            side(src("supplier"), "s_suppkey", "s_nationkey", 1, " Harbour Road")
        )

    def store() -> DataFrame:
        k = F.col("s_suppkey")
        return src("supplier").select(k.alias("store_id"), k.alias("manager_staff_id"), (k * 2 + 1).alias("address_id"))

    def staff() -> DataFrame:
        k = F.col("s_suppkey")
        return src("supplier").select(
            k.alias("staff_id"),
            F.lit("STAFF").alias("first_name"),
            F.col("s_name").alias("last_name"),
            (k * 2 + 1).alias("address_id"),
            k.alias("store_id"),
            (F.col("s_acctbal") > 0).alias("active"),
            F.lower("s_name").alias("username"),
        )

    def actor() -> DataFrame:
        return src("supplier").select(
            F.col("s_suppkey").alias("actor_id"), F.lit("SUPPLIER").alias("first_name"), F.col("s_name").alias("last_name")
        )

    def customer() -> DataFrame:
        k = F.col("c_custkey")
        return src("customer").select(
            k.alias("customer_id"),
            (k % STORES).alias("store_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.when(k % 10 != 0, F.concat(F.lower("c_name"), F.lit("@ex.com"))).alias("email"),
            (k * 2).alias("address_id"),
            (F.col("c_acctbal") > 0).alias("active"),
        )

    brand_no = F.expr("cast(substring(p_brand, 7) as bigint)")

    def category() -> DataFrame:
        return src("part").select(brand_no.alias("category_id"), F.col("p_brand").alias("name")).distinct()

    def film() -> DataFrame:
        k = F.col("p_partkey")
        return src("part").select(
            k.alias("film_id"),
            F.col("p_name").alias("title"),
            F.when(k % 9 != 2, F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("description"),
            F.when(k % 50 == 49, F.lit(1890)).otherwise(1990 + k % 30).cast("int").alias("release_year"),
            (1 + k % 4).alias("language_id"),
            (3 + k % 5).cast("int").alias("rental_duration"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("rental_rate"),
            F.when(F.col("p_size") != 50, F.col("p_size")).alias("length"),
            (F.col("p_retailprice").cast("decimal(12,2)") * 2).cast("decimal(12,2)").alias("replacement_cost"),
            F.when(k % 12 == 11, F.lit("NR"))
            .otherwise(F.expr("element_at(array('G','PG','PG-13','R','NC-17',null), cast(p_partkey % 6 as int) + 1)"))
            .alias("rating"),
        )

    def film_category() -> DataFrame:
        first = F.when(F.col("p_partkey") % 11 != 5, brand_no)
        second = F.when(F.col("p_partkey") % 7 == 3, (brand_no + 6) % 25 + 1)
        return (
            src("part")
            .select(F.col("p_partkey").alias("film_id"), F.explode(F.array(first, second)).alias("category_id"))
            .filter(F.col("category_id").isNotNull())
        )

    def film_actor() -> DataFrame:
        return (
            src("lineitem")
            .filter((F.col("l_partkey") % 13 != 6) & (F.col("l_suppkey") % 17 != 4))
            .select(F.col("l_suppkey").alias("actor_id"), F.col("l_partkey").alias("film_id"))
            .distinct()
        )

    def inventory() -> DataFrame:
        pairs = src("lineitem").select("l_partkey", "l_suppkey").distinct()
        return pairs.select(
            (F.col("l_partkey") * PART_STRIDE + F.col("l_suppkey")).alias("inventory_id"),
            F.col("l_partkey").alias("film_id"),
            (F.col("l_suppkey") % STORES).alias("store_id"),
        )

    def rental() -> DataFrame:
        lines = (
            src("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min(F.col("l_partkey") * PART_STRIDE + F.col("l_suppkey")).alias("inventory_id"),
                F.max((F.col("l_returnflag") == "N").cast("int")).alias("open"),
            )
        )
        out_days = F.expr(
            "case l_linenumber % 3 when 0 then interval '1' day when 1 then interval '5' day else interval '9' day end"
        )
        return lines.join(orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rental_id"),
            F.col("o_orderdate").alias("rental_date"),
            "inventory_id",
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("open") == 0, F.col("o_orderdate") + out_days).alias("return_date"),
            (F.col("inventory_id") % PART_STRIDE).alias("staff_id"),
        )

    def payment() -> DataFrame:
        order_line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        piece = F.col("l_partkey") % NUMBERING_SLICES
        w = Window.partitionBy("l_orderkey", "l_linenumber", piece).orderBy(
            "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
        )
        numbered = src("lineitem").withColumn("rn", F.row_number().over(w).cast("long"))
        return numbered.join(orders(), F.col("l_orderkey") == F.col("o_orderkey")).select(
            (((F.col("rn") - 1) * NUMBERING_SLICES + piece).cast("decimal(20,0)") * F.expr(RENTAL_STRIDE) + order_line)
            .cast("decimal(38,0)")
            .alias("payment_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("staff_id"),
            F.when(F.col("l_partkey") % 20 != 0, order_line).alias("rental_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
            F.col("l_shipdate").alias("payment_date"),
            F.lit(None).cast("timestamp").alias("last_update"),
        )

    def film_text() -> DataFrame:
        return src("documents").select(
            F.col("doc_id").alias("film_id"), F.col("source").alias("title"), F.col("text").alias("description")
        )

    def language() -> DataFrame:
        code = F.ascii("lang").cast("long") * 256 + F.ascii(F.substring("lang", 2, 1))
        return src("documents").select(code.alias("language_id"), F.col("lang").alias("name")).distinct()

    builders = (
        country, city, address, store, staff, actor, customer, category, film, film_category,
        film_actor, inventory, rental, payment, film_text, language,
    )
    return RentalTables({b.__name__: b for b in builders})
