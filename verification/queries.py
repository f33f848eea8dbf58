"""One query per operator, each over the whole tables of a test directory.

Library results keep decimals, dates and timestamps. For comparing with another engine, `plain`
turns money into doubles (after exact decimal summing) and dates, times and wide ids into text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelflow.functions import collation
from reelflow.functions import scalars as S
from reelflow.functions.aggregates import group_concat
from reelflow.operators import cascade, changes, checks, inflate, keys, search, text_index
from reelflow.plans import analytics, distinct, finance, refresh, seed, sql_api, stock, upkeep, views, workload
from reelflow.sources import colocated, roles, schemas, sinks
from reelflow.sources.tables import RentalTables, load_table
from reelflow.streaming import status

AS_OF = "2001-06-15 12:00:00"
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"
SEARCH_TEXT = "action adventure drama love war robot license from data ther data"
MATCH_TEXT = "action love license data"
FILM_SEARCH = "widget gizmo again economy bolt"


def plain(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double" if f.dataType.scale else "string").alias(f.name)
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def _month(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM")


# --- scans, sources, sinks -------------------------------------------------------------------


def load_table_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Store the rentals, read them back with the declared schema."""
    folder = sinks.shared_dir(spark)
    t.rental.withColumn("last_update", F.lit(AS_OF).cast("timestamp")).write.parquet(f"{folder}/rental.parquet")
    return load_table(spark, folder, "rental").drop("last_update")


def load_tables_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Every table stored, read back with its declared schema, and counted by column; values that do not fit their type are NULL."""
    t, folder = _with_rollup(t), sinks.shared_dir(spark)
    parts = []
    for name in t.names():
        given = t[name]
        columns = [f.try_cast(kind).alias(c) if f is not None else F.lit(None).cast(kind).alias(c) for c, kind, f in [(x.name, x.dataType, F.col(x.name) if x.name in given.columns else None) for x in schemas.schema(name)]]
        given.select(*columns).write.parquet(f"{folder}/{name}.parquet")
        back = load_table(spark, folder, name)
        known = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"k_{c}").alias("n_known")) for c in back.columns]))
        counted = back.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in back.columns]).select("n", known.alias("k"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "k.column_name", "n", "k.n_known"))
    return reduce(DataFrame.unionByName, parts)


def write_payments_by_month_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Rows and amount per stored month; months outside 1996-01..2000-12 sit in the default partition."""
    path = sinks.shared_dir(spark)
    sinks.write_payments_by_month(t.payment, path, "1996-01-01", "2000-12-01")
    return (
        spark.read.parquet(path)
        .groupBy(F.coalesce(F.col("payment_month").cast("string"), F.lit("default")).alias("payment_month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    )


def overwrite_full_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Two versions of the customer indicators; the second one is read."""
    path = sinks.shared_dir(spark)
    first = sinks.overwrite_full(refresh.refresh_customer_kpis(t, AS_OF), path)
    doubled = spark.read.parquet(first).withColumn("total_spent", (F.col("total_spent") * 2).cast("decimal(18,2)"))
    second = sinks.overwrite_full(refresh.recompute_balances(doubled), path)
    return spark.read.parquet(second).drop("last_update")


def _yearly(t: RentalTables) -> DataFrame:
    """A daily table: payments per day, late days only from 1998 on."""
    return t.payment.groupBy(F.to_date("payment_date").alias("sales_date")).agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount").cast("decimal(18,2)").alias("total_sales")
    )


def overwrite_range_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """All days are stored; 1998 is then replaced by the days that had a payment over 100,000."""
    path = sinks.shared_dir(spark)
    daily = _yearly(t)
    sinks.overwrite_range(path, daily, FIRST_DAY, LAST_DAY)
    big = _yearly(t.replacing(payment=t.payment.filter("amount > 100000")))
    inside = big.filter(F.col("sales_date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    sinks.overwrite_range(path, inside, "1998-01-01", "1998-12-31")
    return sinks.read_daily(spark, path, FIRST_DAY, LAST_DAY)


def append_with_keys_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Customers appended to themselves; the new rows' addresses of mail are unknown."""
    rows = t.customer.withColumn("email", F.lit(None).cast("string"))
    return keys.append_with_keys(t.customer, rows, "customer_id").select("customer_id", "last_name", "email")


def update_join_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Customers of stores with a negative staff balance become inactive."""
    matched = t.staff.filter(~F.col("active")).select("store_id", F.col("username").alias("by_user"))
    return changes.update_join(
        t.customer.withColumn("last_update", F.lit(None).cast("timestamp")),
        matched,
        "store_id",
        {"active": F.lit(False), "email": F.col("by_user")},
        stamp=AS_OF,
    ).select("customer_id", "active", "email", "last_update")


def update_join_repeated_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Customers matched by each of their rentals: one change each, with the smallest copy, and no new row."""
    matched = t.rental.select("customer_id", F.col("inventory_id").alias("by_copy"))
    changed = changes.update_join(t.customer, matched, "customer_id", {"email": F.col("by_copy").cast("string")})
    return changed.select("customer_id", "active", "email")


def delete_where_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Films over 40 minutes go, and their actor links with them; films of unknown length stay."""
    long_film = F.col("length") > 40
    links = changes.drop_dependants(t.film_actor, changes.deleted_keys(t.film, long_film, "film_id"), "film_id")
    left = links.groupBy("film_id").agg(F.count(F.lit(1)).alias("n_actors"))
    return changes.delete_where(t.film, long_film).join(left, "film_id", "left").select("film_id", "length", "n_actors")


# --- functions -------------------------------------------------------------------------------


def text_functions(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return t.film_text.select(
        "film_id",
        F.concat(F.upper("title"), F.lit(":"), F.lower("title")).alias("cased"),
        S.capitalise("title").alias("capital"),
        F.substring("description", 5, 20).alias("excerpt"),
        F.reverse(F.substring("description", 5, 20)).alias("backwards"),
        S.byte_length("description").cast("long").alias("n_bytes"),
        F.length("description").cast("long").alias("n_chars"),
        F.sha1("description").alias("signature"),
        S.stable_uuid("film", "film_id").alias("uuid"),
    )


def date_functions(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    d = F.col("rental_date")
    return t.rental.select(
        "rental_id",
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        F.to_date(d).alias("day"),
        S.days_between("rental_date", "return_date").alias("days_out"),
        S.month_start(d).alias("month_start"),
        F.last_day(d).alias("month_end"),
        S.add_years(d, 1).alias("next_year"),
        (d - F.expr("interval '30' day")).alias("month_ago"),
        S.strict_greatest(d, F.col("return_date")).alias("latest"),
        F.coalesce(F.col("return_date"), d).alias("known"),
    )


def group_concat_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Categories and distinct stores of every film as ordered lists."""
    named = t.film_category.join(t.category.select("category_id", "name"), "category_id")
    names = named.groupBy("film_id").agg(group_concat("name").alias("categories"))
    held = t.inventory.select("film_id", F.col("store_id").cast("string").alias("store"))
    stores = held.groupBy("film_id").agg(group_concat("store", sep="|", distinct=True).alias("stores"))
    return stores.join(names, "film_id", "left")


# --- change operators ------------------------------------------------------------------------


def film_changes(t: RentalTables) -> DataFrame:
    """A change set taken from the films: what happens to a film depends on its rating."""
    rating = F.col("rating")
    op = F.when(rating == "G", "delete").when(rating.isNull(), "insert").otherwise("update")
    new_title = F.when(rating == "PG", F.concat(F.lit("NEW "), "title")).otherwise(F.col("title"))
    new_text = F.when(rating == "PG-13", F.lit(None)).when(rating == "R", F.concat("title", F.lit(" again")))
    return t.film.filter(F.coalesce(rating != "NC-17", F.lit(True))).select(
        op.alias("op"),
        F.col("film_id").alias("old_film_id"),
        F.col("title").alias("old_title"),
        F.col("description").alias("old_description"),
        (F.col("film_id") + F.when(rating.isNull() | (rating == "PG"), 1_000_000_000).otherwise(0)).alias("new_film_id"),
        new_title.alias("new_title"),
        F.when(rating.isin("PG-13", "R"), new_text).otherwise(F.col("description")).alias("new_description"),
    )


def sync_film_text_query(null_safe: bool):
    def run(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
        copy = t.film.select("film_id", "title", "description")
        return changes.sync_film_text(copy, film_changes(t), null_safe)

    return run


def stamp_last_update_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    before = t.customer.withColumn("last_update", F.lit("1995-01-01 00:00:00").cast("timestamp"))
    after = before.withColumn("email", F.when(F.col("active"), F.lower("last_name")).otherwise(F.col("email")))
    return changes.stamp_last_update(before, after, "customer_id", AS_OF).select("customer_id", "email", "last_update")


def audit_changes_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Payments before June 2001 against repriced payments since June 1995."""
    before = changes.delete_where(t.payment, F.col("payment_date") >= S.ntz("2001-06-01"))
    after = changes.delete_where(
        workload.bulk_price_update(t, 1, 100, AS_OF), F.col("payment_date") < S.ntz("1995-06-01")
    )
    log = changes.audit_changes(before, after, "payment_id", AS_OF, "batch")
    ids, times = ("payment_id", "customer_id"), ("payment_date", "last_update")
    # each text is parsed once for all its fields
    texts = ", ".join(f"{c} string" for c in (*ids, "amount", *times))
    read = log.select("audit_id", "payment_id", "action", "changed_at", "actor_user", *[F.from_json(f"{when}_json", texts).alias(when) for when in ("before", "after")])
    return read.select(
        "audit_id",
        "payment_id",
        "action",
        "changed_at",
        "actor_user",
        *[
            value.alias(f"{when}_{c}")
            for when in ("before", "after")
            for c, value in [
                *[(c, F.col(f"{when}.{c}")) for c in ids],
                *[(c, F.regexp_replace(F.col(f"{when}.{c}"), r"T|\.000Z?$|Z$", " ")) for c in times],
            ]
        ],
        F.col("before.amount").cast("double").alias("old_amount"),
        F.col("after.amount").cast("double").alias("new_amount"),
    )


def audit_bridge_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """A bridge table is audited by its two columns: every second film loses its actors."""
    after = changes.delete_where(t.film_actor, F.col("film_id") % 2 == 0)
    log = changes.audit_changes(t.film_actor, after, ["actor_id", "film_id"], AS_OF)
    return log.groupBy("film_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("audit_id").alias("n_ids"), F.max("action").alias("action"))


def term_vectors(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Number of terms and of positions, first term and its positions per film."""
    first = F.array_min(F.map_keys("fulltext"))
    return search.build_term_vectors(t.film_text).select(
        "film_id",
        F.size("fulltext").cast("long").alias("n_terms"),
        F.aggregate(F.map_values("fulltext"), F.lit(0).cast("long"), lambda a, p: a + F.size(p)).alias("n_positions"),
        first.alias("first_term"),
        F.array_join(F.element_at("fulltext", first), ",").alias("first_positions"),
    )


def term_index(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Occurrences of every term in every film."""
    index = search.build_term_index(t.film_text)
    return index.select("film_id", "term", F.col("dtf").cast("long").alias("dtf"), "u", F.round("norm", 6).alias("norm"))


def indexed_search(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """The ranking of `fulltext_search` from a stored index."""
    path = sinks.shared_dir(spark)
    search.write_term_index(search.build_term_index(t.film_text, buckets=16), path)
    n_documents = t.film_text.agg(F.count(F.lit(1)).alias("n"))
    found = search.score_with_index(spark.read.parquet(path), n_documents, SEARCH_TEXT, buckets=16)
    return found.select("film_id", F.round("score", 6).alias("score"))


def check_unique_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Order lines that occur more than once in the raw line table."""
    lines = roles.driver_table(spark, sf, "lineitem")
    return checks.check_unique(lines, ["l_orderkey", "l_linenumber"])


def _with_rollup(t: RentalTables) -> RentalTables:
    return t.replacing(
        sales_rollup_daily=refresh.refresh_sales_rollup(t, FIRST_DAY, LAST_DAY, AS_OF),
        customer_kpis=refresh.refresh_customer_kpis(t, AS_OF),
        inventory_status=refresh.refresh_inventory_status(t, AS_OF),
    )


def _for_report(t: RentalTables) -> RentalTables:
    """Rentals and the keys of the daily sales written once, for the key reports: their exchanges are freed before the report's."""
    t = _with_rollup(t.replacing(rental=sinks.stored(t.rental)))
    return t.replacing(sales_rollup_daily=sinks.stored(t.sales_rollup_daily.select(*schemas.PRIMARY_KEYS["sales_rollup_daily"])))


def check_domain_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    log = changes.audit_changes(t.payment, workload.bulk_price_update(t, 1, 100, AS_OF), "payment_id", AS_OF)
    return checks.domain_report(t.replacing(audit_payment=log.withColumn("action", F.lower("action"))))


def check_not_null_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return checks.not_null_report(t, required_only=False)


# --- inflation, seeding, upkeep --------------------------------------------------------------


def inflate_rental_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    grown = inflate.inflate_rental(t.rental, on_conflict="skip", as_of=AS_OF)
    return grown.groupBy("customer_id", F.year("rental_date").alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("return_date").alias("n_returned"),
    )


def inflate_payment_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Payments meet by customer and month of the year, which no copy changes, before they are copied; sums need no exchange after it."""
    source = t.payment.withColumn("month", F.month("payment_date"))
    grown = inflate.inflate_payment(source.repartition(inflate.task_count(source), "customer_id", "month"), as_of=AS_OF)
    sums = grown.groupBy("customer_id", "month", F.year("payment_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rental_id").alias("n_with_rental"),
        F.sum("amount").alias("amount"),
    )
    return sums.select("customer_id", _month(F.make_date("year", "month", F.lit(1))).alias("payment_month"), "n", "n_with_rental", "amount")


def _in_blocks(df: DataFrame, key: str) -> DataFrame:
    """(new, block, at): a key as the multiple of 64 below it and the rest; `near`, where given, is a multiple of 64 that may be the one."""
    kind = df.schema[key].dataType
    whole = F.lit(64).cast(kind)
    far = df.withColumn("far", F.try_subtract(F.col(key), F.col("near")))
    step = far.withColumn("step", F.when(F.col("far").between(F.lit(0).cast(kind), F.lit(127).cast(kind)), F.col("far").cast("int")))
    at = step.withColumn("at", F.when(F.col("step").isNotNull(), F.col("step") % 64).otherwise(F.pmod(key, whole).cast("int")))
    block = F.when(F.col("step") < 64, F.col("near")).when(F.col("step") >= 64, F.col("near") + whole).otherwise(F.col(key) - F.col("at").cast(kind))
    return at.select("new", block.cast(kind).alias("block"), "at")


def inflated_keys_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """After both inflations: rows, distinct keys, unchanged source rows, payments that meet a rental of their customer.

    Keys are counted exactly, as bits of 64 neighbours each: copies of a row have keys in a row, so they are one or two
    groups before the exchange. Rentals beyond the keys that payments name are left out of the meeting.

    Payments' keys are wide decimals, whose remainder takes ten times as long as their difference. So a block near a
    row's copies is found once, before there are copies, and a key within it or the next one needs its distance only; any
    other key is divided as it is. The facts are written once, as both counts and the meeting read them.
    """
    paid = sinks.stored(t.payment.select("payment_id", "customer_id", "rental_id", "payment_date"))
    t = t.replacing(payment=paid, rental=sinks.stored(t.rental))
    tasks = inflate.task_count(t.payment)
    first = keys.first_copied_key(t.payment, "payment_id", (1 << len(inflate.STEP_YEARS)) - 1)
    near = t.payment.repartition(tasks, "payment_id").withColumn("near", first)
    payment = inflate.inflate_payment(near.withColumn("near", F.col("near") - F.pmod("near", F.lit(64).cast(near.schema["near"].dataType))))
    rental = inflate.inflate_rental(t.rental)

    def keys_of(grown: DataFrame, source: DataFrame, key: str) -> DataFrame:
        kind = source.schema[key].dataType
        hint = "near" if "near" in grown.columns else F.lit(None).cast(kind).alias("near")
        both = grown.select(key, hint, F.lit(True).alias("new")).unionByName(source.select(key, F.lit(None).cast(kind).alias("near"), F.lit(False).alias("new")))
        bits = _in_blocks(both, key).withColumn("bit", F.expr("shiftleft(1L, at)"))
        blocks = bits.groupBy("block").agg(
            F.count_if("new").alias("n"),
            F.coalesce(F.bit_or(F.when(F.col("new"), F.col("bit"))), F.lit(0)).alias("found"),
            F.coalesce(F.bit_or(F.when(~F.col("new"), F.col("bit"))), F.lit(0)).alias("given"))
        return blocks.agg(
            F.lit(key).alias("key_name"), F.sum("n").alias("n_rows"), F.sum(F.bit_count("found").cast("long")).alias("n_keys"),
            F.sum(F.bit_count(F.col("found").bitwiseAND(F.col("given"))).cast("long")).alias("n_source_keys"))

    named = t.payment.agg(F.min("rental_id").alias("lo"), F.max("rental_id").alias("hi"))
    inside = F.col("rental_id").between(named.select("lo").scalar(), named.select("hi").scalar())
    meeting = payment.join(rental.select("rental_id", "customer_id").where(inside), ["rental_id", "customer_id"])
    met = meeting.agg(
        F.lit("payment meets rental").alias("key_name"), F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("payment_id").alias("n_keys"), F.lit(None).cast("long").alias("n_source_keys"))
    return keys_of(payment, t.payment, "payment_id").union(keys_of(rental, t.rental, "rental_id")).union(met)


def _per_day(t: RentalTables) -> int:
    """As many rentals over 30 days as there are inventory copies; a tenth as many customers as rentals a day."""
    return t.inventory.count() // 30 + 1


def seed_customer_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    new = seed.seed_customers(t, spark, _per_day(t) // 10 + 1, "s1", AS_OF)
    return new["customer"].join(new["address"].select("address_id", "address", "phone"), "address_id")


def seed_synthetic_data_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    per_day = _per_day(t)
    new = seed.seed_synthetic_data(t, spark, per_day // 10 + 1, 30, per_day, "s1", AS_OF)
    return new["rental"].join(new["payment"].select("rental_id", "payment_id", "amount", "payment_date"), "rental_id")


def populate_extended_tables_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Write the three derived tables, read them back, report rows and totals."""
    folder = sinks.shared_dir(spark)
    stored = {
        name: spark.read.parquet(sinks.overwrite_full(df, f"{folder}/{name}"))
        for name, df in refresh.populate_extended_tables(t, FIRST_DAY, LAST_DAY, AS_OF).items()
    }
    measures = {"customer_kpis": F.col("total_spent"), "inventory_status": F.col("total_rentals"), "sales_rollup_daily": F.col("total_sales")}
    return reduce(
        DataFrame.unionByName,
        [
            stored[name].agg(
                F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum(m).cast("double").alias("total")
            )
            for name, m in measures.items()
        ],
    )


def cleanup_recent_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Payments left after a clean-up, with the rental they still belong to."""
    return refresh.cleanup_recent(t, 365, AS_OF).payment.select("payment_id", "rental_id", "amount")


def cleanup_recent_rentals(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return refresh.cleanup_recent(t, 365, AS_OF).rental.select("rental_id", "inventory_id", "customer_id", "rental_date")


def cleanup_recent_status(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return refresh.cleanup_recent(t, 365, AS_OF).inventory_status.drop("last_update")


def cleanup_recent_rollup(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    full = t.replacing(sales_rollup_daily=refresh.refresh_sales_rollup(t, FIRST_DAY, LAST_DAY, AS_OF))
    return refresh.cleanup_recent(full, 365, AS_OF).sales_rollup_daily.drop("last_update")


def cleanup_recent_kpis(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    left = refresh.cleanup_recent(t, 365, AS_OF)
    return left.customer_kpis.drop("last_update")


def fold_kpi_window_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    kpis = t.replacing(customer_kpis=refresh.refresh_customer_kpis(t, "1995-01-01 00:00:00"))
    return refresh.fold_kpi_window(kpis, 500, 365, AS_OF)


def table_counts_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return workload.table_counts(t)


def sql_query(text: str) -> Callable[[SparkSession, str, RentalTables], DataFrame]:
    """A statement over the SQL surface: the functions over whole tables."""

    def run(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
        sql_api.install(spark, t)
        return spark.sql(text)

    return run


def stamp_tables_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Every stamped table after a change to one row in ten: how many rows carry the new stamp."""
    present = [name for name in schemas.STAMPED_TABLES if name in t.names()]
    stamped = {name: t[name].withColumn("last_update", F.lit("1995-01-01 00:00:00").cast("timestamp")) for name in present}
    before = t.replacing(**stamped)

    def changed(name: str) -> DataFrame:
        key = schemas.PRIMARY_KEYS[name][0]
        text = next((f.name for f in t[name].schema.fields if isinstance(f.dataType, T.StringType)), None)
        if text is None:
            return before[name]
        return before[name].withColumn(text, F.when(F.col(key) % 10 == 0, F.lit("changed")).otherwise(F.col(text)))

    after = changes.stamp_tables(before, t.replacing(**{name: changed(name) for name in present}), AS_OF)
    parts = [
        after[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("last_update") == F.lit(AS_OF).cast("timestamp")).alias("n_stamped"))
        for name in present
    ]
    return reduce(DataFrame.unionByName, parts)


# --- upkeep by changes -----------------------------------------------------------------------


def balances_at_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Every rental's balance of its customer at its own date."""
    return finance.balances_at(t, t.rental.select("customer_id", F.col("rental_date").alias("as_of")))


NEW_RENTAL, NEW_PAYMENT = 5_000_000_000, "1000000000000000000000000000000"


def changed_facts(t: RentalTables) -> RentalTables:
    """The tables after many kinds of changes: rentals deleted, returned, given to another customer, moved to one
    copy, added; payments raised, deleted, cut off from deleted rentals, added for the new rentals."""
    k = F.col("rental_id")
    later = lambda c: F.col(c) + F.expr("interval '10' day")
    last_copy = t.inventory.agg(F.max("inventory_id")).scalar()
    rental = t.rental.where(k % 11 != 0)
    rental = rental.withColumn("return_date", F.when((k % 7 == 1) & F.col("return_date").isNull(), F.col("rental_date") + F.expr("interval '3' day")).otherwise(F.col("return_date")))
    rental = rental.withColumn("customer_id", F.when(k % 13 == 2, F.greatest(F.col("customer_id") - 1, F.lit(1))).otherwise(F.col("customer_id")))
    rental = rental.withColumn("inventory_id", F.when(k % 13 == 5, last_copy).otherwise(F.col("inventory_id")))
    more = t.rental.where(k % 17 == 3).withColumn("rental_id", k + NEW_RENTAL).withColumn("rental_date", later("rental_date")).withColumn("return_date", F.lit(None).cast("timestamp_ntz"))
    day = F.dayofmonth("payment_date")
    payment = t.payment.where(day != 9).withColumn("rental_id", F.when(k % 11 != 0, k))
    payment = payment.withColumn("amount", F.when(day == 5, F.col("amount") + 1).otherwise(F.col("amount")).cast(t.payment.schema["amount"].dataType))
    paid = t.payment.where(k % 17 == 3).withColumn("payment_id", (F.col("payment_id") + F.lit(NEW_PAYMENT).cast("decimal(38,0)")).cast("decimal(38,0)"))
    paid = paid.withColumn("rental_id", k + NEW_RENTAL).withColumn("payment_date", later("payment_date"))
    return t.replacing(rental=rental.unionByName(more), payment=payment.unionByName(paid))


def _stored_facts(t: RentalTables, *names: str) -> RentalTables:
    """The facts written once: the versions before and after, their logs and the indicators all read them."""
    return t.replacing(**{n: sinks.stored(t[n]) for n in names})


def _log(t: RentalTables, after: RentalTables, name: str) -> DataFrame:
    """The change log, a stored table: several parts of the upkeep read it."""
    return sinks.stored(changes.audit_changes(t[name], after[name], f"{name}_id", AS_OF, microseconds=True))


def _logs(t: RentalTables, after: RentalTables) -> tuple[DataFrame, DataFrame]:
    return _log(t, after, "rental"), _log(t, after, "payment")


def upkeep_kpis_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Customer indicators kept up by the changes of `changed_facts`; equal to a full refresh."""
    t = _stored_facts(t, "rental", "payment")
    after = changed_facts(t)
    stored = refresh.refresh_customer_kpis(t)
    changed = upkeep.changed_kpis(stored, after, *_logs(t, after))
    return upkeep.merged(stored, changed, "customer_id").drop("last_update")


def upkeep_status_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    t = _stored_facts(t, "rental")
    after = changed_facts(t)
    changed = upkeep.changed_status(after, _log(t, after, "rental"))
    return upkeep.merged(refresh.refresh_inventory_status(t), changed, "inventory_id").drop("last_update")


def upkeep_rollup_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    t = _stored_facts(t, "rental", "payment")
    after = changed_facts(t)
    stored = sinks.stored(refresh.refresh_sales_rollup(t, FIRST_DAY, LAST_DAY))  # compared with the changes, and merged
    changed = upkeep.changed_rollup(stored, after, *_logs(t, after), FIRST_DAY, LAST_DAY)
    return upkeep.merged(stored, changed, ["sales_date", "store_id", "category_id"]).drop("last_update")


def log_read_back_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Payments before and after the changes, each rebuilt from the other one and the change log."""
    t = _stored_facts(t, "payment")
    after = changed_facts(t)
    log = _log(t, after, "payment")
    there = changes.replay(t.payment, log, "payment_id").withColumn("version", F.lit("after"))
    back = changes.rewind(after.payment, log, "payment_id").withColumn("version", F.lit("before"))
    return there.unionByName(back).select("version", "payment_id", "customer_id", "staff_id", "rental_id", "amount", "payment_date")


def delete_cascading_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Rows left in each table after some staff went, and payments that lost their rental."""
    left = cascade.delete_cascading(t, "staff", F.col("staff_id") % 4 == 3)
    names = ("staff", "store", "customer", "inventory", "rental", "address", "film", "film_actor")
    parts = [left[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in names]
    # both counts of payments come from one pass over them
    paid = left.payment.agg(F.count(F.lit(1)).alias("payment"), F.count_if(F.col("rental_id").isNull()).alias("payment without rental"))
    return reduce(DataFrame.unionByName, [*parts, paid.unpivot([], list(paid.columns), "table_name", "n")])


def orphans_after_delete(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Foreign-key report after deleting stores and all that refers to them."""
    return checks.foreign_key_report(cascade.delete_cascading(t, "store", F.col("store_id") % 3 == 1))


PHRASE = "of the"


def phrase_search_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    path = sinks.shared_dir(spark)
    search.write_term_index(text_index.positional_postings(t.film_text), path)
    return text_index.find_phrase(spark.read.parquet(path), PHRASE)


def segmented_search_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Ranking over an index with one segment of changes on top; equal to the ranking over the changed films."""
    path = sinks.shared_dir(spark)
    text_index.create_index(t.film.select("film_id", "title", "description"), path)
    text_index.apply_changes(film_changes(t), path, 1)
    return text_index.search_index(spark, path, FILM_SEARCH).select("film_id", F.round("score", 6).alias("score"))


def merged_search_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """The same after two segments and a merge; the second segment deletes what the first one renamed."""
    path, target = sinks.shared_dir(spark), sinks.shared_dir(spark)
    text_index.create_index(t.film.select("film_id", "title", "description"), path)
    first = film_changes(t)
    text_index.apply_changes(first, path, 1)
    gone = first.where("op = 'update' and new_title like 'NEW %'").withColumn("op", F.lit("delete"))
    text_index.apply_changes(gone.withColumn("old_film_id", F.col("new_film_id")), path, 2)
    text_index.merge_segments(spark, path, target)
    return text_index.search_index(spark, target, FILM_SEARCH).select("film_id", F.round("score", 6).alias("score"))


def distinct_over_months(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Distinct rentals and customers over 31 months, from a stored rollup of monthly sets."""
    path = sinks.shared_dir(spark)
    distinct.distinct_rollup(t, FIRST_DAY, LAST_DAY).write.partitionBy("sales_month").parquet(path)
    return distinct.distinct_counts(spark.read.parquet(path), "1996-03-01", "1998-09-01")


def distinct_by_store(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    return distinct.distinct_counts(distinct.distinct_rollup(t, FIRST_DAY, LAST_DAY), "1995-01-01", "2001-12-01", ["store_id"])


def _spelt(key: str, text: str) -> Column:
    """A text in one of three spellings that count as equal."""
    return F.when(F.col(key) % 3 == 0, F.upper(text)).when(F.col(key) % 3 == 1, F.concat(F.lower(text), F.lit("  "))).otherwise(F.col(text))


def group_by_text_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    people = t.customer.select("customer_id", _spelt("customer_id", "first_name").alias("first_name"), "store_id")
    return collation.group_by_text(people, ["first_name"], F.count(F.lit(1)).alias("n"), F.sum("customer_id").alias("ids"))


def join_by_text_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Films met by the spelling of their titles that another film of the same title has."""
    a = t.film.select("film_id", _spelt("film_id", "title").alias("title"))
    b = t.film.groupBy(F.upper("title").alias("title")).agg(F.min("film_id").alias("first_film"))
    return collation.join_by_text(a, b, ["title"])


def sync_film_text_collated(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Changes of case and trailing blanks alone are none."""
    changed = film_changes(t).withColumn("new_title", _spelt("old_film_id", "new_title"))
    return changes.sync_film_text(t.film.select("film_id", "title", "description"), changed, collation=collation.IGNORE_CASE_AND_BLANKS)


#: Events of one file and files of one batch: what a batch and each of its tasks hold does not grow with the table.
EVENTS_PER_FILE, FILES_PER_BATCH = 2_000_000, 8


def streamed_status_query(spark: SparkSession, sf: str, t: RentalTables) -> DataFrame:
    """Stock after all rentals and returns arrived as a stream of files, several batches."""
    base = sinks.shared_dir(spark)
    events = status.rental_events(t.rental).repartition(2 * FILES_PER_BATCH, "rental_id")
    events.write.option("maxRecordsPerFile", EVENTS_PER_FILE).parquet(f"{base}/events")
    stream = spark.readStream.schema(status.EVENTS).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/events")
    status.keep_status(stream, f"{base}/status", f"{base}/checkpoint").awaitTermination()
    return status.read_status(spark, f"{base}/status", t)


Query = Callable[[SparkSession, str, RentalTables], DataFrame]


def _of(fn: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf, t: fn(t, *args, **kwargs)


REGISTRY: dict[str, Query] = {
    "load_table": load_table_query,
    "load_tables": load_tables_query,
    "write_payments_by_month": write_payments_by_month_query,
    "overwrite_full": overwrite_full_query,
    "overwrite_range": overwrite_range_query,
    "append_with_keys": append_with_keys_query,
    "update_join": update_join_query,
    "update_join_repeated": update_join_repeated_query,
    "delete_where": delete_where_query,
    "text_functions": text_functions,
    "date_functions": date_functions,
    "group_concat": group_concat_query,
    "customer_list": _of(views.customer_list),
    "film_list": _of(views.film_list),
    "nicer_but_slower_film_list": _of(views.nicer_but_slower_film_list),
    "staff_list": _of(views.staff_list),
    "sales_by_store": _of(views.sales_by_store),
    "sales_by_film_category": _of(views.sales_by_film_category),
    "actor_info": _of(views.actor_info),
    "financial_performance": lambda spark, sf, t: analytics.financial_performance(t).withColumn(
        "payment_volatility", F.round("payment_volatility", 4)
    ),
    "performance_of_stored_facts": lambda spark, sf, t: analytics.financial_performance(colocated.store_facts(t, 16)).withColumn(
        "payment_volatility", F.round("payment_volatility", 4)
    ),
    "customer_profile": _of(analytics.customer_profile),
    "customer_activity_top": _of(analytics.customer_activity_top),
    "fulltext_search": _of(workload.fulltext_search, SEARCH_TEXT),
    "search_top_by_rate": _of(workload.search_top_by_rate, MATCH_TEXT),
    "bulk_price_update": lambda spark, sf, t: workload.bulk_price_update(t, 1, 100, AS_OF).select(
        "payment_id", "customer_id", "amount", "last_update"
    ),
    "bump_latest_payments": lambda spark, sf, t: workload.bump_latest_payments(t, 10, "0.01", 5).select(
        "payment_id", "amount"
    ),
    "inventory_held_by_customer": _of(stock.inventory_held_by_customer),
    "inventory_in_stock": _of(stock.inventory_in_stock),
    "film_in_stock": _of(stock.film_in_stock),
    "film_not_in_stock": _of(stock.film_not_in_stock),
    "film_stock_counts": _of(stock.film_stock_counts),
    "customer_balance": _of(finance.customer_balance, "2000-06-30 00:00:00"),
    "customer_balance_with_replacement": _of(finance.customer_balance, "2000-06-30 00:00:00", charge_replacement=True),
    "rewards_report": _of(finance.rewards_report, 1, "50000.00", "2000-03-15"),
    "count_rewardees": lambda spark, sf, t: finance.count_rewardees(
        finance.rewards_report(t, 1, "50000.00", "2000-03-15", months_back=3)
    ),
    "refresh_sales_rollup": lambda spark, sf, t: refresh.refresh_sales_rollup(t, FIRST_DAY, LAST_DAY, AS_OF),
    "refresh_customer_kpis": _of(refresh.refresh_customer_kpis, AS_OF),
    "refresh_inventory_status": _of(refresh.refresh_inventory_status, AS_OF),
    "populate_extended_tables": populate_extended_tables_query,
    "recompute_balances": lambda spark, sf, t: refresh.recompute_balances(
        refresh.refresh_customer_kpis(t, AS_OF).withColumn("balance_cached", F.lit(0).cast("decimal(18,2)"))
    ),
    "cleanup_recent": cleanup_recent_query,
    "cleanup_recent_rentals": cleanup_recent_rentals,
    "cleanup_recent_status": cleanup_recent_status,
    "cleanup_recent_rollup": cleanup_recent_rollup,
    "cleanup_recent_kpis": cleanup_recent_kpis,
    "fold_kpi_window": fold_kpi_window_query,
    "inflate_rental": inflate_rental_query,
    "inflate_payment": inflate_payment_query,
    "inflated_keys": inflated_keys_query,
    "table_counts": table_counts_query,
    "sql_stock": sql_query(
        "select inventory_id, inventory_in_stock(inventory_id) in_stock, inventory_held_by_customer(inventory_id) customer_id from inventory"
    ),
    "sql_balance": sql_query(
        "select customer_id, coalesce(b.balance, 0) balance "
        "from customer left join customer_balances(timestamp_ntz'2000-06-30 00:00:00') b using (customer_id)"
    ),
    "sql_film_in_stock": sql_query(
        "select k.film_id, k.store_id, i.inventory_id from (select distinct film_id, store_id from inventory) k, lateral film_in_stock(k.film_id, k.store_id) i"
    ),
    "sql_film_not_in_stock": sql_query(
        "select k.film_id, k.store_id, i.inventory_id from (select distinct film_id, store_id from inventory) k, lateral film_not_in_stock(k.film_id, k.store_id) i"
    ),
    "sql_rewards": sql_query("select * from rewards_report(1, 50000.00, date'2000-03-15')"),
    "sql_rewards_months": sql_query("select * from rewards_report(1, 50000.00, date'2000-03-15', 3)"),
    "seed_customers": seed_customer_query,
    "seed_synthetic_data": seed_synthetic_data_query,
    "sync_film_text": sync_film_text_query(False),
    "sync_film_text_null_safe": sync_film_text_query(True),
    "stamp_last_update": stamp_last_update_query,
    "stamp_tables": stamp_tables_query,
    "audit_changes": audit_changes_query,
    "audit_bridge": audit_bridge_query,
    "build_term_vectors": term_vectors,
    "build_term_index": term_index,
    "indexed_search": indexed_search,
    "balances_at": balances_at_query,
    "upkeep_kpis": upkeep_kpis_query,
    "upkeep_status": upkeep_status_query,
    "upkeep_rollup": upkeep_rollup_query,
    "log_read_back": log_read_back_query,
    "delete_cascading": delete_cascading_query,
    "orphans_after_delete": orphans_after_delete,
    "phrase_search": phrase_search_query,
    "segmented_search": segmented_search_query,
    "merged_search": merged_search_query,
    "distinct_over_months": distinct_over_months,
    "distinct_by_store": distinct_by_store,
    "group_by_text": group_by_text_query,
    "join_by_text": join_by_text_query,
    "sync_film_text_collated": sync_film_text_collated,
    "streamed_status": streamed_status_query,
    "check_unique": check_unique_query,
    "check_unique_report": lambda spark, sf, t: checks.unique_report(_for_report(t)),
    "check_foreign_key": lambda spark, sf, t: checks.foreign_key_report(_for_report(t)),
    "check_domain": check_domain_query,
    "check_not_null": check_not_null_query,
    "check_required": lambda spark, sf, t: checks.not_null_report(_with_rollup(t)),
}


def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(query(spark, sf_dir, roles.role_tables(spark, sf_dir)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(q) for name, q in REGISTRY.items()}
