"""Rentals and payments stored so that they meet without an exchange.

Both are bucketed on (rental_id, slice), so the join of the two and the sums of payments for each rental read their
buckets where they are. A rental that holds more than `slice_rows` payments is cut into slices of about that size: its
payments are dealt over the slices, its own row is stored once for each, and the slices lie in different buckets, so a hot
rental is read by several tasks. `leads` marks one payment of each rental, the one with the smallest id, so that
rentals can be counted although they have several rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.operators.keys import fresh_join
from reelflow.sources.sinks import shared_dir, stored
from reelflow.sources.tables import RentalTables

#: Payments of one rental that stay together.
SLICE_ROWS = 1_000_000


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    # one task for each bucket, so that a bucket is one file; rows of a bucket are in order
    placed = df.repartition(buckets, "rental_id", "slice")
    writer = placed.write.format("parquet").bucketBy(buckets, "rental_id", "slice").sortBy("rental_id", "slice")
    writer.option("path", shared_dir(spark)).saveAsTable(table)
    return spark.table(table)


def store_facts(t: RentalTables, buckets: int, slice_rows: int = SLICE_ROWS) -> RentalTables:
    """The tables with payments and rentals replaced by bucketed ones, which have a column `slice`, payments also `leads`.

    Payments without a rental are left out; they meet none. Reports that join the two on `rental_id` must use `slice` as
    well, as `financial_performance` does where it is there.
    """
    paid = stored(t.payment.where(F.col("rental_id").isNotNull()))  # numbered once; counted and dealt from there
    sizes = paid.groupBy("rental_id").agg(F.count(F.lit(1)).alias("n"), F.min("payment_id").alias("first"))
    sizes = sizes.select("rental_id", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"), "first")
    hot = sizes.where(F.col("slices") > 1).select("rental_id", "slices")
    own = F.coalesce("slices", F.lit(1))
    # one join gives both the slices and the leading payment: payments are not exchanged by their wide id
    payments = fresh_join(paid, sizes, "rental_id").withColumn("slice", F.pmod(F.xxhash64("payment_id"), own).cast("int"))
    payments = payments.withColumn("leads", F.col("payment_id") == F.col("first"))
    rentals = t.rental.join(hot, "rental_id", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), own - 1)))
    return t.replacing(
        payment=_bucketed(payments.select(*t.payment.columns, "slice", "leads"), "payment", buckets),
        rental=_bucketed(rentals.select(*t.rental.columns, "slice"), "rental", buckets),
    )
