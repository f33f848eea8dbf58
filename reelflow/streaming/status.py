"""Stock of every copy kept up from a stream of rentals and returns.

Spark keeps one small state for each copy: rentals, rentals still open, last rental. In update mode a batch gives
the new totals of the copies it touches; they are written as a folder of their own, named by the batch, so a batch that is
replayed writes the same folder again. The table is the newest row of each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelflow.sources.tables import RentalTables

#: One row for each event: a rental that begins, or one that ends; `at` is its time.
EVENTS = "kind string, rental_id long, inventory_id long, at timestamp_ntz"


def rental_events(rental: DataFrame) -> DataFrame:
    """Events of the rows of a rental table: one `rent`, and one `return` where there is a return date."""
    begun = rental.select(F.lit("rent").alias("kind"), "rental_id", "inventory_id", F.col("rental_date").alias("at"))
    ended = rental.where("return_date is not null").select(F.lit("return").alias("kind"), "rental_id", "inventory_id", F.col("return_date").alias("at"))
    return begun.unionByName(ended)


def copy_totals(events: DataFrame) -> DataFrame:
    """(inventory_id, total_rentals, n_open, last_rental); the same for a stream and for a table."""
    rented = F.col("kind") == "rent"
    return events.groupBy("inventory_id").agg(
        F.count_if(rented).alias("total_rentals"),
        F.sum(F.when(rented, 1).when(F.col("kind") == "return", -1).otherwise(0)).alias("n_open"),
        F.max(F.when(rented, F.col("at"))).alias("last_rental"),
    )


def keep_status(events: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the totals of all copies in `folder` from a stream of `EVENTS`; a restart goes on from `checkpoint`."""

    def react(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")

    trigger = {"availableNow": True} if once else {"processingTime": "1 minute"}
    writer = copy_totals(events).writeStream.outputMode("update").foreachBatch(react)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The newest totals of each copy."""
    rows = spark.read.parquet(folder)
    newest = F.max_by(F.struct("total_rentals", "n_open", "last_rental"), "batch")
    return rows.groupBy("inventory_id").agg(newest.alias("t")).select("inventory_id", "t.*")


def read_status(spark: SparkSession, folder: str, t: RentalTables) -> DataFrame:
    """`refresh_inventory_status` from the kept totals: every copy, those without a rental as well."""
    return t.inventory.select("inventory_id", "film_id", "store_id").join(read_totals(spark, folder), "inventory_id", "left").select(
        "inventory_id", "film_id", "store_id", (F.coalesce("n_open", F.lit(0)) == 0).alias("is_in_stock"),
        F.coalesce("total_rentals", F.lit(0)).cast("long").alias("total_rentals"), "last_rental")
