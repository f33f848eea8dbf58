"""Reactions to arriving rows, one micro-batch at a time.

Each reaction is a batch operator called from `foreachBatch`. They are idempotent per batch:
a batch that is replayed after a lost executor or driver overwrites its own output folder or day
partitions instead of adding to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelflow.operators.changes import sync_film_text
from reelflow.operators.text_index import apply_changes
from reelflow.plans.refresh import refresh_sales_rollup
from reelflow.sources.sinks import overwrite_days, write_payments_by_month
from reelflow.sources.tables import RentalTables

Reaction = Callable[[DataFrame, int], None]


def start(stream: DataFrame, reaction: Reaction, checkpoint: str, available_now: bool = True, **trigger) -> StreamingQuery:
    """Run a reaction on every micro-batch; by default once over what is available."""
    options = {"availableNow": True} if available_now else trigger
    return (
        stream.writeStream.foreachBatch(reaction)
        .option("checkpointLocation", checkpoint)
        .trigger(**options)
        .start()
    )


def store_payments(path: str) -> Reaction:
    """Route new payments to month folders, one sub-folder per batch."""

    def react(batch: DataFrame, batch_id: int) -> None:
        write_payments_by_month(batch, f"{path.rstrip('/')}/batch={batch_id}")

    return react


def keep_film_text(spark: SparkSession, folder: str, null_safe: bool = False) -> Reaction:
    """Apply film changes to the stored text copy `<folder>/<batch number>`.

    Batch n reads version n and writes version n + 1, so a replayed batch rewrites the same
    version from the same input. Version 0 must exist.
    """

    def react(batch: DataFrame, batch_id: int) -> None:
        current = spark.read.parquet(f"{folder.rstrip('/')}/{batch_id}")
        sync_film_text(current, batch, null_safe).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{batch_id + 1}")

    return react


def keep_text_index(path: str, null_safe: bool = False, **words) -> Reaction:
    """Apply film changes to a stored text index, one segment for each batch.

    Batch n writes segment n + 1 from its own rows alone; nothing stored is read or rewritten, and a replayed batch
    writes the same segment again. The index must have been created; `words` are its stopwords and shortest word.
    """

    def react(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, path, batch_id + 1, null_safe, **words)

    return react


def keep_sales_rollup(t: Callable[[], RentalTables], target: str) -> Reaction:
    """Recompute the days that a batch of payments touches, in the stored daily table.

    `t` gives the tables with all payments so far, the batch included. The days are those of the batch
    alone, so one late payment recomputes its own day, not the years since; all of them are one write.
    """

    def react(batch: DataFrame, batch_id: int) -> None:
        # at most one value per calendar day
        days = [r[0] for r in batch.select(F.to_date("payment_date").alias("day")).where("day is not null").distinct().collect()]
        if days:
            now = t()
            own = now.replacing(payment=now.payment.where(F.to_date("payment_date").isin(sorted(days))))
            overwrite_days(target, refresh_sales_rollup(own, min(days), max(days)), days)

    return react
