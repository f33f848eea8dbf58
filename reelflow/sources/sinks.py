"""Sinks: month-partitioned payments, full and range overwrite.

A parquet folder is never overwritten while it is read. A full overwrite goes to a new version
folder whose path is returned; a range overwrite replaces whole month folders of a target that
the new rows do not depend on.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.functions.scalars import as_date, month_start, within_days


MONTH_FOLDER = "month"

#: Spark's setting that frees the files of a statement's exchanges at its end.
FREE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared `spark.checkpoint.dir`.

    A session of one machine may leave it unset; its warehouse holds the folder then. On a cluster an
    unset folder is an error, as the warehouse may be one of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to a shared folder and read from there, so that several uses do not compute it again.

    Files of its exchanges are freed when it is written, as nothing reads them again; else they stay on the
    executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(FREE_EXCHANGES, None)
    spark.conf.set(FREE_EXCHANGES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_EXCHANGES) if before is None else spark.conf.set(FREE_EXCHANGES, before)
    return spark.read.schema(df.schema).parquet(path)


def write_payments_by_month(
    payment: DataFrame, path: str, first_month: date | str | None = None, last_month: date | str | None = None
) -> None:
    """Write payments partitioned by `payment_month`.

    With month bounds, rows outside them go to the default partition (NULL month). The rebalance
    hint lets adaptive execution split a month that holds much of the data into several
    files and join small months into one task.
    """
    month = month_start("payment_date")
    if first_month is not None:
        inside = F.col("payment_date") >= F.lit(as_date(first_month)).cast("timestamp_ntz")
        month = F.when(inside, month)
    if last_month is not None:
        month = F.when(F.trunc("payment_date", "MM") <= F.lit(as_date(last_month)), month)
    routed = payment.withColumn("payment_month", month)
    routed.hint("rebalance", F.col("payment_month")).write.mode("overwrite").partitionBy("payment_month").parquet(path)


def read_payments(spark: SparkSession, path: str, first: date | str, last: date | str) -> DataFrame:
    """Payments of `first..last`, both inclusive; only their months and the default partition are read."""
    lo, hi = as_date(first).replace(day=1), as_date(last).replace(day=1)
    stored = spark.read.parquet(path)
    month = F.col("payment_month")
    wanted = month.isNull() | month.between(F.lit(lo), F.lit(hi))
    return stored.filter(wanted & within_days("payment_date", first, last))


def overwrite_full(df: DataFrame, path: str) -> str:
    """Write `df` as a new version under `path` and return the version's folder."""
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.mode("error").parquet(version)
    return version


def overwrite_range(
    target: str,
    new_rows: DataFrame,
    first: date | str,
    last: date | str,
    column: str = "sales_date",
    tasks: int | None = None,
) -> None:
    """Replace `column BETWEEN first AND last` of a stored daily table by `new_rows`.

    The table is stored in month folders. The months of the range are replaced by dynamic partition
    overwrite; the days of the first and last one that lie outside the range are carried over. Months outside
    are not touched. `new_rows` must not read from `target` and must lie inside the range.

    By default adaptive execution sizes the write tasks by bytes and splits a month that holds much
    of the data; `tasks` fixes their number instead.
    """
    lo, hi = as_date(first), as_date(last)
    inside = F.col(column).between(F.lit(lo), F.lit(hi))
    months = {m for m in _stored_months(new_rows.sparkSession, target) if lo.replace(day=1) <= m <= hi}
    _replace_days(target, new_rows, inside, column, months, {lo.replace(day=1), hi.replace(day=1)}, tasks)


def overwrite_days(target: str, new_rows: DataFrame, days: Collection[date], column: str = "sales_date", tasks: int | None = None) -> None:
    """Replace single days, as `overwrite_range` does for a range, in one write whatever their number."""
    if days:
        inside = F.col(column).isin(sorted(days))
        months = {d.replace(day=1) for d in days} & set(_stored_months(new_rows.sparkSession, target))
        _replace_days(target, new_rows, inside, column, months, months, tasks)


def _replace_days(target: str, new_rows: DataFrame, inside: Column, column: str, stored: set[date], mixed: set[date], tasks: int | None) -> None:
    """Replace the days `inside` holds for, which lie in the `stored` months and new ones; only `mixed` months hold other days as well."""
    spark = new_rows.sparkSession
    outside = F.raise_error(F.lit("row outside the overwritten range")).cast("boolean")
    rows = new_rows.filter(F.when(inside, F.lit(True)).otherwise(outside))
    mixed = mixed & stored
    if mixed:
        # a copy of its own, since the folders it is read from are about to be replaced
        carried = spark.read.parquet(target).filter(F.col(MONTH_FOLDER).isin(sorted(mixed)) & ~F.coalesce(inside, F.lit(False)))
        copy = shared_dir(spark)
        carried.select(*new_rows.columns).write.parquet(copy)
        rows = rows.unionByName(spark.read.schema(new_rows.schema).parquet(copy))
    rows = rows.withColumn(MONTH_FOLDER, month_start(column))
    before = {m: _files(spark, target, m) for m in stored}
    spread = rows.hint("rebalance", F.col(MONTH_FOLDER)) if tasks is None else rows.repartition(tasks, MONTH_FOLDER)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_FOLDER).parquet(target)
    fs, path = _hadoop(spark, target)
    for month, files in before.items():
        if _files(spark, target, month) == files:  # a dynamic overwrite leaves months without rows behind
            fs.delete(path(_month_folder(target, month)), True)


def read_daily(spark: SparkSession, target: str, first: date | str, last: date | str, column: str = "sales_date") -> DataFrame:
    """Rows of `first..last` of a stored daily table; only the folders of their months are read."""
    lo, hi = as_date(first), as_date(last)
    months = F.col(MONTH_FOLDER).between(F.lit(lo.replace(day=1)), F.lit(hi))
    days = F.col(column).between(F.lit(lo), F.lit(hi))
    return spark.read.parquet(target).filter(months & days).drop(MONTH_FOLDER)


def _hadoop(spark: SparkSession, target: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return path(target).getFileSystem(conf), path


def _month_folder(target: str, month: date) -> str:
    return f"{target.rstrip('/')}/{MONTH_FOLDER}={month.isoformat()}"


def _files(spark: SparkSession, target: str, month: date) -> set[str]:
    fs, path = _hadoop(spark, target)
    return {s.getPath().getName() for s in fs.listStatus(path(_month_folder(target, month)))}


def _stored_months(spark: SparkSession, target: str) -> list[date]:
    """Month folders present under `target`."""
    fs, path = _hadoop(spark, target)
    if not fs.exists(path(target)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(target))]
    prefix = f"{MONTH_FOLDER}="
    return [date.fromisoformat(n[len(prefix):]) for n in names if n.startswith(prefix)]
