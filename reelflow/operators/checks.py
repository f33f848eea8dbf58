"""Table checks: unique keys, foreign keys, value domains, required columns.

Each check returns the violations as rows, and `*_report` variants count them for every declared
constraint of the star schema. Keys are counted before they are joined, so a key that holds a
large share of the rows reaches the join as one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.sources import schemas
from reelflow.sources.tables import RentalTables


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count; rows with a NULL key are exempt."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child key values without a parent row, with the number of child rows."""
    used = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_column).alias(column))
    return used.join(known, column, "left_anti")


def check_domain(df: DataFrame, column: str, allowed: Sequence | None = None, between: tuple | None = None) -> DataFrame:
    """Values outside an enumeration or a closed range, with their count; NULL passes."""
    c = F.col(column)
    inside = c.isin(list(allowed)) if allowed is not None else c.between(*between)
    return df.filter(~inside).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per required column with its number of NULLs, counted in one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns]))
    return counted.select(pairs.alias("p")).select("p.column_name", "p.n_null")


def _missing(tables: RentalTables, needed: Sequence[tuple[str, Sequence[str]]]) -> bool:
    known = set(tables.names())
    return any(t not in known or not set(columns) <= set(tables[t].columns) for t, columns in needed)


def _tallied(spark: SparkSession, constraints: list[dict], per_key: Sequence[DataFrame]) -> DataFrame:
    """One row for each constraint, from the broken keys (number, n) of the checked ones.

    A constraint whose table or column is not there is not left out: it has `checked` false and no counts.
    """
    names = [c for c in constraints[0] if c != "checked"]
    given = spark.createDataFrame([(k, *c.values()) for k, c in enumerate(constraints)], ["number", *constraints[0]])
    broken = reduce(DataFrame.unionByName, per_key, spark.createDataFrame([], "number int, n long"))
    tally = broken.groupBy("number").agg(F.count(F.lit(1)).alias("bad_keys"), F.sum("n").cast("long").alias("bad_rows"))
    zero = lambda c: F.when(F.col("checked"), F.coalesce(c, F.lit(0))).alias(c)
    return given.join(tally, "number", "left").select(*names, "checked", zero("bad_keys"), zero("bad_rows"))


def unique_report(tables: RentalTables) -> DataFrame:
    """Violations of every declared primary and unique key.

    Rows are counted by the key columns themselves: those of a table that its keys already place are not exchanged
    again, and none is written as text. A table with several keys is read once for each of them.
    """
    wanted = [(t, k) for t, k in schemas.PRIMARY_KEYS.items()]
    wanted += [(t, k) for t, keys in schemas.UNIQUE_KEYS.items() for k in keys]
    constraints, per_key = [], []
    for number, (table, keys) in enumerate(wanted):
        checked = not _missing(tables, [(table, keys)])
        constraints.append({"table_name": table, "constraint_columns": ",".join(keys), "checked": checked})
        if checked:
            per_key.append(check_unique(tables[table], keys).select(F.lit(number).alias("number"), "n"))
    return _tallied(tables[tables.names()[0]].sparkSession, constraints, per_key)


def foreign_key_report(tables: RentalTables) -> DataFrame:
    """Violations of every declared foreign key, from one scan of each table.

    Constraints whose keys are of one type meet in one exchange, in that type; only where the two sides of one differ, its
    keys are compared as text. Keys are counted before the exchange.
    """
    constraints, entries = [], {}
    for number, (child, column, parent, parent_column) in enumerate(schemas.FOREIGN_KEYS):
        checked = not _missing(tables, [(child, [column]), (parent, [parent_column])])
        constraints.append({"table_name": child, "constraint_columns": column, "parent_table": parent, "checked": checked})
        if checked:
            kinds = {tables[t].schema[c].dataType.simpleString() for t, c in ((child, column), (parent, parent_column))}
            kind = kinds.pop() if len(kinds) == 1 else "string"
            for t, c, is_child in ((child, column, True), (parent, parent_column, False)):
                entry = F.struct(F.lit(number).alias("number"), F.col(c).cast(kind).alias("key"), F.lit(is_child).alias("is_child"))
                entries.setdefault(kind, {}).setdefault(t, []).append(entry)
    per_key = []
    for own in entries.values():
        parts = [tables[t].select(F.explode(F.array(*e)).alias("e")).select("e.*") for t, e in own.items()]
        met = reduce(DataFrame.unionByName, parts).where("key is not null").groupBy("number", "key")
        met = met.agg(F.count_if("is_child").alias("n"), F.max(~F.col("is_child")).alias("known"))
        per_key.append(met.where("n > 0 and not known").select("number", "n"))
    return _tallied(tables[tables.names()[0]].sparkSession, constraints, per_key)


def domain_report(tables: RentalTables) -> DataFrame:
    """Values outside every declared domain: (table_name, column_name, checked, value, n).

    A domain whose table or column is not there has one row with `checked` false and no value.
    """
    parts, absent = [], []
    for t, c, allowed, between in schemas.DOMAINS:
        if _missing(tables, [(t, [c])]):
            absent.append((t, c, False, None, None))
            continue
        bad = check_domain(tables[t], c, allowed, between)
        parts.append(bad.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(True).alias("checked"), F.col(c).cast("string").alias("value"), "n"))
    if absent:
        spark = tables[tables.names()[0]].sparkSession
        parts.append(spark.createDataFrame(absent, "table_name string, column_name string, checked boolean, value string, n long"))
    return reduce(DataFrame.unionByName, parts)


def not_null_report(tables: RentalTables, required_only: bool = True) -> DataFrame:
    """NULLs per column of every table, one pass each: (table_name, column_name, n_null).

    With `required_only` every declared NOT NULL column of every declared table has a row; `n_null`
    is NULL where the table or column is not there. Otherwise the columns that are there.
    """
    parts, absent = [], []
    for name in schemas.DDL if required_only else tables.names():
        present = tables[name].columns if name in tables.names() else []
        wanted = schemas.required_columns(name) if required_only else present
        absent += [(name, c) for c in wanted if c not in present]
        columns = [c for c in wanted if c in present]
        if columns:
            counted = check_not_null(tables[name], columns)
            parts.append(counted.select(F.lit(name).alias("table_name"), "column_name", "n_null"))
    if absent:
        spark = parts[0].sparkSession
        parts.append(spark.createDataFrame([(*a, None) for a in absent], "table_name string, column_name string, n_null long"))
    return reduce(DataFrame.unionByName, parts)
