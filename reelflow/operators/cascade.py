"""Deleting rows together with everything that refers to them, over the whole graph of foreign keys.

The graph has a cycle (a store has a manager, who belongs to a store). Tables of one cycle are followed in rounds: each
round takes the rows that refer to the keys found in the round before, until a round finds none. All others come after
the tables they refer to and are looked at once, when all keys that go there are known. Only
keys of tables that others refer to are followed; bridges and facts at the end are reduced once. Keys found
are written to the shared folder, which cuts the lineage; no key reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.sources import schemas
from reelflow.sources.sinks import stored
from reelflow.sources.tables import RentalTables

#: Foreign keys (child, column) that become NULL when their parent goes; all others take the child row along.
SET_NULL = (("payment", "rental_id"), ("film", "original_language_id"))


def _edges(t: RentalTables) -> list[tuple[str, str, str, str]]:
    known = set(t.names())
    return [e for e in schemas.FOREIGN_KEYS if e[0] in known and e[2] in known and e[1] in t[e[0]].columns and e[3] in t[e[2]].columns]


def removed_keys(t: RentalTables, table: str, predicate: Column, set_null: Sequence[tuple[str, str]] = SET_NULL) -> dict[str, DataFrame]:
    """Keys that go, by table, if the rows of `table` that meet the predicate are deleted: one column `key` each.

    Tables that no foreign key refers to are not listed.
    """
    edges = _edges(t)
    taking = [e for e in edges if (e[0], e[1]) not in set_null]
    parents = {parent: column for _, _, parent, column in edges}
    if table not in parents:
        return {}
    start = stored(t[table].where(predicate).select(F.col(parents[table]).alias("key")).where("key is not null").distinct())
    gone: dict[str, DataFrame] = {}
    for cycle in _cycles([(child, parent) for child, _, parent, _ in taking if child in parents], table):
        found: dict[str, DataFrame] = {table: start} if table in cycle else {}
        for name in cycle:
            outer = [(column, gone[parent]) for child, column, parent, _ in taking if child == name and parent in gone and parent not in cycle]
            if outer:
                found[name] = _referring(t[name], parents[name], outer)
        while found:
            fresh = {}
            for name, new in found.items():
                if name in gone:
                    new = stored(new.join(gone[name], "key", "left_anti"))
                if new.limit(1).count():
                    gone[name] = gone[name].unionByName(new) if name in gone else new
                    fresh[name] = new
            found = {}
            for name in cycle:
                inner = [(column, fresh[parent]) for child, column, parent, _ in taking if child == name and parent in fresh]
                if inner:
                    found[name] = _referring(t[name], parents[name], inner)
    return gone


def _cycles(arcs: Sequence[tuple[str, str]], table: str) -> list[list[str]]:
    """`table` and the tables that refer to it, directly or not, by cycle, each after those it refers to; arcs are (child, parent)."""

    def below(name: str) -> set[str]:
        seen, new = set(), {name}
        while new:
            new = {child for child, parent in arcs if parent in new} - seen
            seen |= new
        return seen

    reached = {name: below(name) for name in sorted(below(table) | {table})}
    # what a table reaches lies below it, so a cycle that reaches more comes first
    cycles = {frozenset({n, *(m for m in reached[n] if n in reached[m])}) for n in reached}
    return [sorted(c) for c in sorted(cycles, key=lambda c: (-len(set().union(c, *(reached[n] for n in c))), sorted(c)))]


def _referring(rows: DataFrame, key: str, gone: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Distinct keys, `key`, of the rows that refer to any of the (column, keys), written once.

    The columns needed are written first where several are looked at, so that rows made by joins are made once.
    """
    if len(gone) > 1:
        rows = stored(rows.select(*dict.fromkeys([key, *(column for column, _ in gone)])))
    parts = [rows.join(keys.select(F.col("key").alias(column)), column, "left_semi").select(F.col(key).alias("key")) for column, keys in gone]
    return stored(reduce(DataFrame.unionByName, parts).where("key is not null").distinct())


def _without(rows: DataFrame, cuts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    for column, keys in cuts:
        rows = rows.join(keys.select(F.col("key").alias(column)), column, "left_anti")
    return rows


def delete_cascading(t: RentalTables, table: str, predicate: Column, set_null: Sequence[tuple[str, str]] = SET_NULL) -> RentalTables:
    """The tables without the rows of `table` that meet the predicate and without all that refers to them.

    Child columns in `set_null` become NULL instead. Rows for which the predicate is not true stay. Orphans that were
    there before stay as they are; none is added.
    """
    gone = removed_keys(t, table, predicate, set_null)
    out: dict[str, DataFrame] = {}
    if table not in gone:
        out[table] = t[table].where(~F.coalesce(predicate, F.lit(False)))
    edges = _edges(t)
    for name in t.names():
        own = next((column for _, _, parent, column in edges if parent == name), None)
        cuts = [(column, gone[parent]) for child, column, parent, _ in edges if child == name and parent in gone and (child, column) not in set_null]
        nulls = [(column, gone[parent]) for child, column, parent, _ in edges if child == name and parent in gone and (child, column) in set_null]
        if not cuts and not nulls and name not in gone:
            continue
        rows = out.get(name, t[name])
        if name in gone:
            # the keys that go already are those of all rows that refer to something gone; only rows without a key are left to look at
            kept = rows.where(F.col(own).isNotNull()).join(gone[name].select(F.col("key").alias(own)), own, "left_anti").select(*t[name].columns)
            rows = rows.where(F.col(own).isNull() & ~F.coalesce(predicate, F.lit(False)) if name == table else F.col(own).isNull())
            rows = kept.unionByName(_without(rows, cuts).select(*t[name].columns))
        else:
            rows = _without(rows, cuts)
        for column, keys in nulls:
            marked = keys.select(F.col("key").alias(column), F.lit(True).alias("_gone"))
            # rows without a key meet nothing and need no exchange with those that have one
            held = rows.where(F.col(column).isNotNull()).join(marked, column, "left")
            held = held.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
            rows = held.select(*t[name].columns).unionByName(rows.where(F.col(column).isNull()).select(*t[name].columns))
        out[name] = rows.select(*t[name].columns)
    return t.replacing(**out)
