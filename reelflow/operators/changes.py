"""Copy-on-write changes: update, delete, replace a range, sync, audit.

Every function takes DataFrames and returns the new version as a DataFrame; writing it is a
separate step (`reelflow.sources.sinks`), so a table is never overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.functions.scalars import ntz
from reelflow.sources import schemas
from reelflow.sources.tables import RentalTables


def update_join(
    target: DataFrame,
    matched: DataFrame,
    on: Sequence[str] | str,
    assignments: Mapping[str, Column],
    stamp: datetime | str | None = None,
    stamp_column: str = "last_update",
    matched_is_unique: bool = False,
) -> DataFrame:
    """`UPDATE target JOIN matched SET ...` as a new version of `target`.

    A target row changes once and none is added: of several `matched` rows with one key the smallest
    counts, compared by the other columns in their order. These can be used in `assignments` (refer
    to them by name; they must not clash with target columns). Unmatched rows keep their values. With `stamp`, matched rows also get a new `last_update`. Assigned values are cast
    back to the column's own type, so decimals round half up to the column's scale.
    """
    keys = [on] if isinstance(on, str) else list(on)
    types = {f.name: f.dataType for f in target.schema.fields}
    rest = [c for c in matched.columns if c not in keys]
    if matched_is_unique:
        first = matched.withColumn("_hit", F.lit(True))
    else:
        smallest = matched.groupBy(*keys).agg(F.min(F.struct(F.lit(True).alias("_hit"), *rest)).alias("_m"))
        first = smallest.select(*keys, "_m.*")
    joined = target.join(first, keys, "left")
    hit = F.col("_hit").isNotNull()
    new = dict(assignments)
    if stamp is not None:
        new[stamp_column] = F.lit(stamp if isinstance(stamp, str) else stamp.isoformat(sep=" "))
    return joined.select(
        *[
            F.when(hit, new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in target.columns
        ]
    )


def stamp_last_update(before: DataFrame, after: DataFrame, key: Sequence[str] | str, as_of: datetime | str) -> DataFrame:
    """`after` with `last_update = as_of` on every row that differs from its row in `before`.

    NULL-safe row compare; rows without an earlier version, or with NULL in their key, keep their own stamp.
    """
    keys = [key] if isinstance(key, str) else list(key)
    body = [c for c in after.columns if c not in keys and c != "last_update"]
    old, new = lambda c: F.col(f"_old.{c}"), lambda c: F.col(f"_new.{c}")
    # a plain `=` would filter NULL keys out of one side only, and a table that both sides share be computed twice
    same = reduce(Column.__and__, [new(k).eqNullSafe(old(k)) & new(k).isNotNull() for k in keys])
    changed = old(keys[0]).isNotNull() & ~F.struct(*map(new, body)).eqNullSafe(F.struct(*map(old, body)))
    stamp = F.lit(as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")).cast("timestamp")
    joined = after.alias("_new").join(before.select(*keys, *body).alias("_old"), same, "left")
    stamped = F.when(changed, stamp).otherwise(new("last_update")).alias("last_update")
    return joined.select(*[stamped if c == "last_update" else new(c) for c in after.columns])


def stamp_tables(before: RentalTables, after: RentalTables, as_of: datetime | str) -> RentalTables:
    """`stamp_last_update` on every table that carries stamps; a pure key table has nothing to stamp."""
    stamped = {}
    for name in schemas.STAMPED_TABLES:
        if name in before.names() and name in after.names():
            keys = schemas.PRIMARY_KEYS[name]
            if set(after[name].columns) - {*keys, "last_update"} and "last_update" in after[name].columns:
                stamped[name] = stamp_last_update(before[name], after[name], keys, as_of)
    return after.replacing(**stamped)


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true (false or unknown rows stay)."""
    return target.filter(~F.coalesce(predicate, F.lit(False)))


def deleted_keys(target: DataFrame, predicate: Column, key: str) -> DataFrame:
    """Keys that `delete_where` removes, for use on dependent tables."""
    return target.filter(predicate).select(key)


def drop_dependants(child: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    """Delete the child rows whose parent went away."""
    return child.join(removed, on, "left_anti")


def replace_range(target: DataFrame, new_rows: DataFrame, column: str, first: date | str, last: date | str) -> DataFrame:
    """Delete `column BETWEEN first AND last` and put `new_rows` in, as one new version."""
    inside = F.col(column).between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
    return delete_where(target, inside).unionByName(new_rows.select(*target.columns))


def effective_changes(changes: DataFrame, null_safe: bool = False, collation: str | None = None) -> DataFrame:
    """The changes of `sync_film_text` that take effect: inserts, deletes, and updates that change a text."""

    def differs(name: str) -> Column:
        old, new = F.col(f"old_{name}"), F.col(f"new_{name}")
        if collation is not None:
            old, new = F.collate(old, collation), F.collate(new, collation)
        return ~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, F.lit(False))

    return changes.filter(F.col("op").isin("insert", "delete") | ((F.col("op") == "update") & (differs("title") | differs("description"))))


def sync_film_text(film_text: DataFrame, changes: DataFrame, null_safe: bool = False, collation: str | None = None) -> DataFrame:
    """Apply film inserts, updates and deletes to the text copy.

    `changes` has one row per changed film: `op` in insert / update / delete, `old_film_id,
    old_title, old_description` and `new_film_id, new_title, new_description`. An update counts
    only if title or description differ by a three-valued `!=`: a change from or to NULL alone is
    missed unless `null_safe` is set. An update may change the key. With a `collation`, texts that it takes
    for equal are no change.
    """
    touched = effective_changes(changes, null_safe, collation).filter("op <> 'insert'").select(
        F.col("old_film_id").alias("film_id"), "op", "new_film_id", "new_title", "new_description"
    )
    updated = F.col("op").isNotNull()
    kept = (
        film_text.join(touched, "film_id", "left")
        .filter(F.coalesce(F.col("op") != "delete", F.lit(True)))
        .select(
            F.when(updated, F.col("new_film_id")).otherwise(F.col("film_id")).alias("film_id"),
            F.when(updated, F.col("new_title")).otherwise(F.col("title")).alias("title"),
            F.when(updated, F.col("new_description")).otherwise(F.col("description")).alias("description"),
        )
    )
    added = changes.filter(F.col("op") == "insert").select(
        F.col("new_film_id").alias("film_id"), F.col("new_title").alias("title"), F.col("new_description").alias("description")
    )
    return kept.unionByName(added)


def audit_changes(
    before: DataFrame,
    after: DataFrame,
    key: Sequence[str] | str,
    as_of: datetime | str,
    actor_user: str | None = None,
    log: DataFrame | None = None,
    microseconds: bool = False,
) -> DataFrame:
    """Change log between two versions of a table: one row per inserted, updated or deleted key.

    The rows carry the old and new row as JSON text. Within one comparison the key is unique, so
    `audit_id` is made of it: one integer key counts from the largest `audit_id` of `log`, the log
    so far, upwards; a key of several columns, as that of a bridge table, is written as JSON text.
    Either way a repeated run gives the same ids. Integer keys must be positive.

    Times in the JSON text have three digits after the second; with `microseconds` they have six, so
    that `replay` and `rewind` give times back exactly.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = before.columns
    body = [c for c in columns if c not in keys]
    # the key is exchanged once, not in the row as well; a row without other columns has a mark
    old = before.select(*keys, F.struct(*body, F.lit(True).alias("_there")).alias("_old"))
    new = after.select(*keys, F.struct(*body, F.lit(True).alias("_there")).alias("_new"))

    def row(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(*[F.col(c) if c in keys else F.col(f"{side}.{c}").alias(c) for c in columns]))

    action = (
        F.when(F.col("_old").isNull(), F.lit("INSERT"))
        .when(F.col("_new").isNull(), F.lit("DELETE"))
        .when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("UPDATE"))
    )
    changed_at = ntz(as_of).cast("timestamp")
    exact = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"} if microseconds else None
    if len(keys) > 1:
        audit_id = F.to_json(F.struct(*keys))
    else:
        audit_id = F.col(keys[0])
        if log is not None:
            audit_id = audit_id + F.coalesce(log.agg(F.max("audit_id")).scalar(), F.lit(0))
    return (
        old.join(new, keys, "full")
        .withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .select(
            audit_id.alias("audit_id"),
            *keys,
            "action",
            changed_at.alias("changed_at"),
            F.lit(actor_user).cast("string").alias("actor_user"),
            F.to_json(row("_old"), exact).alias("before_json"),
            F.to_json(row("_new"), exact).alias("after_json"),
        )
    )


def net_changes(log: DataFrame, key: Sequence[str] | str, like: DataFrame, order: Sequence[str] = ("changed_at",)) -> DataFrame:
    """(key, before, after): one row for each key of a change log, the row as it was before its first change and after its last.

    `before` and `after` are structs with the columns of `like`, read from the JSON text, or NULL where the
    row was not there. Several changes of a key are ordered by the columns `order`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    when = F.struct(*order)
    # structs, since a NULL text is a value here: the row was not there
    first = F.min(F.struct(when.alias("w"), F.col("before_json").alias("j")))["j"]
    last = F.max(F.struct(when.alias("w"), F.col("after_json").alias("j")))["j"]
    ends = log.groupBy(*keys).agg(first.alias("before"), last.alias("after"))
    return ends.select(*keys, *[F.from_json(c, like.schema).alias(c) for c in ("before", "after")])


def _patched(table: DataFrame, net: DataFrame, keys: list[str], side: str) -> DataFrame:
    images = net.where(F.col(side).isNotNull()).select(f"{side}.*").select(*table.columns)
    return table.join(net.select(*keys), keys, "left_anti").unionByName(images)


def replay(table: DataFrame, log: DataFrame, key: Sequence[str] | str, until: datetime | str | None = None, order: Sequence[str] = ("changed_at",)) -> DataFrame:
    """A later version of `table`, as the change log of `audit_changes` tells it: changes up to `until`, or all, are applied."""
    keys = [key] if isinstance(key, str) else list(key)
    wanted = log if until is None else log.where(F.col("changed_at") <= ntz(until).cast("timestamp"))
    return _patched(table, net_changes(wanted, keys, table, order), keys, "after")


def rewind(table: DataFrame, log: DataFrame, key: Sequence[str] | str, to: datetime | str | None = None, order: Sequence[str] = ("changed_at",)) -> DataFrame:
    """An earlier version of `table`: changes after `to`, or all of the log, are taken back.

    Only keys of the log are rebuilt, from the JSON text of their first change after `to`; all other rows are as they are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wanted = log if to is None else log.where(F.col("changed_at") > ntz(to).cast("timestamp"))
    return _patched(table, net_changes(wanted, keys, table, order), keys, "before")
