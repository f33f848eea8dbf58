"""Text keys that ignore case and trailing blanks, as the keys of many databases do.

Spark's string collations give a column that meaning wherever it is compared: in grouping, distinct, joins and
`!=`. Values are stored and shown as they are; only what counts as equal changes. Grouping and joins are by a
key that Spark makes from the value, so they shuffle and combine as for plain strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ignores case and trailing blanks.
IGNORE_CASE_AND_BLANKS = "UTF8_LCASE_RTRIM"
PLAIN = "UTF8_BINARY"


def collated(c: Column | str, collation: str = IGNORE_CASE_AND_BLANKS) -> Column:
    return F.collate(F.col(c) if isinstance(c, str) else c, collation)


def group_by_text(df: DataFrame, keys: Sequence[str], *measures: Column, collation: str = IGNORE_CASE_AND_BLANKS) -> DataFrame:
    """One row for each set of keys that count as equal, with the measures.

    Each key is shown by the smallest of its spellings, compared byte by byte, so the result does not depend on the
    order of rows. A NULL key is a group of its own.
    """
    named = [collated(k, collation).alias(f"_key{i}") for i, k in enumerate(keys)]
    shown = [F.min(F.collate(F.col(k), PLAIN)).alias(k) for k in keys]
    return df.groupBy(*named).agg(*shown, *measures).drop(*[f"_key{i}" for i in range(len(keys))])


def distinct_by_text(df: DataFrame, keys: Sequence[str], collation: str = IGNORE_CASE_AND_BLANKS) -> DataFrame:
    """`SELECT DISTINCT keys`, each shown by its smallest spelling."""
    return group_by_text(df, keys, F.count(F.lit(1)).alias("_n"), collation=collation).drop("_n")


def join_by_text(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", collation: str = IGNORE_CASE_AND_BLANKS) -> DataFrame:
    """Equi-join on text keys that count as equal; the key columns are those of `left`, as they are written there."""
    marks = [f"_key{i}" for i in range(len(on))]
    a = left.select("*", *[collated(k, collation).alias(m) for k, m in zip(on, marks, strict=True)])
    b = right.select(*[c for c in right.columns if c not in on], *[collated(k, collation).alias(m) for k, m in zip(on, marks, strict=True)])
    return a.join(b, marks, how).drop(*marks)
