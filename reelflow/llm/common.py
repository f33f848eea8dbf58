"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelflow.sources.sinks import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters; A-Z are lowered."""
    return text.translate(_SPACED).split() if text else []


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The cells of a string column as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task builds from one stays small with long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: CTEs `crc_rows` and `crc_table` with the checksum table, made by its rule, and the checksum of a list of bytes.
CRC_SQL = """
    crc_rows(i, c, k) as (
        select i, i::bigint, 0 from range(256) r(i)
        union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_rows where k < 8),
    crc_table as (select list(c order by i) l from crc_rows where k = 8)"""


def crc_sql(codes: str) -> str:
    """crc32 of a list of byte values, where `crc_table` is joined in."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])))"
