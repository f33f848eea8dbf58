from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402
from reelflow.sources import schemas  # noqa: E402
from reelflow.sources.roles import role_tables  # noqa: E402
from reelflow.sources.tables import RentalTables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("reelflow-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return check.database(SF)


@pytest.fixture(scope="session")
def tables(spark):
    return role_tables(spark, SF)


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _default(kind: T.DataType):
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.DecimalType):
        return Decimal(0)
    if isinstance(kind, T.BooleanType):
        return True
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return datetime(2000, 1, 1)
    return 0


def make(spark: SparkSession, table: str, *rows: dict):
    """A small table with its declared schema; missing required columns get a neutral value."""
    schema = schemas.schema(table)
    data = [
        tuple(r[f.name] if f.name in r else None if f.nullable else _default(f.dataType) for f in schema.fields)
        for r in rows
    ]
    for r in rows:
        unknown = set(r) - set(schema.names)
        assert not unknown, unknown
    return spark.createDataFrame(data, schema)


def small(spark: SparkSession, **given) -> RentalTables:
    """Small tables by name; every other table is empty."""
    return RentalTables({name: make(spark, name, *given.get(name, [])) for name in schemas.DDL})


def by(df, key: str) -> dict:
    return {r[key]: r for r in df.collect()}
