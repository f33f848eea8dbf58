"""Table access: one lazily built DataFrame per table of the star schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from reelflow.sources import schemas


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan `<directory>/<name>.parquet` (a file or a folder) with its declared schema.

    The declared schema means no schema inference job, and Catalyst prunes columns and pushes
    filters into the scan as usual.
    """
    return spark.read.schema(schemas.schema(name)).parquet(f"{directory.rstrip('/')}/{name}.parquet")


class RentalTables:
    """Named DataFrames with attribute access, e.g. `tables.payment`.

    `sources` maps a table name to a DataFrame or to a zero-argument builder. Builders run once,
    at first use, so a query only plans the tables it touches.
    """

    def __init__(self, sources: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._sources = dict(sources)
        self._built: dict[str, DataFrame] = {}

    @classmethod
    def from_dir(cls, spark: SparkSession, directory: str) -> RentalTables:
        """All declared tables stored as parquet under one directory."""
        return cls({name: (lambda n=name: load_table(spark, directory, n)) for name in schemas.DDL})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._sources:
                raise KeyError(f"no table named {name!r}; known: {sorted(self._sources)}")
            source = self._sources[name]
            self._built[name] = source if isinstance(source, DataFrame) else source()
        return self._built[name]

    def names(self) -> list[str]:
        return list(self._sources)

    def replacing(self, **tables: DataFrame) -> RentalTables:
        """A copy in which some tables are replaced by new versions."""
        merged = {**self._sources, **self._built, **tables}
        return RentalTables(merged)
