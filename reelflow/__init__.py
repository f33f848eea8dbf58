"""Set-based rental analytics on Spark DataFrames."""

from reelflow.sources.tables import RentalTables, load_table

__all__ = ["RentalTables", "load_table"]
