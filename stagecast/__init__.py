"""River-stage analytics on PySpark: every station at once, as DataFrames."""

from stagecast.tables import Tables

__all__ = ["Tables"]
