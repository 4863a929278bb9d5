"""Table schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# They decide the results, so they are stated once and nowhere else.
MEMBERS = 52                                   # ensemble members per reach
HIGH_RES_MEMBER = 52                           # the last one is the high-resolution run
STAT_MEMBERS = MEMBERS - 1                     # members entering the ensemble statistics
FORECAST_DAYS = 14                             # days that get an alert class
STORED_DAYS = 15                               # wd01..wd15 in the warning table
RETURN_PERIODS = (2, 5, 10, 25, 50, 100)
ALERT_PERCENT = 40.0                           # share of members that raises an alert
FLOOR = 0.1                                    # smallest level or discharge kept
RECORD_DAYS = 8                                # days of past records shown with a forecast
ALERT_CLASSES = ("R0", "R2", "R5", "R10", "R25", "R50", "R100")
ACTIVE_CLASSES = ("R2", "R5", "R10", "R25", "R50", "R100")

STATION = T.StructType([
    T.StructField("hydroweb", T.StringType()),
    T.StructField("reachid", T.IntegerType()),
    T.StructField("basin", T.StringType()),
    T.StructField("river", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("type", T.StringType()),
])

OBSERVED = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("hydroweb", T.StringType()),
    T.StructField("waterlevel", T.DoubleType()),
])

COMPILED = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("waterlevel", T.DoubleType()),
    T.StructField("hydroweb", T.StringType()),
    T.StructField("reachid", T.IntegerType()),
])

SIMULATION = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("reachid", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

RECORDS = SIMULATION

ENSEMBLE = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("reachid", T.IntegerType()),
    T.StructField("initialized", T.TimestampNTZType()),
    T.StructField("member", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

WARNING = T.StructType(
    [T.StructField("hydroweb", T.StringType()), T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(f"wd{d:02d}", T.StringType()) for d in range(1, STORED_DAYS + 1)]
)


def day_columns(days: int = FORECAST_DAYS) -> list[str]:
    """``wd01`` .. ``wdNN``."""
    return [f"wd{d:02d}" for d in range(1, days + 1)]


def threshold_columns() -> list[str]:
    """``return_period_2`` .. ``return_period_100``."""
    return [f"return_period_{rp}" for rp in RETURN_PERIODS]
