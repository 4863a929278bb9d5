"""Domain tables derived from the synthetic test tables (see FIXTURES.md).

Only maxima, minima and whole-number arithmetic feed the values, so they are the same in every
engine and for every order of the rows.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.schemas import MEMBERS
from stagecast.tables import Tables
from stagecast.workspace import materialise

INITIALIZED = "2002-01-28 00:00:00"
STEPS = 120


def _code(number) -> F.Column:
    return F.concat(F.lit("HW-"), F.lpad(number.cast("string"), 6, "0"))


def _reach(number) -> F.Column:
    return number - F.pmod(number, F.lit(2))


class Fixtures:
    """Derived tables of one test data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def station(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self._read("supplier")
            .join(self._read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                _code(key).alias("hydroweb"), _reach(key).cast("int").alias("reachid"),
                F.col("r_name").alias("basin"),
                F.concat(F.lit("River-"), F.pmod(key, F.lit(17)).cast("string")).alias("river"),
                F.col("s_name").alias("name"),
                (((key * 3701) % 18000 - 9000).cast("double") / 100).alias("latitude"),
                (((key * 10103) % 36000 - 18000).cast("double") / 100).alias("longitude"),
                F.col("s_acctbal").alias("elevation"),
                F.concat(F.lit("State-"), F.col("s_nationkey").cast("string")).alias("state"),
                F.col("n_name").alias("country"), F.lit("fixture").alias("type"),
            )
        )

    def observed(self) -> DataFrame:
        return (
            self._read("lineitem")
            .groupBy("l_shipdate", "l_suppkey")
            .agg((F.lit(100) + F.max("l_quantity")).alias("waterlevel"))
            .select(F.col("l_shipdate").alias("datetime"), _code(F.col("l_suppkey")).alias("hydroweb"), "waterlevel")
        )

    def simulation(self) -> DataFrame:
        return (
            self._read("lineitem")
            .groupBy(F.col("l_shipdate").alias("datetime"), _reach(F.col("l_suppkey")).cast("int").alias("reachid"))
            .agg((F.floor(F.max("l_extendedprice")).cast("double") / 1000).alias("value"))
        )

    def reaches(self) -> DataFrame:
        return self._read("supplier").select(_reach(F.col("s_suppkey")).alias("reachid")).distinct()

    def ensemble(self) -> DataFrame:
        reach, step, member = F.col("reachid"), F.col("step"), F.col("member")
        raw = (reach * 7919 + step * 104729 + member * 15485863) % 100000
        height = 60 + 10 * ((reach + F.floor(step / 8)) % 17)
        gap = ((member == MEMBERS) & (step >= 80)) | ((member == 7) & (step % 40 == 13))
        return (
            self.reaches()
            .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
            # Few narrow rows that become very many: spread them before they are multiplied.
            .repartition(self.spark.sparkContext.defaultParallelism, "reachid", "step")
            .withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(MEMBERS))))
            .select(
                (F.lit(INITIALIZED).cast("timestamp_ntz") + F.make_dt_interval(hours=step * 3)).alias("datetime"),
                reach.cast("int").alias("reachid"),
                F.lit(INITIALIZED).cast("timestamp_ntz").alias("initialized"),
                "member",
                F.when(~gap, (raw * height).cast("double") / 100000).alias("value"),
            )
        )

    def runs(self) -> list[tuple[str, DataFrame]]:
        """Three runs, a day apart, as model output (time, rivid, ensemble, Qout); the last is ``ensemble``."""
        found = []
        for days in (2, 1, 0):
            back = F.make_dt_interval(days=F.lit(days))
            started = str(dt.datetime.fromisoformat(INITIALIZED) - dt.timedelta(days=days))
            found.append((started, self.ensemble().select(
                (F.col("datetime") - back).alias("time"), F.col("reachid").alias("rivid"), F.col("member").alias("ensemble"),
                (F.col("value") + F.lit(float(days))).alias("Qout"),
            )))
        return found

    def _records(self, first: str, days: int) -> DataFrame:
        day = F.col("day")
        return (
            self.reaches()
            .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
            .select(
                F.date_add(F.lit(first).cast("date"), day).cast("timestamp_ntz").alias("datetime"),
                F.col("reachid").cast("int").alias("reachid"),
                (((F.col("reachid") * 613 + day * 7919) % 100000).cast("double") / 1000).alias("value"),
            )
        )

    def records(self) -> DataFrame:
        return self._records("2002-01-08", 21)

    def records_over_new_year(self) -> DataFrame:
        return self._records("2001-12-20", 40)

    def readings(self) -> DataFrame:
        """Observations as they arrive in a stream: (hydroweb, datetime, waterlevel)."""
        return self._read("events").select(
            _code(F.pmod("user_id", F.lit(10))).alias("hydroweb"),
            F.col("ts").cast("timestamp_ntz").alias("datetime"), F.col("value").alias("waterlevel"),
        )

    def tables(self) -> Tables:
        return Tables(self.station(), self.observed(), self.simulation(), self.ensemble(), self.records())


class StoredFixtures(Fixtures):
    """The same tables, each written to the shared folder on first use, as data at rest would be."""

    @cached_property
    def _station(self) -> DataFrame:
        return materialise(super().station(), "station")

    @cached_property
    def _observed(self) -> DataFrame:
        return materialise(super().observed(), "observed")

    @cached_property
    def _simulation(self) -> DataFrame:
        return materialise(super().simulation(), "simulation")

    @cached_property
    def _ensemble(self) -> DataFrame:
        return materialise(super().ensemble(), "ensemble")

    def station(self) -> DataFrame:
        return self._station

    def observed(self) -> DataFrame:
        return self._observed

    def simulation(self) -> DataFrame:
        return self._simulation

    def ensemble(self) -> DataFrame:
        return self._ensemble
