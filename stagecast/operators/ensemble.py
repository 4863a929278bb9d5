"""Ensemble operators: wide form, statistics, daily maxima, exceedance, probability table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecast.functions.scalar import seconds_between
from stagecast.operators.bias import (
    Model, corrected_members, corrected_values, forecast_rows, forecast_runs, run_mapping, with_order,
)
from stagecast.operators.lookup import lookup_join
from stagecast.schemas import (
    HIGH_RES_MEMBER, MEMBERS, RETURN_PERIODS, STAT_MEMBERS, threshold_columns,
)
from stagecast.tables import Tables
from stagecast.workspace import materialise

_DAY = 86400


def member_column(member: int) -> str:
    return f"ensemble_{member:02d}"


def ensemble_wide(ensemble: DataFrame) -> DataFrame:
    """One column per member, from one aggregation that merges the members of a moment per task before its shuffle."""
    return forecast_rows(ensemble).groupBy("datetime", "reachid", "initialized").agg(*slots(F.col("member"), F.col("value")))


def ensemble_long(wide: DataFrame) -> DataFrame:
    """Back from member columns to member rows."""
    columns = [member_column(m) for m in range(1, MEMBERS + 1)]
    return wide.unpivot(["datetime", "reachid", "initialized"], columns, "member", "value").withColumn(
        "member", F.substring("member", 10, 2).cast("int")
    )


def forecast_records(ensemble: DataFrame) -> DataFrame:
    """First member at the start of its run: the record kept of each forecast."""
    return (
        forecast_rows(ensemble)
        .where((F.col("member") == 1) & (F.col("datetime") == F.col("initialized")))
        .select("datetime", "reachid", "value")
    )


def members_present(member: Column, value: Column) -> Column:
    """Aggregate: a bit per ordinary member that has a value; repeated rows set it once."""
    ordinary = (member >= 1) & (member <= STAT_MEMBERS) & value.isNotNull()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (member - 1).cast("int"))
    return F.coalesce(F.bit_or(F.when(ordinary, bit)), F.lit(0).cast("long"))


def complete_rows(ensemble: DataFrame) -> DataFrame:
    """Moments with a value for every member but the high-resolution one."""
    return (
        forecast_rows(ensemble)
        .groupBy("reachid", "initialized", "datetime")
        .agg(F.bit_count(members_present(F.col("member"), F.col("value"))).cast("long").alias("n_members"))
        .where(F.col("n_members") == STAT_MEMBERS)
    )


def slots(member: Column, value: Column) -> list[Column]:
    """Aggregates: the value of each member, NULL where it has none.

    A group is one row of fixed size, whatever it was given; of a repeated member the largest value
    counts. Merged per task before the shuffle.
    """
    return [F.max(F.when(member == m, value)).alias(member_column(m)) for m in range(1, MEMBERS + 1)]


#: Members of a packed row. A row that is packed is compared with each of its slots, so four rows of
#: 13 slots need about half the time of one row of 52.
_STRIP = 13
_PLACES_OF_STRIP = [f"slot_{k:02d}" for k in range(1, _STRIP + 1)]


def packed(rows: DataFrame) -> DataFrame:
    """Ensemble rows as few rows per moment of a run, each with a ``strip`` of members and a slot for each of them.

    Of rows that repeat a moment and member the largest value stays; nothing else is lost. ``held``
    has a bit for each member of the strip that has a row, with or without a value. A row whose member
    is none of 1..52 stays a row of its own (``usual`` is false), with its ``other`` number and ``value``.
    """
    member, value = F.col("member"), F.col("value")
    usual = _usual(member)
    strip, place = F.floor((member - 1) / F.lit(_STRIP)).cast("int"), F.col("_place")
    placed = rows.select("*", usual.alias("usual"), F.when(usual, F.pmod(member - 1, F.lit(_STRIP)) + 1).alias("_place"))
    return placed.groupBy(
        "datetime", "reachid", "initialized", "usual", F.when(~F.col("usual"), member).alias("other"),
        F.when(F.col("usual"), strip).alias("strip"),
    ).agg(
        _held_bits(F.col("usual"), place).alias("held"),
        *[F.max(F.when(place == k, value)).alias(name) for k, name in enumerate(_PLACES_OF_STRIP, 1)],
        F.max(F.when(~F.col("usual"), value)).alias("value"),
    )


def _usual(member: Column) -> Column:
    """Whether a number is that of a member."""
    return F.coalesce(member.between(1, MEMBERS), F.lit(False))


def _held_bits(which: Column, member: Column) -> Column:
    """Aggregate: a bit for each member that has a row for which ``which`` is true."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (member - 1).cast("int"))
    return F.coalesce(F.bit_or(F.when(which, bit)), F.lit(0).cast("long"))


def _held(place: Column) -> Column:
    """Whether a packed row holds the member of a place."""
    return F.call_function("shiftright", F.col("held"), (place - 1).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def unpacked(moments: DataFrame) -> DataFrame:
    """The rows of :func:`packed` moments, in their order: (datetime, reachid, initialized, member, value)."""
    values = F.when(F.col("usual"), F.array(*_PLACES_OF_STRIP)).otherwise(F.array("value"))
    rows = moments.select("datetime", "reachid", "initialized", "usual", "other", "strip", "held", F.posexplode(values).alias("_at", "value"))
    number = F.col("strip") * F.lit(_STRIP) + F.col("_at") + 1
    rows = rows.withColumn("member", F.when(F.col("usual"), number).otherwise(F.col("other")).cast("int"))
    return rows.where(~F.col("usual") | _held(F.col("_at") + 1)).select("datetime", "reachid", "initialized", "member", "value")


def packed_records(moments: DataFrame) -> DataFrame:
    """As :func:`forecast_records`, from :func:`packed` moments."""
    first = F.col("usual") & (F.col("strip") == 0) & _held(F.lit(1)) & (F.col("datetime") == F.col("initialized"))
    return moments.where(first).select("datetime", "reachid", F.col(_PLACES_OF_STRIP[0]).alias("value"))


def quantile(ordered: Column, share: float) -> Column:
    """Quantile of an ascending array of all ordinary members, interpolated between neighbours."""
    place = share * (STAT_MEMBERS - 1)
    low = int(place)
    below, above = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(min(low + 1, STAT_MEMBERS - 1)))
    return below if place == low else (low + 1 - place) * below + (place - low) * above


def ensemble_stats(corrected: DataFrame) -> DataFrame:
    """Quantiles over the ordinary members and the high-resolution value per moment.

    Quantiles are NULL unless all ordinary members are present; a moment with neither is left
    out. ``flow_avg`` is the median. One aggregation puts every member into its slot; the slots are
    sorted once per moment.
    """
    stats = corrected.groupBy("hydroweb", "initialized", "datetime").agg(*slots(F.col("member"), F.col("corrected")))
    return _summary(stats.select(
        "hydroweb", "initialized", "datetime", F.sort_array(_ordinary()).alias("q"), F.col(member_column(HIGH_RES_MEMBER)).alias("high_res")
    ))


def _ordinary() -> Column:
    """The slots of the ordinary members."""
    return F.array(*[F.col(member_column(m)) for m in range(1, STAT_MEMBERS + 1)])


#: The statistics, each a quantile of the ordinary members.
_QUANTILES = {"flow_max": 1.0, "flow_75": 0.75, "flow_avg": 0.5, "flow_25": 0.25, "flow_min": 0.0}
#: Places in the order of the ordinary members that these quantiles read.
_PLACES = sorted({k for share in _QUANTILES.values() for k in (math.floor(share * (STAT_MEMBERS - 1)), math.ceil(share * (STAT_MEMBERS - 1)))})


def _summary(ordered: DataFrame) -> DataFrame:
    """Statistics of moments with ``q``, the ordinary members in ascending order, and ``high_res``."""
    whole = F.get("q", F.lit(0)).isNotNull()  # NULLs come first
    return ordered.where(whole | F.col("high_res").isNotNull()).select(
        "hydroweb", "initialized", "datetime",
        *[F.when(whole, quantile(F.col("q"), share)).alias(name) for name, share in _QUANTILES.items()],
        "high_res",
    )


def forecast_stats(tables: Tables, model: Model) -> DataFrame:
    """:func:`ensemble_stats` of the corrected forecast of all runs.

    Where the correction of a run keeps the order of values, the members of a moment are put into their order
    once per reach, before they meet its stations, and the places that the quantiles read are corrected.
    Runs whose correction may swap two values are corrected member by member.
    """
    rows = forecast_rows(tables.ensemble)
    runs = forecast_runs(rows)
    mapping = materialise(with_order(run_mapping(runs, model)), "run-order")
    in_order, others = (mapping.where(which).drop("ordered") for which in ("ordered", "NOT ordered"))
    moments = rows.groupBy("reachid", "initialized", "datetime").agg(*slots(F.col("member"), F.col("value")))
    # A generator of one row: the members are sorted once, not once per place that is read.
    sorted_once = F.explode(F.array(F.sort_array(_ordinary()))).alias("q")
    moments = moments.select("reachid", "initialized", "datetime", F.col(member_column(HIGH_RES_MEMBER)).alias("high"), sorted_once)
    whole = F.get("q", F.lit(0)).isNotNull()  # NULLs come first
    values = F.array(*[F.when(whole, F.get("q", F.lit(k))) for k in _PLACES], F.col("high"))
    met = lookup_join(moments.select("reachid", "initialized", "datetime", values.alias("_values")), in_order, ["reachid", "initialized"], runs)
    placed = met.select("*", F.posexplode("_values").alias("member", "value")).drop("_values").where(F.col("value").isNotNull())
    numbers = {k: i for i, k in enumerate(_PLACES)}
    at = lambda i: F.max(F.when(F.col("member") == i, F.col("corrected")))
    stats = corrected_values(placed).groupBy("hydroweb", "initialized", "datetime").agg(
        *[at(i).alias(f"_{k}") for k, i in numbers.items()], at(len(_PLACES)).alias("high_res")
    )
    ordered = F.array(*[F.col(f"_{k}") if k in numbers else F.lit(None).cast("double") for k in range(STAT_MEMBERS)])
    found = _summary(stats.select("hydroweb", "initialized", "datetime", ordered.alias("q"), "high_res"))
    if others.isEmpty():
        return found
    return found.unionByName(ensemble_stats(corrected_members(rows, runs, others)))


def daily_maximum(corrected: DataFrame) -> DataFrame:
    """Largest corrected value per calendar day and member.

    Every day between the first and the last row of a run appears for every member of the run;
    days without rows are NULL. A day is one row with a slot per member, so that neither a shuffle nor a
    window meets the members one by one. Gaps are filled from the daily rows themselves: each row is
    stretched to the day before the next one. A window holds the days of one run.
    """
    member, value = F.col("member"), F.col("corrected")
    usual = _usual(member)
    daily = corrected.groupBy(
        "hydroweb", "initialized", F.to_date("datetime").alias("day"), usual.alias("usual"), F.when(~usual, member).alias("other")
    ).agg(_held_bits(usual, member).alias("held"), *slots(member, value), F.max(F.when(~usual, value)).alias("value"))
    run = Window.partitionBy("hydroweb", "initialized")
    member = Window.partitionBy("hydroweb", "initialized", "usual", "other")
    first, last = F.min("day").over(run), F.max("day").over(run)
    before, after = F.lag("day").over(member.orderBy("day")), F.lead("day").over(member.orderBy("day"))
    values = F.when(F.col("usual"), F.array(*[F.col(member_column(m)) for m in range(1, MEMBERS + 1)])).otherwise(F.array("value"))
    return (
        daily.withColumn("_from", F.when(before.isNull(), first).otherwise(F.col("day")))
        .withColumn("_to", F.when(after.isNull(), last).otherwise(F.date_sub(after, 1)))
        .withColumn("held", F.bit_or("held").over(member))
        .select("hydroweb", "initialized", F.explode(F.sequence("_from", "_to")).alias("_day"), "day", "usual", "other", "held", values.alias("_values"))
        .select("hydroweb", "initialized", "_day", "day", "usual", "other", "held", F.posexplode("_values").alias("_at", "max_value"))
        .where(~F.col("usual") | _held(F.col("_at") + 1))
        .select("hydroweb", "initialized", F.col("_day").alias("day"),
                F.when(F.col("usual"), F.col("_at") + 1).otherwise(F.col("other")).cast("int").alias("member"),
                F.when(F.col("_day") == F.col("day"), F.col("max_value")).alias("max_value"))
    )


def threshold_level(value: Column) -> Column:
    """How many of the six thresholds of its row a value exceeds.

    Thresholds rise with the return period, so the count says which ones.
    """
    hits = [F.when(value > F.col(c), 1).otherwise(0) for c in threshold_columns()]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return F.when(value.isNotNull(), total)


def exceedance_counts(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Members with a level above each threshold: ``n_<rp>`` per group. A group without values counts 0.

    ``levels`` has the keys, member and level, any number of rows per member. Members are bits of a number
    per threshold, merged per task before the shuffle; a number that is no member's is a group of its
    own until then.
    """
    member, usual = F.col("member"), _usual(F.col("member"))
    place = F.when(usual, member).otherwise(1)
    bits = [_held_bits(F.col("level") >= i + 1, place).alias(f"n_{rp}") for i, rp in enumerate(RETURN_PERIODS)]
    each = levels.groupBy(*keys, F.when(~usual, member).alias("_other"), usual.alias("_usual")).agg(*bits)
    return each.groupBy(*keys).agg(*[F.sum(F.bit_count(f"n_{rp}")).alias(f"n_{rp}") for rp in RETURN_PERIODS])


def exceedance_daily(
    tables: Tables, model: Model, thresholds: DataFrame, max_days: int | None = None
) -> DataFrame:
    """Percent of the 52 members whose day maximum exceeds each return period.

    Output: (hydroweb, initialized, day_no, day, pct_<rp>). Days are calendar days counted from
    the first day of the run; days without rows have 0 percent. A member exceeds a threshold on a
    day when any of its values does, so rows are reduced to their level at once and members to bits, merged
    per task before the shuffle. ``max_days`` drops later days before any of that.
    """
    rows = forecast_rows(tables.ensemble)
    runs = forecast_runs(rows)
    limits = thresholds.select("hydroweb", *threshold_columns())
    mapping = run_mapping(runs, model, extra=limits)
    keep = ("first_time", *threshold_columns())
    corrected = corrected_members(rows, runs, mapping, keep).withColumn(
        "day_no", F.datediff(F.to_date("datetime"), F.to_date("first_time")) + 1
    )
    first_day, last_day = F.to_date("first_time"), F.to_date("last_time")
    days = F.datediff(last_day, first_day) + 1
    if max_days is not None:
        corrected = corrected.where(F.col("day_no") <= max_days)
        days = F.least(days, F.lit(max_days))
    keys = ["hydroweb", "reachid", "initialized", "first_time", "day_no"]
    member_days = corrected.select(*keys, F.col("member").cast("int").alias("member"), threshold_level(F.col("corrected")).alias("level"))
    calendar = mapping.select(
        "hydroweb", "reachid", "initialized", "first_time",
        F.explode(F.sequence(F.lit(1), days)).alias("day_no"),
        F.lit(None).cast("int").alias("member"), F.lit(None).cast("int").alias("level"),
    )
    counts = exceedance_counts(member_days.unionByName(calendar), keys)
    return counts.select(
        "hydroweb", "initialized", "day_no",
        F.date_add(F.to_date("first_time"), F.col("day_no") - 1).alias("day"),
        *[(F.col(f"n_{rp}") * F.lit(100.0) / F.lit(float(MEMBERS))).alias(f"pct_{rp}") for rp in RETURN_PERIODS],
    )


def probability_table(
    tables: Tables, model: Model, thresholds: DataFrame
) -> DataFrame:
    """Percent of members above each return period in 24 h windows from the first statistic.

    Output: (hydroweb, initialized, window, day, label, r<rp>). Only moments with all ordinary
    members count, the high-resolution member does not, and the divisor stays 52. Both ends of a
    window belong to it, so a row on a boundary counts in two windows. Windows without rows are 0.
    """
    rows = forecast_rows(tables.ensemble)
    # One row per moment with a slot per member, stored: it dates the runs, says which moments take
    # part, and holds their values. The ensemble itself is shuffled for this and no more.
    member, value = F.col("member"), F.col("value")
    moments = materialise(
        rows.groupBy("reachid", "initialized", "datetime").agg(members_present(member, value).alias("bits"), *slots(member, value)), "moments"
    )
    whole, high = F.bit_count("bits") == STAT_MEMBERS, F.col(member_column(HIGH_RES_MEMBER)).isNotNull()
    in_stats = whole | high
    runs = moments.groupBy("reachid", "initialized").agg(
        F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"),
        F.min(F.when(in_stats, F.col("datetime"))).alias("start"),
        F.max(F.when(in_stats, F.col("datetime"))).alias("end"),
        (F.count_if(whole) * STAT_MEMBERS).alias("n"),
    )
    mapping = run_mapping(
        runs, model, extra=thresholds.select("hydroweb", *threshold_columns())
    ).withColumn("windows", F.floor(seconds_between(F.col("end"), F.col("start")) / F.lit(_DAY)).cast("int"))
    # Windows belong to a moment, so it meets its mapping and its windows as one row, before its members are corrected.
    met = lookup_join(moments.where(whole).select("reachid", "initialized", "datetime", _ordinary().alias("_values")), mapping, ["reachid", "initialized"], runs)
    offset = seconds_between(F.col("datetime"), F.col("start"))
    here = F.floor(offset / F.lit(_DAY)).cast("int")
    before = (F.ceil(offset / F.lit(_DAY)) - 1).cast("int")
    keys = ["hydroweb", "reachid", "initialized", "start", "window"]
    placed = (
        met.withColumn("window", F.explode(F.array_distinct(F.array(here, before))))
        .where((F.col("window") >= 0) & (F.col("window") < F.col("windows")))
        .select("*", F.posexplode("_values").alias("member", "value")).drop("_values")
        .withColumn("member", F.col("member") + 1)
    )
    member_windows = corrected_values(placed, ("start", "window", *threshold_columns())).select(
        *keys, "member", threshold_level(F.col("corrected")).alias("level")
    )
    calendar = mapping.where(F.col("windows") > 0).select(
        "hydroweb", "reachid", "initialized", "start",
        F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("window"),
        F.lit(None).cast("int").alias("member"), F.lit(None).cast("int").alias("level"),
    )
    day = F.date_add(F.to_date("start"), F.col("window"))
    return exceedance_counts(member_windows.unionByName(calendar), keys).select(
        "hydroweb", "initialized", "window", day.alias("day"), F.date_format(day, "MMM dd").alias("label"),
        *[
            F.bround(F.col(f"n_{rp}") * F.lit(100.0) / F.lit(float(MEMBERS)), 0).cast("int").alias(f"r{rp}")
            for rp in RETURN_PERIODS
        ],
    )


def forecast_dates(runs: DataFrame) -> DataFrame:
    """The fifteen dates a forecast run covers: (reachid, initialized, day_no, date)."""
    first = F.to_date("initialized")
    return runs.select(
        "reachid", "initialized",
        F.posexplode(F.sequence(first, F.date_add(first, 14))).alias("day_no", "date"),
    ).withColumn("day_no", F.col("day_no") + 1)
