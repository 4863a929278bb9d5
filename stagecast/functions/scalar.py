"""Column functions: cleaning, return levels, factors, labels, geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagecast.schemas import FLOOR


def present(value: Column) -> Column:
    """The value, with NaN turned into NULL (Spark orders NaN above every number)."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def clamp(value: Column) -> Column:
    """Raise values below the floor to the floor; NULL stays NULL (``greatest`` alone would fill it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(FLOOR)))


def second(moment: Column) -> Column:
    """Drop fractions of a second, without passing through a time zone."""
    seconds = F.extract(F.lit("SECOND"), moment)
    return moment - F.make_dt_interval(secs=seconds - F.floor(seconds))


def class_count(rows: Column) -> Column:
    """Number of histogram classes for a sample of ``rows`` values."""
    return F.ceil(F.lit(1.0) + F.lit(3.322) * F.log10(rows.cast("double"))).cast("double")


def gumbel(spread: Column, mean: Column, years: Column) -> Column:
    """Gumbel type I level of a return period; 0 where spread <= 0 or years <= 1."""
    years = years.cast("double")
    # A row with years <= 1 has no reduced variate: give the logarithms a valid stand-in.
    safe = F.when(years > 1, years).otherwise(F.lit(2.0))
    variate = -F.log(-F.log(F.lit(1.0) - F.lit(1.0) / safe))
    level = variate * spread * F.lit(0.7797) + mean - F.lit(0.45) * spread
    return (
        F.when(spread.isNull() | mean.isNull(), F.lit(None).cast("double"))
        .when((spread <= 0) | (years <= 1), F.lit(0.0))
        .otherwise(level)
    )


def clip(value: Column, low: Column, high: Column) -> Column:
    """``value`` limited to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def below_factor(value: Column, low: Column) -> Column:
    """value/low where the value lies below ``low``, else 1; NULL stays NULL."""
    return F.when(value < low, F.try_divide(value, low)).when(value.isNotNull(), F.lit(1.0))


def above_factor(value: Column, high: Column) -> Column:
    """value/high where the value lies above ``high``, else 1; NULL stays NULL."""
    return F.when(value > high, F.try_divide(value, high)).when(value.isNotNull(), F.lit(1.0))


def display_name(name: Column) -> Column:
    """Station name as shown: separators become blanks, upper case."""
    return F.upper(F.translate(name, "-_", "  "))


def decade(moment: Column) -> Column:
    """First year of the ten-year range a moment lies in."""
    year = F.year(moment)
    return (year - F.pmod(year, F.lit(10))).cast("int")


def point_geometry(longitude: Column, latitude: Column) -> Column:
    """GeoJSON point as a struct."""
    return F.struct(
        F.lit("Point").alias("type"),
        F.array(longitude, latitude).alias("coordinates"),
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later``, without passing through a time zone."""
    def of_day(moment: Column) -> Column:
        return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)

    days = F.datediff(F.to_date(later), F.to_date(earlier)).cast("long")
    return days * 86400 + of_day(later) - of_day(earlier)
