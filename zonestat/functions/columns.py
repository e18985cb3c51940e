"""Column expressions: values, days, join keys, exact quantiles, longitude frames, the leap calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN = r"(?i)^(k|kelvin|degree_?k(elvin)?)$"
DAYS_IN_CALENDAR = 366


def value_expr(column: str, unit: str | None = None) -> Column:
    """A variable's value; kelvins become degrees Celsius."""
    import re

    value = F.col(column).cast("double")
    return value - F.lit(273.15) if unit and re.match(KELVIN, unit) else value


def long_format(slab: DataFrame, variable: str, type_column: str = "measurement_type", value_column: str = "measurement_value") -> DataFrame:
    """The rows of one variable of a long table, its values in column ``value``."""
    return slab.where(F.col(type_column) == variable).withColumn("value", F.col(value_column).cast("double"))


def no_nan(value: Column) -> Column:
    """NaN means no data: it becomes null, else one NaN would spoil every statistic of its group."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def utc_day(time: Column) -> Column:
    return F.to_date(time)


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def cell_key(coordinate: Column, decimals: int) -> Column:
    """A coordinate as a whole number of 10^-decimals degrees: float and double axes meet."""
    return F.round(coordinate.cast("double") * F.lit(10.0**decimals)).cast("long")


def quantile(value: Column, p: float) -> Column:
    """Exact continuous quantile, linear between neighbours."""
    return F.percentile(value, F.lit(p))


def class_code(value: Column) -> Column:
    """A class number: rounded half to even, as a cast to BIGINT does in the oracle."""
    return F.rint(value.cast("double")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normal_longitude(lon: Column, centre: int = 0) -> Column:
    """Into (-180, 180] about 0, into [0, 360) about 180."""
    turned = F.pmod(lon, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned) if centre == 0 else turned


def dataset_longitude(lon: Column, lon_max: float) -> Column:
    """A longitude in a dataset's own frame: one that reaches beyond 180 counts from 0 to 360."""
    return F.when(F.lit(lon_max) > 180, F.when(lon < 0, lon + 360).otherwise(lon)).otherwise(F.when(lon > 180, lon - 360).otherwise(lon))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def band_of(day: Column) -> Column:
    """The day's place in a leap year, 1 to 366: 1 March is 61 in every year."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(day), F.day(day))).cast("long")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def band_day(year: Column, band: Column) -> Column:
    """The date that a band stands for; null for 29 February of other than leap years."""
    in_2000 = F.date_add(F.lit("2000-01-01").cast("date"), (band - 1).cast("int"))
    return F.when((band == 60) & ~is_leap(year), F.lit(None).cast("date")).otherwise(F.make_date(year.cast("int"), F.month(in_2000), F.day(in_2000)))


def step_band(band: Column, by: int) -> Column:
    """A band some days on, round the calendar."""
    return F.pmod(band - 1 + by, F.lit(DAYS_IN_CALENDAR)) + 1


def spacing_days(text: Column) -> Column:
    """Days of a spacing such as '8 days 0h 7m 57s'; null if none."""
    part = lambda pattern: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0))
    days = part(r"(?i)([\d.]+)\s*days?") + part(r"(\d+)\s*h\b") / 24 + part(r"(\d+)\s*m\b") / 1440 + part(r"(\d+)\s*s\b") / 86400
    return F.when(days > 0, days)


def step_label(days: Column) -> Column:
    whole = F.round(days).cast("long")
    return (
        F.when(days.isNull() | (days <= 0), F.lit(None).cast("string")).when(days < 1, "sub-daily").when(whole == 1, "daily").when(whole == 7, "weekly")
        .when(whole.between(28, 31), "monthly").when(whole.between(360, 366), "annual").otherwise(F.concat(whole.cast("string"), F.lit("-day")))
    )


def file_safe(name: Column) -> Column:
    """A name for files: runs of other than letters, digits, dot, dash and underscore become one dash."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def mask_key(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name what a partial result was computed from."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def is_polygonal(geometry_type: Column) -> Column:
    return geometry_type.rlike("(?i)^(multi)?polygon$")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9][a-z0-9_-]*$")


def result_name(prefix: str, extension: str | Column, *parts: Column) -> Column:
    """A result's file name: the prefix and its parts, made safe and joined by underscores; parts that are null or empty are left out."""
    safe = F.filter(F.transform(F.array(F.lit(prefix), *parts), lambda p: F.when(p != "", file_safe(p))), lambda p: p.isNotNull())
    ending = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(F.array_join(safe, "_"), F.lit("."), F.regexp_replace(ending, r"^\.", ""))


def lobe_span(west: Column, east: Column, low: Column, high: Column) -> Column:
    """A lobe's longitudes in a dataset's frame from ``low`` to ``high``, kept inside it: a struct of west and east."""
    framed = lambda x: F.when((high > 180) & (x < 0), x + 360).when((low < 0) & (x > 180), x - 360).otherwise(x)
    kept = lambda x: F.least(F.greatest(x, low), high)
    a, b = framed(west), framed(east)
    return F.struct(kept(F.least(a, b)).alias("west"), kept(F.greatest(a, b)).alias("east"))
