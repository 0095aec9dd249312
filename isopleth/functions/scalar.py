"""Small column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(v: Column) -> Column:
    """NaN and infinities become null, the only missing value in here."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def lon360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a point lies in a box, both ends included; an eastern end over 360 wraps."""
    inside = lat.between(south, north)
    return inside & ((lon >= west) | (lon <= east - 360) if east > 360 else lon.between(west, east))


def km_per_degree(lat: Column, degrees: Column | float = 1.0) -> Column:
    return 111.32 * area_weight(lat) * degrees


def kelvin_to_celsius(v: Column) -> Column:
    return v - 273.15


def physical(v: Column, most: float = 100.0) -> Column:
    """Values from ``most`` on are missing."""
    return F.when(v < most, v)


def slug(s: Column, most: int = 80) -> Column:
    """Lower-case words joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def number(s: Column) -> Column:
    """A tolerant number: thousands separators, unicode minus and per cent signs are taken off; null where none is left."""
    return F.regexp_replace(F.regexp_replace(s, "[−–]", "-"), "[,%+ ]", "").try_cast("double")


def with_stats(rows: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """rows with statistics of their group as columns: aggregated (partly before the shuffle) and joined back.

    No task holds a whole group, as a window's would; the optimizer broadcasts the statistics while they are small. Null keys are a group.
    """
    made = rows.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    if not by:
        return rows.crossJoin(F.broadcast(made))  # one row
    keys = {k: f"_key_{k}" for k in by}
    made = made.withColumnsRenamed(keys)
    return rows.join(made, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(made[n]) for k, n in keys.items()])).drop(*keys.values())


def signed(v: Column, digits: int = 2) -> Column:
    """A number with its sign always written, minus as U+2212."""
    plus = F.when(F.round(v, digits) >= 0, "+").otherwise("")
    return F.replace(F.concat(plus, F.format_string(f"%.{digits}f", v)), F.lit("-"), F.lit("\u2212"))


def percent(v: Column, digits: int = 0) -> Column:
    """A share as per cent."""
    return F.concat(F.format_string(f"%.{digits}f", v * 100), F.lit("%"))


def r4(v: Column, digits: int = 4) -> Column:
    """Rounded, and never minus zero."""
    return F.round(v, digits) + F.lit(0.0)


def settled(v: Column, digits: int = 10) -> Column:
    """v without the last bits that hang on the order of a sum's rows, so that a tie is rounded alike, and as the exact value is, in any order."""
    return F.round(v, digits)


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation over rows that have both values; null, and no error, where either doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
