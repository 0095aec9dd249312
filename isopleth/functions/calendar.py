"""Season and lead-window arithmetic on absolute months (year * 12 + month - 1) and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Initials of the months; days of each month, February's on average; lead windows (first and last day, day 1 is the start).
INITIALS = "JFMAMJJASOND"
MONTH_DAYS = [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
LEAD_WINDOWS = {"day1_30": (1, 30), "week1": (1, 7), "week2": (8, 14), "week3": (15, 21), "week4": (22, 28)}


def abs_month(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def wraps(months: list[int]) -> bool:
    """Whether a window of months crosses the year's end."""
    return months[0] > months[-1]


def wraps_col(months: Column) -> Column:
    return F.element_at(months, 1) > F.element_at(months, -1)


def season_year(year: Column, month: Column, months: list[int]) -> Column:
    """The year of the window's last month: months before the turn of the year count to the next one."""
    early = [m for m in months if m > months[-1]] if wraps(months) else []
    return year + month.isin(early).cast("int") if early else year


def preseason(season: Column, months: list[int], gap: int, k: int = 0) -> Column:
    """Absolute month that lies gap + 1 + k months before the window's first, for the season labelled by its last month's year."""
    return (season - int(wraps(months))) * 12 + (months[0] - 1 - (gap + 1 + k))


def init_month(start: int, lead: int) -> int:
    """Month in which a forecast for a window from ``start`` on is issued ``lead`` months ahead."""
    return (start - lead - 1) % 12 + 1


def lead_of(start: Column, init: Column) -> Column:
    return F.pmod(start - init, F.lit(12))


def month_initials(months: Column) -> Column:
    return F.array_join(F.transform(months, lambda m: F.substring(F.lit(INITIALS), m, F.lit(1))), "")


def moved_to_year(day: Column, year: Column) -> Column:
    """The same day in another year; 29 February becomes the 28th where there is none."""
    first = F.make_date(year, F.month(day), F.lit(1))
    return F.make_date(year, F.month(day), F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(first))))


def lead_windows(spark: SparkSession) -> DataFrame:
    """(window, first_day, last_day)."""
    return spark.createDataFrame([(k, *v) for k, v in LEAD_WINDOWS.items()], "window string, first_day int, last_day int")


def valid_days(start: Column, first_day: Column, last_day: Column) -> Column:
    """Dates of a lead window."""
    return F.sequence(F.date_add(start, first_day - 1), F.date_add(start, last_day - 1))


def span_text(first: Column, last: Column) -> Column:
    """Two dates as "3 – 9 Oct" or "28 Sep – 4 Oct", a month that both share once."""
    name = lambda d: F.date_format(d, "MMM")
    head = F.when(F.month(first) == F.month(last), F.dayofmonth(first).cast("string")).otherwise(F.concat(F.dayofmonth(first).cast("string"), F.lit(" "), name(first)))
    return F.concat(head, F.lit(" \u2013 "), F.dayofmonth(last).cast("string"), F.lit(" "), name(last))


def month_length(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in MONTH_DAYS]), month)


def walk_forward(n: int, folds: int, least: int = 20) -> list[tuple[range, range]]:
    """(train, test) places: the test blocks divide what follows the first half (at least ``least``), each trained on all before it."""
    first = max(least, n // 2)
    edges = [int(first + (n - first) * k / folds) for k in range(folds + 1)]
    return [(range(0, a), range(a, b)) for a, b in zip(edges, edges[1:])]


def k_fold(n: int, folds: int) -> list[tuple[list[int], range]]:
    """(train, test) places of contiguous blocks; the first n % folds blocks have one more."""
    out, at = [], 0
    for k in range(folds):
        size = n // folds + (k < n % folds)
        out.append(([i for i in range(n) if not at <= i < at + size], range(at, at + size)))
        at += size
    return out
