"""Time as Modified Julian Days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from each epoch's zero to that of Modified Julian Days.
OFFSETS = {"mjd": 0.0, "unix_days": 40587.0, "python": -678576.0, "matlab": -678942.0}


def from_timestamp(ts: str | Column) -> Column:
    """MJD of a TIMESTAMP_NTZ, independent of the session's time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1858-11-17 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)
    return micros / F.lit(8.64e10)


def from_number(value: Column, epoch: str = "mjd") -> Column:
    """MJD of numbers counted from an epoch; ``unix`` counts seconds, all others days."""
    if epoch == "unix":
        return value / F.lit(86400.0) + F.lit(OFFSETS["unix_days"])
    return value + F.lit(OFFSETS[epoch])


def from_civil(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0, millisecond: Column | int = 0) -> Column:
    """MJD of a date of the proleptic Gregorian calendar; an impossible date gives null."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    date = F.when((month.between(1, 12)) & (day >= 1) & (day <= F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))), F.make_date(year, month, day))
    clock = (lit(hour) * 3600.0 + lit(minute) * 60.0 + lit(second)) + lit(millisecond) / 1000.0
    return F.date_diff(date, F.lit("1858-11-17").cast("date")) + clock / 86400.0


def angle_error(a: Column, b: Column) -> Column:
    """Least difference of two angles in degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def cluster(angle: Column, centre: Column, period: float = 360.0) -> Column:
    """``angle`` moved by whole periods to within half a period of ``centre``."""
    return centre + F.pmod(angle - centre + period / 2, F.lit(period)) - period / 2
