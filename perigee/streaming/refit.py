"""Near-real-time refits, an extension: moments of a one-constituent model in event-time windows.

The model is linear in its moments, so a window's fit needs only sums: watermarked windowed aggregation in
a stream, the same aggregation in a batch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.time import from_timestamp
from perigee.operators import moments
from perigee.sources.constituents import BY_NAME

_COLUMNS = ["c", "s", "one"]


def window_moments(events: DataFrame, ts: str, key: str, value: str, days: int, name: str = "M2", late: str | None = None) -> DataFrame:
    """series_id, window and the sums of the normal equations; with ``late`` (a duration) for a stream."""
    timed = events.select(F.col(key).alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), from_timestamp(F.col(ts).cast("timestamp_ntz")).alias("mjd"), F.col(value).cast("double").alias("y"))
    timed = timed.withWatermark("ts", late) if late else timed
    angle = F.lit(2 * math.pi * 24 * BY_NAME[name].frequency) * F.col("mjd")
    design = timed.withColumns({"c": F.cos(angle), "s": F.sin(angle), "one": F.lit(1.0)})
    return design.groupBy("series_id", F.window("ts", f"{days} days")).agg(*map(F.expr, moments.moment_expressions(_COLUMNS, ["y"])))


def solve_windows(sums: DataFrame) -> DataFrame:
    """series_id, window start, n_obs, amplitude, mean of windows with enough rows."""
    table = sums.where(f"n_obs > {len(_COLUMNS) + 1}")
    for step in moments.solution_steps(len(_COLUMNS), 1):
        table = table.withColumns({n: F.expr(e) for n, e in step})
    return table.select("series_id", F.col("window.start").alias("window_start"), "n_obs", F.round(F.hypot("b_0_0", "b_1_0"), 5).alias("amplitude"), F.round("b_2_0", 5).alias("mean"))


def refit_windows(events: DataFrame, ts: str, key: str, value: str, days: int) -> DataFrame:
    return solve_windows(window_moments(events, ts, key, value, days))


def refit_stream(events: DataFrame, ts: str, key: str, value: str, days: int, late: str = "1 hour") -> DataFrame:
    """A streaming frame of fits, emitted when a window is complete; write it in append mode."""
    return solve_windows(window_moments(events, ts, key, value, days, late=late))
