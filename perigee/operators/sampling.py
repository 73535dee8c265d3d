"""Sampling of series: counts, spans, gaps, regularity, spectral grids and bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.operators.options import AnalysisError


def finite(obs: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` all have values (the joint mask of several components)."""
    for c in columns:
        obs = obs.where(F.col(c).isNotNull() & ~F.isnan(F.col(c)))
    return obs


def without_fill(value: Column, fill: float) -> Column:
    """NaN and the fill value (compared after widening a float) become null."""
    return F.when(F.isnan(value) | (value == F.lit(float(np.float32(fill)))), None).otherwise(value)


def valid_latitude(latitude: Column) -> Column:
    return F.coalesce(~F.isnan(latitude) & latitude.between(-90, 90) & (latitude != 0), F.lit(False))


def time_axis(times: DataFrame, time: str = "mjd") -> DataFrame:
    """time_index, mjd: the distinct finite times in order. An axis is one bounded table, so one task numbers it."""
    return finite(times.select(time), time).distinct().withColumn("time_index", (F.row_number().over(Window.orderBy(time)) - 1).cast("int")).select("time_index", time)


def check_increasing(obs: DataFrame, series: str = "series_id", time: str = "mjd") -> None:
    """Raise unless every series has each time once."""
    if not obs.groupBy(series, time).count().where("count > 1").isEmpty():
        raise AnalysisError("time_axis", "times must increase within a series")


def series_sampling(obs: DataFrame, series: str = "series_id", time: str = "mjd") -> DataFrame:
    """Per series: n_obs, first, last, reference, span_days, mean_step_hours, largest_gap_hours."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(series).orderBy(time))
    return (
        obs.select(series, time, step.alias("step"))
        .groupBy(series)
        .agg(
            F.count(time).alias("n_obs"),
            F.min(time).alias("first_mjd"),
            F.max(time).alias("last_mjd"),
            ((F.min(time) + F.max(time)) / 2).alias("reference_mjd"),
            (F.max(time) - F.min(time)).alias("span_days"),
            (24.0 * (F.max(time) - F.min(time)) / F.nullif(F.count(time) - 1, F.lit(0))).alias("mean_step_hours"),
            (24.0 * F.max("step")).alias("largest_gap_hours"),
        )
    )


def sampling_summary(sampled: DataFrame, least_rows: int) -> DataFrame:
    """One row over all series: how many, how many can be fitted, extremes of counts, spans and gaps."""
    return sampled.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("n_obs") >= least_rows).alias("n_fitted"),
        F.min("n_obs").alias("min_obs"),
        F.max("n_obs").alias("max_obs"),
        F.min("span_days").alias("min_span"),
        F.max("span_days").alias("max_span"),
        F.max("largest_gap_hours").alias("max_gap"),
    )


def axis_regularity(axis: DataFrame, time: str = "mjd") -> DataFrame:
    """n_times, n_steps (different ones), step_variance, regular: whether the different steps vary by less than a double's resolution."""
    steps = axis.select((F.col(time) - F.lag(time).over(Window.orderBy(time))).alias("step")).where("step IS NOT NULL").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return steps.agg((F.sum("n") + 1).alias("n_times"), F.count(F.lit(1)).alias("n_steps"), F.var_pop("step").alias("step_variance")).withColumn("regular", F.col("step_variance") < F.lit(2.220446049250313e-16))


def fft_grid(sampled: DataFrame, series: str = "series_id", interval_hours: float = 1.0) -> DataFrame:
    """series_id, bin, frequency: grid of an even count of samples, ``n`` of each series."""
    even = F.col("n") - F.col("n") % 2
    return sampled.select(series, even.alias("even"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(even / 2))).alias("bin")).select(series, "bin", (F.col("bin") / (F.col("even") * F.lit(interval_hours))).alias("frequency"))


def lomb_grid(sampled: DataFrame, series: str = "series_id") -> DataFrame:
    """series_id, bin, frequency: i / (n dt) for i from 1 to n/2 - 1."""
    length = F.col("n_obs") * F.col("span_days") * 24.0 / (F.col("n_obs") - 1)
    last = F.floor(F.col("n_obs") / 2) - 1
    return sampled.where(last >= 1).select(series, F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("bin"), length.alias("length")).select(series, "bin", (F.col("bin") / F.col("length")).alias("frequency"))


def banded(grid: DataFrame, bands: DataFrame, series: str = "series_id") -> DataFrame:
    """``grid`` with the bands each bin belongs to; a band takes one bin more than lies below its upper edge."""
    before = F.lag("frequency").over(Window.partitionBy(series).orderBy("bin"))
    near = grid.withColumn("before", before)
    # Nine bands, a fixed number: a range join with a broadcast side.
    return near.join(F.broadcast(bands), (F.col("frequency") >= F.col("lower")) & (F.coalesce(F.col("before"), F.lit(-1.0)) < F.col("upper")))


def band_counts(grid: DataFrame, bands: DataFrame, frequencies: list[float], series: str = "series_id") -> DataFrame:
    """series_id, band, bins, usable: bins per band, and those that no constituent is nearest to on a regular grid."""
    step = F.min(F.when(F.col("bin") == 1, F.col("frequency"))).over(Window.partitionBy(series))
    taken = F.array(*(F.rint(F.lit(f) / step).cast("long") for f in frequencies))
    return banded(grid.withColumn("taken", F.array_contains(taken, F.col("bin"))), bands, series).groupBy(series, "band").agg(F.count(F.lit(1)).alias("bins"), F.count_if(~F.col("taken")).alias("usable"))


def fill_gaps(series: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """``filled``: linear interpolation over ``index`` of missing values, constant beyond the ends."""
    back = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(index))
    a, b, ia, ib = F.last(value, True).over(back), F.first(value, True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = F.when(ia == ib, a).otherwise(a + (b - a) * (F.col(index) - ia) / (ib - ia))
    return series.withColumn("filled", F.coalesce(between, a, b))
