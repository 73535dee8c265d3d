"""Spectra of series: one shuffle packs a series into an array by time, the transform runs over Arrow batches.

A series' samples and one block of frequencies are in memory at a time; rows are only made for the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.spectra import fft_spectrum, lomb_power

_SCHEMA = "bin long, frequency double, {value} double"


def _packed(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    known = series.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    points = F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("x"))))
    return known.groupBy(F.col(key).alias(key)).agg(points.alias("points"))


def _each(packed: DataFrame, key: str, name: str, spectrum: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (key, bin, frequency, ``name``) of ``spectrum(t, x)``."""
    kind = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("points")
            t, x = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            bounds = lists.offsets.to_numpy()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                bins, frequency, found = spectrum(t[a:b], x[a:b])
                keys = pa.chunked_array([batch.column(key).slice(i, 1)]).take(pa.array(np.zeros(len(bins), np.int64))).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, pa.array(bins, pa.int64()), pa.array(frequency), pa.array(found)], names=[key, "bin", "frequency", name])

    return packed.mapInArrow(run, f"`{key}` {kind}, " + _SCHEMA.format(value=name))


def periodogram(series: DataFrame, key: str, index: str, value: str, interval_hours: float = 1.0) -> DataFrame:
    """key, bin, frequency, density: one-sided, of values without their mean times the periodic Hann window, in the order of
    ``index``; an odd last sample is left out, the first and last bin aren't doubled. A series below two samples has none."""

    def one(_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(x) < 2:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        frequency, density = fft_spectrum(x[None], interval_hours)
        return np.arange(len(frequency)), frequency, density[0, 0]

    return _each(_packed(series, key, index, value), key, "density", one)


def lomb(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, bin, frequency, power: half the sum of the projections on both phase-shifted waves, not normalised, at
    i / (n dt) for i from 1 to n/2 - 1; ``time`` in days, frequencies an hour."""

    def one(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(t)
        bins = np.arange(1, n // 2)
        hours = 24.0 * (t - t[0])
        frequency = bins / (n * hours[-1] / (n - 1)) if len(bins) else np.zeros(0)
        return bins, frequency, lomb_power(hours, x, frequency)

    return _each(_packed(series, key, time, value), key, "power", one)
