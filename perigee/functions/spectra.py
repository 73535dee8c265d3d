"""Residual spectra and band powers: periodogram on regular axes, Lomb-Scargle on others."""

from __future__ import annotations

import numpy as np

from perigee.sources.constituents import BANDS

MOST_PER_BAND = 500
_LOW, _HIGH = np.array(BANDS)[:, 0], np.array(BANDS)[:, 1]


def regular_interval_hours(mjd: np.ndarray) -> float | None:
    """Sampling interval, if the different steps of the axis vary by less than the resolution of doubles."""
    if len(mjd) < 2:
        return None
    steps = np.unique(np.diff(mjd))
    return float(24.0 * (mjd[1] - mjd[0])) if np.mean((steps - steps.mean()) ** 2) < np.finfo(float).eps else None


def fft_frequencies(count: int, interval_hours: float) -> np.ndarray:
    even = count - count % 2
    return np.arange(even // 2 + 1) / (even * interval_hours)


def _band_slices(frequencies: np.ndarray) -> list[slice]:
    """One bin more than lies below the upper edge belongs to a band."""
    start = np.searchsorted(frequencies, _LOW, side="left")
    stop = np.minimum(np.searchsorted(frequencies, _HIGH, side="left") + 1, len(frequencies))
    return [slice(a, b) for a, b in zip(start, stop)]


def lomb_frequencies(hours: np.ndarray) -> np.ndarray:
    n = len(hours)
    length = n * ((hours[-1] - hours[0]) / (n - 1))
    base = np.arange(1, n // 2) / length
    out = []
    for part in (base[s] for s in _band_slices(base)):
        if len(part) > MOST_PER_BAND:
            part = part[0] + (part[-1] - part[0]) * np.arange(MOST_PER_BAND) / (MOST_PER_BAND - 1)
        out.append(part)
    return np.concatenate(out) if out else base[:0]


def nearest_bins(frequencies: np.ndarray, wanted: np.ndarray, regular: bool) -> np.ndarray:
    """Nearest grid index of each wanted frequency; halves go to the even index."""
    if regular and len(frequencies) > 1:
        at = wanted / frequencies[1]
    else:
        at = np.interp(wanted, frequencies, np.arange(len(frequencies)))
    return np.clip(np.rint(at), 0, len(frequencies) - 1).astype(int)


def band_counts(frequencies: np.ndarray, wanted: np.ndarray, regular: bool = False) -> tuple[list[int], list[int]]:
    """Bins per band, and those that no constituent is nearest to."""
    if not len(frequencies):
        return [0] * len(BANDS), [0] * len(BANDS)
    free = np.ones(len(frequencies), bool)
    free[nearest_bins(frequencies, wanted, regular)] = False
    slices = _band_slices(frequencies)
    return [s.stop - s.start if s.stop > s.start else 0 for s in slices], [int(free[s].sum()) for s in slices]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def fft_spectrum(residuals: np.ndarray, interval_hours: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided cross densities (k, k, bins) of ``residuals`` (k, samples); an odd last sample is left out."""
    n = residuals.shape[1] - residuals.shape[1] % 2
    window = hann(n)
    x = residuals[:, :n] - residuals[:, :n].mean(axis=1, keepdims=True)
    transform = np.fft.rfft(x * window, axis=1)
    density = (transform[:, None] * transform[None].conj()).real * (interval_hours / (window @ window))
    density[..., 1:-1] *= 2.0
    return fft_frequencies(n, interval_hours), density


def lomb_power(hours: np.ndarray, x: np.ndarray, frequencies: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Half the sum of the projections of ``x`` on both waves of each frequency, shifted so that they are orthogonal."""
    out, rows = np.empty(len(frequencies)), max(1, block // max(1, len(hours)))
    for a in range(0, len(frequencies), rows):
        angle = 2 * np.pi * frequencies[a : a + rows, None] * hours[None]
        shift = 0.5 * np.arctan2(np.sin(2 * angle).sum(axis=1), np.cos(2 * angle).sum(axis=1))
        c, s = np.cos(angle - shift[:, None]), np.sin(angle - shift[:, None])
        out[a : a + rows] = 0.5 * ((c @ x) ** 2 / (c * c).sum(axis=1) + (s @ x) ** 2 / (s * s).sum(axis=1))
    return out


def lomb_spectrum(residuals: np.ndarray, hours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`fft_spectrum` on any increasing times; the window follows the position within the span."""
    n = residuals.shape[1] - residuals.shape[1] % 2
    x, t = residuals[:, :n], hours[:n]
    span = t[-1] - t[0]
    place = np.clip((t - t[0]) / (span / (n - 1)), 0, n - 1)
    left = np.floor(place).astype(int)
    table = hann(n)
    window = table[left] + (place - left) * (table[np.minimum(left + 1, n - 1)] - table[left])
    x = (x - x.mean(axis=1, keepdims=True)) * window
    frequencies = lomb_frequencies(t)
    angle = 2 * np.pi * frequencies[:, None] * (t - t[0])[None]
    shift = 0.5 * np.arctan2(np.sin(2 * angle).sum(axis=1), np.cos(2 * angle).sum(axis=1))
    c, s = np.cos(angle - shift[:, None]), np.sin(angle - shift[:, None])
    pc, ps = x @ c.T, x @ s.T
    ec, es = (c * c).sum(axis=1), (s * s).sum(axis=1)
    cross = 0.5 * (pc[:, None] * pc[None] / ec + ps[:, None] * ps[None] / es)
    return frequencies, cross * (2.0 * (span / (n - 1)) * n / (window @ window))


def band_power(frequencies: np.ndarray, density: np.ndarray, wanted: np.ndarray, days: float, regular: bool) -> np.ndarray:
    """Mean density of the band of each wanted frequency without constituents' bins, as power over ``days``.

    Outside all bands the power is zero; a band without free bins gives NaN. ``density``: (..., bins).
    """
    free = np.ones(len(frequencies), bool)
    free[nearest_bins(frequencies, wanted, regular)] = False
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.stack([density[..., s][..., free[s]].sum(axis=-1) / np.float64(free[s].sum()) for s in _band_slices(frequencies)], axis=-1)
    inside = (wanted[:, None] >= _LOW) & (wanted[:, None] <= _HIGH)
    first = inside.argmax(axis=1)
    return np.where(inside.any(axis=1), means[..., first], 0.0) / (days * 24.0)
