"""Astronomical arguments, frequencies, phases and nodal corrections, for arrays and as column expressions.

Times are Modified Julian Days. Phases are in cycles, frequencies in cycles per hour.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.sources.constituents import BY_NAME, Constituent

# Ordinal day of MJD 0, ordinal day of the polynomials' epoch, and per argument (lunar longitude, solar
# longitude, lunar perigee, negative node, solar perigee) the coefficients in degrees.
ORDINAL_AT_MJD_ZERO = 678576.0
EPOCH_ORDINAL = 693595.5
POLYNOMIALS = (
    (270.434164, 13.1763965268, -0.0000850, 0.000000039),
    (279.696678, 0.9856473354, 0.00002267, 0.0),
    (334.329556, 0.1114040803, -0.0007739, -0.00000026),
    (-259.183275, 0.0529539222, -0.0001557, -0.000000050),
    (281.220844, 0.0000470684, 0.0000339, 0.000000070),
)
# Latitude factors of diurnal and semidiurnal satellites.
DIURNAL, SEMIDIURNAL, LEAST_LATITUDE = 0.36309, 2.59808, 5.0


def arguments(mjd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six cycles and six cycles per day at each time: arrays of shape (6, times)."""
    mjd = np.atleast_1d(np.asarray(mjd, float))
    days = mjd + ORDINAL_AT_MJD_ZERO - EPOCH_ORDINAL
    d = days / 10000.0
    c = np.array(POLYNOMIALS)
    place = np.stack([np.ones_like(d), days, d * d, d**3])
    speed = np.stack([np.zeros_like(d), np.ones_like(d), 2e-4 * d, 3e-4 * d * d])
    cycles, rate = np.fmod(c @ place / 360.0, 1.0), c @ speed / 360.0
    tau = np.mod(mjd + ORDINAL_AT_MJD_ZERO, 1.0) + cycles[1] - cycles[0]
    return np.vstack([tau, cycles]), np.vstack([1.0 + rate[1] - rate[0], rate])


def latitude_factors(latitude: float) -> np.ndarray:
    near = np.sign(latitude) * LEAST_LATITUDE if abs(latitude) < LEAST_LATITUDE else latitude
    s = np.sin(np.radians(near))
    return np.array([1.0, DIURNAL * (1 - 5 * s * s) / s, SEMIDIURNAL * s])


@lru_cache(maxsize=256)
def _parents(names: tuple[str, ...]) -> tuple[tuple[Constituent, ...], np.ndarray]:
    """Base constituents that are needed, and the matrix of coefficients from them to ``names``."""
    chosen = [BY_NAME[n] for n in names]
    base = list(dict.fromkeys(p for c in chosen for p in ([c.name] if c.doodson else [t for _, t in c.terms])))
    mix = np.zeros((len(names), len(base)))
    for i, c in enumerate(chosen):
        for k, parent in [(1.0, c.name)] if c.doodson else c.terms:
            mix[i, base.index(parent)] += k
    return tuple(BY_NAME[b] for b in base), mix


class TimeTerms:
    """What depends on times only: phases and satellite sums of the base constituents; latitude comes later."""

    def __init__(self, names: tuple[str, ...], mjd: np.ndarray):
        self.base, self.mix = _parents(names)
        cycles, rate = arguments(mjd)
        doodson = np.array([c.doodson for c in self.base], float).reshape(-1, 6)
        self.base_phase = np.fmod(doodson @ cycles + np.array([[c.phase] for c in self.base]), 1.0)
        self.base_frequency = doodson @ rate / 24.0
        self.terms = np.zeros((3, len(self.base), cycles.shape[1]), complex)
        for i, c in enumerate(self.base):
            for s in c.satellites:
                turn = np.fmod(s.delta[0] * cycles[3] + s.delta[1] * cycles[4] + s.delta[2] * cycles[5] + s.phase, 1.0)
                self.terms[s.latitude_class, i] += s.ratio * np.exp(2j * np.pi * turn)

    @property
    def phase(self) -> np.ndarray:
        return self.mix @ self.base_phase

    @property
    def frequency(self) -> np.ndarray:
        return self.mix @ self.base_frequency

    def nodal(self, latitude: float) -> np.ndarray:
        """Complex corrections (names, times); compounds multiply factors by |coefficient| and add angles by coefficient."""
        base = 1.0 + np.tensordot(latitude_factors(latitude), self.terms, 1)
        if np.array_equal(self.mix, np.eye(len(self.mix))):
            return base
        return np.exp(np.abs(self.mix) @ np.log(np.abs(base)) + 1j * (self.mix @ np.angle(base)))


    def nodal_many(self, latitudes: np.ndarray) -> np.ndarray:
        """Corrections (latitudes, names, times), as :meth:`nodal` of each."""
        factors = np.stack([latitude_factors(x) for x in latitudes])
        base = 1.0 + np.tensordot(factors, self.terms, 1)
        if np.array_equal(self.mix, np.eye(len(self.mix))):
            return base
        return np.exp(np.abs(self.mix) @ np.log(np.abs(base)) + 1j * (self.mix @ np.angle(base)))


def argument_columns(mjd: Column) -> tuple[list[Column], list[Column]]:
    """The six cycles and the six cycles per day as column expressions."""
    days = mjd + F.lit(ORDINAL_AT_MJD_ZERO) - F.lit(EPOCH_ORDINAL)
    d = days / F.lit(10000.0)
    cycles, rate = [], []
    for a, b, c, e in POLYNOMIALS:
        cycles.append(((F.lit(a) + F.lit(b) * days + F.lit(c) * d * d + F.lit(e) * d * d * d) / F.lit(360.0)) % F.lit(1.0))
        rate.append((F.lit(b) + F.lit(c) * F.lit(2e-4) * d + F.lit(e) * F.lit(3e-4) * d * d) / F.lit(360.0))
    tau = F.pmod(mjd + F.lit(ORDINAL_AT_MJD_ZERO), F.lit(1.0)) + cycles[1] - cycles[0]
    return [tau, *cycles], [F.lit(1.0) + rate[1] - rate[0], *rate]


def latitude_factor_columns(latitude: Column) -> list[Column]:
    near = F.when(F.abs(latitude) < LEAST_LATITUDE, F.signum(latitude) * LEAST_LATITUDE).otherwise(latitude)
    s = F.sin(F.radians(near))
    return [F.lit(1.0), F.lit(DIURNAL) * (1 - 5 * s * s) / s, F.lit(SEMIDIURNAL) * s]


def phase_column(name: str, cycles: list[Column]) -> Column:
    c = BY_NAME[name]
    if c.doodson:
        total = F.lit(c.phase)
        for k, x in zip(c.doodson, cycles):
            total = total + F.lit(float(k)) * x
        return total % F.lit(1.0)
    total = F.lit(0.0)
    for k, parent in c.terms:
        total = total + F.lit(k) * phase_column(parent, cycles)
    return total


def frequency_column(name: str, rate: list[Column]) -> Column:
    c, total = BY_NAME[name], F.lit(0.0)
    if c.doodson:
        for k, x in zip(c.doodson, rate):
            total = total + F.lit(float(k)) * x
        return total / F.lit(24.0)
    for k, parent in c.terms:
        total = total + F.lit(k) * frequency_column(parent, rate)
    return total


def nodal_columns(name: str, cycles: list[Column], factors: list[Column]) -> tuple[Column, Column]:
    """Real and imaginary part of the nodal correction."""
    c = BY_NAME[name]
    if c.doodson:
        re, im = F.lit(1.0), F.lit(0.0)
        for s in c.satellites:
            turn = (F.lit(float(s.delta[0])) * cycles[3] + F.lit(float(s.delta[1])) * cycles[4] + F.lit(float(s.delta[2])) * cycles[5] + F.lit(s.phase)) % F.lit(1.0)
            re = re + factors[s.latitude_class] * F.lit(s.ratio) * F.cos(turn * (2 * np.pi))
            im = im + factors[s.latitude_class] * F.lit(s.ratio) * F.sin(turn * (2 * np.pi))
        return re, im
    return compound_columns(name, {parent: nodal_columns(parent, cycles, factors) for _, parent in c.terms})


def compound_columns(name: str, parents: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """A shallow-water constituent's correction from its parents' ones."""
    size, angle = F.lit(0.0), F.lit(0.0)
    for k, parent in BY_NAME[name].terms:
        a, b = parents[parent]
        size = size + F.lit(abs(k)) * F.ln(F.hypot(a, b))
        angle = angle + F.lit(k) * F.atan2(b, a)
    return F.exp(size) * F.cos(angle), F.exp(size) * F.sin(angle)
