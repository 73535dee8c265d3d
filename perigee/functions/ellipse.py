"""Current ellipses from component coefficients and back, with linearised errors; for arrays and as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def from_coefficients(uc, us, vc, vs):
    """Semi-major, signed semi-minor, inclination in [0, 180), phase in [0, 360)."""
    plus, minus = (uc + vs + 1j * (vc - us)) / 2, (uc - vs + 1j * (vc + us)) / 2
    a, b = np.degrees(np.angle(plus)), np.degrees(np.angle(minus))
    tilt = np.mod((a + b) / 2, 180.0)
    return np.abs(plus) + np.abs(minus), np.abs(plus) - np.abs(minus), tilt, np.mod(tilt - a, 360.0)


def to_coefficients(major, minor, inclination, phase):
    g, th = np.radians(phase), np.radians(inclination)
    plus = (major + minor) / 2 * np.exp(1j * (th - g))
    minus = (major - minor) / 2 * np.exp(1j * (th + g))
    both, apart = plus + minus, plus - minus
    return both.real, -apart.imag, both.imag, apart.real


def sigmas(uc, us, vc, vs, variances):
    """Standard errors of semi-major, semi-minor, phase and inclination (degrees) from the coefficients' variances."""
    plus, minus = np.hypot(uc + vs, vc - us) / 2, np.hypot(uc - vs, vc + us) / 2
    e, f, g, h = (uc + vs) / plus, (uc - vs) / minus, (us - vc) / plus, (us + vc) / minus
    spread = lambda d: np.sqrt(sum(x * x * v for x, v in zip(d, variances)))
    major = spread([(e + f) / 4, (g + h) / 4, (h - g) / 4, (e - f) / 4])
    minor = spread([(e - f) / 4, (g - h) / 4, (h + g) / 4, (e + f) / 4])
    n, d = 2 * (uc * us + vc * vs), uc**2 - us**2 + vc**2 - vs**2
    phase = np.degrees(spread([d * us - n * uc, d * uc + n * us, d * vs - n * vc, d * vc + n * vs]) / (n * n + d * d))
    n, d = 2 * (uc * vc + us * vs), uc**2 + us**2 - vc**2 - vs**2
    tilt = np.degrees(spread([d * vc - n * uc, d * vs - n * us, d * uc + n * vc, d * us + n * vs]) / (n * n + d * d))
    return major, minor, phase, tilt


def ellipse_columns(uc: Column, us: Column, vc: Column, vs: Column) -> tuple[Column, Column, Column, Column]:
    pr, pi, mr, mi = (uc + vs) / 2, (vc - us) / 2, (uc - vs) / 2, (vc + us) / 2
    plus, minus = F.hypot(pr, pi), F.hypot(mr, mi)
    a, b = F.degrees(F.atan2(pi, pr)), F.degrees(F.atan2(mi, mr))
    tilt = F.pmod((a + b) / 2, F.lit(180.0))
    return plus + minus, plus - minus, tilt, F.pmod(tilt - a, F.lit(360.0))


def coefficient_columns(major: Column, minor: Column, inclination: Column, phase: Column) -> tuple[Column, Column, Column, Column]:
    ct, st, cg, sg = F.cos(F.radians(inclination)), F.sin(F.radians(inclination)), F.cos(F.radians(phase)), F.sin(F.radians(phase))
    return major * ct * cg + minor * st * sg, major * ct * sg - minor * st * cg, major * st * cg - minor * ct * sg, major * st * sg + minor * ct * cg
