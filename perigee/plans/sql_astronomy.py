"""Astronomy as SQL text, for comparison in another engine."""

from __future__ import annotations

import math

from perigee.functions.astronomy import DIURNAL, EPOCH_ORDINAL, LEAST_LATITUDE, ORDINAL_AT_MJD_ZERO, POLYNOMIALS, SEMIDIURNAL
from perigee.plans.tables import pmod
from perigee.sources.constituents import BY_NAME


def _d(x: float) -> str:
    return f"({x!r})::DOUBLE"


def argument_sql(mjd: str) -> tuple[list[str], list[str]]:
    days = f"({mjd} + {_d(ORDINAL_AT_MJD_ZERO)} - {_d(EPOCH_ORDINAL)})"
    d = f"({days} / 10000.0::DOUBLE)"
    cycles, rate = [], []
    for a, b, c, e in POLYNOMIALS:
        cycles.append(f"((({_d(a)} + {_d(b)} * {days} + {_d(c)} * {d} * {d} + {_d(e)} * {d} * {d} * {d}) / 360.0::DOUBLE) % 1.0::DOUBLE)")
        rate.append(f"(({_d(b)} + {_d(c * 2e-4)} * {d} + {_d(e * 3e-4)} * {d} * {d}) / 360.0::DOUBLE)")
    tau = f"({pmod(f'{mjd} + {_d(ORDINAL_AT_MJD_ZERO)}', 1.0)} + {cycles[1]} - {cycles[0]})"
    return [tau, *cycles], [f"(1.0::DOUBLE + {rate[1]} - {rate[0]})", *rate]


def factor_sql(latitude: str) -> list[str]:
    s = f"SIN(RADIANS(CASE WHEN ABS({latitude}) < {LEAST_LATITUDE} THEN SIGN({latitude}) * {LEAST_LATITUDE}::DOUBLE ELSE {latitude} END))"
    return ["1.0::DOUBLE", f"({_d(DIURNAL)} * (1 - 5 * {s} * {s}) / {s})", f"({_d(SEMIDIURNAL)} * {s})"]


def phase_sql(name: str, cycles: list[str]) -> str:
    c = BY_NAME[name]
    if c.doodson:
        return f"(({_d(c.phase)} + " + " + ".join(f"{_d(float(k))} * {x}" for k, x in zip(c.doodson, cycles)) + ") % 1.0::DOUBLE)"
    return "(" + " + ".join(f"{_d(k)} * {phase_sql(p, cycles)}" for k, p in c.terms) + ")"


def frequency_sql(name: str, rate: list[str]) -> str:
    c = BY_NAME[name]
    if c.doodson:
        return "((" + " + ".join(f"{_d(float(k))} * {x}" for k, x in zip(c.doodson, rate)) + ") / 24.0::DOUBLE)"
    return "(" + " + ".join(f"{_d(k)} * {frequency_sql(p, rate)}" for k, p in c.terms) + ")"


def nodal_sql(name: str, cycles: list[str], factors: list[str]) -> tuple[str, str]:
    c = BY_NAME[name]
    if c.doodson:
        re, im = ["1.0::DOUBLE"], ["0.0::DOUBLE"]
        for s in c.satellites:
            turn = f"{_d(2 * math.pi)} * (({_d(float(s.delta[0]))} * {cycles[3]} + {_d(float(s.delta[1]))} * {cycles[4]} + {_d(float(s.delta[2]))} * {cycles[5]} + {_d(s.phase)}) % 1.0::DOUBLE)"
            re.append(f"{factors[s.latitude_class]} * {_d(s.ratio)} * COS({turn})")
            im.append(f"{factors[s.latitude_class]} * {_d(s.ratio)} * SIN({turn})")
        return f"({' + '.join(re)})", f"({' + '.join(im)})"
    size, angle = [], []
    for k, parent in c.terms:
        a, b = nodal_sql(parent, cycles, factors)
        size.append(f"{_d(abs(k))} * LN(SQRT({a} * {a} + {b} * {b}))")
        angle.append(f"{_d(k)} * ATAN2({b}, {a})")
    size, angle = " + ".join(size), " + ".join(angle)
    return f"(EXP({size}) * COS({angle}))", f"(EXP({size}) * SIN({angle}))"
