"""Options of a fit, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from perigee.sources.constituents import BY_NAME

# Tuning constants of the robust weight functions.
TUNING = {"andrews": 1.339, "bisquare": 4.685, "cauchy": 2.385, "fair": 1.4, "huber": 1.345, "logistic": 1.205, "ols": 1.0, "talwar": 2.795, "welsch": 2.985}


class AnalysisError(ValueError):
    """A request or an input that can't be analysed; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _need(ok: bool, code: str, message: str) -> None:
    if not ok:
        raise AnalysisError(code, message)


@dataclass(frozen=True)
class Relation:
    """An inferred constituent as a fixed ratio and phase lag (degrees) of a reference; vectors have a second pair."""

    inferred: str
    reference: str
    ratio: float
    phase: float
    negative_ratio: float | None = None
    negative_phase: float | None = None


@dataclass(frozen=True)
class PreFilter:
    """A known real response: gains at increasing frequencies (cycles per hour), the accepted range, what holds beyond."""

    frequency: tuple[float, ...]
    gain: tuple[float, ...]
    low: float = 0.01
    high: float = 100.0
    fallback: str = "error"

    def __post_init__(self) -> None:
        _need(len(self.frequency) == len(self.gain) >= 2, "prefilter", "needs two points at least, as many gains as frequencies")
        _need(all(a < b for a, b in zip(self.frequency, self.frequency[1:])), "prefilter", "frequencies must increase")
        _need(0 < self.low <= self.high, "prefilter", "the accepted range must be positive")
        _need(self.fallback in ("error", "unity"), "prefilter", "fallback is error or unity")

    @classmethod
    def from_mapping(cls, given: dict) -> "PreFilter":
        """Keys frequency_cph, gain, acceptable_gain_range, fallback, or frq, P, rng; others are refused."""
        names = {"frequency_cph": "frequency", "frq": "frequency", "gain": "gain", "P": "gain", "acceptable_gain_range": "range", "rng": "range", "fallback": "fallback"}
        _need(set(given) <= set(names), "prefilter", f"unknown keys {sorted(set(given) - set(names))}")
        found = {names[k]: v for k, v in given.items()}
        low, high = found.pop("range", (0.01, 100.0))
        return cls(tuple(map(float, found["frequency"])), tuple(map(float, found["gain"])), float(low), float(high), found.get("fallback", "error"))


@dataclass(frozen=True)
class FitOptions:
    constituents: tuple[str, ...] | None = None
    """None: chosen by the Rayleigh criterion on each record's span."""
    rayleigh_min: float = 1.0
    trend: bool = True
    phase: str = "greenwich"
    nodal: str = "exact"
    method: str = "ols"
    weight_function: str = "cauchy"
    tuning: float | None = None
    tolerance: float = 0.001
    max_iterations: int = 50
    confidence: str = "none"
    noise: str = "colored"
    realizations: int = 200
    seed: int = 0
    order: str | tuple[str, ...] | None = "pe"
    infer: tuple[Relation, ...] = ()
    approximate: bool = False
    prefilter: PreFilter | None = None
    diagnostics: bool = False
    diagnostic_min_snr: float = 2.0
    axis: str = "own"
    """own: each series is a record of its own; shared: series are masked views of one time axis."""
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.constituents is not None:
            unknown = [x for x in self.constituents if x not in BY_NAME]
            _need(not unknown, "unknown_constituent", ", ".join(unknown))
            _need(len(set(self.constituents)) == len(self.constituents) > 0, "duplicate_constituent", "names must be unique and at least one")
        for name, allowed in (("phase", ("greenwich", "linear_time", "raw")), ("nodal", ("exact", "linear_time", "disabled")), ("method", ("ols", "robust")), ("confidence", ("none", "linear", "monte_carlo")), ("noise", ("white", "colored")), ("axis", ("own", "shared"))):
            _need(getattr(self, name) in allowed, f"invalid_{name}", f"{getattr(self, name)!r} isn't one of {allowed}")
        _need(self.weight_function in TUNING, "invalid_weight_function", self.weight_function)
        _need(self.rayleigh_min > 0, "invalid_rayleigh_minimum", str(self.rayleigh_min))
        _need(self.tolerance > 0 and self.max_iterations > 0, "invalid_robust_options", "tolerance and iterations must be positive")
        _need(self.realizations >= 2, "invalid_monte_carlo", "two realizations at least")
        _need(self.order != "snr" or self.confidence != "none", "order_needs_confidence", "order by SNR needs confidence intervals")
        seen: set[str] = set()
        for r in self.infer:
            _need(r.inferred in BY_NAME and r.reference in BY_NAME, "unknown_constituent", f"{r.inferred}, {r.reference}")
            _need(r.inferred != r.reference, "self_reference", r.inferred)
            _need(r.inferred not in seen, "duplicate_inferred", r.inferred)
            seen.add(r.inferred)
        _need(not seen & {r.reference for r in self.infer}, "inferred_as_reference", "an inferred constituent can't be a reference")

    @property
    def tuning_constant(self) -> float:
        return TUNING[self.weight_function] if self.tuning is None else self.tuning

    def layout(self, names: tuple[str, ...]) -> tuple[tuple[str, ...], int, tuple[tuple[int, Relation | None], ...]]:
        """Fitted names (ordinary ones, then references first seen first), how many are ordinary, and per output its
        fitted source with its relation; inferred ones follow, grouped by reference."""
        inferred = {r.inferred for r in self.infer}
        references = list(dict.fromkeys(r.reference for r in self.infer))
        ordinary = [n for n in names if n not in inferred and n not in references]
        fitted = (*ordinary, *references)
        outputs: list[tuple[int, Relation | None]] = [(i, None) for i in range(len(fitted))]
        for k, reference in enumerate(references):
            outputs += [(len(ordinary) + k, r) for r in self.infer if r.reference == reference]
        return fitted, len(ordinary), tuple(outputs)

    @property
    def minimum_rows(self):
        return lambda fitted: 2 * fitted + 1 + int(self.trend) + 1
