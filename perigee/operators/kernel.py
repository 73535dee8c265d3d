"""Numerical kernel of one record: design, least squares, robust weights, uncertainty, diagnostics.

Pure arrays; the distributed side is in :mod:`perigee.operators.fit`. A model value is cosine coefficient times the real
part of the basis plus sine coefficient times its imaginary part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from perigee.functions import ellipse
from perigee.functions.astronomy import TimeTerms
from perigee.functions.ellipse import Z95
from perigee.functions.spectra import band_power, fft_spectrum, lomb_spectrum, regular_interval_hours
from perigee.operators.options import AnalysisError, FitOptions, PreFilter
from perigee.sources.constituents import CATALOG

MAD = 0.6745


@dataclass(frozen=True)
class Record:
    """The times of a series within its axis. With ``interval`` the spectrum is taken on the whole regular axis."""

    mjd: np.ndarray
    reference: float
    span: float
    interval: float | None
    positions: np.ndarray
    full: int

    @classmethod
    def make(cls, mjd: np.ndarray, axis: np.ndarray | None = None) -> "Record":
        """``axis``: the shared axis that ``mjd`` is part of; a regular one keeps its reference, span and grid."""
        grid = mjd if axis is None else axis
        interval = regular_interval_hours(grid)
        if axis is not None and interval is None:
            grid = mjd
        positions = np.searchsorted(grid, mjd)
        return cls(mjd, float((grid[0] + grid[-1]) / 2), float(grid[-1] - grid[0]), interval, positions, len(grid))

    @property
    def effective_days(self) -> float:
        return self.span * self.full / (self.full - 1)

    def band_powers(self, residuals: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
        """Cross powers (k, k, constituents) of weighted residuals (k, rows)."""
        if self.interval is not None:
            grid = np.arange(self.full)
            filled = np.stack([np.interp(grid, self.positions, r) for r in residuals])
            f, density = fft_spectrum(filled, self.interval)
        else:
            f, density = lomb_spectrum(residuals, 24.0 * self.mjd)
        return band_power(f, density, frequencies, self.effective_days, self.interval is not None)


def rayleigh(span_days: float, least: float) -> tuple[str, ...]:
    limit = least / (24.0 * span_days)
    names = tuple(c.name for c in CATALOG if c.separation >= limit)
    if not names:
        raise AnalysisError("empty_constituents", "the record is too short for any constituent")
    return names


def gains(frequencies: np.ndarray, response: PreFilter | None) -> np.ndarray:
    if response is None:
        return np.ones(len(frequencies))
    grid, values = np.array(response.frequency), np.array(response.gain)
    inside = (frequencies >= grid[0]) & (frequencies <= grid[-1])
    g = np.interp(frequencies, grid, values)
    fine = inside & (np.abs(g) >= response.low) & (np.abs(g) <= response.high)
    if response.fallback == "error" and not fine.all():
        raise AnalysisError("prefilter_gain", "a constituent's gain isn't known or isn't accepted")
    return np.where(fine, g, 1.0)


def basis(terms: TimeTerms, at_reference: TimeTerms, mjd: np.ndarray, reference: float, latitude: float, options: FitOptions) -> tuple[np.ndarray, np.ndarray]:
    """Complex basis (constituents, times) and the frequencies at the reference time."""
    if not np.isfinite(latitude) or abs(latitude) > 90 or latitude == 0:
        raise AnalysisError("invalid_latitude", str(latitude))
    frequency = at_reference.frequency[:, 0]
    if (frequency <= 0).any() or len(np.unique(frequency)) < len(frequency):
        raise AnalysisError("invalid_frequency", "frequencies must be positive and different")
    advance = 24.0 * frequency[:, None] * (mjd - reference)[None]
    phase = {"greenwich": lambda: terms.phase, "linear_time": lambda: at_reference.phase + advance, "raw": lambda: advance}[options.phase]()
    nodal = {"exact": lambda: terms.nodal(latitude), "linear_time": lambda: at_reference.nodal(latitude), "disabled": lambda: 1.0}[options.nodal]()
    return gains(frequency, options.prefilter)[:, None] * nodal * np.exp(2j * np.pi * phase), frequency


def robust_weight(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    small = x <= np.sqrt(np.finfo(float).eps)
    safe = np.where(small, 1.0, x)
    return {
        "andrews": lambda: np.where(x >= np.pi, 0.0, np.where(small, 1.0, np.sin(safe) / safe)),
        "bisquare": lambda: np.where(x >= 1, 0.0, (1 - np.minimum(x, 1) ** 2) ** 2),
        "cauchy": lambda: 1 / (1 + x * x),
        "fair": lambda: 1 / (1 + x),
        "huber": lambda: 1 / np.maximum(x, 1),
        "logistic": lambda: np.where(small, 1.0, np.tanh(safe) / safe),
        "ols": lambda: np.ones_like(x),
        "talwar": lambda: (x < 1).astype(float),
        "welsch": lambda: np.exp(-x * x),
    }[name]()


def _complex_median(values: np.ndarray) -> complex:
    """Middle of the order by real, then imaginary part."""
    v = values[np.lexsort((values.imag, values.real))]
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@dataclass
class Fit:
    """Coefficients (columns, right-hand sides), weights by row, and how a robust fit ended."""

    design: np.ndarray
    coefficients: np.ndarray
    weights: np.ndarray
    iterations: int = 0
    termination: str = "ols"
    scale: float | None = None
    rms: float | None = None
    leverage: np.ndarray | None = None

    def fitted(self) -> np.ndarray:
        return self.design @ self.coefficients

    def inverse(self) -> np.ndarray:
        """Inverse of the weighted normal matrix."""
        x = self.design
        return np.linalg.inv(x.conj().T @ (self.weights[:, None] * x))


def least_squares(design: np.ndarray, data: np.ndarray, options: FitOptions) -> Fit:
    """Ordinary, or iteratively reweighted with one weight per row for all right-hand sides.

    Weights multiply rows of design and data; the objective is the mean of squared weighted residuals by weight.
    """
    rows, columns = design.shape
    if rows <= columns:
        raise AnalysisError("too_few_observations", f"{rows} rows for {columns} columns")
    q, r = np.linalg.qr(design)
    if np.abs(np.diag(r)).min() <= np.finfo(float).eps * max(design.shape) * np.abs(np.diag(r)).max():
        raise AnalysisError("rank_deficient", "the model isn't identifiable on these times")
    beta, weights = np.linalg.solve(r, q.conj().T @ data), np.ones(rows)
    if options.method == "ols":
        return Fit(design, beta, weights)
    leverage = (np.abs(q) ** 2).sum(axis=1)
    if (leverage >= 1).any():
        raise AnalysisError("full_leverage", "an observation determines a coefficient alone")
    factor = 1 / (options.tuning_constant * np.sqrt(1 - leverage))
    before: tuple | None = None
    scale, rms = None, 0.0
    for index in range(options.max_iterations):
        if index:
            beta = np.linalg.lstsq(weights[:, None] * design, weights[:, None] * data, rcond=None)[0]
        residual = data - design @ beta
        size = np.sqrt((np.abs(residual) ** 2).sum(axis=1))
        objective = float(((weights * size) ** 2).sum() / weights.sum())
        if index == 0:
            rms = float(np.sqrt((size**2).mean()))
        if before is not None:
            gain = (before[0] - objective) / before[0]
            if gain < 0:
                return Fit(design, before[1], before[2], index, "objective_increase", before[3], rms, leverage)
            if gain < options.tolerance:
                return Fit(design, beta, weights, index + 1, "tolerance", scale, rms, leverage)
        flat = residual[:, 0] if residual.shape[1] == 1 else residual[:, 0] + 1j * residual[:, 1]
        middle = _complex_median(flat) if np.iscomplexobj(flat) else np.median(flat)
        spread = float(np.median(np.abs(flat - middle)) / MAD)
        if spread == 0.0:
            if (size <= 64 * np.finfo(float).eps * max(1.0, float(np.abs(data).max())) * rows).all():
                return Fit(design, beta, weights, index + 1, "exact_fit", scale, rms, leverage)
            raise AnalysisError("degenerate_robust_scale", "half of the residuals are equal")
        before = (objective, beta, weights, scale)
        weights, scale = robust_weight(options.weight_function, factor * size / spread), spread
    raise AnalysisError("robust_did_not_converge", f"{options.max_iterations} iterations")


def _positive_definite(c: np.ndarray) -> np.ndarray:
    """Cholesky factor of the nearest covariance: negative eigenvalues go, a least increment makes it definite."""
    c = (c + c.T) / 2
    try:
        return np.linalg.cholesky(c)
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh(c)
        c = (vector * np.maximum(value, 0)) @ vector.T
        most = np.abs(value).max()
        step = max(np.nextafter(most, np.inf) - most, np.finfo(float).tiny)
        for k in range(1, 101):
            try:
                return np.linalg.cholesky((c + c.T) / 2 + np.eye(len(c)) * step * k)
            except np.linalg.LinAlgError:
                continue
        raise AnalysisError("covariance", "can't be repaired") from None


def _clustered(degrees: np.ndarray, fitted: float) -> np.ndarray:
    """Angles around the fitted one, which takes the first draw's place."""
    x = degrees.copy()
    x[0] = fitted
    return x[0] + np.mod(x - x[0] + 180.0, 360.0) - 180.0


def _mad_interval(x: np.ndarray) -> float:
    return float(Z95 * np.median(np.abs(x - np.median(x))) / MAD)


def _draws(mean: np.ndarray, covariance: np.ndarray, options: FitOptions, stream: int, constituent: int) -> np.ndarray:
    """Normal draws that depend on seed, series and constituent only, not on where they are made."""
    rng = np.random.Generator(np.random.Philox(key=[(options.seed * 0x9E3779B97F4A7C15 + stream) % 2**64, constituent]))
    return mean + rng.standard_normal((options.realizations, len(mean))) @ _positive_definite(covariance).T


class Model:
    """Everything of a record that doesn't depend on observations."""

    def __init__(self, record: Record, latitude: float, names: tuple[str, ...], options: FitOptions, terms: TimeTerms, at_reference: TimeTerms):
        self.record, self.options = record, options
        self.fitted, self.ordinary, self.outputs = options.layout(names)
        self.names = (*self.fitted, *(r.inferred for _, r in self.outputs if r is not None))
        self.values, self.frequency = basis(terms, at_reference, record.mjd, record.reference, latitude, options)
        self.k = len(self.fitted)
        self.source = np.array([s for s, _ in self.outputs])
        turn = lambda a, g: (1.0 if a is None else a) * np.exp(1j * np.radians(g or 0.0))
        self.plus = np.array([1.0 if r is None else turn(r.ratio, r.phase) for _, r in self.outputs], complex)
        self.minus = np.array([1.0 if r is None else np.conj(turn(r.ratio if r.negative_ratio is None else r.negative_ratio, r.phase if r.negative_phase is None else r.negative_phase)) for _, r in self.outputs], complex)
        affine = [np.ones(len(record.mjd))] + ([(record.mjd - record.reference) / record.span] if options.trend else [])
        self.affine = np.stack(affine, axis=1)

    @staticmethod
    def all_names(names: tuple[str, ...], options: FitOptions) -> tuple[str, ...]:
        fitted, _, outputs = options.layout(names)
        return (*fitted, *(r.inferred for _, r in outputs if r is not None))

    def _combined(self, ratio: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = values[: self.k].copy()
        if not self.options.approximate:
            for i in range(self.k, len(values)):
                total[self.source[i]] += ratio[i] * values[i]
        return total

    def real_design(self) -> np.ndarray:
        z = self._combined(self.plus, self.values)
        columns = np.empty((len(self.record.mjd), 2 * self.k))
        columns[:, ::2], columns[:, 1::2] = z.real.T, z.imag.T
        return np.hstack([columns, self.affine])

    def rotary_design(self) -> np.ndarray:
        """Ordinary columns turning forth, then back, references forth, then back, and the affine ones."""
        plus, minus = self._combined(self.plus, self.values), self._combined(self.minus, self.values.conj())
        o = self.ordinary
        return np.hstack([plus[:o].T, minus[:o].T, plus[o:].T, minus[o:].T, self.affine.astype(complex)])

    # -- scalar ------------------------------------------------------------------------------------------------

    def solve_scalar(self, y: np.ndarray, stream: int = 0) -> dict:
        o = self.options
        fit = least_squares(self.real_design(), y[:, None], o)
        b = fit.coefficients[:, 0]
        out = {"cos": b[0 : 2 * self.k : 2], "sin": b[1 : 2 * self.k : 2]}
        source = (out["cos"] - 1j * out["sin"]) * 1.0
        all_ = source[self.source] * self.plus
        out = {"cos": all_.real, "sin": -all_.imag, "mean": float(b[2 * self.k]), "slope": float(b[2 * self.k + 1] / self.record.span) if o.trend else 0.0}
        out["amplitude"] = np.abs(all_)
        out["phase"] = np.mod(np.degrees(np.arctan2(out["sin"], out["cos"])), 360.0)
        out["pe"] = 100.0 * out["amplitude"] ** 2 / (out["amplitude"] ** 2).sum()
        if o.confidence == "linear":
            self._scalar_linear(out, fit, y, source)
        elif o.confidence == "monte_carlo":
            self._scalar_draws(out, fit, y, source, stream)
        if o.confidence != "none":
            with np.errstate(divide="ignore", invalid="ignore"):
                out["snr"] = out["amplitude"] ** 2 / (out["amplitude_ci"] / Z95) ** 2
        self._finish(out, fit, y[:, None])
        return out

    def _scalar_weights(self, fit: Fit) -> np.ndarray:
        """Variance of each coefficient per unit of noise, cosine and sine interleaved."""
        if not self.options.infer:
            return np.diag(fit.inverse())[: 2 * self.k].copy()
        z = fit.design[:, 0 : 2 * self.k : 2] + 1j * fit.design[:, 1 : 2 * self.k : 2]
        o = self.ordinary
        x = np.hstack([z[:, :o], z[:, :o].conj(), z[:, o:], z[:, o:].conj(), fit.design[:, 2 * self.k :].astype(complex)])
        wx = fit.weights[:, None] * x
        normal, pseudo = np.linalg.inv(x.conj().T @ wx), np.linalg.inv(x.T @ wx)
        gall, hall = normal + pseudo, normal - pseudo
        i = np.arange(self.k)  # indexed as if all forth columns came first
        j = i + self.k
        out = np.empty(2 * self.k)
        out[::2] = (gall[i, i] + gall[j, j] + 2 * gall[i, j]).real / 2
        out[1::2] = (hall[i, i] + hall[j, j] - 2 * hall[i, j]).real / 2
        return out

    def _component_variances(self, fit: Fit, y: np.ndarray, column: int, weights: np.ndarray, colored: bool) -> tuple[np.ndarray, np.ndarray]:
        fitted = fit.fitted()[:, column]
        n, p = fit.design.shape
        white = float((fit.weights * y * y).sum() - (fit.weights * fitted * y).sum()) / (n - p)
        c, s = weights[::2], weights[1::2]
        if not colored:
            return white * c, white * s
        power = self.record.band_powers((fit.weights * (y - fitted))[None], self.frequency)[0, 0][: self.k]
        return power * c / (c + s), power * s / (c + s)

    def _scalar_linear(self, out: dict, fit: Fit, y: np.ndarray, source: np.ndarray) -> None:
        vc, vs = self._component_variances(fit, y, 0, self._scalar_weights(fit), self.options.noise == "colored")
        c, s = source.real[self.source], -source.imag[self.source]
        vc, vs = vc[self.source], vs[self.source]
        a, b = self.plus.real**2, self.plus.imag**2
        inferred = np.arange(len(self.names)) >= self.k
        vc, vs = np.where(inferred, (a * vc + b * vs) / 2, vc), np.where(inferred, (a * vs + b * vc) / 2, vs)
        size = c * c + s * s
        out["amplitude_ci"] = Z95 * np.sqrt((c * c * vc + s * s * vs) / size)
        out["phase_ci"] = Z95 * np.degrees(np.sqrt((s * s * vc + c * c * vs) / size**2))

    def _scalar_draws(self, out: dict, fit: Fit, y: np.ndarray, source: np.ndarray, stream: int) -> None:
        n, p = fit.design.shape
        error = y - fit.fitted()[:, 0]
        variance = float((fit.weights * y * error).sum() / (n - p))
        inverse = fit.inverse()
        power = self.record.band_powers((fit.weights * error)[None], self.frequency)[0, 0] if self.options.noise == "colored" else None
        amplitude_ci, phase_ci = np.zeros(len(self.names)), np.zeros(len(self.names))
        for k in range(self.k):
            covariance = variance * inverse[2 * k : 2 * k + 2, 2 * k : 2 * k + 2]
            if power is not None:
                covariance = covariance * power[k] / np.trace(covariance)
            drawn = _draws(np.array([source[k].real, -source[k].imag]), covariance, self.options, stream, k)
            z = drawn[:, 0] - 1j * drawn[:, 1]
            for i in np.flatnonzero(self.source == k):
                w = z * self.plus[i]
                amplitude_ci[i] = _mad_interval(np.abs(w))
                phase_ci[i] = _mad_interval(_clustered(np.mod(np.degrees(np.arctan2(-w.imag, w.real)), 360.0), out["phase"][i]))
        out["amplitude_ci"], out["phase_ci"] = amplitude_ci, phase_ci

    # -- vector ------------------------------------------------------------------------------------------------

    def solve_vector(self, u: np.ndarray, v: np.ndarray, stream: int = 0) -> dict:
        o = self.options
        if o.infer:
            fit = least_squares(self.rotary_design(), (u + 1j * v)[:, None], o)
            b, n = fit.coefficients[:, 0], self.ordinary
            m = self.k - n
            forth, back = np.r_[b[:n], b[2 * n : 2 * n + m]], np.r_[b[n : 2 * n], b[2 * n + m : 2 * n + 2 * m]]
            mean, slope = b[2 * self.k], b[2 * self.k + 1] / self.record.span if o.trend else 0.0
        else:
            fit = least_squares(self.real_design(), np.column_stack([u, v]), o)
            b = fit.coefficients
            z = b[0 : 2 * self.k : 2] - 1j * b[1 : 2 * self.k : 2]
            forth, back = (z[:, 0] + 1j * z[:, 1]) / 2, (z[:, 0].conj() + 1j * z[:, 1].conj()) / 2
            mean = b[2 * self.k] @ np.array([1, 1j])
            slope = b[2 * self.k + 1] @ np.array([1, 1j]) / self.record.span if o.trend else 0.0
        forth, back = forth[self.source] * self.plus, back[self.source] * self.minus
        both, apart = forth + back, forth - back
        out = {"u_cos": both.real, "u_sin": -apart.imag, "v_cos": both.imag, "v_sin": apart.real}
        out |= {"mean": float(np.real(mean)), "mean_v": float(np.imag(mean)), "slope": float(np.real(slope)), "slope_v": float(np.imag(slope))}
        four = [out[x] for x in ("u_cos", "u_sin", "v_cos", "v_sin")]
        out["semi_major"], out["semi_minor"], out["inclination"], out["phase"] = ellipse.from_coefficients(*four)
        energy = out["semi_major"] ** 2 + out["semi_minor"] ** 2
        out["pe"] = 100.0 * energy / energy.sum()
        if o.confidence == "linear":
            self._vector_linear(out, fit, u, v, four)
        elif o.confidence == "monte_carlo":
            self._vector_draws(out, fit, u, v, four, stream)
        if o.confidence != "none":
            with np.errstate(divide="ignore", invalid="ignore"):
                out["snr"] = energy / ((out["semi_major_ci"] / Z95) ** 2 + (out["semi_minor_ci"] / Z95) ** 2)
        self._finish(out, fit, np.column_stack([u, v]))
        return out

    def _rotary_covariances(self, fit: Fit, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, f = fit.design, fit.fitted()[:, 0]
        n, p = x.shape
        wz, wx = fit.weights * z, fit.weights[:, None] * x
        misfit = float((z.conj() * wz - f.conj() * wz).sum().real) / (n - p)
        pseudo = (z * wz - f * wz).sum() / (n - p)
        a, b = np.linalg.inv(x.conj().T @ wx) * misfit, np.linalg.inv(x.T @ wx) * pseudo
        return a + b, a - b

    def _vector_linear(self, out: dict, fit: Fit, u: np.ndarray, v: np.ndarray, four: list[np.ndarray]) -> None:
        """Eastward variances are white in any case, northward ones follow the chosen noise."""
        colored = self.options.noise == "colored"
        if not self.options.infer:
            weights = self._scalar_weights(fit)
            variances = [*self._component_variances(fit, u, 0, weights, False), *self._component_variances(fit, v, 1, weights, colored)]
            spread = ellipse.sigmas(*four, variances)
        else:
            g, h = self._rotary_covariances(fit, u + 1j * v)
            i = np.arange(self.k)  # indexed as if all forth columns came first
            j = i + self.k
            xu, yu = (g[i, i] + g[j, j] + 2 * g[i, j]).real / 2, (h[i, i] + h[j, j] - 2 * h[i, j]).real / 2
            xv, yv = (h[i, i] + h[j, j] + 2 * h[i, j]).real / 2, (g[i, i] + g[j, j] - 2 * g[i, j]).real / 2
            if colored:
                power = self.record.band_powers((fit.weights * (v - fit.fitted()[:, 0].imag))[None], self.frequency)[0, 0][: self.k]
                xv, yv = power * xv / (xv + yv), power * yv / (xv + yv)
            s = self.source
            spread = [np.array(x) for x in ellipse.sigmas(*four, [xu[s], yu[s], xv[s], yv[s]])]
            real, imag = 0.25 * (xu + yv)[s], 0.25 * (yu + xv)[s]
            a, b = self.plus.real**2 + self.minus.real**2, self.plus.imag**2 + self.minus.imag**2
            x, y = a * real + b * imag, a * imag + b * real
            at = ellipse.sigmas(*(c[s] for c in four), [x, y, y, x])
            for whole, own in zip(spread, at):
                whole[self.k :] = own[self.k :]
        for name, sigma in zip(("semi_major_ci", "semi_minor_ci", "phase_ci", "inclination_ci"), spread):
            out[name] = Z95 * sigma

    def _vector_covariances(self, fit: Fit, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        fitted = fit.fitted()
        f = np.column_stack([fitted[:, 0].real, fitted[:, 0].imag]) if self.options.infer else fitted
        eu, ev, w = u - f[:, 0], v - f[:, 1], fit.weights
        n, p = fit.design.shape
        blocks = []
        if self.options.infer:
            g, h = self._rotary_covariances(fit, u + 1j * v)
            o, m = self.ordinary, self.k - self.ordinary
            for k in range(self.k):
                i, j = (k, o + k) if k < o else (2 * o + k - o, 2 * o + m + k - o)
                xx = lambda a: (a[i, i], a[i, j], a[j, i], a[j, j])  # noqa: B023, E731
                (g0, g1, g2, g3), (h0, h1, h2, h3) = xx(g), xx(h)
                c = np.zeros((4, 4))
                c[0, 0], c[1, 1] = (g0 + g3 + 2 * g1).real / 2, (h0 + h3 - 2 * h1).real / 2
                c[2, 2], c[3, 3] = (h0 + h3 + 2 * h1).real / 2, (g0 + g3 - 2 * g1).real / 2
                c[0, 1], c[2, 3] = (h0 - h1 + h2 - h3).imag / 2, (g0 - g1 + g2 - g3).imag / 2
                c[0, 2], c[0, 3] = (-h0 - h1 - h2 - h3).imag / 2, (g0 - g3).real / 2
                c[1, 2], c[1, 3] = (-h0 + h3).real / 2, (-g0 + g1 + g2 - g3).imag / 2
                blocks.append(np.triu(c) + np.triu(c, 1).T)
        else:
            inverse = fit.inverse()
            ku, kv, kx = (w * u * eu).sum() / (n - p), (w * v * ev).sum() / (n - p), (w * (u * ev + v * eu)).sum() / 2 / (n - p)
            for k in range(self.k):
                d = inverse[2 * k : 2 * k + 2, 2 * k : 2 * k + 2]
                blocks.append(np.block([[ku * d, kx * d], [kx * d.T, kv * d]]))
        if self.options.noise == "colored":
            power = self.record.band_powers(np.stack([w * eu, w * ev]), self.frequency)
            ratio = lambda a, b: a / b if b else 0.0
            for k, c in enumerate(blocks):
                c[:2, :2] *= ratio(power[0, 0, k], np.trace(c[:2, :2]))
                c[2:, 2:] *= ratio(power[1, 1, k], np.trace(c[2:, 2:]))
                c[:2, 2:] *= ratio(power[0, 1, k], np.abs(c[:2, 2:]).sum())
                c[2:, :2] = c[:2, 2:].T
        return blocks

    def _vector_draws(self, out: dict, fit: Fit, u: np.ndarray, v: np.ndarray, four: list[np.ndarray], stream: int) -> None:
        names = ("semi_major", "semi_minor", "inclination", "phase")
        intervals = {n: np.zeros(len(self.names)) for n in names}
        for k, covariance in enumerate(self._vector_covariances(fit, u, v)):
            d = _draws(np.array([x[k] for x in four]), covariance, self.options, stream, k)
            zu, zv = d[:, 0] - 1j * d[:, 1], d[:, 2] - 1j * d[:, 3]
            forth, back = (zu + 1j * zv) / 2, (zu.conj() + 1j * zv.conj()) / 2
            for i in np.flatnonzero(self.source == k):
                a, b = forth * self.plus[i], back * self.minus[i]
                both, apart = a + b, a - b
                drawn = dict(zip(names, ellipse.from_coefficients(both.real, -apart.imag, both.imag, apart.real)))
                for n in names:
                    x = drawn[n] if n.startswith("semi") else _clustered(drawn[n], out[n][i])
                    intervals[n][i] = _mad_interval(x)
        out |= {f"{n}_ci": x for n, x in intervals.items()}

    # -- shared ------------------------------------------------------------------------------------------------

    def _finish(self, out: dict, fit: Fit, data: np.ndarray) -> None:
        o = self.options
        out |= {"frequency": self.frequency, "names": list(self.names), "iterations": fit.iterations, "termination": fit.termination, "scale": fit.scale, "rms": fit.rms, "weights": fit.weights if o.method == "robust" else None}
        if o.diagnostics:
            self._diagnose(out, fit, data)

    def _harmonic(self, out: dict, chosen: np.ndarray) -> np.ndarray:
        z = self.values[chosen]
        pairs = [("u_cos", "u_sin"), ("v_cos", "v_sin")] if "u_cos" in out else [("cos", "sin")]
        return np.column_stack([out[c][chosen] @ z.real + out[s][chosen] @ z.imag for c, s in pairs])

    def _diagnose(self, out: dict, fit: Fit, data: np.ndarray) -> None:
        """Rayleigh neighbours of directly fitted constituents, greatest correlations, conditioning and variances."""
        o, k = self.options, self.k
        order = np.lexsort((np.arange(k), self.frequency[:k]))
        lower, higher = np.full(len(self.names), -1), np.full(len(self.names), -1)
        lower[order[1:]], higher[order[:-1]] = order[:-1], order[1:]
        f, rr = self.frequency, {}
        for side, other in (("lower", lower), ("higher", higher)):
            apart = np.abs(f - f[other])
            rr[side] = np.where(other >= 0, 24.0 * self.record.effective_days * apart / o.rayleigh_min, np.nan)
        snr = out.get("snr")
        inverse = fit.inverse()
        if np.iscomplexobj(inverse):
            n, m = self.ordinary, k - self.ordinary
            places = [[i, n + i] if i < n else [2 * n + i - n, 2 * n + m + i - n] for i in range(k)]
        else:
            places = [[2 * i, 2 * i + 1] for i in range(k)]
        size = np.sqrt(np.abs(np.diag(inverse)))
        correlation = np.abs(inverse) / np.outer(size, size)
        for side, other in (("lower", lower), ("higher", higher)):
            out[f"{side}_index"], out[f"{side}_rr"] = other, rr[side]
            out[f"{side}_rnm"] = None if snr is None else np.where(other >= 0, rr[side] * np.sqrt((snr + snr[other]) / 2), np.nan)
            out[f"{side}_correlation"] = np.array([correlation[np.ix_(places[i], places[j])].max() if i < k and j >= 0 else np.nan for i, j in enumerate(other)])
        scaled = fit.design.copy()
        if not np.iscomplexobj(scaled):
            scaled[:, : 2 * k] *= np.sqrt(2.0)
        singular = np.linalg.svd(scaled, compute_uv=False)
        out["condition"] = float(singular[0] / singular[-1]) if singular[-1] else float("inf")
        values = fit.fitted()
        values = np.column_stack([values[:, 0].real, values[:, 0].imag]) if np.iscomplexobj(values) else values
        n, p = fit.design.shape
        energy = float((fit.weights[:, None] * values**2).sum())
        noise = float((fit.weights[:, None] * (data - values) ** 2).sum() / (n - p))
        out["snr_all"] = None if energy == 0 and noise == 0 else float("inf") if noise == 0 else energy / noise
        out["snr_all_adjusted"] = None if out["snr_all"] is None or (np.isinf(out["snr_all"]) and np.isinf(out["condition"])) else out["snr_all"] / out["condition"]
        tide = self._harmonic(out, np.arange(len(self.names)))
        affine = values - self._harmonic(out, np.arange(len(self.names))) if not o.approximate else self.affine @ np.real(np.column_stack([fit.coefficients[2 * k :].real, fit.coefficients[2 * k :].imag]) if np.iscomplexobj(fit.coefficients) else fit.coefficients[2 * k :])
        square = lambda x: float((x**2).sum(axis=1).mean())
        out["tv_raw"], out["tv_all"] = square(data - affine), square(tide)
        out["tv_snr"] = None if snr is None else square(self._harmonic(out, np.flatnonzero(snr >= o.diagnostic_min_snr)))
        share = lambda x: None if x is None or out["tv_raw"] <= 0 else 100.0 * x / out["tv_raw"]
        out["ptv_all"], out["ptv_snr"] = share(out["tv_all"]), share(out["tv_snr"])


def solve(mjd: np.ndarray, u: np.ndarray, v: np.ndarray | None, latitude: float, options: FitOptions, axis: np.ndarray | None = None, stream: int = 0) -> dict:
    """Fit one series; rows with missing values are left out, infinite ones are errors."""
    mjd, u = np.asarray(mjd, float), np.asarray(u, float)
    v = None if v is None else np.asarray(v, float)
    if np.isinf(u).any() or (v is not None and np.isinf(v).any()):
        raise AnalysisError("infinite_observation", "observations must be finite or missing")
    ok = np.isfinite(mjd) & ~np.isnan(u) & (True if v is None else ~np.isnan(v))
    mjd, u, v = mjd[ok], u[ok], None if v is None else v[ok]
    if len(mjd) < 2 or (np.diff(mjd) <= 0).any():
        raise AnalysisError("time_axis", "times must increase and be two at least")
    record = Record.make(mjd, axis if options.axis == "shared" else None)
    names = options.constituents or rayleigh(record.span, options.rayleigh_min)
    full = Model.all_names(names, options)
    model = Model(record, latitude, names, options, TimeTerms(full, mjd), TimeTerms(full, np.array([record.reference])))
    out = model.solve_scalar(u, stream) if v is None else model.solve_vector(u, v, stream)
    return out | {"reference": record.reference, "span": record.span, "rows": len(mjd)}
