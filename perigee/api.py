"""Entry points for arrays and files: one series, many series, reconstruction, saved fits.

Arrays are for single series and tests; tables go through :func:`perigee.operators.fit.fit`. Saved fits are
Parquet with a metadata file whose version is checked on loading.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from perigee import __version__
from perigee.functions.astronomy import TimeTerms
from perigee.functions.time import OFFSETS
from perigee.operators.fit import presentation
from perigee.operators.fit import fit as fit_table
from perigee.operators.kernel import basis
from perigee.operators.kernel import solve as solve_arrays
from perigee.operators.options import AnalysisError, FitOptions, PreFilter, Relation

FORMAT_VERSION = 1
_UNSET = object()


class Result(dict):
    """A dictionary whose entries are attributes as well; arrays are read-only."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        for x in self.values():
            if isinstance(x, np.ndarray):
                x.setflags(write=False)

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


def to_mjd(t, epoch: str | dt.date | dt.datetime | None = None) -> np.ndarray:
    """Days as MJD: datetime64 (no epoch allowed, NaT is missing), or numbers counted from an epoch.

    ``epoch``: None or ``mjd``, ``unix`` (seconds), ``python``, ``matlab``, or a date that day zero stands for.
    """
    t = np.asarray(t)
    if t.dtype.kind == "M":
        if epoch is not None:
            raise AnalysisError("epoch", "dates carry their own epoch")
        out = t.astype("datetime64[us]").astype(np.int64) / 8.64e10 + OFFSETS["unix_days"]
        return np.where(np.isnat(t), np.nan, out)
    t = t.astype(float)
    if epoch is None or epoch == "mjd":
        return t
    if epoch == "unix":
        return t / 86400.0 + OFFSETS["unix_days"]
    if isinstance(epoch, str) and epoch in OFFSETS:
        return t + OFFSETS[epoch]
    if isinstance(epoch, str):
        epoch = dt.datetime.fromisoformat(epoch)
    if isinstance(epoch, dt.datetime):
        origin = epoch.astimezone(dt.timezone.utc).replace(tzinfo=None) if epoch.tzinfo else epoch
    else:
        origin = dt.datetime(epoch.year, epoch.month, epoch.day)
    return t + (origin - dt.datetime(1858, 11, 17)) / dt.timedelta(days=1)


def _values(x) -> np.ndarray:
    return np.ma.filled(np.ma.asarray(x).astype(float), np.nan)


def options(constit="auto", conf_int="linear", method="ols", trend=True, phase="Greenwich", nodal=True, prefilt: Mapping | None = None, infer: Mapping | None = None, order_constit="PE", MC_n=200, MC_seed=0, robust_kw: Mapping | None = None, Rayleigh_min=1.0, diagnostics=False, diagnostic_min_SNR=2.0, white=False, axis="own") -> FitOptions:
    """Options by their customary names; unknown keys of the mappings are refused."""
    robust = dict(robust_kw or {})
    known = {"weight_function", "tuning_constant", "tolerance", "max_iterations", "tune", "tol", "maxit"}
    if set(robust) - known:
        raise AnalysisError("robust_kw", f"unknown keys {sorted(set(robust) - known)}")
    relations = ()
    if infer:
        extra = set(infer) - {"inferred_names", "reference_names", "amp_ratios", "phase_offsets", "approximate"}
        if extra:
            raise AnalysisError("infer", f"unknown keys {sorted(extra)}")
        ratios, phases = (np.asarray(infer[k], float) for k in ("amp_ratios", "phase_offsets"))
        n = len(infer["inferred_names"])
        relations = tuple(Relation(a, b, float(ratios[i]), float(phases[i]), *((float(ratios[n + i]), float(phases[n + i])) if len(ratios) == 2 * n else (None, None))) for i, (a, b) in enumerate(zip(infer["inferred_names"], infer["reference_names"])))
    order = order_constit if order_constit is None or not isinstance(order_constit, str) else {"PE": "pe", "SNR": "snr"}.get(order_constit, order_constit)
    return FitOptions(
        constituents=None if constit is None or isinstance(constit, str) else tuple(constit),
        rayleigh_min=Rayleigh_min,
        trend=trend,
        phase=phase.lower(),
        nodal={True: "exact", False: "disabled"}.get(nodal, nodal),
        method=method,
        weight_function=robust.get("weight_function", "cauchy"),
        tuning=robust.get("tuning_constant", robust.get("tune")),
        tolerance=robust.get("tolerance", robust.get("tol", 0.001)),
        max_iterations=robust.get("max_iterations", robust.get("maxit", 50)),
        confidence={"linear": "linear", "MC": "monte_carlo", "none": "none", None: "none"}[conf_int],
        noise="white" if white else "colored",
        realizations=MC_n,
        seed=MC_seed,
        order=tuple(order) if order is not None and not isinstance(order, str) else order,
        infer=relations,
        approximate=bool(infer and infer.get("approximate", False)),
        prefilter=PreFilter.from_mapping(dict(prefilt)) if prefilt else None,
        diagnostics=diagnostics,
        diagnostic_min_snr=diagnostic_min_SNR,
        axis=axis,
    )


def solve(t, u, v=None, lat: float | None = None, *, epoch=None, **given) -> Result:
    """Fit one series of arrays; results in presentation order, with the stable ones under ``stable``."""
    o = options(**given)
    stable = solve_arrays(to_mjd(t, epoch), _values(u), None if v is None else _values(v), float("nan") if lat is None else lat, o)
    order = presentation(stable, o.order)
    n = len(stable["names"])
    shown = {k: (x[order] if isinstance(x, np.ndarray) and x.shape == (n,) and k != "weights" else x) for k, x in stable.items()}
    return Result(shown | {"names": [stable["names"][i] for i in order], "stable": stable, "options": o, "latitude": lat})


def solve_many(spark: SparkSession, t, u, v=None, lat=0.0, *, epoch=None, **given) -> DataFrame:
    """Fit the columns of (time, series) matrices on their common axis; one row per column."""
    mjd, u = to_mjd(t, epoch), _values(u)
    v = None if v is None else _values(v)
    lat = np.broadcast_to(np.asarray(lat, float), u.shape[1:])
    at, series = (x.ravel() for x in np.meshgrid(np.arange(len(mjd)), np.arange(u.shape[1]), indexing="ij"))
    import pandas as pd

    rows = pd.DataFrame({"series_id": series, "mjd": mjd[at], "u": u.ravel()} | ({} if v is None else {"v": v.ravel()}))
    sites = spark.createDataFrame(pd.DataFrame({"series_id": np.arange(len(lat)), "lat": lat}))
    return fit_table(spark.createDataFrame(rows), options(**({"axis": "shared"} | given)), sites, v=None if v is None else "v", axis=np.sort(np.unique(mjd[np.isfinite(mjd)])))


def reconstruct(t, coef: Result, epoch=None, constit: Sequence[str] | None = None, min_SNR: float | None = 2.0, min_PE: float = 0.0) -> Result:
    """Values at any times; missing times give missing values. ``h``, or ``u`` and ``v``."""
    s, o = coef["stable"], coef["options"]
    if constit is not None:
        if unknown := [x for x in constit if x not in s["names"]]:
            raise AnalysisError("unknown_constituent", f"not fitted: {unknown}")
        chosen = np.isin(s["names"], list(constit))
    else:
        if min_SNR is not None and "snr" not in s:
            raise AnalysisError("snr_needs_confidence", "a fit without intervals has no SNR")
        chosen = (s["pe"] >= min_PE) & (True if min_SNR is None else s["snr"] >= min_SNR)
    mjd = to_mjd(t, epoch)
    ok = np.isfinite(mjd)
    names = tuple(s["names"])
    z, _ = basis(TimeTerms(names, mjd[ok]), TimeTerms(names, np.array([s["reference"]])), mjd[ok], s["reference"], coef["latitude"], o)

    def part(c: str, d: str, mean: str, slope: str) -> np.ndarray:
        out = np.full(len(mjd), np.nan)
        out[ok] = (s[c] * chosen) @ z.real + (s[d] * chosen) @ z.imag + s[mean] + s[slope] * (mjd[ok] - s["reference"])
        return out

    if "u_cos" in s:
        return Result(u=part("u_cos", "u_sin", "mean", "slope"), v=part("v_cos", "v_sin", "mean_v", "slope_v"))
    return Result(h=part("cos", "sin", "mean", "slope"))


def diagnostic_table(coef: Result) -> str:
    """The result as lines of text, in presentation order."""
    size = "amplitude" if "amplitude" in coef else "semi_major"
    lines = [f"{'name':>6} {'freq cph':>12} {size:>11} {'phase':>9} {'PE %':>8} {'SNR':>10}"]
    for i, name in enumerate(coef["names"]):
        snr = f"{coef['snr'][i]:10.3g}" if "snr" in coef else " " * 10
        lines.append(f"{name:>6} {coef['frequency'][i]:12.9f} {coef[size][i]:11.5f} {coef['phase'][i]:9.3f} {coef['pe'][i]:8.3f} {snr}")
    return "\n".join(lines)


def save(fitted: DataFrame, path: str, o: FitOptions, overwrite: bool = False) -> None:
    """Write fits with their options. Spark commits whole tables only; an existing target is an error unless asked for."""
    fitted.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/fit")
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    meta = {"format_version": FORMAT_VERSION, "version": __version__, "options": {k: x for k, x in vars(o).items() if k not in ("prefilter", "infer", "extra")}, "infer": [vars(r) for r in o.infer], "prefilter": o.prefilter and vars(o.prefilter)}
    with fs.open_output_stream(f"{root}/metadata.json") as out:
        out.write(json.dumps(meta, indent=1).encode())


def load(spark: SparkSession, path: str) -> tuple[DataFrame, FitOptions]:
    """Saved fits and their options; another format version is refused."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(f"{root}/metadata.json") as f:
        meta = json.loads(f.read())
    if meta.get("format_version") != FORMAT_VERSION:
        raise AnalysisError("format_version", f"{meta.get('format_version')} isn't {FORMAT_VERSION}")
    tuples = {k: tuple(x) if isinstance(x, list) else x for k, x in meta["options"].items()}
    response = meta["prefilter"] and PreFilter(**{k: tuple(x) if isinstance(x, list) else x for k, x in meta["prefilter"].items()})
    o = FitOptions(**tuples, infer=tuple(Relation(**r) for r in meta["infer"]), prefilter=response or None)
    return spark.read.parquet(f"{path}/fit"), o
