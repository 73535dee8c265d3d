"""Distributed fits: observations in long form to one row of coefficients per series.

One shuffle brings a series together (as arrays sorted by time); everything else is per row. The kernel runs over
Arrow batches of such rows and keeps what depends on times only for series that share them. Streams of random
draws are keyed by the series, so results don't depend on partitions.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions.astronomy import TimeTerms
from perigee.functions import ellipse
from perigee.operators.kernel import Model, Record, gains, rayleigh
from perigee.operators.options import AnalysisError, FitOptions

_ARRAYS = ("frequency", "cos", "sin", "amplitude", "phase", "pe", "snr", "amplitude_ci", "phase_ci", "u_cos", "u_sin", "v_cos", "v_sin", "semi_major", "semi_minor", "inclination", "semi_major_ci", "semi_minor_ci", "inclination_ci", "weights", "lower_rr", "higher_rr", "lower_rnm", "higher_rnm", "lower_correlation", "higher_correlation")
_NUMBERS = ("reference", "span", "mean", "mean_v", "slope", "slope_v", "scale", "rms", "condition", "snr_all", "snr_all_adjusted", "tv_raw", "tv_all", "tv_snr", "ptv_all", "ptv_snr")
_INDICES = ("lower_index", "higher_index", "rank_order")
SCHEMA = ", ".join(["status string", "rows int", "iterations int", "termination string", "names array<string>", "latitude double", *(f"{x} double" for x in _NUMBERS), *(f"{x} array<double>" for x in _ARRAYS), *(f"{x} array<int>" for x in _INDICES)])

#: Points of a shared time axis that are sent with the job at most.
AXIS_POINTS = 5_000_000


def presentation(out: dict, order: str | tuple[str, ...] | None) -> np.ndarray:
    """Stable indices in the order of presentation; ties keep the lower index."""
    index = np.arange(len(out["names"]))
    if order is None or order == "selection":
        return index
    if order == "frequency":
        return np.lexsort((index, out["frequency"]))
    if isinstance(order, tuple):
        if unknown := [x for x in order if x not in out["names"]]:
            raise AnalysisError("order", f"not fitted: {unknown}")
        return np.array([out["names"].index(x) for x in order])
    return np.lexsort((index, -np.asarray(out["snr" if order == "snr" else "pe"])))


class Solver:
    """Solves series after series and remembers the time terms of recent axes and the models of recent sites."""

    def __init__(self, options: FitOptions, axis: np.ndarray | None = None, keep: int = 32):
        self.options, self.axis, self.keep = options, axis if options.axis == "shared" else None, keep
        self.terms: OrderedDict = OrderedDict()
        self.models: OrderedDict = OrderedDict()

    def _kept(self, store: OrderedDict, key, make):
        if key in store:
            store.move_to_end(key)
            return store[key]
        store[key] = value = make()
        if len(store) > self.keep:
            store.popitem(last=False)
        return value

    def _times(self, mjd: np.ndarray) -> tuple:
        record = Record.make(mjd, self.axis)
        names = self.options.constituents or rayleigh(record.span, self.options.rayleigh_min)
        every = Model.all_names(names, self.options)
        return record, names, TimeTerms(every, mjd), TimeTerms(every, np.array([record.reference]))

    def solve(self, mjd: np.ndarray, u: np.ndarray, v: np.ndarray | None, latitude: float, stream: int) -> dict:
        if np.isinf(u).any() or (v is not None and np.isinf(v).any()):
            raise AnalysisError("infinite_observation", "observations must be finite or missing")
        ok = np.isfinite(mjd) & ~np.isnan(u) & (True if v is None else ~np.isnan(v))
        mjd, u, v = mjd[ok], u[ok], None if v is None else v[ok]
        if len(mjd) < 2 or (np.diff(mjd) <= 0).any():
            raise AnalysisError("time_axis", "times must increase and be two at least")
        key = mjd.tobytes()
        record, names, terms, at_reference = self._kept(self.terms, key, lambda: self._times(mjd))
        model = self._kept(self.models, (key, latitude), lambda: Model(record, latitude, names, self.options, terms, at_reference))
        out = model.solve_scalar(u, stream) if v is None else model.solve_vector(u, v, stream)
        return out | {"reference": record.reference, "span": record.span, "rows": len(mjd), "rank_order": presentation(out, self.options.order)}


#: Series with the same times that are solved together, and the condition of the normal matrix up to which they are.
TOGETHER, WELL_CONDITIONED = 32, 1e8


class Stack:
    """Plain least squares of many series on the same times at once: one batch of normal equations.

    Their relative error is that of the orthogonal solution for well-conditioned models; others, and
    everything but plain fits, go through :class:`Solver` one by one.
    """

    def __init__(self, solver: Solver):
        self.solver, o = solver, solver.options
        self.plain = o.method == "ols" and o.confidence == "none" and not o.infer and not o.diagnostics

    def solve(self, mjd: np.ndarray, values: list[np.ndarray], latitudes: np.ndarray) -> dict[int, dict]:
        """Results by position; ``values``: one or two arrays (series, times). Positions that aren't well conditioned are left out."""
        o, solver = self.solver.options, self.solver
        record, names, terms, at_reference = solver._kept(solver.terms, mjd.tobytes(), lambda: solver._times(mjd))
        frequency, k, n = at_reference.frequency[:, 0], len(names), len(mjd)
        if (frequency <= 0).any() or len(np.unique(frequency)) < k or n <= 2 * k + 1 + o.trend:
            return {}
        advance = 24.0 * frequency[:, None] * (mjd - record.reference)[None]
        phase = {"greenwich": lambda: terms.phase, "linear_time": lambda: at_reference.phase + advance, "raw": lambda: advance}[o.phase]()
        turn = gains(frequency, o.prefilter)[:, None] * np.exp(2j * np.pi * phase)
        affine = np.stack([np.ones(n)] + ([(mjd - record.reference) / record.span] if o.trend else []))
        out: dict[int, dict] = {}
        for at in range(0, len(latitudes), TOGETHER):
            lat = latitudes[at : at + TOGETHER]
            if o.nodal == "disabled":
                z = np.broadcast_to(turn, (len(lat), k, n))
            else:
                used = terms if o.nodal == "exact" else at_reference
                z = used.nodal_many(lat) * turn
            design = np.empty((len(lat), 2 * k + len(affine), n))
            design[:, : 2 * k : 2], design[:, 1 : 2 * k : 2], design[:, 2 * k :] = z.real, z.imag, affine
            normal = design @ design.transpose(0, 2, 1)
            data = np.stack([v[at : at + TOGETHER] for v in values], axis=2)
            size = np.linalg.eigvalsh(normal)
            fine = np.flatnonzero(size[:, -1] < WELL_CONDITIONED * size[:, 0])
            if not len(fine):
                continue
            beta = np.linalg.solve(normal[fine], design[fine] @ data[fine])
            for j, b in zip(fine.tolist(), beta):
                out[at + j] = self._described(b, record, names, frequency, n)
        return out

    def _described(self, b: np.ndarray, record: Record, names: tuple[str, ...], frequency: np.ndarray, n: int) -> dict:
        o, k = self.solver.options, len(names)
        slope = b[2 * k + 1] / record.span if o.trend else np.zeros(b.shape[1])
        out = {"names": list(names), "frequency": frequency, "mean": float(b[2 * k, 0]), "slope": float(slope[0]), "iterations": 0, "termination": "ols", "reference": record.reference, "span": record.span, "rows": n}
        c, s = b[: 2 * k : 2], b[1 : 2 * k : 2]
        if b.shape[1] == 1:
            out |= {"cos": c[:, 0], "sin": s[:, 0], "amplitude": np.hypot(c[:, 0], s[:, 0]), "phase": np.mod(np.degrees(np.arctan2(s[:, 0], c[:, 0])), 360.0)}
            energy = out["amplitude"] ** 2
        else:
            out |= {"u_cos": c[:, 0], "u_sin": s[:, 0], "v_cos": c[:, 1], "v_sin": s[:, 1], "mean_v": float(b[2 * k, 1]), "slope_v": float(slope[1])}
            out["semi_major"], out["semi_minor"], out["inclination"], out["phase"] = ellipse.from_coefficients(c[:, 0], s[:, 0], c[:, 1], s[:, 1])
            energy = out["semi_major"] ** 2 + out["semi_minor"] ** 2
        out["pe"] = 100.0 * energy / energy.sum()
        return out | {"rank_order": presentation(out, o.order)}


def _listed(x):
    return None if x is None else [None if isinstance(v, float) and math.isnan(v) else v for v in np.asarray(x).tolist()]


def together(stack: Stack, t: np.ndarray, y: np.ndarray, z: np.ndarray | None, bounds: np.ndarray, latitudes: list) -> dict[int, dict]:
    """Results, by row of a batch, of series that share their valid times with others and have nothing odd."""
    groups: dict[bytes, list[int]] = {}
    ok = np.isfinite(t) & np.isfinite(y) & (True if z is None else np.isfinite(z))
    for i, (a, b, lat) in enumerate(zip(bounds, bounds[1:], latitudes)):
        if lat is None or not (np.isfinite(lat) and 0 < abs(lat) <= 90) or np.isinf(y[a:b]).any() or (z is not None and np.isinf(z[a:b]).any()):
            continue
        groups.setdefault(t[a:b][ok[a:b]].tobytes(), []).append(i)
    out: dict[int, dict] = {}
    for key, rows in groups.items():
        mjd = np.frombuffer(key)
        if len(rows) < 4 or len(mjd) < 2 or (np.diff(mjd) <= 0).any():
            continue
        values = [np.stack([x[bounds[i] : bounds[i + 1]][ok[bounds[i] : bounds[i + 1]]] for i in rows]) for x in (y, z) if x is not None]
        try:
            found = stack.solve(mjd, values, np.array([latitudes[i] for i in rows]))
        except AnalysisError:
            continue
        out |= {rows[j]: x for j, x in found.items()}
    return out


def pack(obs: DataFrame, series: str = "series_id", time: str = "mjd", u: str = "u", v: str | None = None) -> DataFrame:
    """series_id, o: array of (t, u[, v]) by time; missing times go, missing values stay as null for the kernel to mask."""
    known = obs.where(F.col(time).isNotNull() & ~F.isnan(F.col(time)))
    point = F.struct(F.col(time).cast("double").alias("t"), F.col(u).cast("double").alias("u"), *([F.col(v).cast("double").alias("v")] if v else []))
    # Dealt by hand, as the work per row is heavy: partitions are few bytes then, and would be merged otherwise.
    dealt = known.select(F.col(series).alias("series_id"), point.alias("p")).repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id")
    return dealt.groupBy("series_id").agg(F.array_sort(F.collect_list("p")).alias("o"))


def shared_axis(obs: DataFrame, time: str = "mjd") -> np.ndarray:
    """The distinct times of all series, sorted; a time axis is bounded, and the bound is checked."""
    axis = obs.where(F.col(time).isNotNull() & ~F.isnan(F.col(time))).select(F.col(time).cast("double").alias("t")).distinct()
    if axis.count() > AXIS_POINTS:
        raise AnalysisError("axis_too_long", f"more than {AXIS_POINTS} points")
    return np.sort(np.array([r.t for r in axis.toLocalIterator()]))


def fit(obs: DataFrame, options: FitOptions, sites: DataFrame | None = None, series: str = "series_id", time: str = "mjd", u: str = "u", v: str | None = None, latitude: float | None = None, axis: np.ndarray | None = None) -> DataFrame:
    """One row per series: status (fitted, or why not), fit statistics, and arrays in stable constituent order.

    ``sites``: (series_id, lat), or one ``latitude`` for all.
    """
    packed = pack(obs, series, time, u, v)
    located = packed.withColumn("lat", F.lit(float(latitude))) if sites is None else packed.join(sites.select(F.col(series).alias("series_id"), F.col("lat").cast("double").alias("lat")), "series_id", "left")
    rows = located.withColumn("stream", F.xxhash64("series_id"))
    if options.axis == "shared" and axis is None:
        axis = shared_axis(obs, time)
    kind = obs.schema[series].dataType.simpleString()
    names = ["series_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, schema = Solver(options, axis), None
        stack = Stack(solver)
        for batch in batches:
            lists = batch.column("o")
            points, bounds = lists.flatten(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            t, y, z = (points.field(i).to_numpy(zero_copy_only=False) if i < points.type.num_fields else None for i in range(3))
            out: dict[str, list] = {n: [] for n in names}
            done = together(stack, t, y, z, bounds, batch.column("lat").to_pylist()) if stack.plain else {}
            for i, (key, lat, stream) in enumerate(zip(batch.column("series_id").to_pylist(), batch.column("lat").to_pylist(), batch.column("stream").to_pylist())):
                own = slice(bounds[i], bounds[i + 1])
                try:
                    if i in done:
                        found = done[i] | {"status": "fitted", "series_id": key, "latitude": lat}
                        for n in names:
                            x = found.get(n)
                            out[n].append(_listed(x) if n in _ARRAYS or n in _INDICES else x)
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        found = solver.solve(t[own], y[own], None if z is None else z[own], float("nan") if lat is None else lat, stream) | {"status": "fitted"}
                except AnalysisError as e:
                    found = {"status": e.code, "rows": int(own.stop - own.start)}
                except np.linalg.LinAlgError:
                    found = {"status": "singular", "rows": int(own.stop - own.start)}
                found |= {"series_id": key, "latitude": lat}
                for n in names:
                    x = found.get(n)
                    out[n].append(_listed(x) if n in _ARRAYS or n in _INDICES else x)
            if schema is None:
                types = {"series_id": batch.schema.field("series_id").type, "status": pa.string(), "termination": pa.string(), "rows": pa.int32(), "iterations": pa.int32(), "names": pa.list_(pa.string())}
                types |= {n: pa.list_(pa.float64()) for n in _ARRAYS} | {n: pa.list_(pa.int32()) for n in _INDICES}
                schema = pa.schema([(n, types.get(n, pa.float64())) for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], schema.field(n).type) for n in names], schema=schema)

    return rows.mapInArrow(run, f"series_id {kind}, {SCHEMA}")


def coefficients(fitted: DataFrame) -> DataFrame:
    """One row per series and constituent, with its stable index and its rank in presentation order."""
    several = [n for n in _ARRAYS if n != "weights"]
    columns = [F.get(n, F.col("constituent_index")).alias(n) for n in several]
    return fitted.where("status = 'fitted'").select("*", F.posexplode("names").alias("constituent_index", "name")).select(
        "series_id", "constituent_index", "name", (F.array_position("rank_order", F.col("constituent_index")) - 1).cast("int").alias("rank"), F.col("reference").alias("reference_mjd"), "mean", "mean_v", F.col("slope").alias("slope_per_day"), F.col("slope_v").alias("slope_v_per_day"), "latitude", *columns
    )


def reconstruct(fitted: DataFrame, targets: DataFrame, options: FitOptions, names: tuple[str, ...] | None = None, min_snr: float | None = None, min_pe: float = 0.0, non_harmonic: str = "mean_and_trend", series: str = "series_id", time: str = "mjd") -> DataFrame:
    """series_id, mjd, h or u and v at ``targets`` (series_id, mjd; any order, repeats stay, a missing time gives a missing value).

    Named constituents win over thresholds, which are inclusive. ``non_harmonic``: none, mean or mean_and_trend.
    """
    if names is None and min_snr is not None and options.confidence == "none":
        raise AnalysisError("snr_needs_confidence", "a fit without intervals has no SNR")
    asked = targets.groupBy(F.col(series).alias("series_id")).agg(F.collect_list(F.col(time).cast("double")).alias("t"), F.count_if(F.col(time).isNull()).alias("missing"))
    rows = fitted.where("status = 'fitted'").select("series_id", "names", "latitude", "reference", "mean", "mean_v", "slope", "slope_v", "snr", "pe", "cos", "sin", "u_cos", "u_sin", "v_cos", "v_sin").join(asked, "series_id")
    kind = fitted.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from perigee.operators.kernel import basis

        for batch in batches:
            keys, ts, us, vs = [], [], [], []
            for row in batch.to_pylist():
                t = np.array([x for x in row["t"] if np.isfinite(x)])
                every = tuple(row["names"])
                lost = len(row["t"]) - len(t) + row["missing"]
                if names is not None:
                    if unknown := [n for n in names if n not in every]:
                        raise AnalysisError("unknown_constituent", f"not fitted: {unknown}")
                    chosen = np.array([n in names for n in every])
                else:
                    chosen = np.array([x is not None and x >= min_pe for x in row["pe"]])
                    if min_snr is not None:
                        chosen &= np.array([x is not None and x >= min_snr for x in row["snr"]])
                z, _ = basis(TimeTerms(every, t), TimeTerms(every, np.array([row["reference"]])), t, row["reference"], row["latitude"], options)
                parts = []
                for c, s, m, k in (("cos", "sin", "mean", "slope"),) if row["cos"] is not None else (("u_cos", "u_sin", "mean", "slope"), ("v_cos", "v_sin", "mean_v", "slope_v")):
                    value = (np.array(row[c]) * chosen) @ z.real + (np.array(row[s]) * chosen) @ z.imag
                    if non_harmonic != "none":
                        value = value + row[m]
                    if non_harmonic == "mean_and_trend":
                        value = value + row[k] * (t - row["reference"])
                    parts.append(value.tolist() + [None] * lost)
                keys += [row["series_id"]] * (len(t) + lost)
                ts += t.tolist() + [None] * lost
                us += parts[0]
                vs += parts[1] if len(parts) > 1 else [None] * (len(t) + lost)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("series_id").type), pa.array(ts, pa.float64()), pa.array(us, pa.float64()), pa.array(vs, pa.float64())], names=["series_id", "mjd", "u", "v"])

    return rows.mapInArrow(run, f"series_id {kind}, mjd double, u double, v double")
