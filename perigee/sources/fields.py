"""Model fields in long form: node elevations, element currents, layered currents, and their times.

Parquet's own column pruning and pushed filters do what hyperslab reads do elsewhere: a selection of series or layers
and the needed columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.operators.options import AnalysisError
from perigee.operators.sampling import finite, without_fill
from perigee.operators.selection import select_layers, select_series

MILLISECONDS_PER_DAY = 86_400_000.0


def split_time(days: str = "itime", milliseconds: str = "itime2", fill: int | None = None) -> Column:
    """MJD from whole days and milliseconds; a fill value in either part makes the time missing."""
    ok = F.col(days).isNotNull() & F.col(milliseconds).isNotNull()
    if fill is not None:
        ok &= (F.col(days) != fill) & (F.col(milliseconds) != fill)
    return F.when(ok, F.col(days) + F.col(milliseconds) / F.lit(MILLISECONDS_PER_DAY))


def scalar_field(table: DataFrame, value: str = "zeta", fill: float | None = None, series: str = "node", prefix: int | None = None, indices: list[int] | None = None, time: Column | None = None) -> DataFrame:
    """series_id, mjd, u of the selected nodes; fill values and NaN are missing, rows without a time go."""
    chosen = select_series(table, series, prefix, indices)
    u = F.col(value).cast("double") if fill is None else without_fill(F.col(value).cast("double"), fill)
    rows = chosen.select(F.col(series).alias("series_id"), (split_time() if time is None else time).alias("mjd"), u.alias("u"))
    return finite(rows, "mjd")


def vector_field(table: DataFrame, u: str = "ua", v: str = "va", fill: float | tuple[float | None, float | None] | None = None, series: str = "element", prefix: int | None = None, indices: list[int] | None = None, layers: list[int] | None = None, time: Column | None = None) -> DataFrame:
    """series_id, mjd, u, v (and of selected layers ``layer`` and ``layer_position``, their order): both components present.

    ``fill``: value that is missing in either component, or a pair of each component's own (None: it has none).
    """
    chosen = select_series(table, series, prefix, indices)
    if layers is not None:
        chosen = select_layers(chosen, layers)
    fill_u, fill_v = fill if isinstance(fill, tuple) else (fill, fill)
    clean = lambda c, own: F.col(c).cast("double") if own is None else without_fill(F.col(c).cast("double"), own)
    more = ["layer", "layer_position"] if layers is not None else []
    rows = chosen.select(F.col(series).alias("series_id"), *more, (split_time() if time is None else time).alias("mjd"), clean(u, fill_u).alias("u"), clean(v, fill_v).alias("v"))
    return finite(rows, "mjd", "u", "v")


@dataclass(frozen=True)
class FieldSource:
    """What a model's tables say of themselves: units, rows, and how values lie in the vertical.

    ``vertical``: surface (no layers), layers (a layer column), or depths (layers, with sigma, bathymetry and surface to
    interpolate by).
    """

    unit: str
    series: int
    times: int
    layers: tuple[int, ...]
    vertical: str
    missing: int


def describe(values: DataFrame, units: dict[str, str], series: str, columns: tuple[str, ...], geometry: dict[str, DataFrame] | None = None, time: Column | None = None) -> FieldSource:
    """Check a model's tables and describe them, by one aggregation over ``values``.

    ``units`` of the value columns must agree. ``geometry`` (sigma, bathymetry, surface, mesh) is all there or not at all, its nodes
    are known to the bathymetry, and each element has three of them.
    """
    unit = same_units(*(units[c] for c in columns))
    layered = "layer" in values.columns
    none = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in columns]
    n, times, missing, layers = values.agg(F.count_distinct(series), F.count_distinct(split_time() if time is None else time), sum(none[1:], none[0]), F.array_sort(F.collect_set("layer")) if layered else F.array().cast("array<int>")).first()
    if geometry:
        if lacking := {"sigma", "bathymetry", "surface", "mesh"} - set(geometry):
            raise AnalysisError("geometry", f"lacks {sorted(lacking)}")
        if not layered:
            raise AnalysisError("geometry", "values without layers can't be interpolated to depths")
        mesh = geometry["mesh"]
        if not mesh.where(F.size("node_ids") != 3).isEmpty():
            raise AnalysisError("geometry", "an element needs three nodes")
        if not mesh.select(F.explode("node_ids").alias("node_id")).join(geometry["bathymetry"], "node_id", "left_anti").isEmpty():
            raise AnalysisError("geometry", "a node has no depth")
    return FieldSource(unit, n, times, tuple(layers), "depths" if geometry else "layers" if layered else "surface", missing)


def same_units(*units: str) -> str:
    """The common unit of several variables; different ones are an error."""
    if len({x.strip() for x in units}) != 1:
        raise AnalysisError("units", f"{units} differ")
    return units[0].strip()


def axis_fingerprint(axis: DataFrame, time: str = "mjd") -> str:
    """A hash of a time axis' points, to tell whether a fit and a request share it; their order is that of their values, so
    sums of the points' hashes do, and no task sees them all."""
    h = F.xxhash64(F.col(time).cast("double"))
    n, low, high = axis.where(F.col(time).isNotNull()).agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(2**31 - 1))), F.sum(F.shiftrightunsigned(h, 31))).first()
    return f"{n:x}-{low or 0:x}-{high or 0:x}"


def ordered(table: DataFrame, layer: str = "layer", element: str = "series_id") -> DataFrame:
    """Output order: by layer or depth, then element."""
    return table.orderBy(layer, element)


def now_mjd(spark: SparkSession) -> float:
    return spark.sql("SELECT unix_micros(current_timestamp()) / 8.64e10D + 40587").first()[0]
