"""Result products: fixed, versioned tables of coefficients, series, order, weights, bands and sampling, with a report.

Tasks write their own partitions and Spark commits them together, so no result is held in one place; the digest is
taken from the written tables. Everything is written to a folder beside the target and renamed at the end, so a product
is there whole or not at all, and a failed overwrite leaves the old one.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import __version__
from perigee.operators.fit import coefficients, reconstruct
from perigee.operators.options import AnalysisError, FitOptions, PreFilter, Relation
from perigee.operators.sampling import band_counts, lomb_grid
from perigee.functions.spectra import MOST_PER_BAND
from perigee.sources.constituents import BY_NAME, band_table

SCHEMA_VERSION = 2
FEATURES = ("scalar", "vector", "inference", "prefilter", "robust", "linear_confidence", "monte_carlo_confidence", "diagnostics", "shared_axis", "fixed_depth", "reconstruction")
#: Series whose results the report repeats.
SAMPLE_SERIES = 3
_SERIES = ("series_id", "status", "rows", "iterations", "termination", "latitude", "reference", "span", "mean", "mean_v", "slope", "slope_v", "scale", "rms", "condition", "snr_all", "snr_all_adjusted", "tv_raw", "tv_all", "tv_snr", "ptv_all", "ptv_snr")


class _Files:
    """Whole files and renames on the file system that Spark takes for a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, x: str):
        return self.jvm.org.apache.hadoop.fs.Path(x)

    def exists(self, x: str) -> bool:
        return self.fs.exists(self.path(x))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    def remove(self, x: str) -> None:
        self.fs.delete(self.path(x), True)

    def write(self, x: str, text: str) -> None:
        out = self.fs.create(self.path(x), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, x: str) -> str:
        found = self.fs.open(self.path(x))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(found)).decode()
        finally:
            found.close()


def options_to_dict(o: FitOptions) -> dict:
    return {k: v for k, v in dataclasses.asdict(o).items() if k != "extra"}


def options_from_dict(given: dict) -> FitOptions:
    plain = {k: tuple(v) if isinstance(v, list) and k != "infer" else v for k, v in given.items()}
    response = plain.pop("prefilter")
    response = PreFilter(**{k: tuple(v) if isinstance(v, list) else v for k, v in response.items()}) if response else None
    return FitOptions(**plain | {"infer": tuple(Relation(**r) for r in given["infer"]), "prefilter": response})


def bands(series: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """series_id, band, lower, upper, bins, usable: of fitted series, the bins of a spectrum on their own grid, and those that no
    constituent is nearest to."""
    table = band_table(series.sparkSession)
    grid = lomb_grid(series.where("status = 'fitted' AND rows > 3").select("series_id", F.col("rows").alias("n_obs"), F.col("span").alias("span_days")))
    counted = band_counts(grid, table, [BY_NAME[n].frequency for n in names])
    most = F.lit(MOST_PER_BAND).cast("long")
    return counted.join(F.broadcast(table), "band").select("series_id", "band", "lower", "upper", F.least("bins", most).alias("bins"), F.least("usable", most).alias("usable"))


def write_product(fitted: DataFrame, path: str, options: FitOptions, overwrite: bool = False, targets: DataFrame | None = None) -> dict:
    """Tables coefficients, series, order, bands, for robust fits weights, and a report below ``path``; returns the report.

    With ``targets`` (series_id, mjd) a table ``reconstruction`` as well, from the same run of the kernel.
    """
    spark, began, path = fitted.sparkSession, time.time(), path.rstrip("/")
    files, mark = _Files(spark, path), uuid.uuid4().hex
    if files.exists(path) and not overwrite:
        raise AnalysisError("exists", f"{path} is there already")
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        fitted.write.parquet(f"{new}/.fits")  # all tables come from one run of the kernel
        kept = spark.read.parquet(f"{new}/.fits")
        series = kept.select(*_SERIES)
        coef = coefficients(kept)
        good = kept.where("status = 'fitted'")
        tables = {"series": series, "coefficients": coef}
        tables["order"] = good.select("series_id", "names", F.posexplode("rank_order").alias("presentation_rank", "constituent_index")).select("series_id", "presentation_rank", "constituent_index", F.get("names", F.col("constituent_index")).alias("name"))
        named = options.constituents or tuple(r.name for r in good.select(F.explode("names").alias("name")).distinct().collect())  # of 146
        tables["bands"] = bands(series, named)
        if options.method == "robust":
            tables["weights"] = good.select("series_id", F.posexplode("weights").alias("position", "weight"))
        if targets is not None:
            tables["reconstruction"] = reconstruct(kept, targets, options)
        for name, table in tables.items():
            table.write.parquet(f"{new}/{name}")
        written = spark.read.parquet(f"{new}/coefficients")
        summary = spark.read.parquet(f"{new}/series").agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("status") == "fitted").alias("fitted"), F.min("rows").alias("least_rows"), F.max("rows").alias("most_rows"), F.min("span").alias("shortest_span"), F.max("span").alias("longest_span"), F.max(24 * F.col("span") / F.nullif(F.col("rows") - 1, F.lit(0))).alias("longest_step_hours"))
        size = "semi_major" if "v_cos" in written.columns and not written.where("v_cos IS NOT NULL").isEmpty() else "amplitude"
        first = spark.read.parquet(f"{new}/series").where("status = 'fitted'").select("series_id").orderBy("series_id").limit(SAMPLE_SERIES)
        sample = written.join(F.broadcast(first), "series_id").orderBy("series_id", "rank").select("series_id", "name", size, "phase").collect()
        files.remove(f"{new}/.fits")
        report = {"schema_version": SCHEMA_VERSION, "version": __version__, "options": options_to_dict(options), "tables": sorted(tables), "digest": product_digest(written)}
        report |= summary.first().asDict() | {"sample": [r.asDict() for r in sample], "seconds": round(time.time() - began, 3)}
        files.write(f"{new}/report.json", json.dumps(report, indent=1))
        if files.exists(path):
            files.rename(path, old)
        try:
            files.rename(new, path)
        except Exception:
            if files.exists(old):
                files.rename(old, path)
            raise
        files.remove(old)
    except Exception:
        files.remove(new)
        raise
    return report


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Coefficients, series and report; another schema version is refused. :func:`product_options` gives the options back."""
    report = json.loads(_Files(spark, path).read(f"{path}/report.json"))
    if report.get("schema_version") != SCHEMA_VERSION:
        raise AnalysisError("schema_version", f"{report.get('schema_version')} isn't {SCHEMA_VERSION}")
    return spark.read.parquet(f"{path}/coefficients"), spark.read.parquet(f"{path}/series"), report


def product_options(report: dict) -> FitOptions:
    """The options a product was made with, relations and response included."""
    return options_from_dict(report["options"])


def dataset(spark: SparkSession, path: str) -> dict:
    """A product as coordinates, variables with their dimensions, and attributes, the form that ``xarray.Dataset.from_dict`` takes.

    For products that fit into the driver's memory: (series, constituent) arrays in stable order.
    """
    coef, series, report = read_product(spark, path)
    rows = coef.orderBy("series_id", "constituent_index").toPandas()
    ids, names = rows["series_id"].drop_duplicates().tolist(), rows["name"].drop_duplicates().tolist()
    values = [c for c in rows.columns if rows[c].dtype.kind == "f" and rows[c].notna().any() and c not in ("reference_mjd", "mean", "mean_v", "slope_per_day", "slope_v_per_day", "latitude")]
    wide = {c: {"dims": ("series", "constituent"), "data": rows.pivot(index="series_id", columns="name", values=c).reindex(index=ids, columns=names).to_numpy().tolist()} for c in values}
    per = series.where("status = 'fitted'").orderBy("series_id").toPandas().set_index("series_id").reindex(ids)
    single = {c: {"dims": ("series",), "data": per[c].tolist()} for c in ("latitude", "reference", "span", "mean", "slope", "rows")}
    return {"coords": {"series": {"dims": ("series",), "data": ids}, "constituent": {"dims": ("constituent",), "data": names}}, "dims": {"series": len(ids), "constituent": len(names)}, "data_vars": wide | single, "attrs": {"schema_version": report["schema_version"], "digest": report["digest"], "options": json.dumps(report["options"])}}


def product_digest(coef: DataFrame, digits: int = 9) -> str:
    """One digest of all coefficients that doesn't depend on the order of rows: sums of row hashes over rounded values."""
    values = [c for c in ("cos", "sin", "u_cos", "u_sin", "v_cos", "v_sin") if c in coef.columns]
    row = F.xxhash64("series_id", "name", *(F.round(F.col(c), digits) + F.lit(0.0) for c in values))
    parts = coef.agg(F.count(F.lit(1)), F.sum(F.pmod(row, F.lit(2**31 - 1))), F.sum(F.pmod(F.shiftright(row, 31), F.lit(2**31 - 1)))).first()
    return "-".join(f"{x or 0:x}" for x in parts)


def read_response(path: str) -> PreFilter:
    """A pre-filter response from a JSON file with known keys only."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(root) as f:
        return PreFilter.from_mapping(json.loads(f.read()))
