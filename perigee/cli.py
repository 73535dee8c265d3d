"""Command line: fit every series of a Parquet table and write a product.

    python -m perigee.cli analyze-scalar OBS --sites SITES --out DIR [options]
    python -m perigee.cli analyze-vector OBS --sites SITES --out DIR [options]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from perigee import __version__
from perigee.operators.fit import fit
from perigee.operators.options import AnalysisError, FitOptions, Relation
from perigee.operators.selection import select_series
from perigee.plans.shipping import ship
from perigee.sources.product import read_response, write_product


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="perigee", description="Harmonic analysis of many time series.")
    p.add_argument("--version", action="version", version=__version__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("analyze-scalar", "analyze-vector"):
        q = verbs.add_parser(verb)
        q.add_argument("observations", help="Parquet of series_id, mjd, u (and v)")
        place = q.add_mutually_exclusive_group(required=True)
        place.add_argument("--sites", help="Parquet of series_id, lat")
        place.add_argument("--latitude", type=float)
        q.add_argument("--out", required=True)
        q.add_argument("--overwrite", action="store_true")
        q.add_argument("--constituents", help="comma-separated names; default: by the Rayleigh criterion")
        q.add_argument("--rayleigh-min", type=float, default=1.0)
        q.add_argument("--no-trend", action="store_true")
        q.add_argument("--phase", choices=("greenwich", "linear_time", "raw"), default="greenwich")
        q.add_argument("--nodal", choices=("exact", "linear_time", "disabled"), default="exact")
        q.add_argument("--method", choices=("ols", "robust"), default="ols")
        q.add_argument("--weight-function", default="cauchy")
        q.add_argument("--tuning", type=float)
        q.add_argument("--tolerance", type=float, default=0.001)
        q.add_argument("--max-iterations", type=int, default=50)
        q.add_argument("--confidence", choices=("none", "linear", "monte_carlo"), default="none")
        q.add_argument("--noise", choices=("white", "colored"), default="colored")
        q.add_argument("--realizations", type=int, default=200)
        q.add_argument("--seed", type=int, default=0)
        q.add_argument("--order", default="pe", help="pe, snr, frequency, selection or comma-separated names")
        q.add_argument("--infer", action="append", default=[], metavar="NAME=REFERENCE:RATIO:PHASE[:RATIO:PHASE]")
        q.add_argument("--approximate", action="store_true")
        q.add_argument("--prefilter", help="JSON of frequencies and gains")
        q.add_argument("--diagnostics", action="store_true")
        q.add_argument("--axis", choices=("own", "shared"), default="shared")
        q.add_argument("--prefix", type=int, help="only series below this number")
        q.add_argument("--indices", help="only these series, comma-separated")
        q.add_argument("--reconstruct", action="store_true", help="write the fitted values at the observations' times as well")
    return p


def relation(text: str) -> Relation:
    try:
        inferred, rest = text.split("=")
        reference, *numbers = rest.split(":")
        ratio, phase, *more = map(float, numbers)
        return Relation(inferred, reference, ratio, phase, *more)
    except (ValueError, TypeError):
        raise AnalysisError("infer", f"{text!r} isn't NAME=REFERENCE:RATIO:PHASE") from None


def options_of(a: argparse.Namespace) -> FitOptions:
    order = a.order if a.order in ("pe", "snr", "frequency", "selection") else tuple(a.order.split(","))
    return FitOptions(
        constituents=tuple(a.constituents.split(",")) if a.constituents else None, rayleigh_min=a.rayleigh_min, trend=not a.no_trend, phase=a.phase, nodal=a.nodal, method=a.method, weight_function=a.weight_function, tuning=a.tuning, tolerance=a.tolerance, max_iterations=a.max_iterations, confidence=a.confidence,
        noise=a.noise, realizations=a.realizations, seed=a.seed, order=order, infer=tuple(map(relation, a.infer)), approximate=a.approximate, prefilter=read_response(a.prefilter) if a.prefilter else None, diagnostics=a.diagnostics, axis=a.axis,
    )


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        o = options_of(a)
        spark = spark or SparkSession.builder.appName("perigee").getOrCreate()
        ship(spark)
        obs = spark.read.parquet(a.observations)
        obs = select_series(obs, "series_id", a.prefix, [int(x) for x in a.indices.split(",")] if a.indices else None)
        fitted = fit(obs, o, spark.read.parquet(a.sites) if a.sites else None, v="v" if a.verb == "analyze-vector" else None, latitude=a.latitude)
        report = write_product(fitted, a.out, o, a.overwrite, obs if a.reconstruct else None)
    except AnalysisError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
