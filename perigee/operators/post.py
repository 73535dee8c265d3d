"""What follows from coefficients in long form: energies, ranks, neighbours, intervals, inference, filters, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.ellipse import Z95


def amplitude_phase(c: Column, s: Column) -> tuple[Column, Column]:
    return F.hypot(c, s), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def percent_energy(energy: Column, series: str = "series_id") -> Column:
    return 100.0 * energy / F.sum(energy).over(Window.partitionBy(series))


def rank_by(coef: DataFrame, key: Column, name: str, series: str = "series_id", index: str = "constituent_index") -> DataFrame:
    """``name``: position from 0 in the order of ``key``, ties by the stable index; storage order stays."""
    return coef.withColumn(name, F.row_number().over(Window.partitionBy(series).orderBy(key, F.col(index))) - 1)


def scalar_snr(amplitude: Column, interval: Column) -> Column:
    return amplitude * amplitude / F.pow(interval / Z95, F.lit(2.0))


def white_intervals(c: Column, s: Column, vc: Column, vs: Column) -> tuple[Column, Column]:
    """Intervals of amplitude and phase (degrees) from the variances of both coefficients."""
    size = c * c + s * s
    return Z95 * F.sqrt((c * c * vc + s * s * vs) / size), Z95 * F.degrees(F.sqrt((s * s * vc + c * c * vs) / (size * size)))


def rayleigh_neighbours(coef: DataFrame, effective_days: Column, least: float = 1.0, series: str = "series_id") -> DataFrame:
    """lower_name, lower_rr, higher_name, higher_rr (and rnm if there is ``snr``): neighbours in frequency."""
    order = Window.partitionBy(series).orderBy("frequency", "constituent_index")
    out = coef
    for side, take in (("lower", F.lag), ("higher", F.lead)):
        rr = 24.0 * effective_days * F.abs(take("frequency").over(order) - F.col("frequency")) / least
        out = out.withColumns({f"{side}_name": take("name").over(order), f"{side}_rr": rr})
        if "snr" in coef.columns:
            out = out.withColumn(f"{side}_rnm", F.col(f"{side}_rr") * F.sqrt((F.col("snr") + take("snr").over(order)) / 2))
    return out


def tidal_variances(points: DataFrame, series: str = "series_id") -> DataFrame:
    """tv_raw, tv_all, ptv_all from ``raw`` and ``tide`` at each time; no share of a raw variance that isn't positive."""
    out = points.groupBy(series).agg(F.avg(F.col("raw") * F.col("raw")).alias("tv_raw"), F.avg(F.col("tide") * F.col("tide")).alias("tv_all"))
    return out.withColumn("ptv_all", F.when(F.col("tv_raw") > 0, 100.0 * F.col("tv_all") / F.col("tv_raw")))


def infer(coef: DataFrame, relations: DataFrame, series: str = "series_id") -> DataFrame:
    """Inferred constituents from fitted references: ``relations`` (inferred, reference, ratio, phase), a few rows."""
    turn = F.radians("phase")
    re, im = F.col("ratio") * F.cos(turn), F.col("ratio") * F.sin(turn)
    met = coef.join(F.broadcast(relations), coef.name == relations.reference)
    return met.select(series, F.col("inferred").alias("name"), (re * F.col("c") + im * F.col("s")).alias("c"), (re * F.col("s") - im * F.col("c")).alias("s"))


def prefilter_gain(constituents: DataFrame, response: DataFrame, low: float, high: float) -> DataFrame:
    """``gain``: linear interpolation of the response; 1 beyond its grid or for a gain that isn't accepted.

    The response is a short table; its brackets are made by one window and broadcast.
    """
    order = Window.orderBy("frequency_cph")
    brackets = response.select(F.col("frequency_cph").alias("f0"), F.col("gain").alias("g0"), F.lead("frequency_cph").over(order).alias("f1"), F.lead("gain").over(order).alias("g1")).where("f1 IS NOT NULL")
    last = F.max("f1").over(Window.partitionBy())
    closed = brackets.withColumn("closed", F.col("f1") == last)
    met = constituents.join(F.broadcast(closed), (F.col("frequency") >= F.col("f0")) & ((F.col("frequency") < F.col("f1")) | (F.col("closed") & (F.col("frequency") == F.col("f1")))), "left")
    g = F.col("g0") + (F.col("g1") - F.col("g0")) * (F.col("frequency") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    return met.withColumn("gain", F.when(F.abs(g).between(low, high), g).otherwise(1.0)).drop("f0", "g0", "f1", "g1", "closed")


def reconstruction_filter(coef: DataFrame, names: list[str] | None = None, min_snr: float | None = None, min_pe: float = 0.0) -> DataFrame:
    """Names win over thresholds; thresholds are inclusive."""
    if names is not None:
        return coef.where(F.col("name").isin(names))
    kept = coef.where(F.col("pe") >= min_pe)
    return kept if min_snr is None else kept.where(F.col("snr") >= min_snr)


def evaluate(coef: DataFrame, basis: DataFrame, series: str = "series_id") -> DataFrame:
    """series_id, mjd, tide: sums of cosine times real part plus sine times imaginary part, over the basis (name, mjd, re, im).

    The sum over constituents is taken before the shuffle.
    """
    return coef.join(basis, "name").groupBy(series, "mjd").agg(F.sum(F.col("c") * F.col("re") + F.col("s") * F.col("im")).alias("tide"))


def result_digest(coef: DataFrame, columns: list[str], series: str = "series_id", digits: int = 6) -> DataFrame:
    """series_id, digest: SHA-256 over the rounded values in constituent order."""
    text = F.concat_ws("|", F.col("name"), *(F.format_number(F.round(F.col(c), digits) + F.lit(0.0), digits) for c in columns))
    return coef.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("constituent_index", text.alias("t")))).alias("rows")).select(series, F.sha2(F.array_join(F.col("rows.t"), ";"), 256).alias("digest"))
