"""Choosing constituents, series and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.operators.options import AnalysisError


def rayleigh_constituents(sampled: DataFrame, catalogue: DataFrame, least: float = 1.0, series: str = "series_id") -> DataFrame:
    """series_id, constituent_index, name: those whose separation a series' span resolves; in catalogue order by index.

    The catalogue has 146 rows, so the theta join broadcasts it.
    """
    return sampled.join(F.broadcast(catalogue), F.col("separation") >= F.lit(least) / (24.0 * F.col("span_days"))).select(series, "constituent_index", "name")


def explicit_constituents(catalogue: DataFrame, names: list[str]) -> DataFrame:
    """ordinal, constituent_index, name, frequency in the order asked for; unknown or repeated names are errors."""
    spark = catalogue.sparkSession
    if len(set(names)) < len(names) or not names:
        raise AnalysisError("duplicate_constituent", "names must be unique and at least one")
    asked = spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")
    missing = asked.join(catalogue, "name", "left_anti")
    if not missing.isEmpty():
        raise AnalysisError("unknown_constituent", ", ".join(r.name for r in missing.collect()))
    return asked.join(F.broadcast(catalogue), "name").select("ordinal", "constituent_index", "name", "frequency")


def select_series(table: DataFrame, key: str, prefix: int | None = None, indices: list[int] | None = None) -> DataFrame:
    """All, those numbered below ``prefix``, or ``indices`` in the order asked for (``position``); what isn't there is an error."""
    if prefix is not None:
        most = table.agg(F.max(key)).first()[0]
        if prefix < 1 or most is None or prefix > most + 1:
            raise AnalysisError("selection", f"a prefix must lie between 1 and {0 if most is None else most + 1}, not {prefix}")
        return table.where(F.col(key) < prefix)
    if indices is None:
        return table
    return _asked(table, key, indices, "position")


def select_layers(table: DataFrame, layers: list[int], layer: str = "layer") -> DataFrame:
    """``table`` at ``layers``, with the order asked for (``layer_position``); a layer that isn't there is an error."""
    return _asked(table, layer, layers, "layer_position")


def _asked(table: DataFrame, key: str, values: list[int], position: str) -> DataFrame:
    if len(set(values)) < len(values) or not values:
        raise AnalysisError("selection", f"{key}: what is asked for must be unique and one at least")
    asked = table.sparkSession.createDataFrame(list(enumerate(values)), f"{position} int, asked long")
    found = table.join(F.broadcast(asked), F.col(key) == F.col("asked")).drop("asked")
    if found.select(position).distinct().count() < len(values):
        raise AnalysisError("selection", f"{key}: a value is out of range")
    return found


def not_prepared(requested: DataFrame, prepared: DataFrame, on: str = "name") -> DataFrame:
    return requested.join(prepared, on, "left_anti")


def mask_groups(obs: DataFrame, series: str, index: str, value: str) -> DataFrame:
    """series_id, mask (digest of the positions with values), n_present, n_sharing: series that share a mask."""
    masks = obs.where(F.col(value).isNotNull()).groupBy(series).agg(F.array_sort(F.collect_list(F.col(index).cast("string"))).alias("present"))
    digest = masks.select(series, F.sha2(F.array_join("present", ","), 256).alias("mask"), F.size("present").alias("n_present"))
    return digest.join(digest.groupBy("mask").agg(F.count(F.lit(1)).alias("n_sharing")), "mask").select(series, "mask", "n_present", "n_sharing")
