"""Layered currents on a mesh, interpolated to fixed depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def only_wet(rows: DataFrame, wet: DataFrame) -> DataFrame:
    """``rows`` (mjd, element_id, ...) without those of elements that ``wet`` (mjd, element_id, wet 0 or 1) doesn't say to be wet then."""
    return rows.join(wet.where("wet = 1").select("mjd", "element_id"), ["mjd", "element_id"], "left_semi")


def layer_depths(mesh: DataFrame, sigma: DataFrame, bathymetry: DataFrame, surface: DataFrame, wet: DataFrame | None = None) -> DataFrame:
    """mjd, element_id, layer, depth: mean over an element's three nodes of -sigma (h + zeta); all three must be known.

    ``mesh`` (element_id, node_ids), ``sigma`` (layer, node_id, sigma), ``bathymetry`` (node_id, h), ``surface`` (mjd, node_id, zeta).
    With ``wet`` (mjd, element_id, wet) an element has layers at the times only at which it is wet.
    """
    corners = mesh.select("element_id", F.explode("node_ids").alias("node_id"))
    column = corners.join(bathymetry, "node_id").join(sigma, "node_id").join(surface, "node_id")
    depth = -F.col("sigma") * (F.col("h") + F.col("zeta"))
    depths = column.groupBy("mjd", "element_id", "layer").agg(F.avg(depth).alias("depth"), F.count(depth).alias("corners")).where("corners = 3").drop("corners")
    return depths if wet is None else only_wet(depths, wet)


def to_depths(layers: DataFrame, depths: list[float], keys: tuple[str, ...] = ("mjd", "element_id"), values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """keys, target, values: linear between neighbouring layers, exact on a layer, nothing beyond the first and last.

    ``layers`` has ``layer``, ``depth`` and values; a column of layers whose depths don't increase is left out.
    """
    order = Window.partitionBy(*keys).orderBy("layer")
    nexts = {f"next_{c}": F.lead(c).over(order) for c in ("depth", *values)}
    all_ = Window.partitionBy(*keys)
    bracket = layers.withColumns(nexts).withColumn("bad", F.max(F.coalesce((F.col("next_depth") <= F.col("depth")).cast("int"), F.lit(0))).over(all_)).where("bad = 0")
    targets = bracket.withColumn("target", F.explode(F.array(*(F.lit(float(d)) for d in depths))))
    inside = targets.where(F.col("target").between(F.col("depth"), F.coalesce(F.col("next_depth"), F.col("depth"))))
    part = (F.col("target") - F.col("depth")) / (F.col("next_depth") - F.col("depth"))
    value = lambda c: F.when(F.col("target") == F.col("depth"), F.col(c)).when(F.col("target") == F.col("next_depth"), F.col(f"next_{c}")).otherwise(F.col(c) + part * (F.col(f"next_{c}") - F.col(c)))
    found = inside.select(*keys, "target", "layer", *(value(c).alias(c) for c in values))
    first = found.withColumn("first", F.min("layer").over(Window.partitionBy(*keys, "target"))).where("layer = first")
    return first.select(*keys, "target", *values)
