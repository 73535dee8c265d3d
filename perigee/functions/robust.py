"""Robust weights and scales as expressions and grouped aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.operators.options import TUNING  # noqa: F401

_SMALL = math.sqrt(2.220446049250313e-16)


def weight(name: str, residual: Column) -> Column:
    """Weight of a residual in units of scale times tuning constant."""
    x = F.abs(residual)
    return {
        "andrews": lambda: F.when(x >= math.pi, 0.0).when(x <= _SMALL, 1.0).otherwise(F.sin(x) / x),
        "bisquare": lambda: F.when(x >= 1, 0.0).otherwise((1 - x * x) * (1 - x * x)),
        "cauchy": lambda: 1 / (1 + x * x),
        "fair": lambda: 1 / (1 + x),
        "huber": lambda: F.when(x <= 1, 1.0).otherwise(1 / x),
        "logistic": lambda: F.when(x <= _SMALL, 1.0).otherwise(F.tanh(x) / x),
        "ols": lambda: F.lit(1.0),
        "talwar": lambda: F.when(x < 1, 1.0).otherwise(0.0),
        "welsch": lambda: F.exp(-x * x),
    }[name]()


def mad_scale(residuals: DataFrame, key: str, value: str) -> DataFrame:
    """key, centre, scale: median and median absolute deviation over 0.6745, in two grouped passes."""
    centre = residuals.groupBy(key).agg(F.median(value).alias("centre"))
    return residuals.join(centre, key).groupBy(key).agg(F.first("centre").alias("centre"), (F.median(F.abs(F.col(value) - F.col("centre"))) / 0.6745).alias("scale"))
