"""The driver's tables as inputs of the engine, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions.time import from_timestamp

MJD = "date_diff('microsecond', TIMESTAMP '1858-11-17 00:00:00', {0})::DOUBLE / 8.64e10"
OBS = f"obs AS (SELECT user_id AS series_id, event_id, event_type, {MJD.format('ts')} AS mjd, value AS u, CAST(event_id % 7 AS DOUBLE) AS v, CAST(40 + user_id % 30 AS DOUBLE) AS lat FROM events)"
HOURLY = "hourly AS (SELECT event_type AS series_id, date_diff('hour', TIMESTAMP '1858-11-17 00:00:00', ts) AS hour, SUM(value) AS u, SUM(CAST(event_id % 7 AS DOUBLE)) AS v FROM events GROUP BY 1, 2)"
SAMPLED = "sampled AS (SELECT series_id, COUNT(*) AS n_obs, MIN(mjd) AS first_mjd, MAX(mjd) AS last_mjd, (MIN(mjd) + MAX(mjd)) / 2 AS reference_mjd, MAX(mjd) - MIN(mjd) AS span_days FROM obs GROUP BY series_id)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an irregular series of a scalar and a second component."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "event_id", "event_type", from_timestamp("ts").alias("mjd"), F.col("value").alias("u"), (F.col("event_id") % 7).cast("double").alias("v"), (40 + F.col("user_id") % 30).cast("double").alias("lat"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums per event type: a regular axis with gaps."""
    hour = F.timestamp_diff("HOUR", F.expr("TIMESTAMP_NTZ'1858-11-17 00:00:00'"), F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), hour.alias("hour")).agg(F.sum("value").alias("u"), F.sum((F.col("event_id") % 7).cast("double")).alias("v"))


def pmod(a: str, b: float) -> str:
    return f"((({a}) % {b}::DOUBLE + {b}::DOUBLE) % {b}::DOUBLE)"
