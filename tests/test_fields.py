from datetime import datetime

import pytest
from pyspark.sql import functions as F

from perigee.operators.options import AnalysisError
from perigee.plans import catalogue
from perigee.sources import fields


def test_scalar_and_vector_fields(spark):
    fill = -999.0
    rows = [(0, 58000, 0, 1.5, 2.0, 1), (0, 58000, 43_200_000, -999.0, 2.0, 1), (1, None, 0, 1.0, 2.0, 1), (1, 58001, -7, 1.0, 2.0, 2), (2, 58001, 0, float("nan"), 3.0, 1), (3, 58002, 0, 4.0, None, 1)]
    table = spark.createDataFrame(rows, "node int, itime int, itime2 int, zeta float, va float, layer int")
    got = fields.scalar_field(table, fill=fill, prefix=3, time=fields.split_time(fill=-7)).orderBy("series_id", "mjd").collect()
    assert [(r.series_id, r.mjd, r.u) for r in got] == [(0, 58000.0, 1.5), (0, 58000.5, None), (2, 58001.0, None)]
    both = fields.vector_field(table, u="zeta", v="va", fill=fill, series="node", layers=[1], time=fields.split_time(fill=-7)).collect()
    assert [(r.series_id, r.layer, r.layer_position, r.u, r.v) for r in both] == [(0, 1, 0, 1.5, 2.0)]
    with pytest.raises(AnalysisError):
        fields.vector_field(table, u="zeta", v="va", series="node", layers=[1, 1])


def test_each_component_has_its_own_fill_value(spark):
    table = spark.createDataFrame([(0, 58000.0, 3.0, 1.0), (1, 58000.0, 1.0, 3.0), (2, 58000.0, 3.0, 3.0), (3, 58000.0, None, 1.0)], "element int, mjd double, ua double, va double")
    kept = lambda fill: sorted(r.series_id for r in fields.vector_field(table, fill=fill, time=F.col("mjd")).collect())
    assert (kept((None, 3.0)), kept((3.0, None)), kept(3.0), kept(None)) == ([0], [1], [], [0, 1, 2])


def test_a_value_like_the_other_components_fill_stays(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1), 5, 3.0), (3, datetime(2024, 1, 2), 5, 1.0), (4, datetime(2024, 1, 3), 6, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").withColumn("event_type", F.lit("view")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalogue.queries()["vector_field_scan"](spark, str(tmp_path)).collect()] == [(5, 60310.0, 3.0, 1.0)]


def test_units_fingerprints_and_now(spark):
    assert fields.same_units("m s-1", " m s-1") == "m s-1"
    with pytest.raises(AnalysisError):
        fields.same_units("m", "cm")
    axis = spark.createDataFrame([(1.0,), (2.0,)], "mjd double")
    assert fields.axis_fingerprint(axis) == fields.axis_fingerprint(axis.orderBy("mjd", ascending=False)) != fields.axis_fingerprint(axis.limit(1))
    assert fields.now_mjd(spark) > 60000


def test_sources_describe_themselves(spark):
    rows = [(e, 58000, 0, k, 1.0 * e, 2.0 if e else None) for e in range(3) for k in (1, 2)]
    table = spark.createDataFrame(rows, "element int, itime int, itime2 int, layer int, u double, v double")
    units = {"u": "m s-1", "v": "m s-1 "}
    geometry = {
        "mesh": spark.createDataFrame([(e, [e, e + 1, e + 2]) for e in range(3)], "element_id int, node_ids array<int>"),
        "bathymetry": spark.createDataFrame([(n, 10.0) for n in range(5)], "node_id int, h double"),
        "sigma": spark.createDataFrame([(1, 0, -0.5)], "layer int, node_id int, sigma double"),
        "surface": spark.createDataFrame([(58000.0, 0, 0.0)], "mjd double, node_id int, zeta double"),
    }
    found = fields.describe(table, units, "element", ("u", "v"), geometry)
    assert found == fields.FieldSource("m s-1", 3, 1, (1, 2), "depths", 2)
    assert fields.describe(table, units, "element", ("u", "v")).vertical == "layers"
    assert fields.describe(table.drop("layer"), units, "element", ("u",)) == fields.FieldSource("m s-1", 3, 1, (), "surface", 0)
    for wrong in ({k: x for k, x in geometry.items() if k != "sigma"}, geometry | {"bathymetry": geometry["bathymetry"].where("node_id < 4")}, geometry | {"mesh": spark.createDataFrame([(0, [1, 2])], "element_id int, node_ids array<int>")}):
        with pytest.raises(AnalysisError):
            fields.describe(table, units, "element", ("u", "v"), wrong)
    with pytest.raises(AnalysisError):
        fields.describe(table, {"u": "m", "v": "cm"}, "element", ("u", "v"))
    with pytest.raises(AnalysisError):
        fields.describe(table.drop("layer"), units, "element", ("u", "v"), geometry)
