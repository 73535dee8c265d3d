import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.functions import astronomy, time
from perigee.operators.kernel import rayleigh
from perigee.sources.constituents import BY_NAME, CATALOG


def test_catalogue_is_whole():
    assert len(CATALOG) == 146 and [c.index for c in CATALOG] == list(range(146))
    assert sum(1 for c in CATALOG if c.doodson) == 45
    assert sum(len(c.satellites) for c in CATALOG) == 162
    assert sum(len(c.terms) for c in CATALOG) == 251
    assert {p for c in CATALOG for _, p in c.terms} == {"K1", "K2", "L2", "M2", "N2", "O1", "P1", "S2"}


def test_arguments_known_values():
    cycles, _ = astronomy.arguments(np.array([58128.5]))
    expected = [0.7173822770472214, 0.5880846147713328, 0.8054668918185541, 0.26898236326374025, 0.6211234989092382, 0.7868070868231519]
    assert np.allclose(np.mod(cycles[:, 0], 1), expected, atol=1e-12)


def test_frequencies_at_reference():
    terms = astronomy.TimeTerms(("M2", "S2", "N2", "K1", "O1"), np.array([58128.5]))
    expected = [0.0805114006715772, 0.08333333333333333, 0.07899924869910928, 0.04178074622163722, 0.03873065444993997]
    assert np.allclose(terms.frequency[:, 0], expected, atol=1e-15)


def test_rayleigh_on_a_month():
    names = "MSF 2Q1 Q1 O1 NO1 K1 J1 OO1 UPS1 N2 M2 S2 ETA2 MO3 M3 MK3 SK3 MN4 M4 MS4 S4 2MK5 2SK5 2MN6 M6 2MS6 2SM6 3MK7 M8"
    assert rayleigh(31.0, 1.0) == tuple(names.split())


def test_latitude_near_equator_is_held():
    assert np.array_equal(astronomy.latitude_factors(1.0), astronomy.latitude_factors(5.0))
    assert np.array_equal(astronomy.latitude_factors(-1.0), astronomy.latitude_factors(-5.0))


def test_columns_equal_arrays(spark):
    mjd = np.array([57000.25, 58128.5, 60324.9])
    rows = spark.createDataFrame([(float(x),) for x in mjd], "mjd double")
    cycles, rate = astronomy.argument_columns(F.col("mjd"))
    names = ("M2", "K1", "MS4", "M7")
    factors = astronomy.latitude_factor_columns(F.lit(60.0))
    columns = []
    for n in names:
        columns += [astronomy.phase_column(n, cycles), astronomy.frequency_column(n, rate), *astronomy.nodal_columns(n, cycles, factors)]
    got = np.array([list(r) for r in rows.orderBy("mjd").select(*columns).collect()]).reshape(3, len(names), 4)
    terms = astronomy.TimeTerms(names, mjd)
    nodal = terms.nodal(60.0)
    assert np.allclose(np.exp(2j * np.pi * got[:, :, 0]).T, np.exp(2j * np.pi * terms.phase), atol=1e-9)
    assert np.allclose(got[:, :, 1].T, terms.frequency, atol=1e-15)
    assert np.allclose(got[:, :, 2].T + 1j * got[:, :, 3].T, nodal, atol=1e-12)


def test_epochs(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2017-12-26 06:00:00' AS ts").select(
        time.from_timestamp("ts"), time.from_number(F.lit(17526.25), "unix_days"), time.from_number(F.lit(736689.25), "python"), time.from_number(F.lit(737055.25), "matlab"), time.from_number(F.lit(17526.25 * 86400), "unix"),
        time.from_civil(F.lit(2000), F.lit(2), F.lit(29), 12, 34, 56, 789), time.from_civil(F.lit(2001), F.lit(2), F.lit(29)),
    ).first()
    # 2017-12-26T06:00 is MJD 58113.25
    assert [round(x, 9) for x in row[:5]] == [58113.25] * 5
    assert math.isclose(row[5], 51603.5242683912, abs_tol=1e-9) and row[6] is None


def test_shallow_frequency_is_sum_of_parents():
    for c in CATALOG:
        if c.terms:
            assert math.isclose(c.frequency, sum(k * BY_NAME[p].frequency for k, p in c.terms), abs_tol=2e-9), c.name


@pytest.mark.parametrize("name", ["Z0"])
def test_zero_frequency_is_refused(name):
    from perigee.operators.kernel import solve
    from perigee.operators.options import AnalysisError, FitOptions

    t = 58000 + np.arange(200) / 24
    with pytest.raises(AnalysisError, match="invalid_frequency"):
        solve(t, np.sin(t), None, 50.0, FitOptions(constituents=(name, "M2")))
