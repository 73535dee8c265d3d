"""Every query with SQL against the same SQL in DuckDB, at the smallest scale."""

import glob
import os

import pytest

from perigee.plans import catalogue

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, database, name):
    frame = catalogue.queries()[name](spark, DIR)
    names = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in frame.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    found = database.sql(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry_stands_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("perigee.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setitem(sys.modules, "perigee.llm", None)
    real = importlib.import_module

    def without(name, *a):
        if name.startswith("perigee.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="perigee.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = real("__spark_entry__")
    assert "pipeline" not in entry.queries() and "harmonic_fit_trend" in entry.queries() and entry.oracle_sql()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_every_hour_is_reconstructed(spark):
    hours = catalogue.hourly(spark, DIR).select("hour").distinct().count()
    out = catalogue.queries()["reconstruct_series"](spark, DIR)
    assert out.select("mjd").distinct().count() == hours
    assert out.count() == hours * out.select("series_id").distinct().count()


def test_every_part_begins_an_element(spark):
    keys = {r.p_partkey for r in catalogue.read(spark, DIR, "part").select("p_partkey").collect()}
    want = {k for k in keys if {k + 1, k + 2} <= keys}
    out = catalogue.queries()["layer_depths"](spark, DIR).collect()
    assert {r.element_id for r in out} == want and len(out) == 3 * len(want)
