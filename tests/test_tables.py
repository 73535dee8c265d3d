import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee import api, cli
from perigee.functions.astronomy import TimeTerms
from perigee.operators import fit as fitting
from perigee.operators import moments, post, sampling, selection, vertical
from perigee.operators.kernel import basis
from perigee.operators.options import AnalysisError, FitOptions, PreFilter, Relation
from perigee.sources.constituents import constituent_table
from perigee.sources.product import read_product

NAMES = ("M2", "S2", "K1")
T = 58113 + np.arange(400) / 24


def signal(lat, shift=0.0, t=T):
    o = FitOptions(constituents=NAMES)
    ref = (T[0] + T[-1]) / 2
    z, _ = basis(TimeTerms(NAMES, t), TimeTerms(NAMES, np.array([ref])), t, ref, lat, o)
    a, g = np.array([0.8, 0.3, 0.1]), np.radians(np.array([20.0, 100.0, 200.0]) + shift)
    return 0.2 + (a * np.cos(g)) @ z.real + (a * np.sin(g)) @ z.imag


@pytest.fixture(scope="module")
def table(spark):
    rows = [(s, float(t), float(x), float(y)) for s in range(4) for t, x, y in zip(T, signal(50.0 + s), signal(50.0 + s, 60.0))]
    rows += [(0, None, 1.0, 1.0), (9, float(T[0]), 1.0, 1.0), (1, float("nan"), 1.0, 1.0)]
    return spark.createDataFrame(rows, "series_id long, mjd double, u double, v double").repartition(5)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(s, 50.0 + s) for s in range(4)] + [(9, 50.0)], "series_id long, lat double")


def test_fit_table(table, sites):
    out = {r.series_id: r for r in fitting.fit(table, FitOptions(constituents=NAMES), sites).collect()}
    assert out[9].status == "time_axis" and all(out[s].status == "fitted" for s in range(4))
    assert np.allclose(out[2].amplitude, [0.8, 0.3, 0.1]) and out[2].rank_order == [0, 1, 2]
    coef = fitting.coefficients(fitting.fit(table, FitOptions(constituents=NAMES), sites))
    assert coef.count() == 12 and coef.where("rank = 0").select("name").distinct().collect()[0].name == "M2"


def test_results_do_not_depend_on_partitions(table, sites):
    o = FitOptions(constituents=NAMES, confidence="monte_carlo", noise="white")
    a, b = (sorted((r.series_id, r.amplitude_ci) for r in fitting.fit(table.repartition(n), o, sites).collect() if r.status == "fitted") for n in (1, 7))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-9)


@pytest.mark.parametrize("v", [None, "v"])
def test_reconstruction_returns_the_signal(table, sites, v):
    o = FitOptions(constituents=NAMES)
    fitted = fitting.fit(table, o, sites, v=v)
    got = fitting.reconstruct(fitted, table, o).join(table.withColumnsRenamed({"u": "x", "v": "y"}), ["series_id", "mjd"]).where("mjd IS NOT NULL AND NOT isnan(mjd)")
    worst = got.agg(F.max(F.abs(F.col("u") - F.col("x"))), F.max(F.abs(F.col("v") - F.col("y")))).first()
    assert worst[0] < 1e-10 and (v is None or worst[1] < 1e-10)
    with pytest.raises(AnalysisError):
        fitting.reconstruct(fitted, table, o, min_snr=2.0)


def test_named_constituents_and_no_mean(table, sites):
    o = FitOptions(constituents=NAMES)
    fitted = fitting.fit(table, o, sites)
    whole = fitting.reconstruct(fitted, table, o, names=NAMES, non_harmonic="none").agg(F.avg("u")).first()[0]
    assert abs(whole) < 0.05


def test_moments_equal_the_kernel(table, sites):
    o = FitOptions(constituents=("M2", "K1"), phase="raw", nodal="disabled")
    fitted = {r.series_id: r for r in fitting.fit(table, o, sites).collect() if r.status == "fitted"}
    ref = (T[0] + T[-1]) / 2
    w = [2 * np.pi * 24 * f for f in fitted[0].frequency]
    dt = F.col("mjd") - F.lit(float(ref))
    design = table.where("mjd IS NOT NULL AND NOT isnan(mjd)").withColumns({f"{k}{i}": g(F.lit(float(x)) * dt) for i, x in enumerate(w) for k, g in (("c", F.cos), ("s", F.sin))} | {"one": F.lit(1.0), "tr": dt / float(T[-1] - T[0])})
    for r in moments.solve_by_moments(design, "series_id", ["c0", "s0", "c1", "s1", "one", "tr"], ["u"], errors=True).collect():
        f = fitted[r.series_id]
        assert np.allclose([r.b_0_0, r.b_2_0, r.b_1_0, r.b_3_0], [*f["cos"], *f["sin"]], atol=1e-9) and abs(r.b_4_0 - f.mean) < 1e-9


def test_gap_filling(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([None, 2.0, None, None, 8.0, None])], "k int, i int, x double")
    assert [r.filled for r in sampling.fill_gaps(rows, "k", "i", "x").orderBy("i").collect()] == [2, 2, 4, 6, 8, 8]


def test_sampling_and_masks(spark, table):
    out = {r.series_id: r for r in sampling.series_sampling(sampling.finite(table, "mjd")).collect()}
    assert out[0].n_obs == 400 and out[0].largest_gap_hours == pytest.approx(1.0) and out[9].mean_step_hours is None
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 3.0), (2, 1, None), (3, 1, 1.0)], "s int, i int, x double")
    assert {r.s: r.n_sharing for r in selection.mask_groups(rows, "s", "i", "x").collect()} == {1: 2, 2: 2, 3: 1}
    with pytest.raises(AnalysisError):
        sampling.check_increasing(rows.withColumn("mjd", F.lit(1.0)), "s")


def test_selection(spark):
    every = constituent_table(spark)
    assert [r.name for r in selection.explicit_constituents(every, ["K1", "M2"]).orderBy("ordinal").collect()] == ["K1", "M2"]
    for bad in (["K1", "K1"], ["XX"], []):
        with pytest.raises(AnalysisError):
            selection.explicit_constituents(every, bad)
    with pytest.raises(AnalysisError):
        selection.select_series(spark.range(3), "id", indices=[1, 7])


def test_fixed_depths(spark):
    layers = spark.createDataFrame([(1, k, d, float(u)) for k, (d, u) in enumerate([(5.0, 1), (10.0, 3), (20.0, 7)])] + [(2, 0, 5.0, 1.0), (2, 1, 5.0, 2.0)], "element_id int, layer int, depth double, u double")
    got = {r.target: r.u for r in vertical.to_depths(layers, [4.0, 5.0, 10.0, 15.0, 20.0, 21.0], ("element_id",), ("u",)).collect()}
    assert got == {5.0: 1.0, 10.0: 3.0, 15.0: 5.0, 20.0: 7.0}


def test_prefilter_gain_table(spark):
    response = spark.createDataFrame([(0.0, 1.0), (0.05, 0.4), (0.1, 0.005)], "frequency_cph double, gain double")
    asked = spark.createDataFrame([("a", 0.025), ("b", 0.1), ("c", 0.12)], "name string, frequency double")
    got = {r.name: r.gain for r in post.prefilter_gain(asked, response, 0.01, 100.0).collect()}
    assert got["a"] == pytest.approx(0.7) and got["b"] == got["c"] == 1.0


def test_array_interface():
    u = signal(55.0)
    u[7] = np.nan
    coef = api.solve(T, u, lat=55.0, constit=list(NAMES), conf_int="none")
    back = api.reconstruct(np.r_[T, np.nan], coef, min_SNR=None)
    assert np.isnan(back.h[-1]) and np.nanmax(np.abs(back.h[:-1] - u)) < 1e-11
    assert coef.names[0] == "M2" and "M2" in api.diagnostic_table(coef)
    with pytest.raises(AnalysisError):
        api.reconstruct(T, coef)
    with pytest.raises(ValueError):
        coef.amplitude[0] = 1
    both = api.solve(T, u, signal(55.0, 60.0), lat=55.0, constit=list(NAMES), white=True, infer={"inferred_names": ["K2"], "reference_names": ["S2"], "amp_ratios": [0.2, 0.1], "phase_offsets": [5, 6]})
    assert "K2" in both.names and api.reconstruct(T, both, constit=["M2"]).v.shape == T.shape


def test_epochs():
    day = np.array(["2017-12-26T06:00"], "datetime64[ms]")
    assert api.to_mjd(day)[0] == 58113.25
    assert api.to_mjd([17526.25 * 86400], "unix")[0] == 58113.25 and api.to_mjd([736689.25], "python")[0] == 58113.25 and api.to_mjd([737055.25], "matlab")[0] == 58113.25
    assert api.to_mjd([1.0], "2017-12-25T07:00:00+01:00")[0] == 58113.25
    with pytest.raises(AnalysisError):
        api.to_mjd(day, "unix")


def test_many_and_saved(spark, tmp_path):
    u = np.column_stack([signal(50.0), signal(51.0)])
    u[5, 0] = np.nan
    given = dict(constit=list(NAMES), conf_int="linear", white=True)
    fitted = api.solve_many(spark, T, u, lat=[50.0, 51.0], **given)
    o = api.options(**given, axis="shared")
    api.save(fitted, f"{tmp_path}/m", o)
    again, options = api.load(spark, f"{tmp_path}/m")
    assert options == o and again.count() == 2
    with pytest.raises(Exception):
        api.save(fitted, f"{tmp_path}/m", o)
    meta = tmp_path / "m" / "metadata.json"
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"format_version": 9}))
    with pytest.raises(AnalysisError):
        api.load(spark, f"{tmp_path}/m")


def test_command_line(spark, table, sites, tmp_path, capsys):
    table.where("mjd IS NOT NULL AND NOT isnan(mjd)").write.parquet(f"{tmp_path}/obs")
    sites.write.parquet(f"{tmp_path}/sites")
    common = [f"{tmp_path}/obs", "--sites", f"{tmp_path}/sites", "--constituents", "M2,S2,K1", "--axis", "own", "--prefix", "3"]
    assert cli.main(["analyze-vector", *common, "--out", f"{tmp_path}/p", "--reconstruct"], spark) == 0
    coef, series, report = read_product(spark, f"{tmp_path}/p")
    assert report["series"] == report["fitted"] == series.count() == 3 and coef.count() == 9
    assert spark.read.parquet(f"{tmp_path}/p/reconstruction").count() == 1200
    assert report["tables"] == ["bands", "coefficients", "order", "reconstruction", "series"] and len(report["sample"]) == 9
    assert not [x for x in tmp_path.iterdir() if ".new-" in x.name or ".old-" in x.name]
    assert cli.main(["analyze-vector", *common, "--out", f"{tmp_path}/p"], spark) == 2  # there already
    assert cli.main(["analyze-scalar", *common, "--out", f"{tmp_path}/q", "--order", "snr"], spark) == 2
    assert cli.main(["analyze-scalar", *common, "--out", f"{tmp_path}/q", "--infer", "bad"], spark) == 2


def test_streamed_refit_equals_batch(spark, tmp_path):
    from perigee.streaming.refit import refit_stream, refit_windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = refit_stream(stream, "ts", "user_id", "value", 10).writeStream.format("memory").queryName("refits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    whole = refit_windows(events, "ts", "user_id", "value", 10)
    assert 0 < spark.table("refits").count() and spark.table("refits").exceptAll(whole).count() == 0


@pytest.mark.parametrize("v", [None, "v"])
@pytest.mark.parametrize("given", [{}, {"nodal": "linear_time", "phase": "linear_time"}, {"nodal": "disabled", "phase": "raw", "trend": False}, {"constituents": ("M2", "MS4", "K1"), "order": "frequency"}])
def test_series_solved_together_equal_single_ones(spark, v, given):
    from perigee.operators.kernel import solve

    o = FitOptions(**({"constituents": NAMES} | given))
    rng = np.random.default_rng(1)
    data = {s: (signal(40.0 + s) + rng.normal(0, 0.1, len(T)), signal(40.0 + s, 50.0)) for s in range(40)}
    for s in range(0, 40, 9):
        data[s][0][s] = np.nan
    rows = spark.createDataFrame([(s, float(t), float(x), float(y)) for s, (a, b) in data.items() for t, x, y in zip(T, a, b)], "series_id long, mjd double, u double, v double")
    sites = spark.createDataFrame([(s, 40.0 + s) for s in data], "series_id long, lat double")
    for r in fitting.fit(rows.coalesce(1), o, sites, v=v).collect():
        alone = solve(T, data[r.series_id][0], data[r.series_id][1] if v else None, 40.0 + r.series_id, o)
        assert r.status == "fitted" and r.names == alone["names"] and r.rows == alone["rows"]
        for c in ("pe", "mean", "slope", "frequency", *(("semi_major", "semi_minor", "u_cos", "v_sin", "mean_v") if v else ("cos", "sin", "amplitude"))):
            assert np.allclose(r[c], alone[c], atol=1e-10), c


def test_a_failed_overwrite_leaves_the_old_product(spark, table, sites, tmp_path, monkeypatch):
    from perigee.sources import product

    o = FitOptions(constituents=("M2", "S2"), method="robust", infer=(Relation("K2", "S2", 0.3, 10.0),), prefilter=PreFilter((0.0, 0.2), (1.0, 0.5), fallback="unity"))
    rows = table.where("mjd IS NOT NULL AND NOT isnan(mjd)")
    fitted, path = fitting.fit(rows, o, sites), f"{tmp_path}/p"
    report = product.write_product(fitted, path, o)
    assert product.product_options(json.loads(json.dumps(report))) == o and "weights" in report["tables"]
    first = sorted(map(str, product.read_product(spark, path)[0].collect()))
    order = spark.read.parquet(f"{path}/order").collect()
    assert len(order) == 3 * report["fitted"] and {r.presentation_rank for r in order} == {0, 1, 2}
    assert spark.read.parquet(f"{path}/weights").groupBy("series_id").count().where("count > 10").count() == report["fitted"]
    assert spark.read.parquet(f"{path}/bands").where("usable > bins OR lower >= upper").count() == 0

    def broken(*_):
        raise OSError("no space")

    for name in ("product_digest", "reconstruct"):
        with monkeypatch.context() as m:
            m.setattr(product, name, broken)
            with pytest.raises(OSError):
                product.write_product(fitted, path, o, overwrite=True, targets=rows)
    true = product._Files.rename
    with monkeypatch.context() as m:
        m.setattr(product._Files, "rename", lambda self, a, b: broken() if ".new-" in a else true(self, a, b))
        with pytest.raises(OSError):
            product.write_product(fitted, path, o, overwrite=True)
    with pytest.raises(AnalysisError):
        product.write_product(fitted, path, o)
    assert sorted(map(str, product.read_product(spark, path)[0].collect())) == first and [x.name for x in tmp_path.iterdir()] == ["p"]
    again = product.write_product(fitted, path, o, overwrite=True)
    assert again["digest"] == report["digest"] and [x.name for x in tmp_path.iterdir()] == ["p"]
    view = product.dataset(spark, path)
    assert view["dims"] == {"series": report["fitted"], "constituent": 3} and np.shape(view["data_vars"]["amplitude"]["data"]) == (report["fitted"], 3)


def test_selection_out_of_range(spark):
    from perigee.operators.selection import select_layers, select_series

    rows = spark.createDataFrame([(s, k) for s in range(4) for k in (5, 6, 7)], "series_id long, layer int")
    assert select_series(rows, "series_id", prefix=4).count() == 12
    for wrong in (0, 5):
        with pytest.raises(AnalysisError):
            select_series(rows, "series_id", prefix=wrong)
    with pytest.raises(AnalysisError):
        select_series(rows, "series_id", indices=[1, 9])
    got = select_layers(rows.where("series_id = 0"), [7, 5]).orderBy("layer_position").collect()
    assert [r.layer for r in got] == [7, 5]
    for wrong in ([8], [5, 5], []):
        with pytest.raises(AnalysisError):
            select_layers(rows, wrong)


def test_dry_elements_have_no_layers(spark):
    from perigee.operators import vertical

    mesh = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4])], "element_id int, node_ids array<int>")
    sigma = spark.createDataFrame([(k, n, -0.25 * k) for k in (1, 2) for n in range(1, 5)], "layer int, node_id int, sigma double")
    h = spark.createDataFrame([(n, 10.0 * n) for n in range(1, 5)], "node_id int, h double")
    zeta = spark.createDataFrame([(float(t), n, 0.1 * t) for t in range(3) for n in range(1, 5)], "mjd double, node_id int, zeta double")
    wet = spark.createDataFrame([(0.0, 0, 1), (0.0, 1, 0), (1.0, 0, 1), (1.0, 1, 1), (2.0, 0, None)], "mjd double, element_id int, wet int")
    got = {(r.mjd, r.element_id, r.layer): r.depth for r in vertical.layer_depths(mesh, sigma, h, zeta, wet).collect()}
    assert set(got) == {(t, e, k) for t, e in ((0.0, 0), (1.0, 0), (1.0, 1)) for k in (1, 2)}
    assert got[1.0, 1, 2] == pytest.approx(0.5 * 30.1)
    assert vertical.layer_depths(mesh, sigma, h, zeta).count() == 12


def test_spectra_equal_sums_over_samples(spark):
    from perigee.operators import spectrum

    rng = np.random.default_rng(2)
    data = {s: (np.sort(rng.uniform(0, 20, n)), rng.normal(size=n)) for s, n in (("a", 41), ("b", 8), ("c", 1))}
    rows = spark.createDataFrame([(s, float(t), float(x)) for s, (a, b) in data.items() for t, x in zip(a, b)], "key string, t double, x double")
    psd = {(r.key, r.bin): r for r in spectrum.periodogram(rows, "key", "t", "x").collect()}
    power = {(r.key, r.bin): r for r in spectrum.lomb(rows, "key", "t", "x").collect()}
    for s, (t, x) in data.items():
        n = len(x) - len(x) % 2
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n, 1))
        y = (x[:n] - x[:n].mean()) * w if n else x[:0]
        for b in range(n // 2 + 1 if n else 0):
            z = (y * np.exp(-2j * np.pi * b * np.arange(n) / n)).sum()
            assert psd.pop((s, b)).density == pytest.approx((1 if b in (0, n // 2) else 2) * abs(z) ** 2 / (w @ w), abs=1e-9)
        hours = 24 * (t - t[0])
        for b in range(1, len(t) // 2):
            f = b / (len(t) * hours[-1] / (len(t) - 1))
            a = 2 * np.pi * f * hours
            shift = np.arctan2(np.sin(2 * a).sum(), np.cos(2 * a).sum()) / 2
            c, d = np.cos(a - shift), np.sin(a - shift)
            r = power.pop((s, b))
            assert r.frequency == pytest.approx(f) and r.power == pytest.approx(((x @ c) ** 2 / (c @ c) + (x @ d) ** 2 / (d @ d)) / 2)
    assert not psd and not power
