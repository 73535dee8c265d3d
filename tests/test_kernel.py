import numpy as np
import pytest

from perigee.functions import ellipse, spectra
from perigee.operators.kernel import TimeTerms, basis, robust_weight, solve
from perigee.operators.options import TUNING, AnalysisError, FitOptions, PreFilter, Relation

NAMES = ("M2", "S2", "N2", "K1", "O1")
AMPLITUDE = np.array([0.85, 0.24, 0.19, 0.13, 0.09])
PHASE = np.array([10.0, 80.0, 150.0, 220.0, 300.0])
HOURLY = 58113 + np.arange(745) / 24


def tide(t, latitude, options, reference=None, amplitude=AMPLITUDE, phase=PHASE, names=NAMES):
    reference = (t[0] + t[-1]) / 2 if reference is None else reference
    z, _ = basis(TimeTerms(names, t), TimeTerms(names, np.array([reference])), t, reference, latitude, options)
    return (amplitude * np.cos(np.radians(phase))) @ z.real + (amplitude * np.sin(np.radians(phase))) @ z.imag


@pytest.mark.parametrize("phase", ["greenwich", "linear_time", "raw"])
@pytest.mark.parametrize("nodal", ["exact", "linear_time", "disabled"])
@pytest.mark.parametrize("trend", [True, False])
def test_fit_finds_what_was_put_in(phase, nodal, trend):
    o = FitOptions(constituents=NAMES, phase=phase, nodal=nodal, trend=trend)
    y = tide(HOURLY, 60.0, o) + 0.3 + (0.002 * (HOURLY - HOURLY.mean()) if trend else 0)
    out = solve(HOURLY, y, None, 60.0, o)
    assert np.allclose(out["amplitude"], AMPLITUDE, atol=1e-12)
    assert np.allclose(out["phase"], PHASE, atol=1e-9)
    assert abs(out["mean"] - 0.3) < 1e-12 and abs(out["slope"] - 0.002 * trend) < 1e-13
    assert abs(out["pe"].sum() - 100) < 1e-9


@pytest.mark.parametrize("gaps", [False, True])
def test_order_of_rows_with_gaps_on_a_shared_axis(gaps):
    o = FitOptions(constituents=NAMES, confidence="linear", axis="shared")
    y = tide(HOURLY, 60.0, o) + 0.01 * np.sin(np.arange(745) * 1.7)
    if gaps:
        y[[0, 137, 411]] = np.nan
    out = solve(HOURLY, y, None, 60.0, o, axis=HOURLY)
    assert out["reference"] == (HOURLY[0] + HOURLY[-1]) / 2  # the axis', not the record's
    assert np.isfinite(out["amplitude_ci"]).all() and (out["snr"] > 100).all()


def test_single_record_with_a_gap_is_irregular():
    t = np.delete(HOURLY, 300)
    assert spectra.regular_interval_hours(HOURLY) == pytest.approx(1.0)
    assert spectra.regular_interval_hours(t) is None


def test_vector_is_two_scalars():
    o = FitOptions(constituents=NAMES)
    u, v = tide(HOURLY, 58.0, o), tide(HOURLY, 58.0, o, phase=PHASE + 70, amplitude=AMPLITUDE / 2)
    both, a, b = solve(HOURLY, u, v, 58.0, o), solve(HOURLY, u, None, 58.0, o), solve(HOURLY, v, None, 58.0, o)
    assert np.allclose(both["u_cos"], a["cos"]) and np.allclose(both["u_sin"], a["sin"])
    assert np.allclose(both["v_cos"], b["cos"]) and np.allclose(both["v_sin"], b["sin"])


def test_ellipse_round_trip():
    rng = np.random.default_rng(1)
    four = rng.normal(size=(4, 200))
    back = ellipse.to_coefficients(*ellipse.from_coefficients(*four))
    assert np.allclose(back, four)


@pytest.mark.parametrize("function", sorted(TUNING))
def test_robust_resists_outliers(function):
    o = FitOptions(constituents=NAMES, method="robust", weight_function=function, max_iterations=200)
    y = tide(HOURLY, 60.0, o) + np.random.default_rng(2).normal(0, 0.01, 745)
    y[[71, 218, 503]] += [5, -4, 4]
    plain = solve(HOURLY, y, None, 60.0, FitOptions(constituents=NAMES))
    out = solve(HOURLY, y, None, 60.0, o)
    worse, better = np.abs(plain["amplitude"] - AMPLITUDE).max(), np.abs(out["amplitude"] - AMPLITUDE).max()
    assert better <= worse + 1e-9
    if function != "ols":
        assert out["weights"][71] < 0.5


def test_exact_data_end_a_robust_fit():
    o = FitOptions(constituents=("M2",), method="robust", trend=False, phase="raw", nodal="disabled")
    out = solve(HOURLY, np.zeros(745), None, 60.0, o)
    assert out["termination"] == "exact_fit"


def test_weights_at_edges():
    x = np.array([0.0, 1e-9, 1.0, 4.0])
    assert robust_weight("talwar", x).tolist() == [1, 1, 0, 0]
    assert robust_weight("andrews", x)[[0, 3]].tolist() == [1, 0]
    assert robust_weight("bisquare", x)[2] == 0


@pytest.mark.parametrize("vector", [False, True])
@pytest.mark.parametrize("approximate", [False, True])
def test_inference_ratios_hold(vector, approximate):
    o = FitOptions(constituents=NAMES, infer=(Relation("K2", "S2", 0.27, -15.0, 0.2, 5.0), Relation("P1", "K1", 0.33, 12.0, 0.3, -8.0)), approximate=approximate, confidence="linear", noise="white")
    y = tide(HOURLY, 60.0, o)
    out = solve(HOURLY, y, y[::-1].copy() if vector else None, 60.0, o)
    assert out["names"] == ["M2", "N2", "O1", "S2", "K1", "K2", "P1"]
    if not vector:
        assert np.allclose(out["amplitude"][5:] / out["amplitude"][[3, 4]], [0.27, 0.33])
        assert np.allclose(np.mod(out["phase"][[3, 4]] - out["phase"][5:], 360), [345.0, 12.0])


def test_exact_inference_recovers_the_pair():
    o = FitOptions(constituents=NAMES)
    names = (*NAMES, "P1")
    y = tide(HOURLY, 60.0, o, names=names, amplitude=np.r_[AMPLITUDE, 0.13 * 0.33], phase=np.r_[PHASE, 220.0 - 12.0])
    out = solve(HOURLY, y, None, 60.0, FitOptions(constituents=NAMES, infer=(Relation("P1", "K1", 0.33, 12.0),)))
    assert out["amplitude"][out["names"].index("K1")] == pytest.approx(0.13, abs=1e-10)


def test_monte_carlo_is_near_linear_and_repeatable():
    y = tide(HOURLY, 60.0, FitOptions(constituents=NAMES)) + np.random.default_rng(3).normal(0, 0.05, 745)
    linear = solve(HOURLY, y, None, 60.0, FitOptions(constituents=NAMES, confidence="linear", noise="white"))
    o = FitOptions(constituents=NAMES, confidence="monte_carlo", noise="white", realizations=2000)
    drawn, again, other = solve(HOURLY, y, None, 60.0, o, stream=7), solve(HOURLY, y, None, 60.0, o, stream=7), solve(HOURLY, y, None, 60.0, o, stream=8)
    assert np.array_equal(drawn["amplitude_ci"], again["amplitude_ci"]) and not np.array_equal(drawn["amplitude_ci"], other["amplitude_ci"])
    assert np.allclose(drawn["amplitude_ci"] / linear["amplitude_ci"], 1, atol=0.15)


def test_prefilter_scales_the_basis():
    response = PreFilter((0.0, 0.05, 0.1), (1.0, 0.4, 0.3))
    o = FitOptions(constituents=NAMES, prefilter=response)
    out = solve(HOURLY, tide(HOURLY, 60.0, FitOptions(constituents=NAMES)), None, 60.0, o)
    gain = np.interp(out["frequency"], response.frequency, response.gain)
    assert np.allclose(out["amplitude"], AMPLITUDE / gain)
    with pytest.raises(AnalysisError, match="prefilter_gain"):
        solve(HOURLY, np.sin(HOURLY), None, 60.0, FitOptions(constituents=("M8",), prefilter=response))


def test_diagnostics():
    o = FitOptions(constituents=NAMES, confidence="linear", noise="white", diagnostics=True)
    y = tide(HOURLY, 60.0, o) + np.random.default_rng(4).normal(0, 0.02, 745)
    out = solve(HOURLY, y, None, 60.0, o)
    assert out["lower_index"].tolist() == [2, 0, 3, 4, -1] and out["higher_index"].tolist() == [1, -1, 0, 2, 3]
    assert out["condition"] >= 1 and 95 < out["ptv_all"] <= 100.5 and out["tv_snr"] <= out["tv_all"] * 1.01
    assert np.nanmax(out["lower_correlation"]) < 1


@pytest.mark.parametrize("latitude", [0.0, 91.0, float("nan")])
def test_bad_latitude(latitude):
    with pytest.raises(AnalysisError, match="invalid_latitude"):
        solve(HOURLY, np.sin(HOURLY), None, latitude, FitOptions(constituents=NAMES))


def test_too_few_rows_and_bad_times():
    with pytest.raises(AnalysisError, match="too_few"):
        solve(HOURLY[:12], np.ones(12), None, 60.0, FitOptions(constituents=NAMES))
    with pytest.raises(AnalysisError, match="time_axis"):
        solve(HOURLY[::-1], np.ones(745), None, 60.0, FitOptions(constituents=NAMES))
    with pytest.raises(AnalysisError, match="infinite"):
        solve(HOURLY, np.r_[np.inf, np.ones(744)], None, 60.0, FitOptions(constituents=NAMES))


def test_sampling_bins():
    f = spectra.fft_frequencies(240, 1.0)
    wanted = np.array([0.0805114, 1 / 24])
    bins, usable = spectra.band_counts(f, wanted, regular=True)
    assert bins == [2, 5, 5, 5, 5, 5, 6, 8, 49] and usable == [2, 4, 4, 5, 5, 5, 6, 8, 49]


def test_lomb_on_a_regular_axis_is_near_the_periodogram():
    x = np.random.default_rng(5).normal(size=(1, 400))
    f, a = spectra.fft_spectrum(x, 1.0)
    g, b = spectra.lomb_spectrum(x, np.arange(400.0))
    same = np.isin(np.round(f, 9), np.round(g, 9))
    other = np.isin(np.round(g, 9), np.round(f, 9))
    assert np.allclose(a[0, 0][same], b[0, 0][other], rtol=0.05)


@pytest.mark.parametrize("options", [dict(constituents=("XX",)), dict(constituents=("M2", "M2")), dict(order="snr"), dict(phase="x"), dict(realizations=1), dict(infer=(Relation("M2", "M2", 1, 0),)), dict(infer=(Relation("K2", "S2", 1, 0), Relation("K2", "M2", 1, 0)))])
def test_options_are_checked(options):
    with pytest.raises(AnalysisError):
        FitOptions(**options)


def test_prefilter_keys():
    assert PreFilter.from_mapping({"frq": [0, 1], "P": [1, 2], "rng": (0.1, 5)}).high == 5
    with pytest.raises(AnalysisError):
        PreFilter.from_mapping({"frq": [0, 1], "P": [1, 2], "x": 1})
