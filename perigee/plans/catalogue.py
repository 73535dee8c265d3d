"""Every registered query on the driver's tables, with the SQL it is compared against.

Doubles are rounded, and angles given as cosine and sine or away from their seam, so that both engines agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.functions import astronomy, ellipse, robust, time
from perigee.operators import moments, post, sampling, selection, spectrum, vertical
from perigee.operators.fit import coefficients, fit, reconstruct
from perigee.operators.options import FitOptions, PreFilter, Relation
from perigee.plans import sql_astronomy as sa
from perigee.plans.tables import HOURLY, MJD, OBS, SAMPLED, hourly, obs, pmod, read
from perigee.sources import constituents as cat
from perigee.sources.fields import split_time, vector_field

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FIVE = ("M2", "S2", "N2", "K1", "O1")
_BANDS = "bands(band, lower, upper) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(cat.BANDS)) + ")"
_CONSTITUENTS = "constituent(constituent_index, name, separation, frequency) AS (VALUES " + ", ".join(f"({c.index}, '{c.name}', {c.separation!r}::DOUBLE, {c.frequency!r}::DOUBLE)" for c in cat.CATALOG) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _s(x: str, digits: int = 6) -> str:
    return f"(ROUND(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"


# -- time ------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT event_id, {_s('mjd', 8)} AS mjd FROM obs")
def mjd_events(spark, sf_dir):
    return obs(spark, sf_dir).select("event_id", _r("mjd", 8).alias("mjd"))


@query(f"WITH {OBS} SELECT event_id, {_s('(mjd - 40587) * 86400 / 86400 + 40587', 6)} AS from_unix, {_s('mjd', 6)} AS from_python, {_s('mjd', 6)} AS from_matlab FROM obs")
def mjd_epochs(spark, sf_dir):
    m = F.col("mjd")
    return obs(spark, sf_dir).select("event_id", _r(time.from_number((m - 40587.0) * 86400.0, "unix")).alias("from_unix"), _r(time.from_number(m + 678576.0, "python")).alias("from_python"), _r(time.from_number(m + 678942.0, "matlab")).alias("from_matlab"))


@query(f"SELECT o_orderkey, {_s(MJD.format('o_orderdate'))} AS mjd, {_s(MJD.format('o_orderdate') + ' + 0.5')} AS noon FROM orders")
def civil_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    parts = (F.year(d), F.month(d), F.dayofmonth(d))
    clock = (F.hour(d), F.minute(d), F.second(d).cast("int"))
    whole = time.from_civil(*parts, *clock)
    return read(spark, sf_dir, "orders").select("o_orderkey", _r(whole).alias("mjd"), _r(whole + 0.5).alias("noon"))


@query(f"WITH {HOURLY}, axis AS (SELECT DISTINCT hour / 24.0::DOUBLE AS mjd FROM hourly) SELECT CAST(ROW_NUMBER() OVER (ORDER BY mjd) - 1 AS INTEGER) AS time_index, {_s('mjd')} AS mjd FROM axis")
def time_axis(spark, sf_dir):
    axis = sampling.time_axis(hourly(spark, sf_dir).select((F.col("hour") / 24.0).alias("mjd")))
    return axis.select("time_index", _r("mjd").alias("mjd"))


@query(f"SELECT event_id, CASE WHEN event_id % 10 > 0 THEN {_s('58000 + event_id % 30 + (event_id % 86400) * 1000 / 86400000.0::DOUBLE')} END AS mjd FROM events")
def split_times(spark, sf_dir):
    e = F.col("event_id")
    parts = read(spark, sf_dir, "events").select("event_id", F.when(e % 10 > 0, 58000 + e % 30).otherwise(-1).alias("itime"), ((e % 86400) * 1000).alias("itime2"))
    return parts.select("event_id", _r(split_time(fill=-1)).alias("mjd"))


@query(f"WITH {OBS} SELECT series_id, {_s('mjd')} AS mjd, {_s('u')} AS u, v FROM obs WHERE u IS NOT NULL AND v <> 3")
def vector_field_scan(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumnsRenamed({"series_id": "element", "u": "ua", "v": "va"})
    out = vector_field(rows, fill=(None, 3.0), time=F.col("mjd"))
    return out.select("series_id", _r("mjd").alias("mjd"), _r("u").alias("u"), "v")


# -- sampling ----------------------------------------------------------------------------------------------------

_GAPS = "gaps AS (SELECT series_id, MAX(d) AS gap FROM (SELECT series_id, mjd - LAG(mjd) OVER (PARTITION BY series_id ORDER BY mjd) AS d FROM obs) GROUP BY series_id)"


@query(f"WITH {OBS}, {SAMPLED}, {_GAPS} SELECT series_id, n_obs, {_s('reference_mjd')} AS reference_mjd, {_s('span_days')} AS span_days, {_s('24 * span_days / (n_obs - 1)')} AS mean_step_hours, {_s('24 * gap')} AS largest_gap_hours FROM sampled JOIN gaps USING (series_id)")
def sampling_series(spark, sf_dir):
    out = sampling.series_sampling(obs(spark, sf_dir))
    return out.select("series_id", "n_obs", *(_r(c).alias(c) for c in ("reference_mjd", "span_days", "mean_step_hours", "largest_gap_hours")))


@query(f"WITH {OBS}, {SAMPLED}, {_GAPS} SELECT COUNT(*) AS n_series, COUNT(*) FILTER (n_obs >= 13) AS n_fitted, MIN(n_obs) AS min_obs, MAX(n_obs) AS max_obs, {_s('MIN(span_days)')} AS min_span, {_s('MAX(span_days)')} AS max_span, {_s('MAX(24 * gap)')} AS max_gap FROM sampled JOIN gaps USING (series_id)")
def sampling_summary(spark, sf_dir):
    out = sampling.sampling_summary(sampling.series_sampling(obs(spark, sf_dir)), FitOptions(constituents=FIVE).minimum_rows(5))
    return out.select("n_series", "n_fitted", "min_obs", "max_obs", *(_r(c).alias(c) for c in ("min_span", "max_span", "max_gap")))


_DAYS = f"days AS (SELECT DISTINCT {MJD.format('l_shipdate')} AS mjd FROM lineitem)"


@query(f"WITH {_DAYS}, steps AS (SELECT mjd - LAG(mjd) OVER (ORDER BY mjd) AS step FROM days), kinds AS (SELECT step, COUNT(*) AS n FROM steps WHERE step IS NOT NULL GROUP BY step) SELECT CAST(SUM(n) + 1 AS BIGINT) AS n_times, COUNT(*) AS n_steps, {_s('VAR_POP(step)')} AS step_variance, VAR_POP(step) < 2.220446049250313e-16 AS regular FROM kinds")
def axis_regularity(spark, sf_dir):
    days = read(spark, sf_dir, "lineitem").select(time.from_timestamp("l_shipdate").alias("mjd")).distinct()
    return sampling.axis_regularity(days).withColumn("step_variance", _r("step_variance"))


@query(f"SELECT event_id, CASE WHEN value = 50 THEN NULL ELSE {_s('value')} END AS u, value IS NOT NULL AND event_id % 3 > 0 AS joint FROM events")
def missing_values(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 > 0, F.lit(1.0))
    return read(spark, sf_dir, "events").select("event_id", sampling.without_fill(_r("value"), 50.0).alias("u"), (F.col("value").isNotNull() & v.isNotNull()).alias("joint"))


@query("SELECT s_suppkey, s_acctbal / 100 BETWEEN -90 AND 90 AND s_acctbal <> 0 AS valid FROM supplier")
def latitude_check(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", sampling.valid_latitude(F.col("s_acctbal") / 100).alias("valid"))


@query(f"WITH {OBS}, {SAMPLED} SELECT series_id, bin, {_s('bin / (n_obs * span_days * 24 / (n_obs - 1))', 9)} AS frequency FROM sampled, LATERAL (SELECT UNNEST(range(1, n_obs // 2)) AS bin)")
def lomb_grid(spark, sf_dir):
    return sampling.lomb_grid(sampling.series_sampling(obs(spark, sf_dir))).select("series_id", "bin", _r("frequency", 9).alias("frequency"))


_FFT_COUNTS = f"grid AS (SELECT series_id, bin, bin / (n - n % 2)::DOUBLE AS frequency, n - n % 2 AS even FROM (SELECT series_id, COUNT(*) AS n FROM hourly GROUP BY 1), LATERAL (SELECT UNNEST(range(0, (n - n % 2) // 2 + 1)) AS bin))"


@query(f"WITH {HOURLY}, {_FFT_COUNTS} SELECT series_id, bin, {_s('frequency', 9)} AS frequency FROM grid")
def fft_grid(spark, sf_dir):
    n = hourly(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.fft_grid(n).select("series_id", "bin", _r("frequency", 9).alias("frequency"))


_FREQ = [cat.BY_NAME[n].frequency for n in FIVE]
_TAKEN = " OR ".join(f"bin = CAST(round_even({f!r} * even, 0) AS BIGINT)" for f in _FREQ)


@query(f"WITH {HOURLY}, {_FFT_COUNTS}, {_BANDS}, near AS (SELECT *, LAG(frequency) OVER (PARTITION BY series_id ORDER BY bin) AS before FROM grid) SELECT series_id, band, COUNT(*) AS bins, COUNT(*) FILTER (NOT ({_TAKEN})) AS usable FROM near JOIN bands ON frequency >= lower AND COALESCE(before, -1) < upper GROUP BY 1, 2")
def band_counts(spark, sf_dir):
    n = hourly(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.band_counts(sampling.fft_grid(n), cat.band_table(spark), _FREQ)


_FULL = "full_axis AS (SELECT series_id, h AS hour FROM (SELECT DISTINCT series_id FROM hourly), (SELECT UNNEST(range(MIN(hour), MAX(hour) + 1)) AS h FROM hourly)), gappy AS (SELECT series_id, hour, CASE WHEN hour % 5 > 0 THEN u END AS u FROM full_axis LEFT JOIN hourly USING (series_id, hour))"


def _gappy(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    ends = rows.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    axis = rows.select("series_id").distinct().crossJoin(F.broadcast(ends)).select("series_id", F.explode(F.sequence("a", "b")).alias("hour"))
    return axis.join(rows, ["series_id", "hour"], "left").select("series_id", "hour", F.when(F.col("hour") % 5 > 0, F.col("u")).alias("u"))


@query(
    f"""WITH {HOURLY}, {_FULL}, ends AS (SELECT *, LAST_VALUE(u IGNORE NULLS) OVER b AS a, FIRST_VALUE(u IGNORE NULLS) OVER f AS z,
    LAST_VALUE(CASE WHEN u IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS ia, FIRST_VALUE(CASE WHEN u IS NOT NULL THEN hour END IGNORE NULLS) OVER f AS iz FROM gappy
    WINDOW b AS (PARTITION BY series_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series_id, hour, {_s('COALESCE(CASE WHEN ia = iz THEN a ELSE a + (z - a) * (hour - ia)::DOUBLE / (iz - ia) END, a, z)')} AS filled FROM ends"""
)
def gap_interpolation(spark, sf_dir):
    return sampling.fill_gaps(_gappy(spark, sf_dir), "series_id", "hour", "u").select("series_id", "hour", _r("filled").alias("filled"))


# -- selection ---------------------------------------------------------------------------------------------------


@query(f"WITH {OBS}, {SAMPLED}, {_CONSTITUENTS} SELECT series_id, constituent_index, name FROM sampled JOIN constituent ON separation >= 1.0::DOUBLE / (24.0::DOUBLE * span_days)")
def rayleigh_select(spark, sf_dir):
    return selection.rayleigh_constituents(sampling.series_sampling(obs(spark, sf_dir)), cat.constituent_table(spark))


@query(f"WITH {_CONSTITUENTS}, asked(ordinal, name) AS (VALUES (0, 'K1'), (1, 'M2'), (2, 'MS4')) SELECT ordinal, constituent_index, name, {_s('frequency', 9)} AS frequency FROM asked JOIN constituent USING (name)")
def explicit_select(spark, sf_dir):
    return selection.explicit_constituents(cat.constituent_table(spark), ["K1", "M2", "MS4"]).withColumn("frequency", _r("frequency", 9))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 7")
def select_prefix(spark, sf_dir):
    return selection.select_series(read(spark, sf_dir, "nation"), "n_nationkey", prefix=7).select("n_nationkey", "n_name")


@query("SELECT position, n_nationkey, n_name FROM nation JOIN (VALUES (0, 9), (1, 2), (2, 21)) a(position, asked) ON n_nationkey = asked")
def select_indices(spark, sf_dir):
    return selection.select_series(read(spark, sf_dir, "nation"), "n_nationkey", indices=[9, 2, 21]).select("position", "n_nationkey", "n_name")


@query(f"WITH {_CONSTITUENTS} SELECT name FROM constituent WHERE name NOT IN ({', '.join(repr(c.name) for c in cat.CATALOG if c.doodson)})")
def not_prepared(spark, sf_dir):
    every = cat.constituent_table(spark)
    return selection.not_prepared(every, every.where("doodson IS NOT NULL")).select("name")


@query(f"WITH {HOURLY}, masks AS (SELECT series_id, sha256(string_agg(hour::VARCHAR, ',' ORDER BY hour::VARCHAR)) AS mask, COUNT(*)::INTEGER AS n_present FROM hourly GROUP BY 1) SELECT series_id, mask, n_present, COUNT(*) OVER (PARTITION BY mask) AS n_sharing FROM masks")
def mask_groups(spark, sf_dir):
    return selection.mask_groups(hourly(spark, sf_dir), "series_id", "hour", "u")


# -- astronomy ---------------------------------------------------------------------------------------------------

_HOURS = "hours AS (SELECT DISTINCT hour, hour / 24.0::DOUBLE AS mjd FROM hourly)"
_CYC, _RATE = sa.argument_sql("mjd")
_SIX = ("tau", "s", "h", "p", "n", "p1")


def _hours(spark, sf_dir):
    return hourly(spark, sf_dir).select("hour").distinct().withColumn("mjd", F.col("hour") / 24.0)


@query(f"WITH {HOURLY}, {_HOURS} SELECT hour, " + ", ".join(f"{_s(f'COS({2 * math.pi!r} * {c})')} AS cos_{n}, {_s(f'SIN({2 * math.pi!r} * {c})')} AS sin_{n}, {_s(r, 9)} AS rate_{n}" for n, c, r in zip(_SIX, _CYC, _RATE)) + " FROM hours")
def astronomical_arguments(spark, sf_dir):
    cycles, rate = astronomy.argument_columns(F.col("mjd"))
    both = [x for n, c, r in zip(_SIX, cycles, rate) for x in (_r(F.cos(c * (2 * math.pi))).alias(f"cos_{n}"), _r(F.sin(c * (2 * math.pi))).alias(f"sin_{n}"), _r(r, 9).alias(f"rate_{n}"))]
    return _hours(spark, sf_dir).select("hour", *both)


_NAMES = ("M2", "K1", "O1", "MS4", "2MK5")


@query(f"WITH {OBS}, {SAMPLED}, ref AS (SELECT series_id, reference_mjd AS mjd FROM sampled) " + " UNION ALL ".join(f"SELECT series_id, '{n}' AS name, {_s(sa.frequency_sql(n, _RATE), 9)} AS frequency FROM ref" for n in _NAMES))
def frequency_at_reference(spark, sf_dir):
    _, rate = astronomy.argument_columns(F.col("reference_mjd"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), _r(astronomy.frequency_column(n, rate), 9).alias("frequency")) for n in _NAMES)))
    return sampling.series_sampling(obs(spark, sf_dir)).select("series_id", each.alias("x")).select("series_id", "x.name", "x.frequency")


@query(f"WITH {HOURLY}, {_HOURS} " + " UNION ALL ".join(f"SELECT hour, '{n}' AS name, {_s(f'COS({2 * math.pi!r} * {sa.phase_sql(n, _CYC)})')} AS re, {_s(f'SIN({2 * math.pi!r} * {sa.phase_sql(n, _CYC)})')} AS im FROM hours" for n in _NAMES))
def greenwich_phase(spark, sf_dir):
    cycles, _ = astronomy.argument_columns(F.col("mjd"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (astronomy.phase_column(n, cycles) * (2 * math.pi)).alias("angle")) for n in _NAMES)))
    return _hours(spark, sf_dir).select("hour", each.alias("x")).select("hour", "x.name", _r(F.cos("x.angle")).alias("re"), _r(F.sin("x.angle")).alias("im"))


@query(f"SELECT s_suppkey, {_s(sa.factor_sql('lat')[1])} AS diurnal, {_s(sa.factor_sql('lat')[2])} AS semidiurnal FROM (SELECT s_suppkey, (s_suppkey % 160 - 80.5)::DOUBLE AS lat FROM supplier)")
def latitude_factors(spark, sf_dir):
    f = astronomy.latitude_factor_columns((F.col("s_suppkey") % 160 - 80.5).cast("double"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", _r(f[1]).alias("diurnal"), _r(f[2]).alias("semidiurnal"))


_NODAL = {n: sa.nodal_sql(n, _CYC, sa.factor_sql("60.0::DOUBLE")) for n in ("M2", "K1", "MS4")}


@query(f"WITH {HOURLY}, {_HOURS} " + " UNION ALL ".join(f"SELECT hour, '{n}' AS name, {_s(re)} AS re, {_s(im)} AS im FROM hours" for n, (re, im) in _NODAL.items()))
def nodal_corrections(spark, sf_dir):
    cycles, _ = astronomy.argument_columns(F.col("mjd"))
    rows = _hours(spark, sf_dir).withColumns({f"y{k}": c for k, c in enumerate(cycles)} | {f"f{k}": x for k, x in enumerate(astronomy.latitude_factor_columns(F.lit(60.0)))})
    y, f = [F.col(f"y{k}") for k in range(6)], [F.col(f"f{k}") for k in range(3)]
    # Base corrections first, compounds from their columns: each is computed once.
    base = {n: astronomy.nodal_columns(n, y, f) for n in ("M2", "K1", "S2")}
    rows = rows.withColumns({f"{k}_{n}": x for n, pair in base.items() for k, x in zip(("re", "im"), pair)})
    compound = astronomy.compound_columns("MS4", {n: (F.col(f"re_{n}"), F.col(f"im_{n}")) for n in base})
    rows = rows.withColumns({f"{k}_MS4": x for k, x in zip(("re", "im"), compound)})
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("name"), _r(f"re_{n}").alias("re"), _r(f"im_{n}").alias("im")) for n in _NODAL)))
    return rows.select("hour", each)


# -- fits by moments -----------------------------------------------------------------------------------------------

_W = {n: 2 * math.pi * 24.0 * cat.BY_NAME[n].frequency for n in FIVE}


def _raw_design(spark, sf_dir, names, trend):
    rows = obs(spark, sf_dir)
    ends = rows.groupBy("series_id").agg(((F.min("mjd") + F.max("mjd")) / 2).alias("ref"), (F.max("mjd") - F.min("mjd")).alias("span"))
    met = rows.join(ends, "series_id").withColumn("dt", F.col("mjd") - F.col("ref"))
    columns = {f"{k}{i}": f(F.lit(_W[n]) * F.col("dt")) for i, n in enumerate(names) for k, f in (("c", F.cos), ("s", F.sin))}
    return met.withColumns({**columns, "one": F.lit(1.0), **({"tr": F.col("dt") / F.col("span")} if trend else {})})


def _raw_sql(names, trend):
    columns = ", ".join(f"COS({_W[n]!r}::DOUBLE * dt) AS c{i}, SIN({_W[n]!r}::DOUBLE * dt) AS s{i}" for i, n in enumerate(names))
    return f"{OBS}, {SAMPLED}, timed AS (SELECT obs.*, mjd - reference_mjd AS dt, span_days AS span FROM obs JOIN sampled USING (series_id)), design AS (SELECT *, {columns}, 1.0::DOUBLE AS one{', dt / span AS tr' if trend else ''} FROM timed)"


def _design_columns(names, trend):
    return [f"{k}{i}" for i in range(len(names)) for k in "cs"] + ["one"] + ["tr"] * trend


def _fit_sql(names, trend, targets=("u",)):
    return f"WITH {_raw_sql(names, trend)}, {moments.gauss_sql('design', 'series_id', _design_columns(names, trend), list(targets))} "


#: Near the driver's tables' times.
EPOCH = 60324.0


def _fit_native(spark, sf_dir, names, trend, targets=("u",), errors=False):
    if not errors:
        return moments.harmonic_moments(obs(spark, sf_dir), "series_id", "mjd", [_W[n] for n in names], list(targets), trend, EPOCH)
    return moments.solve_by_moments(_raw_design(spark, sf_dir, names, trend), "series_id", _design_columns(names, trend), list(targets), errors)


@query(_fit_sql(("M2",), False) + f"SELECT series_id, n_obs, {_s('b_0_0', 5)} AS cos_m2, {_s('b_1_0', 5)} AS sin_m2, {_s('SQRT(b_0_0 * b_0_0 + b_1_0 * b_1_0)', 5)} AS amplitude, {_s('b_2_0', 5)} AS mean FROM solved")
def harmonic_fit_raw(spark, sf_dir):
    a, _ = post.amplitude_phase(F.col("b_0_0"), F.col("b_1_0"))
    return _fit_native(spark, sf_dir, ("M2",), False).select("series_id", "n_obs", _r("b_0_0", 5).alias("cos_m2"), _r("b_1_0", 5).alias("sin_m2"), _r(a, 5).alias("amplitude"), _r("b_2_0", 5).alias("mean"))


_FIVE_SQL = ", ".join(f"{_s(f'b_{2 * i}_0', 5)} AS cos_{n}, {_s(f'b_{2 * i + 1}_0', 5)} AS sin_{n}" for i, n in enumerate(FIVE))


@query(_fit_sql(FIVE, True) + f"SELECT series_id, n_obs, {_FIVE_SQL}, {_s('b_10_0', 5)} AS mean, {_s('b_11_0', 5)} AS trend FROM solved")
def harmonic_fit_trend(spark, sf_dir):
    each = [x for i, n in enumerate(FIVE) for x in (_r(f"b_{2 * i}_0", 5).alias(f"cos_{n}"), _r(f"b_{2 * i + 1}_0", 5).alias(f"sin_{n}"))]
    return _fit_native(spark, sf_dir, FIVE, True).select("series_id", "n_obs", *each, _r("b_10_0", 5).alias("mean"), _r("b_11_0", 5).alias("trend"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five constituents, mean and trend for every series, without leaving the engine."""
    return harmonic_fit_trend(spark, sf_dir)


def _nodal_design_sql(names=("M2", "K1"), trend=False, gain=None):
    """Exact phases and nodal corrections at every time, of series that have each time once."""
    parts = []
    for i, n in enumerate(names):
        (re, im), turn = sa.nodal_sql(n, ["", *(f"y{k}" for k in range(1, 6))], ["1.0::DOUBLE", "f1", "f2"]), f"{2 * math.pi!r}::DOUBLE * " + sa.phase_sql(n, [f"y{k}" for k in range(6)])
        g = f"{gain(n)} * " if gain else ""
        parts.append(f"{g}({re} * COS({turn}) - {im} * SIN({turn})) AS c{i}, {g}({re} * SIN({turn}) + {im} * COS({turn})) AS s{i}")
    f = sa.factor_sql("lat")
    once = "timed AS (SELECT obs.*, reference_mjd, mjd - reference_mjd AS dt, span_days AS span FROM obs JOIN sampled USING (series_id) WHERE series_id NOT IN (SELECT series_id FROM obs GROUP BY series_id, mjd HAVING COUNT(*) > 1))"
    return f"{OBS}, {SAMPLED}, {once}, angled AS (SELECT *, {', '.join(f'{c} AS y{k}' for k, c in enumerate(_CYC))}, {f[1]} AS f1, {f[2]} AS f2 FROM timed), design AS (SELECT *, {', '.join(parts)}, 1.0::DOUBLE AS one{', dt / span AS tr' if trend else ''} FROM angled)"


@query(f"WITH {_nodal_design_sql()}, {moments.gauss_sql('design', 'series_id', ['c0', 's0', 'c1', 's1', 'one'], ['u'])} SELECT series_id, {_s('b_0_0', 5)} AS cos_M2, {_s('b_1_0', 5)} AS sin_M2, {_s('b_2_0', 5)} AS cos_K1, {_s('b_3_0', 5)} AS sin_K1, {_s('b_4_0', 5)} AS mean FROM solved")
def harmonic_fit_nodal(spark, sf_dir):
    cycles, _ = astronomy.argument_columns(F.col("mjd"))
    rows = obs(spark, sf_dir).withColumns({f"y{k}": c for k, c in enumerate(cycles)} | {f"f{k}": x for k, x in enumerate(astronomy.latitude_factor_columns(F.col("lat")))})
    y, f, design = [F.col(f"y{k}") for k in range(6)], [F.col(f"f{k}") for k in range(3)], {"one": F.lit(1.0)}
    for i, n in enumerate(("M2", "K1")):
        (re, im), turn = astronomy.nodal_columns(n, y, f), astronomy.phase_column(n, y) * (2 * math.pi)
        design |= {f"c{i}": re * F.cos(turn) - im * F.sin(turn), f"s{i}": re * F.sin(turn) + im * F.cos(turn)}
    out = moments.solve_by_moments(rows.withColumns(design), "series_id", ["c0", "s0", "c1", "s1", "one"], ["u"])
    return out.select("series_id", *(_r(f"b_{i}_0", 5).alias(n) for i, n in enumerate(("cos_M2", "sin_M2", "cos_K1", "sin_K1", "mean"))))


_ELL = dict(zip(("uc", "us", "vc", "vs"), ("b_0_0", "b_1_0", "b_0_1", "b_1_1")))
_PR, _PI_, _MR, _MI = "((b_0_0 + b_1_1) / 2)", "((b_0_1 - b_1_0) / 2)", "((b_0_0 - b_1_1) / 2)", "((b_0_1 + b_1_0) / 2)"
_PLUS, _MINUS = f"SQRT({_PR} * {_PR} + {_PI_} * {_PI_})", f"SQRT({_MR} * {_MR} + {_MI} * {_MI})"
_TILT = pmod(f"(DEGREES(ATAN2({_PI_}, {_PR})) + DEGREES(ATAN2({_MI}, {_MR}))) / 2", 180.0)


@query(_fit_sql(("M2",), False, ("u", "v")) + f"SELECT series_id, {_s(f'{_PLUS} + {_MINUS}', 5)} AS semi_major, {_s(f'{_PLUS} - {_MINUS}', 5)} AS semi_minor, {_s(f'COS(2 * RADIANS({_TILT}))', 4)} AS tilt_cos, {_s(f'SIN(2 * RADIANS({_TILT}))', 4)} AS tilt_sin FROM solved")
def vector_fit(spark, sf_dir):
    major, minor, tilt, _ = ellipse.ellipse_columns(*map(F.col, _ELL.values()))
    return _fit_native(spark, sf_dir, ("M2",), False, ("u", "v")).select("series_id", _r(major, 5).alias("semi_major"), _r(minor, 5).alias("semi_minor"), _r(F.cos(2 * F.radians(tilt)), 4).alias("tilt_cos"), _r(F.sin(2 * F.radians(tilt)), 4).alias("tilt_sin"))


@query(_fit_sql(("M2",), False, ("u", "v")) + "SELECT series_id, " + ", ".join(f"{_s(c, 5)} AS {n}" for n, c in _ELL.items()) + " FROM solved")
def ellipse_round_trip(spark, sf_dir):
    forth = ellipse.ellipse_columns(*map(F.col, _ELL.values()))
    back = ellipse.coefficient_columns(*forth)
    return _fit_native(spark, sf_dir, ("M2",), False, ("u", "v")).select("series_id", *(_r(c, 5).alias(n) for n, c in zip(_ELL, back)))


_VC, _VS = "(noise_0 * v_0)", "(noise_0 * v_1)"
_SIZE = "(b_0_0 * b_0_0 + b_1_0 * b_1_0)"
_ACI = f"(1.96 * SQRT((b_0_0 * b_0_0 * {_VC} + b_1_0 * b_1_0 * {_VS}) / {_SIZE}))"


@query(_fit_sql(("M2", "K1"), True) + f"SELECT series_id, {_s(_ACI, 5)} AS amplitude_ci, {_s(f'{_SIZE} / POWER({_ACI} / 1.96, 2)', 5)} AS snr, {_s('noise_0', 4)} AS noise FROM solved")
def white_confidence(spark, sf_dir):
    c, s = F.col("b_0_0"), F.col("b_1_0")
    a, _ = post.amplitude_phase(c, s)
    interval, _ = post.white_intervals(c, s, F.col("noise_0") * F.col("v_0"), F.col("noise_0") * F.col("v_1"))
    return _fit_native(spark, sf_dir, ("M2", "K1"), True, errors=True).select("series_id", _r(interval, 5).alias("amplitude_ci"), _r(post.scalar_snr(a, interval), 5).alias("snr"), _r("noise_0", 4).alias("noise"))


# -- coefficients in long form ---------------------------------------------------------------------------------------

_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT series_id, {i} AS constituent_index, '{n}' AS name, {cat.BY_NAME[n].frequency!r}::DOUBLE AS frequency, b_{2 * i}_0 AS c, b_{2 * i + 1}_0 AS s FROM solved" for i, n in enumerate(FIVE)) + "), coef AS (SELECT *, SQRT(c * c + s * s) AS amplitude, 100 * (c * c + s * s) / SUM(c * c + s * s) OVER (PARTITION BY series_id) AS pe FROM long) "


def _coef(spark, sf_dir):
    each = F.array(*(F.struct(F.lit(i).alias("constituent_index"), F.lit(n).alias("name"), F.lit(cat.BY_NAME[n].frequency).alias("frequency"), F.col(f"b_{2 * i}_0").alias("c"), F.col(f"b_{2 * i + 1}_0").alias("s")) for i, n in enumerate(FIVE)))
    long = _fit_native(spark, sf_dir, FIVE, True).select("series_id", F.inline(each))
    a, _ = post.amplitude_phase(F.col("c"), F.col("s"))
    return long.withColumns({"amplitude": a, "pe": post.percent_energy(F.col("c") * F.col("c") + F.col("s") * F.col("s"))})


_COEF = _fit_sql(FIVE, True).rstrip() + _LONG


@query(_COEF + f"SELECT series_id, name, {_s('amplitude', 5)} AS amplitude, {_s('pe', 5)} AS pe, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY pe DESC, constituent_index)::INTEGER - 1 AS pe_rank, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY frequency, constituent_index)::INTEGER - 1 AS frequency_rank FROM coef")
def presentation_orders(spark, sf_dir):
    ranked = post.rank_by(post.rank_by(_coef(spark, sf_dir), F.desc("pe"), "pe_rank"), F.col("frequency"), "frequency_rank")
    return ranked.select("series_id", "name", _r("amplitude", 5).alias("amplitude"), _r("pe", 5).alias("pe"), "pe_rank", "frequency_rank")


@query(_COEF + f"SELECT series_id, name, LAG(name) OVER w AS lower_name, {_s('24 * span_days * n_obs / (n_obs - 1) * (frequency - LAG(frequency) OVER w)', 5)} AS lower_rr, LEAD(name) OVER w AS higher_name, {_s('24 * span_days * n_obs / (n_obs - 1) * (LEAD(frequency) OVER w - frequency)', 5)} AS higher_rr FROM coef JOIN (SELECT series_id, n_obs, span_days FROM sampled) USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY frequency, constituent_index)")
def rayleigh_neighbours(spark, sf_dir):
    days = sampling.series_sampling(obs(spark, sf_dir)).select("series_id", (F.col("span_days") * F.col("n_obs") / (F.col("n_obs") - 1)).alias("days"))
    out = post.rayleigh_neighbours(_coef(spark, sf_dir).join(days, "series_id"), F.col("days"))
    return out.select("series_id", "name", "lower_name", _r("lower_rr", 5).alias("lower_rr"), "higher_name", _r("higher_rr", 5).alias("higher_rr"))


@query(_COEF + f"SELECT series_id, name, {_s('amplitude', 5)} AS amplitude FROM coef WHERE pe >= 10")
def reconstruction_filter(spark, sf_dir):
    return post.reconstruction_filter(_coef(spark, sf_dir), min_pe=10.0).select("series_id", "name", _r("amplitude", 5).alias("amplitude"))


_RELATIONS = (("P1", "K1", 0.331, 12.0), ("K2", "S2", 0.272, -20.0))


@query(_COEF + "SELECT series_id, inferred AS name, " + _s("ratio * COS(RADIANS(phase)) * c + ratio * SIN(RADIANS(phase)) * s", 5) + " AS c, " + _s("ratio * COS(RADIANS(phase)) * s - ratio * SIN(RADIANS(phase)) * c", 5) + " AS s FROM coef JOIN (VALUES " + ", ".join(f"('{a}', '{b}', {r}::DOUBLE, {g}::DOUBLE)" for a, b, r, g in _RELATIONS) + ") r(inferred, reference, ratio, phase) ON name = reference")
def inferred_constituents(spark, sf_dir):
    relations = spark.createDataFrame(_RELATIONS, "inferred string, reference string, ratio double, phase double")
    return post.infer(_coef(spark, sf_dir), relations).select("series_id", "name", _r("c", 5).alias("c"), _r("s", 5).alias("s"))


_TARGETS = "targets AS (SELECT DISTINCT hour / 24.0::DOUBLE AS mjd FROM hourly)"


@query(_COEF.replace(f"WITH {OBS}", f"WITH {HOURLY}, {_TARGETS}, {OBS}") + f"SELECT series_id, {_s('mjd')} AS mjd, {_s('SUM(c * COS(' + repr(2 * math.pi * 24) + ' * frequency * (mjd - 60324)) + s * SIN(' + repr(2 * math.pi * 24) + ' * frequency * (mjd - 60324)))', 4)} AS tide FROM coef, targets GROUP BY series_id, mjd")
def reconstruct_series(spark, sf_dir):
    targets = _hours(spark, sf_dir).select("mjd")
    names = spark.createDataFrame([(n, cat.BY_NAME[n].frequency) for n in FIVE], "name string, f double")
    angle = F.lit(2 * math.pi * 24) * F.col("f") * (F.col("mjd") - 60324)
    # Times by five constituents: the basis table, with the few constituents broadcast.
    basis = targets.crossJoin(F.broadcast(names)).select("name", "mjd", F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    return post.evaluate(_coef(spark, sf_dir), basis).select("series_id", _r("mjd").alias("mjd"), _r("tide", 4).alias("tide"))


_POINTS = "points AS (SELECT series_id, mjd, u - b_10_0 - b_11_0 * tr AS raw, " + " + ".join(f"b_{2 * i}_0 * c{i} + b_{2 * i + 1}_0 * s{i}" for i in range(5)) + " AS tide FROM design JOIN solved USING (series_id)) "


@query(_fit_sql(FIVE, True).rstrip() + ", " + _POINTS + f"SELECT series_id, {_s('AVG(raw * raw)', 3)} AS tv_raw, {_s('AVG(tide * tide)', 3)} AS tv_all, {_s('100 * AVG(tide * tide) / AVG(raw * raw)', 4)} AS ptv_all FROM points GROUP BY series_id")
def tidal_variances(spark, sf_dir):
    design = _raw_design(spark, sf_dir, FIVE, True)
    met = design.join(_fit_native(spark, sf_dir, FIVE, True), "series_id")
    tide = sum((F.col(f"b_{2 * i}_0") * F.col(f"c{i}") + F.col(f"b_{2 * i + 1}_0") * F.col(f"s{i}") for i in range(5)), F.lit(0.0))
    points = met.select("series_id", (F.col("u") - F.col("b_10_0") - F.col("b_11_0") * F.col("tr")).alias("raw"), tide.alias("tide"))
    return post.tidal_variances(points).select("series_id", _r("tv_raw", 3).alias("tv_raw"), _r("tv_all", 3).alias("tv_all"), _r("ptv_all", 4).alias("ptv_all"))


@query(_COEF + "SELECT series_id, sha256(string_agg(name || '|' || printf('%.3f', ROUND(c, 3) + 0.0) || '|' || printf('%.3f', ROUND(s, 3) + 0.0), ';' ORDER BY constituent_index)) AS digest FROM coef GROUP BY series_id")
def result_digest(spark, sf_dir):
    text = F.concat_ws("|", "name", *(F.format_string("%.3f", F.round(F.col(c), 3) + F.lit(0.0)) for c in ("c", "s")))
    rows = _coef(spark, sf_dir).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("constituent_index", text.alias("t")))).alias("x"))
    return rows.select("series_id", F.sha2(F.array_join("x.t", ";"), 256).alias("digest"))


# -- spectra -----------------------------------------------------------------------------------------------------------


def _windowed_sql(source="hourly", key="series_id", index="hour", value="u"):
    return f"numbered AS (SELECT {key}, {index} AS at, {value} AS y, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {index}) - 1 AS i, COUNT(*) OVER (PARTITION BY {key}) AS n0 FROM {source}), evened AS (SELECT *, n0 - n0 % 2 AS n FROM numbered WHERE i < n0 - n0 % 2), win AS (SELECT *, 0.5 - 0.5 * COS({2 * math.pi!r} * i / n) AS w, (y - AVG(y) OVER (PARTITION BY {key})) * (0.5 - 0.5 * COS({2 * math.pi!r} * i / n)) AS x FROM evened)"


_DFT = f"dft AS (SELECT series_id, bin, SUM(x * COS({2 * math.pi!r} * ((bin * i) % n) / n)) AS re, SUM(x * SIN({2 * math.pi!r} * ((bin * i) % n) / n)) AS im, SUM(w * w) AS energy, ANY_VALUE(n) AS n FROM win, LATERAL (SELECT UNNEST(range(0, n // 2 + 1)) AS bin) GROUP BY 1, 2), psd AS (SELECT series_id, bin, bin / n::DOUBLE AS frequency, CASE WHEN bin = 0 OR bin = n // 2 THEN 1 ELSE 2 END * (re * re + im * im) / energy AS density FROM dft)"


@query(f"WITH {HOURLY}, {_windowed_sql()}, {_DFT} SELECT series_id, bin, {_s('frequency', 9)} AS frequency, {_s('density', 2)} AS density FROM psd")
def residual_periodogram(spark, sf_dir):
    out = spectrum.periodogram(hourly(spark, sf_dir), "series_id", "hour", "u")
    return out.select("series_id", "bin", _r("frequency", 9).alias("frequency"), _r("density", 2).alias("density"))


@query(f"WITH {HOURLY}, {_windowed_sql()}, {_DFT}, {_BANDS}, near AS (SELECT *, LAG(frequency) OVER (PARTITION BY series_id ORDER BY bin) AS before FROM psd) SELECT series_id, band, {_s('AVG(density)', 2)} AS density FROM near JOIN bands ON frequency >= lower AND COALESCE(before, -1) < upper GROUP BY 1, 2")
def band_power(spark, sf_dir):
    psd = spectrum.periodogram(hourly(spark, sf_dir), "series_id", "hour", "u")
    return sampling.banded(psd, cat.band_table(spark)).groupBy("series_id", "band").agg(_r(F.avg("density"), 2).alias("density"))


_LGRID = "lgrid AS (SELECT series_id, first_mjd, bin, bin / (n_obs * span_days * 24 / (n_obs - 1)) AS f FROM sampled, LATERAL (SELECT UNNEST(range(1, n_obs // 2)) AS bin))"
_ANG = f"{2 * math.pi!r}::DOUBLE * f * t"


@query(
    f"""WITH {OBS}, {SAMPLED}, {_LGRID}, pairs AS (SELECT series_id, bin, f, (mjd - first_mjd) * 24 AS t, u FROM obs JOIN lgrid USING (series_id)),
    shifts AS (SELECT series_id, bin, ATAN2(SUM(SIN(2 * {_ANG})), SUM(COS(2 * {_ANG}))) / 2 AS sh FROM pairs GROUP BY 1, 2),
    sums AS (SELECT series_id, bin, SUM(u * COS({_ANG} - sh)) AS xc, SUM(u * SIN({_ANG} - sh)) AS xs, SUM(COS({_ANG} - sh) * COS({_ANG} - sh)) AS cc, SUM(SIN({_ANG} - sh) * SIN({_ANG} - sh)) AS ss FROM pairs JOIN shifts USING (series_id, bin) GROUP BY 1, 2)
    SELECT series_id, bin, {_s('(xc * xc / cc + xs * xs / ss) / 2', 3)} AS power FROM sums"""
)
def lomb_spectrum(spark, sf_dir):
    return spectrum.lomb(obs(spark, sf_dir), "series_id", "mjd", "u").select("series_id", "bin", _r("power", 3).alias("power"))


# -- robust ------------------------------------------------------------------------------------------------------------

_X = "ABS((value - 50) / 20)"
_WEIGHTS = {
    "andrews": f"CASE WHEN {_X} >= PI() THEN 0 WHEN {_X} <= 1.4901161193847656e-08 THEN 1 ELSE SIN({_X}) / {_X} END",
    "bisquare": f"CASE WHEN {_X} >= 1 THEN 0 ELSE (1 - {_X} * {_X}) * (1 - {_X} * {_X}) END",
    "cauchy": f"1 / (1 + {_X} * {_X})",
    "fair": f"1 / (1 + {_X})",
    "huber": f"CASE WHEN {_X} <= 1 THEN 1 ELSE 1 / {_X} END",
    "logistic": f"CASE WHEN {_X} <= 1.4901161193847656e-08 THEN 1 ELSE (EXP(2 * {_X}) - 1) / (EXP(2 * {_X}) + 1) / {_X} END",
    "ols": "1.0",
    "talwar": f"CASE WHEN {_X} < 1 THEN 1 ELSE 0 END",
    "welsch": f"EXP(-{_X} * {_X})",
}


@query("SELECT event_id, " + ", ".join(f"{_s(x)} AS {n}" for n, x in _WEIGHTS.items()) + " FROM events")
def robust_weights(spark, sf_dir):
    x = (F.col("value") - 50) / 20
    return read(spark, sf_dir, "events").select("event_id", *(_r(robust.weight(n, x)).alias(n) for n in _WEIGHTS))


_MADS = "centres AS (SELECT series_id, MEDIAN(u) AS centre FROM obs GROUP BY 1), scales AS (SELECT series_id, ANY_VALUE(centre) AS centre, MEDIAN(ABS(u - centre)) / 0.6745 AS scale FROM obs JOIN centres USING (series_id) GROUP BY 1)"


@query(f"WITH {OBS}, {_MADS} SELECT series_id, {_s('centre')} AS centre, {_s('scale')} AS scale, {_s('1.96 * scale')} AS interval FROM scales")
def mad_scale(spark, sf_dir):
    out = robust.mad_scale(obs(spark, sf_dir), "series_id", "u")
    return out.select("series_id", _r("centre").alias("centre"), _r("scale").alias("scale"), _r(1.96 * F.col("scale")).alias("interval"))


_STEP = "weighted AS (SELECT series_id, u, 1 / (1 + POWER((u - centre) / (2.385 * scale), 2)) AS w FROM obs JOIN scales USING (series_id))"


@query(f"WITH {OBS}, {_MADS}, {_STEP} SELECT series_id, {_s('SUM(w * w * u) / SUM(w * w)', 5)} AS location, {_s('SUM(w)', 5)} AS weight FROM weighted GROUP BY 1")
def reweighted_step(spark, sf_dir):
    met = obs(spark, sf_dir).join(robust.mad_scale(obs(spark, sf_dir), "series_id", "u"), "series_id")
    w = robust.weight("cauchy", (F.col("u") - F.col("centre")) / (2.385 * F.col("scale")))
    return met.select("series_id", "u", w.alias("w")).groupBy("series_id").agg(_r(F.sum(F.col("w") * F.col("w") * F.col("u")) / F.sum(F.col("w") * F.col("w")), 5).alias("location"), _r(F.sum("w"), 5).alias("weight"))


@query(f"SELECT event_id, {_s('ABS(' + pmod('value * 7 - event_id % 360 + 180', 360.0) + ' - 180)')} AS error, {_s('(event_id % 360) + ' + pmod('value * 7 - event_id % 360 + 180', 360.0) + ' - 180')} AS clustered FROM events")
def angles(spark, sf_dir):
    a, b = F.col("value") * 7, (F.col("event_id") % 360).cast("double")
    return read(spark, sf_dir, "events").select("event_id", _r(time.angle_error(a, b)).alias("error"), _r(time.cluster(a, b)).alias("clustered"))


# -- filters and depths ------------------------------------------------------------------------------------------------

_GRID = ((0.0, 1.0), (0.05, 0.4), (0.1, 0.005), (0.25, 0.9))


@query(f"WITH {_CONSTITUENTS}, response(f, g) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _GRID)}), br AS (SELECT f AS f0, g AS g0, LEAD(f) OVER (ORDER BY f) AS f1, LEAD(g) OVER (ORDER BY f) AS g1 FROM response), raw AS (SELECT name, g0 + (g1 - g0) * (frequency - f0) / (f1 - f0) AS g FROM constituent LEFT JOIN br ON frequency >= f0 AND (frequency < f1 OR (frequency = f1 AND f1 = 0.25))) SELECT name, {_s('CASE WHEN ABS(g) BETWEEN 0.01 AND 100 THEN g ELSE 1 END')} AS gain FROM raw")
def prefilter_gain(spark, sf_dir):
    response = spark.createDataFrame(_GRID, "frequency_cph double, gain double")
    return post.prefilter_gain(cat.constituent_table(spark).select("name", "frequency"), response, 0.01, 100.0).select("name", _r("gain").alias("gain"))


# An element for every part; one is dry at a layer's time if its part's key says so.
_MESH = """mesh AS (SELECT p_partkey AS element_id, UNNEST([p_partkey, p_partkey + 1, p_partkey + 2]) AS node_id FROM part),
node AS (SELECT p_partkey AS node_id, 20 + p_retailprice % 10 AS h, (p_size % 5) / 10.0::DOUBLE AS zeta FROM part),
column_ AS (SELECT element_id, layer, -s * (h + zeta) AS d FROM mesh JOIN node USING (node_id), (VALUES (1, -0.25::DOUBLE), (2, -0.5::DOUBLE), (3, -0.75::DOUBLE)) sigma(layer, s)),
depths AS (SELECT element_id, layer, AVG(d) AS depth FROM column_ GROUP BY 1, 2 HAVING COUNT(d) = 3)"""


def _mesh(spark, sf_dir, wet=False):
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    mesh = part.select(key.alias("element_id"), F.array(key, key + 1, key + 2).alias("node_ids"))
    nodes = part.select(key.alias("node_id"), (20 + F.col("p_retailprice") % 10).alias("h"), ((F.col("p_size") % 5) / 10.0).alias("zeta"))
    sigma = nodes.select("node_id").crossJoin(F.broadcast(spark.createDataFrame([(1, -0.25), (2, -0.5), (3, -0.75)], "layer int, sigma double")))
    mask = part.select(F.lit(0.0).alias("mjd"), key.alias("element_id"), (F.col("p_size") % 4 > 0).cast("int").alias("wet")) if wet else None
    return vertical.layer_depths(mesh, sigma, nodes.select("node_id", "h"), nodes.select(F.lit(0.0).alias("mjd"), "node_id", "zeta"), mask)


@query(f"WITH {_MESH} SELECT element_id, layer, {_s('depth')} AS depth FROM depths")
def layer_depths(spark, sf_dir):
    return _mesh(spark, sf_dir).select("element_id", "layer", _r("depth").alias("depth"))


@query(f"WITH {_MESH} SELECT element_id, layer, {_s('depth')} AS depth FROM depths JOIN part ON element_id = p_partkey WHERE p_size % 4 > 0")
def wet_layer_depths(spark, sf_dir):
    return _mesh(spark, sf_dir, wet=True).select("element_id", "layer", _r("depth").alias("depth"))


@query(
    f"""WITH {_MESH}, lay AS (SELECT *, element_id % 7 + layer AS u, LEAD(depth) OVER w AS d1, LEAD(element_id % 7 + layer) OVER w AS u1 FROM depths WINDOW w AS (PARTITION BY element_id ORDER BY layer)),
    hit AS (SELECT element_id, target, layer, CASE WHEN target = depth THEN u WHEN target = d1 THEN u1 ELSE u + (target - depth) / (d1 - depth) * (u1 - u) END AS u FROM lay, (VALUES (6.0::DOUBLE), (12.0::DOUBLE), (40.0::DOUBLE)) t(target) WHERE target BETWEEN depth AND COALESCE(d1, depth))
    SELECT element_id, target, {_s('u')} AS u FROM hit QUALIFY ROW_NUMBER() OVER (PARTITION BY element_id, target ORDER BY layer) = 1"""
)
def fixed_depths(spark, sf_dir):
    layers = _mesh(spark, sf_dir).withColumn("u", (F.col("element_id") % 7 + F.col("layer")).cast("double"))
    return vertical.to_depths(layers, [6.0, 12.0, 40.0], ("element_id",), ("u",)).select("element_id", "target", _r("u").alias("u"))


# -- the kernel (no SQL: iterative, spectral or drawn) -----------------------------------------------------------------


def _sites(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id").agg(F.first("lat").alias("lat"))


def _kernel(spark, sf_dir, v=None, **options):
    rows = obs(spark, sf_dir)
    return coefficients(fit(rows, FitOptions(**({"constituents": FIVE} | options)), _sites(rows), v=v))


_KERNEL = f"{moments.gauss_sql('design', 'series_id', _design_columns(FIVE, True), ['u'])}"
_RANKED = _LONG + f"SELECT series_id, name, {{rank}}{_s('amplitude')} AS amplitude{{pe}} FROM coef"


@query(f"WITH {_nodal_design_sql(FIVE, True)}, {_KERNEL}" + _RANKED.format(rank="(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY pe DESC, constituent_index) - 1)::INTEGER AS rank, ", pe=f", {_s('pe')} AS pe"))
def fit_ols(spark, sf_dir):
    return _kernel(spark, sf_dir).select("series_id", "name", "rank", _r("amplitude").alias("amplitude"), _r("pe").alias("pe"))


@query()
def fit_auto(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return fit(rows, FitOptions(), _sites(rows)).select("series_id", "status", "rows", F.size("names").alias("n_names"))


@query()
def fit_colored(spark, sf_dir):
    return _kernel(spark, sf_dir, confidence="linear").select("series_id", "name", _r("amplitude").alias("amplitude"), _r("amplitude_ci").alias("amplitude_ci"), _r("snr", 3).alias("snr"))


@query()
def fit_robust(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return fit(rows, FitOptions(constituents=FIVE, method="robust", confidence="linear", noise="white"), _sites(rows)).select("series_id", "status", "iterations", "termination", _r("scale").alias("scale"), _r("mean").alias("mean"))


@query()
def fit_monte_carlo(spark, sf_dir):
    return _kernel(spark, sf_dir, confidence="monte_carlo").select("series_id", "name", _r("amplitude_ci").alias("amplitude_ci"), _r("phase_ci", 4).alias("phase_ci"))


@query()
def fit_vector(spark, sf_dir):
    return _kernel(spark, sf_dir, v="v", confidence="linear").select("series_id", "name", *(_r(c).alias(c) for c in ("semi_major", "semi_minor", "inclination", "phase", "semi_major_ci")))


@query()
def fit_inference(spark, sf_dir):
    infer = tuple(Relation(a, b, r, g, r / 2, -g) for a, b, r, g in _RELATIONS)
    return _kernel(spark, sf_dir, v="v", infer=infer, confidence="linear", noise="white").select("series_id", "constituent_index", "name", _r("semi_major").alias("semi_major"), _r("semi_major_ci").alias("semi_major_ci"))


@query()
def fit_scalar_inference(spark, sf_dir):
    infer = tuple(Relation(a, b, r, g) for a, b, r, g in _RELATIONS)
    return _kernel(spark, sf_dir, infer=infer, confidence="monte_carlo", noise="white").select("series_id", "constituent_index", "name", _r("amplitude").alias("amplitude"), _r("amplitude_ci").alias("amplitude_ci"))


@query()
def fit_diagnostics(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return fit(rows, FitOptions(constituents=FIVE, confidence="linear", noise="white", diagnostics=True), _sites(rows)).select("series_id", *(_r(c, 4).alias(c) for c in ("condition", "snr_all", "tv_raw", "tv_all", "tv_snr", "ptv_all", "ptv_snr")))


_, _RATE_AT_REFERENCE = sa.argument_sql("reference_mjd")


def _gain_sql(name):
    """The response between its points at the frequency that a constituent has at the reference time, if it is accepted."""
    f = sa.frequency_sql(name, _RATE_AT_REFERENCE)
    line = " ".join(f"WHEN {f} BETWEEN {f0} AND {f1} THEN {g0}::DOUBLE + ({g1 - g0!r})::DOUBLE * ({f} - {f0}) / {f1 - f0!r}" for (f0, g0), (f1, g1) in zip(_GRID, _GRID[1:]))
    return f"(SELECT CASE WHEN ABS(g) BETWEEN 0.01 AND 100 THEN g ELSE 1 END FROM (SELECT CASE {line} END AS g))"


@query(f"WITH {_nodal_design_sql(FIVE, True, _gain_sql)}, {_KERNEL}" + _RANKED.format(rank="", pe=""))
def fit_prefiltered(spark, sf_dir):
    response = PreFilter(tuple(a for a, _ in _GRID), tuple(b for _, b in _GRID), fallback="unity")
    return _kernel(spark, sf_dir, prefilter=response).select("series_id", "name", _r("amplitude").alias("amplitude"))


@query()
def fit_shared_axis(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("series_id", (F.col("hour") / 24.0).alias("mjd"), "u")
    return coefficients(fit(rows, FitOptions(constituents=FIVE, axis="shared", confidence="linear"), latitude=55.0)).select("series_id", "name", _r("amplitude", 4).alias("amplitude"), _r("amplitude_ci", 4).alias("amplitude_ci"))


@query(f"WITH {_nodal_design_sql(FIVE, True)}, {_KERNEL} SELECT series_id, {_s('mjd')} AS mjd, {_s('b_10_0 + b_11_0 * tr + ' + ' + '.join(f'b_{2 * i}_0 * c{i} + b_{2 * i + 1}_0 * s{i}' for i in range(5)), 4)} AS h FROM design JOIN solved USING (series_id)")
def reconstruct_fit(spark, sf_dir):
    rows, options = obs(spark, sf_dir), FitOptions(constituents=FIVE)
    return reconstruct(fit(rows, options, _sites(rows)), rows, options).select("series_id", _r("mjd").alias("mjd"), _r("u", 4).alias("h"))


_WINDOWS = f"win AS (SELECT series_id || ' ' || start AS key, series_id, start, u, COS({_W['M2']!r}::DOUBLE * mjd) AS c, SIN({_W['M2']!r}::DOUBLE * mjd) AS s, 1.0::DOUBLE AS one FROM (SELECT *, FLOOR((mjd - 40587) / 10)::BIGINT AS start FROM obs))"


@query(f"WITH {OBS}, {_WINDOWS}, {moments.gauss_sql('win', 'key', ['c', 's', 'one'], ['u'])} SELECT split_part(key, ' ', 1)::BIGINT AS series_id, TIMESTAMP '1970-01-01' + to_days((10 * split_part(key, ' ', 2)::BIGINT)::INTEGER) AS window_start, n_obs, {_s('SQRT(b_0_0 * b_0_0 + b_1_0 * b_1_0)', 5)} AS amplitude, {_s('b_2_0', 5)} AS mean FROM solved WHERE n_obs > 4")
def windowed_refit(spark, sf_dir):
    from perigee.streaming.refit import refit_windows

    out = refit_windows(read(spark, sf_dir, "events"), "ts", "user_id", "value", days=10)
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "amplitude": _r("amplitude", 5), "mean": _r("mean", 5)})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
