"""Least squares with expressions only: moments by one grouped aggregation, then an unrolled Cholesky solution.

For models of few columns this needs no Python at all; sums are combined before the shuffle, so a series may be
of any length. For comparison :func:`gauss_sql` states the same fits for another engine by another route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def moment_expressions(columns: list[str], targets: list[str]) -> list[str]:
    """SUM expressions of all products that the normal equations need."""
    out = [f"SUM({a} * {b}) AS s_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if j <= i]
    out += [f"SUM({a} * {y}) AS t_{i}_{k}" for i, a in enumerate(columns) for k, y in enumerate(targets)]
    return out + [f"SUM({y} * {y}) AS yy_{k}" for k, y in enumerate(targets)] + ["COUNT(*) AS n_obs"]


def solution_steps(p: int, targets: int, errors: bool = True) -> list[list[tuple[str, str]]]:
    """Levels of named expressions, each on the names of the levels before: factor by columns, forward, backward,
    and for ``errors`` the factor's inverse by diagonals and the noise. Few levels keep the plan shallow."""
    steps: list[list[tuple[str, str]]] = []
    less = lambda i, j: "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
    for j in range(p):
        steps.append([(f"l_{j}_{j}", f"SQRT(s_{j}_{j}{less(j, j)})")])
        if j + 1 < p:
            steps.append([(f"l_{i}_{j}", f"(s_{i}_{j}{less(i, j)}) / l_{j}_{j}") for i in range(j + 1, p)])
    for i in range(p):
        steps.append([(f"z_{i}_{t}", f"(t_{i}_{t}" + "".join(f" - l_{i}_{k} * z_{k}_{t}" for k in range(i)) + f") / l_{i}_{i}") for t in range(targets)])
    for i in range(p - 1, -1, -1):
        steps.append([(f"b_{i}_{t}", f"(z_{i}_{t}" + "".join(f" - l_{k}_{i} * b_{k}_{t}" for k in range(i + 1, p)) + f") / l_{i}_{i}") for t in range(targets)])
    if errors:
        steps.append([(f"m_{i}_{i}", f"1.0 / l_{i}_{i}") for i in range(p)])
        for d in range(1, p):
            steps.append([(f"m_{i + d}_{i}", "-(" + " + ".join(f"l_{i + d}_{k} * m_{k}_{i}" for k in range(i, i + d)) + f") / l_{i + d}_{i + d}") for i in range(p - d)])
        steps.append([(f"v_{i}", " + ".join(f"m_{k}_{i} * m_{k}_{i}" for k in range(i, p))) for i in range(p)])
        # White variance: squares of the data less those that the model explains, by degrees of freedom.
        steps.append([(f"noise_{t}", f"(yy_{t}" + "".join(f" - b_{i}_{t} * t_{i}_{t}" for i in range(p)) + f") / (n_obs - {p})") for t in range(targets)])
    return steps


def solve_by_moments(design: DataFrame, key: str, columns: list[str], targets: list[str], errors: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """key, n_obs, b_i_t (coefficients), and for ``errors`` v_i (diagonal of the inverse) and noise_t; series with too few rows are left out.

    ``more``: further aggregates, with their names, that are kept.
    """
    p = len(columns)
    table = design.groupBy(key).agg(*(_expr(x) for x in (*moment_expressions(columns, targets), *more))).where(f"n_obs > {p}")
    for step in solution_steps(p, len(targets), errors):
        table = table.withColumns({name: _expr(text) for name, text in step})
    found = [*(f"v_{i}" for i in range(p)), *(f"noise_{t}" for t in range(len(targets)))] if errors else []
    return table.select(key, "n_obs", *(f"b_{i}_{t}" for i in range(p) for t in range(len(targets))), *found, *(x.rsplit(" AS ", 1)[1] for x in more))


def harmonic_moments(obs: DataFrame, key: str, time: str, turns: list[float], targets: list[str], trend: bool, epoch: float) -> DataFrame:
    """key, n_obs, b_i_t of waves (radians a day in ``turns``), mean and trend over the span, about the middle of each series.

    The sums are taken about one ``epoch`` near the data, so that one pass with sums combined before the shuffle is enough; the
    coefficients are turned to each series' own middle afterwards, from its first and last time.
    """
    from pyspark.sql import functions as F

    dt, k = F.col(time) - F.lit(epoch), len(turns)
    design = obs.withColumns({f"{x}{i}": f(F.lit(w) * dt) for i, w in enumerate(turns) for x, f in (("c", F.cos), ("s", F.sin))} | {"one": F.lit(1.0)} | ({"tr": dt} if trend else {}))
    columns = [f"{x}{i}" for i in range(k) for x in "cs"] + ["one"] + ["tr"] * trend
    table = solve_by_moments(design, key, columns, targets, more=(f"MIN({time}) AS first_", f"MAX({time}) AS last_"))
    shift, span = (F.col("first_") + F.col("last_")) / 2 - F.lit(epoch), F.col("last_") - F.col("first_")
    table = table.withColumns({f"{x}_{i}": f(F.lit(w) * shift) for i, w in enumerate(turns) for x, f in (("re", F.cos), ("im", F.sin))})
    out = {}
    for t in range(len(targets)):
        for i in range(k):
            c, s = F.col(f"b_{2 * i}_{t}"), F.col(f"b_{2 * i + 1}_{t}")
            out[f"b_{2 * i}_{t}"], out[f"b_{2 * i + 1}_{t}"] = c * F.col(f"re_{i}") + s * F.col(f"im_{i}"), s * F.col(f"re_{i}") - c * F.col(f"im_{i}")
        out[f"b_{2 * k}_{t}"] = F.col(f"b_{2 * k}_{t}") + (F.col(f"b_{2 * k + 1}_{t}") * shift if trend else F.lit(0.0))
        if trend:
            out[f"b_{2 * k + 1}_{t}"] = F.col(f"b_{2 * k + 1}_{t}") * span
    return table.select(key, "n_obs", *(out[f"b_{i}_{t}"].alias(f"b_{i}_{t}") for i in range(len(columns)) for t in range(len(targets))))


def gauss_sql(source: str, key: str, columns: list[str], targets: list[str]) -> str:
    """The same fits for another engine and by another route: normal equations as lists of rows, with the right-hand sides
    and the unit matrix beside them, brought to the unit matrix by Gauss-Jordan steps. Ends in a table ``solved``."""
    p, right = len(columns), len(columns) + len(targets)
    rows = [f"[{', '.join([f'SUM({a} * {b})' for b in [*columns, *targets]] + [f'{float(i == j)}::DOUBLE' for j in range(p)])}]" for i, a in enumerate(columns)]
    chain = [f"m0 AS (SELECT {key}, COUNT(*) AS n_obs, [{', '.join(f'SUM({y} * {y})' for y in targets)}] AS yy, [{', '.join(rows)}] AS m FROM {source} GROUP BY {key} HAVING COUNT(*) > {p})"]
    for k in range(1, p + 1):
        turned = f"list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda x: x / q[{k}]) ELSE list_transform(r, lambda x, j: x - r[{k}] * q[j] / q[{k}]) END)"
        chain.append(f"m{k} AS (SELECT {key}, n_obs, yy, {turned} AS m FROM (SELECT *, m[{k}] AS q FROM m{k - 1}))")
    b = [f"z.m[{i + 1}][{p + t + 1}] AS b_{i}_{t}" for i in range(p) for t in range(len(targets))]
    v = [f"z.m[{i + 1}][{right + i + 1}] AS v_{i}" for i in range(p)]
    explained = lambda t: " + ".join(f"z.m[{i + 1}][{p + t + 1}] * a.m[{i + 1}][{p + t + 1}]" for i in range(p))
    noise = [f"(z.yy[{t + 1}] - ({explained(t)})) / (z.n_obs - {p}) AS noise_{t}" for t in range(len(targets))]
    chain.append(f"solved AS (SELECT z.{key}, z.n_obs, {', '.join([*b, *v, *noise])} FROM m{p} z JOIN m0 a ON z.{key} = a.{key})")
    return ",\n".join(chain)


def _expr(text: str):
    from pyspark.sql import functions as F

    return F.expr(text)
