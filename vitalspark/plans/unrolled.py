"""DuckDB SQL of iterative fits, unrolled: a chain of CTEs for each Newton step, with the linear solve written out.

Used as oracles of the registered queries; nothing in the operators depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _cte(name: str, body: str) -> str:
    return f",\n{name} AS MATERIALIZED ({body})"


def solve(source: str, p: int, name: str) -> str:
    """CTEs that reduce (H | g | I) of the one row of source, H in h{i}_{j} and g in g{i}; the last, `name`, has the
    solution in x{i} and the inverse in v{i}_{j}."""
    h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    first = [f"{h(i, j)} AS a{i}_{j}" for i in range(p) for j in range(p)] + [f"g{i} AS a{i}_{p}" for i in range(p)]
    first += [f"CAST({int(i == j)} AS double) AS a{i}_{p + 1 + j}" for i in range(p) for j in range(p)]
    out = _cte(f"{name}_0", f"SELECT {', '.join(first)} FROM {source}")
    for k in range(p):
        cols = [f"a{i}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(p) for j in range(2 * p + 1)]
        out += _cte(f"{name}_{k + 1}", f"SELECT {', '.join(cols)} FROM {name}_{k}")
    last = [f"a{i}_{p} AS x{i}" for i in range(p)] + [f"a{i}_{p + 1 + j} AS v{i}_{j}" for i in range(p) for j in range(p)]
    return out + _cte(name, f"SELECT {', '.join(last)} FROM {name}_{p}")


def _dot(p: int) -> str:
    return " + ".join(f"b{i} * x{i}" for i in range(p))


def _start(p: int, name: str) -> str:
    return _cte(f"{name}n0", "SELECT " + ", ".join(f"CAST(0 AS double) AS b{i}" for i in range(p)))


def _move(p: int, name: str, k: int, sign: str = "+") -> str:
    cols = [f"b{i} {sign} x{i} AS b{i}" for i in range(p)] + [f"{name}j{k}.v{i}_{j}" for i in range(p) for j in range(p)]
    return _cte(f"{name}n{k + 1}", f"SELECT {', '.join(cols)} FROM {name}n{k}, {name}j{k}")


def logit(rows: str, p: int, name: str, steps: int = 9) -> str:
    """rows: a relation with y and x0..; the coefficients are in CTE {name}n{steps} as b0.."""
    out = _start(p, name)
    for k in range(steps):
        sums = [f"sum((y - q) * x{i}) AS g{i}" for i in range(p)] + [f"sum(q * (1 - q) * x{i} * x{j}) AS h{i}_{j}" for i, j in _pairs(p)]
        out += _cte(f"{name}g{k}", f"SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({_dot(p)}))) AS q FROM {rows}, {name}n{k})")
        out += solve(f"{name}g{k}", p, f"{name}j{k}") + _move(p, name, k)
    return out


def moments(rows: str, p: int, name: str, steps: int = 14) -> str:
    """rows: a relation with x0.. to be balanced; minimises the sum of exp(b x)."""
    out = _start(p, name)
    for k in range(steps):
        sums = [f"sum(q * x{i}) AS g{i}" for i in range(p)] + [f"sum(q * x{i} * x{j}) AS h{i}_{j}" for i, j in _pairs(p)]
        out += _cte(f"{name}g{k}", f"SELECT {', '.join(sums)} FROM (SELECT *, exp({_dot(p)}) AS q FROM {rows}, {name}n{k})")
        out += solve(f"{name}g{k}", p, f"{name}j{k}") + _move(p, name, k, "-")
    return out


def cox(rows: str, p: int, name: str, efron: bool = False, steps: int = 9, by: str = "", penalty: Sequence[str] | None = None) -> str:
    """rows: a relation with time, event, w and x0..; coefficients b{i} and their variances v{i}_{j} in {name}n{steps}.

    penalty: for the elastic net, a function's SQL by step for slope and curvature of coefficient b, as two formats.
    """
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    names = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in _pairs(p)]]
    values = ["r", *[f"r * x{i}" for i in range(p)], *[f"r * x{i} * x{j}" for i, j in _pairs(p)]]
    out = _start(p, name) if not by else _cte(f"{name}n0", f"SELECT DISTINCT {key}" + ", ".join(f"CAST(0 AS double) AS b{i}" for i in range(p)) + f" FROM {rows}")
    for k in range(steps):
        t, u, f, g = (f"{name}{c}{k}" for c in "tufg")
        join = f" JOIN {name}n{k} USING ({by})" if by else f", {name}n{k}"
        cols = [f"sum({v}) AS {n}" for n, v in zip(names, values)] + [f"sum(w * event * x{i}) AS d1_{i}" for i in range(p)]
        cols += [f"sum(event * {v}) AS e_{n}" for n, v in zip(names, values)] if efron else []
        out += _cte(t, f"SELECT {key}time, sum(w * event) AS dw, sum(event) AS m, {', '.join(cols)} FROM (SELECT *, w * exp({_dot(p)}) AS r FROM {rows}{join}) GROUP BY {key}time")
        kept = [f"sum({n}) OVER ({part}ORDER BY time DESC) AS {n}" for n in names] + [f"d1_{i}" for i in range(p)] + ([f"e_{n}" for n in names] if efron else [])
        out += _cte(u, f"SELECT {key}dw, m, {', '.join(kept)} FROM {t}")
        if efron:
            out += _cte(f"{f}a", f"SELECT *, unnest(generate_series(0, CAST(m AS bigint) - 1)) AS l FROM {u} WHERE dw > 0")
            cols = [f"{n} - l / m * e_{n} AS {n}" for n in names] + [f"d1_{i} / m AS d1_{i}" for i in range(p)]
            out += _cte(f, f"SELECT {key}dw / m AS dw, {', '.join(cols)} FROM (SELECT * REPLACE (CAST(m AS double) AS m) FROM {f}a)")
        else:
            out += _cte(f, f"SELECT * FROM {u} WHERE dw > 0")
        sums = [f"sum(d1_{i} - dw * s1_{i} / s0) AS g{i}" for i in range(p)]
        sums += [f"sum(dw * (s2_{i}_{j} / s0 - s1_{i} * s1_{j} / (s0 * s0))) AS h{i}_{j}" for i, j in _pairs(p)]
        out += _cte(g, f"SELECT {key}{', '.join(sums)} FROM {f}" + (f" GROUP BY {by}" if by else ""))
        if by:  # one column only
            out += _cte(f"{name}n{k + 1}", f"SELECT {key}b0 + g0 / h0_0 AS b0, 1 / h0_0 AS v0_0 FROM {name}n{k} JOIN {g} USING ({by})")
            continue
        if penalty:
            slope, curve = penalty
            a = 1.3 ** (k + 1)
            cols = [f"g{i} - n_rows * ({slope.format(b=f'b{i}', a=a)}) AS g{i}" for i in range(p)]
            cols += [f"h{i}_{j}" + (f" + n_rows * ({curve.format(b=f'b{i}', a=a)})" if i == j else "") + f" AS h{i}_{j}" for i, j in _pairs(p)]
            out += _cte(f"{g}p", f"SELECT {', '.join(cols)} FROM {g}, {name}n{k}, (SELECT CAST(count(*) AS double) AS n_rows FROM {rows})")
            g += "p"
        out += solve(g, p, f"{name}j{k}") + _move(p, name, k)
    return out


def summary(name: str, covariates: Sequence[str], steps: int = 9, digits: int = 4, alpha_quantile: float = 1.959963984540054) -> str:
    """The rows of a summary table, but for the p-value, from the last CTE of a Cox fit."""
    r = lambda x, n: f"round({x}, {digits}) AS {n}"
    rows = []
    for i, c in enumerate(covariates):
        se = f"sqrt(v{i}_{i})"
        low, high = f"(b{i} - {alpha_quantile} * {se})", f"(b{i} + {alpha_quantile} * {se})"
        cols = [r(f"b{i}", "coef"), r(f"exp(b{i})", "exp_coef"), r(se, "se"), r(low, "ci_low"), r(high, "ci_high"), r(f"exp({low})", "exp_low"), r(f"exp({high})", "exp_high"), r(f"b{i} / {se}", "z")]
        rows.append(f"SELECT '{c}' AS covariate, {', '.join(cols)} FROM {name}n{steps}")
    return " UNION ALL ".join(rows)


def efron_scores(rows: str, p: int, name: str, steps: int = 9) -> str:
    """The weighted score residuals of a Cox fit with Efron's ties, in columns f{i} of CTE {name}phi, a row each."""
    names = ["s0", *[f"s1_{i}" for i in range(p)]]
    values = ["w * r", *[f"w * r * x{i}" for i in range(p)]]
    out = _cte(f"{name}p", f"SELECT *, exp({_dot(p)}) AS r FROM {rows}, {name}n{steps}")
    cols = [f"sum({v}) AS {n}" for n, v in zip(names, values)] + [f"sum(event * {v}) AS e_{n}" for n, v in zip(names, values)]
    out += _cte(f"{name}q", f"SELECT time, sum(w * event) AS dw, sum(event) AS m, {', '.join(cols)} FROM {name}p GROUP BY time")
    out += _cte(f"{name}r", f"SELECT time, dw, m, {', '.join(f'sum({n}) OVER (ORDER BY time DESC) AS {n}, e_{n}' for n in names)} FROM {name}q")
    out += _cte(f"{name}l", f"SELECT *, unnest(generate_series(0, CAST(m AS bigint) - 1)) / m AS part FROM {name}r WHERE m > 0")
    out += _cte(f"{name}h", f"SELECT time, part, dw / m / (s0 - part * e_s0) AS h, {', '.join(f'(s1_{i} - part * e_s1_{i}) / (s0 - part * e_s0) AS m{i}' for i in range(p))} FROM {name}l")
    cols = [f"sum(h * m{i}) AS b{i}, sum(h * part * m{i}) AS ob{i}, avg(m{i}) AS mean{i}" for i in range(p)]
    out += _cte(f"{name}s", f"SELECT time, sum(h) AS a, sum(h * part) AS oa, {', '.join(cols)} FROM {name}h GROUP BY time")
    zero = lambda c: f"coalesce({c}, 0)"
    cols = [f"sum({zero(f'b{i}')}) OVER (ORDER BY time) AS cb{i}, {zero(f'ob{i}')} AS ob{i}, {zero(f'mean{i}')} AS mean{i}" for i in range(p)]
    out += _cte(f"{name}c", f"SELECT time, sum({zero('a')}) OVER (ORDER BY time) AS ca, {zero('oa')} AS oa, {', '.join(cols)} FROM {name}q LEFT JOIN {name}s USING (time)")
    cols = [f"w * (event * (x{i} - mean{i}) - r * ((ca - event * oa) * x{i} - (cb{i} - event * ob{i}))) AS f{i}" for i in range(p)]
    return out + _cte(f"{name}phi", f"SELECT {', '.join(cols)} FROM {name}p JOIN {name}c USING (time)")
