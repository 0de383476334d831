"""SQL that fits a Cox model of a few columns: Newton steps and the robust variance written out, for the oracle."""

from __future__ import annotations

from itertools import permutations


def normal_p(z: str) -> str:
    """Two-sided normal probability by the series of the error function."""
    return chi2_p(f"POWER({z}, 2)", "1")


def chi2_p(x: str, df: str) -> str:
    """Upper tail of the chi-square law by the series of the incomplete gamma function."""
    a, h = f"({df} / 2.0::DOUBLE)", f"GREATEST(({x}) / 2.0::DOUBLE, 1e-300)"
    return f"(1 - list_sum(list_transform(range(600), lambda i: EXP(({a} + i) * LN({h}) - {h} - LGAMMA({a} + i + 1)))))"


def det(m: list[list[str]]) -> str:
    """Determinant as a sum over permutations."""
    if not m:
        return "1.0::DOUBLE"
    parts = []
    for order in permutations(range(len(m))):
        turns = sum(order[i] > order[j] for i in range(len(m)) for j in range(i + 1, len(m)))
        parts.append(("-" if turns % 2 else "+") + " * ".join(m[i][k] for i, k in enumerate(order)))
    return "(" + " ".join(parts) + ")"


def inverse(m: list[list[str]]) -> list[list[str]]:
    n = len(m)

    def cell(i: int, j: int) -> str:
        less = [[m[a][b] for b in range(n) if b != i] for a in range(n) if a != j]
        return f"({'-' if (i + j) % 2 else ''}{det(less)} / {det(m)})"
    return [[cell(i, j) for j in range(n)] for i in range(n)]


def sym(name: str, n: int) -> list[list[str]]:
    """Names of a symmetric matrix of which the upper half is there."""
    return [[f"{name}{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]


def _step(i: int | str, b: str, p: int) -> str:
    cols, pairs = range(p), [(j, k) for j in range(p) for k in range(j, p)]
    eta = " + ".join(f"b{j} * x{j}" for j in cols)
    r = f"w * EXP({eta})"
    ev = lambda c: f"SUM(CASE WHEN e = 1 THEN {c} ELSE 0 END)"
    sums = [f"SUM({r}) AS r0", f"{ev(r)} AS d0", f"{ev('w')} AS dw", f"{ev(f'w * ({eta})')} AS de", "COUNT(*) FILTER (WHERE e = 1) AS dn"]
    sums += [f"SUM({r} * x{j}) AS r1{j}, {ev(f'{r} * x{j}')} AS d1{j}, {ev(f'w * x{j}')} AS dx{j}" for j in cols]
    sums += [f"SUM({r} * x{j} * x{k}) AS r2{j}{k}, {ev(f'{r} * x{j} * x{k}')} AS d2{j}{k}" for j, k in pairs]
    over = [f"SUM(r1{j}) OVER v AS s1{j}" for j in cols] + [f"SUM(r2{j}{k}) OVER v AS s2{j}{k}" for j, k in pairs]
    m = [f"(s1{j} - f * d1{j}) / (s0 - f * d0) AS m{j}" for j in cols]
    v = [f"(s2{j}{k} - f * d2{j}{k}) / (s0 - f * d0) - (s1{j} - f * d1{j}) * (s1{k} - f * d1{k}) / POWER(s0 - f * d0, 2) AS v{j}{k}"
         for j, k in pairs]
    u = [f"SUM(dx{j} / dn - wb * m{j}) AS u{j}" for j in cols] + [f"SUM(wb * v{j}{k}) AS i{j}{k}" for j, k in pairs]
    return f""",
r{i} AS MATERIALIZED (SELECT s, t, {', '.join(sums)} FROM d, {b} GROUP BY s, t),
q{i} AS MATERIALIZED (SELECT *, SUM(r0) OVER v AS s0, {', '.join(over)} FROM r{i} WINDOW v AS (PARTITION BY s ORDER BY t DESC)),
l{i} AS MATERIALIZED (SELECT *, dw / dn AS wb, s0 - f * d0 AS z, {', '.join(m)}, {', '.join(v)} FROM
(SELECT q{i}.*, k / dn::DOUBLE AS f FROM q{i}, UNNEST(GENERATE_SERIES(0, dn - 1)) AS u(k) WHERE dn > 0)),
u{i} AS MATERIALIZED (SELECT {', '.join(u)}, SUM(de / dn - wb * LN(z)) AS ll FROM l{i})"""


def cox_many(rows: str, p: int, steps: int = 7) -> str:
    """Table expressions from ``d`` (ref, s, t, e, w, x0, ...) to ``fit``: b0, ..., information i00, ..., ``ll``; ``u1`` holds the start."""
    sql = f", d AS MATERIALIZED ({rows}), b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{j}' for j in range(p))})"
    for i in range(1, steps + 1):
        inv = inverse(sym("i", p))
        moved = [f"b{j} + " + " + ".join(f"{inv[j][k]} * u{k}" for k in range(p)) + f" AS b{j}" for j in range(p)]
        sql += _step(i, f"b{i - 1}", p) + f", b{i} AS MATERIALIZED (SELECT {', '.join(moved)} FROM b{i - 1}, u{i})"
    return sql + _step("z", f"b{steps}", p) + f", fit AS MATERIALIZED (SELECT * FROM b{steps}, uz)"


def naive_variance(p: int) -> str:
    inv = inverse(sym("i", p))
    cells = ", ".join(f"{inv[j][k]} AS v{j}{k}" for j in range(p) for k in range(j, p))
    return f", var AS MATERIALIZED (SELECT {cells} FROM fit)"


def robust_variance(p: int) -> str:
    """Sandwich of the people's score residuals."""
    cols, pairs = range(p), [(j, k) for j in range(p) for k in range(j, p)]
    eta = " + ".join(f"b{j} * x{j}" for j in cols)
    per = ", ".join(f"SUM(wb * m{j} / z) AS g{j}, SUM(wb * f * m{j} / z) AS o{j}, AVG(m{j}) AS c{j}" for j in cols)
    run = ", ".join(f"SUM(COALESCE(g{j}, 0)) OVER v AS g{j}, COALESCE(o{j}, 0) AS o{j}, COALESCE(c{j}, 0) AS c{j}" for j in cols)
    res = ", ".join(f"w * (e * (x{j} - c{j}) - EXP({eta}) * (x{j} * (h - e * own) - (g{j} - e * o{j}))) AS y{j}" for j in cols)
    meat = ", ".join(f"SUM(y{j} * y{k}) AS k{j}{k}" for j, k in pairs)
    inv, k = sym("n", p), sym("k", p)
    cell = lambda a, b: " + ".join(f"{inv[a][i]} * {k[i][j]} * {inv[j][b]}" for i in cols for j in cols)
    naive = inverse(sym("i", p))
    return f""", ra AS (SELECT s, t, SUM(wb / z) AS a0, SUM(wb * f / z) AS a1, {per} FROM lz GROUP BY s, t),
rh AS MATERIALIZED (SELECT q.s, q.t, SUM(COALESCE(a0, 0)) OVER v AS h, COALESCE(a1, 0) AS own, {run} FROM qz q LEFT JOIN ra ON q.s = ra.s AND q.t = ra.t
WINDOW v AS (PARTITION BY q.s ORDER BY q.t)),
ry AS (SELECT {res} FROM d JOIN rh ON d.s = rh.s AND d.t = rh.t, fit), rk AS (SELECT {meat} FROM ry),
rn AS (SELECT {', '.join(f'{naive[j][i]} AS n{j}{i}' for j, i in pairs)} FROM fit),
var AS MATERIALIZED (SELECT {', '.join(f'{cell(j, i)} AS v{j}{i}' for j, i in pairs)}, {', '.join(f'n{j}{j} AS naive{j}' for j in cols)} FROM rk, rn)"""


def tidy_rows(names: list[str], digits: int = 5) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS term, ROUND(b{j}, {digits}) AS estimate, ROUND(SQRT(v{j}{j}), {digits}) AS std_error, ROUND(b{j} / SQRT(v{j}{j}), {digits}) AS statistic,
ROUND({normal_p(f'b{j} / SQRT(v{j}{j})')}, {digits}) + 0.0 AS p_value FROM fit, var""" for j, name in enumerate(names))
