"""Regressions, resampling and distribution tails as SQL, for comparison.

Matrices are lists of lists. Symmetric positive systems are solved by
Gauss-Jordan elimination in a recursive table; tails are integrated by Simpson's rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.operators.inference import LIMITS, PRIME, REPLICATES

STEPS = 600


def _simpson(density: str, upto: str) -> str:
    """Integral of `density` in `v` from 0 to `upto`."""
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density.replace('{v}', f'({upto} * i / {STEPS}.0)')})))::DOUBLE * {upto} / {3 * STEPS}.0)"


def normal_p(z: str) -> str:
    """Two-sided p of a normal score."""
    return f"greatest(0.0, 1 - 2 * {_simpson('exp(-{v} * {v} / 2)', f'least(abs({z}), 12.0)')} / sqrt(2 * pi()))"


def _t_scale(df: str) -> str:
    return f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"


def t_p(t: str, df: str) -> str:
    """Two-sided p of a t score."""
    return f"greatest(0.0, 1 - 2 * {_simpson('pow(1 + {v} * {v} / ' + df + f', -({df} + 1) / 2.0)', f'abs({t})')} * {_t_scale(df)})"


def t_quantile(source: str, df: str, name: str = "crit") -> str:
    """A select of `source` with the 97.5 % quantile of t: the expansion around the
    normal quantile, and three Newton steps."""
    z = 1.959963984540054
    start = f"({z} + {(z**3 + z) / 4} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / pow({df}, 2) + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / pow({df}, 3))"
    out = f"SELECT *, {start} q0 FROM {source}"
    for k in range(3):
        f = f"({t_p(f'q{k}', df)} / 2 - 0.025)"
        out = f"SELECT *, q{k} + {f} / (pow(1 + q{k} * q{k} / {df}, -({df} + 1) / 2.0) * {_t_scale(df)}) q{k + 1} FROM ({out})"
    return f"SELECT * EXCLUDE (q0, q1, q2, q3), q3 {name} FROM ({out})"


def _matrix(k: int, entry: str) -> str:
    return "[" + ", ".join("[" + ", ".join(f"sum({entry.format(i=i, j=j)})" for j in range(1, k + 1)) + "]" for i in range(1, k + 1)) + "]"


def _join(by: Sequence[str], *tables: str) -> str:
    if by:
        return " JOIN ".join(tables[:1]) + "".join(f" JOIN {t} USING ({', '.join(by)})" for t in tables[1:])
    return " CROSS JOIN ".join(tables)


def inverse(p: str, source: str, matrix: str, k: int, by: Sequence[str] = ()) -> str:
    """Table `{p}_inv` (`by`, `inv`): the inverses of the matrices in `source`."""
    keys = "".join(f"{b}, " for b in by)
    start = f"list_transform(range(1, {k + 1}), lambda i: list_concat({matrix}[i], list_transform(range(1, {k + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))"
    return f""", {p}_gj AS (SELECT {keys}0 k, {start} m FROM {source}
  UNION ALL SELECT {keys}k + 1, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(range(1, {2 * k + 1}), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {p}_gj WHERE k < {k}),
{p}_inv AS (SELECT {keys}list_transform(m, lambda r: r[{k + 1}:{2 * k}]) inv FROM {p}_gj WHERE k = {k})"""


def rows(p: str, source: str, y: str, xs: Sequence[str], by: Sequence[str] = (), cluster: str = "NULL") -> str:
    """Table `{p}_d` (`by`, `g`, `y`, `x`): complete rows with a constant."""
    keys = "".join(f"{b}, " for b in by)
    known = " AND ".join(f"{c} IS NOT NULL AND isfinite({c}::DOUBLE)" for c in [y, *xs])
    return f""", {p}_d AS (SELECT {keys}{cluster} g, {y}::DOUBLE y, [1.0::DOUBLE, {', '.join(f'{x}::DOUBLE' for x in xs)}] x FROM {source} WHERE {known})"""


def _sandwich(p: str, k: int, by: Sequence[str], terms: Sequence[str], scores: str, extra: str) -> str:
    """Table `{p}_c`: the clusters' meat of `{p}_r` with the score `scores`."""
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    sums = ", ".join(f"sum({scores} * x[{i}])" for i in range(1, k + 1))
    return f""",
{p}_c AS (SELECT {keys}count(*) groups, {_matrix(k, 's[{i}] * s[{j}]')} cm FROM (SELECT {keys}g, [{sums}] s FROM {p}_r GROUP BY {keys}g){group})"""


def ols(p: str, source: str, y: str, xs: Sequence[str], by: Sequence[str] = (), cluster: str = "NULL") -> str:
    """Table `{p}_t`: `by, i, term, n, beta, se, se_cluster, std, adj_r2` of a least-squares fit per `by`."""
    k, keys = len(xs) + 1, "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    dot = "list_dot_product"
    var = lambda m: f"{dot}(inv[i], list_transform({m}, lambda r: {dot}(r, inv[i])))"
    return rows(p, source, y, xs, by, cluster) + f""",
{p}_g AS (SELECT {keys}count(*) n, sum(y) sy, sum(y * y) yy, [{', '.join(f'sum(x[{i}] * y)' for i in range(1, k + 1))}] xy, {_matrix(k, 'x[{i}] * x[{j}]')} xx FROM {p}_d{group})""" + inverse(p, f"{p}_g", "xx", k, by) + f""",
{p}_b AS (SELECT *, list_transform(inv, lambda r: {dot}(r, xy)) beta FROM {_join(by, f'{p}_g', f'{p}_inv')}),
{p}_r AS (SELECT *, e / (1 - h) u FROM (SELECT {keys}g, y, x, y - {dot}(x, beta) e, list_sum(list_transform(range(1, {k + 1}), lambda i: x[i] * {dot}(inv[i], x))) h FROM {_join(by, f'{p}_d', f'{p}_b')})),
{p}_m AS (SELECT {keys}sum(e * e) rss, {_matrix(k, 'u * u * x[{i}] * x[{j}]')} meat FROM {p}_r{group})""" + _sandwich(p, k, by, xs, "e", "") + f""",
{p}_t AS (SELECT {keys}i, {['const', *xs]}[i] term, n, beta[i] beta, sqrt({var('meat')}) se, sqrt({var('cm')} * (groups / greatest(groups - 1, 1)::DOUBLE) * (n - 1) / (n - {k})) se_cluster,
  CASE WHEN i > 1 THEN beta[i] * sqrt(greatest(xx[i][i] / n - pow(xx[1][i] / n, 2), 0)) / sqrt(yy / n - pow(sy / n, 2)) END std, 1 - (rss / (yy - sy * sy / n)) * (n - 1) / (n - {k}) adj_r2
  FROM {_join(by, f'{p}_b', f'{p}_m', f'{p}_c')} CROSS JOIN (SELECT unnest(range(1, {k + 1})) i))"""


def logit(p: str, source: str, y: str, xs: Sequence[str], cluster: str = "NULL", steps: int = 9, ridge: str = "0.0") -> str:
    """Table `{p}_t`: `i, term, n, beta, se, se_cluster` of a logistic fit on standardised
    columns by Newton steps; `ridge` is added to all but the constant."""
    k, dot = len(xs) + 1, "list_dot_product"
    out = rows(f"{p}_0", source, y, xs, (), cluster) + f""",
{p}_s AS (SELECT count(*) n, [{', '.join(f'avg(x[{i}])' for i in range(2, k + 1))}] mu, [{', '.join(f'stddev_pop(x[{i}])' for i in range(2, k + 1))}] sd FROM {p}_0_d),
{p}_d AS (SELECT n, g, y, list_concat([1.0::DOUBLE], list_transform(range(1, {k}), lambda i: (x[i + 1] - mu[i]) / CASE WHEN sd[i] > 0 THEN sd[i] ELSE 1 END)) x FROM {p}_0_d CROSS JOIN {p}_s),
{p}_b0 AS (SELECT list_transform(range(1, {k + 1}), lambda i: 0.0::DOUBLE) beta)"""
    pull = f"list_transform(range(1, {k + 1}), lambda i: sc[i] - CASE WHEN i > 1 THEN {ridge} * beta[i] ELSE 0 END)"
    bend = f"list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}), lambda j: he[i][j] + CASE WHEN i = j AND i > 1 THEN {ridge} ELSE 0 END))"
    for s in range(steps):
        q = f"{p}_{s + 1}"
        out += f""",
{q}_h AS (SELECT any_value(beta) beta, [{', '.join(f'sum((y - pr) * x[{i}])' for i in range(1, k + 1))}] sc, {_matrix(k, 'pr * (1 - pr) * x[{i}] * x[{j}]')} he FROM (SELECT y, x, beta, 1 / (1 + exp(-{dot}(x, beta))) pr FROM {p}_d CROSS JOIN {p}_b{s})),
{q}_a AS (SELECT beta, {pull} sc, {bend} he FROM {q}_h)""" + inverse(q, f"{q}_a", "he", k) + f""",
{p}_b{s + 1} AS (SELECT list_transform(range(1, {k + 1}), lambda i: beta[i] + {dot}(inv[i], sc)) beta FROM {q}_a CROSS JOIN {q}_inv)"""
    last = f"{p}_{steps}"
    out += f""",
{p}_r AS (SELECT n, g, x, y - 1 / (1 + exp(-{dot}(x, beta))) e FROM {p}_d CROSS JOIN {p}_b{steps})""" + _sandwich(p, k, (), xs, "e", "")
    var = f"{dot}(inv[i], list_transform(cm, lambda r: {dot}(r, inv[i])))"
    return out + f""",
{p}_t AS (SELECT i, {['const', *xs]}[i] term, n, beta[i] beta, sqrt(inv[i][i]) se, sqrt({var} * (groups / greatest(groups - 1, 1)::DOUBLE) * (n - 1) / (n - {k})) se_cluster
  FROM {p}_b{steps} CROSS JOIN {last}_inv CROSS JOIN {p}_c CROSS JOIN {p}_s CROSS JOIN (SELECT unnest(range(1, {k + 1})) i))"""


def aliased(p: str, source: str, xs: Sequence[str], tol: float = 1e-9) -> str:
    """Table `{p}_k` (`term, kept`): columns in order, each kept if eliminating those
    kept before leaves some of its variance."""
    k = len(xs)
    known = " AND ".join(f"{c} IS NOT NULL AND isfinite({c}::DOUBLE)" for c in xs)
    corr = "[" + ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"coalesce(corr({a}, {b}), 0.0)" for b in xs) + "]" for a in xs) + "]"
    return f""", {p}_w AS (SELECT 0 k, {corr} m, []::BOOLEAN[] kept FROM {source} WHERE {known}
  UNION ALL SELECT k + 1, CASE WHEN m[k + 1][k + 1] > {tol} THEN list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 1}), lambda j: CASE WHEN i > k + 1 AND j > k THEN m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] END)) ELSE m END,
    list_append(kept, m[k + 1][k + 1] > {tol}) FROM {p}_w WHERE k < {k}),
{p}_k AS (SELECT unnest({list(xs)}) term, unnest(kept) kept FROM {p}_w WHERE k = {k})"""


def weights(p: str, source: str, ids: Sequence[str], seed: int, keep: Sequence[str], replicates: int = REPLICATES) -> str:
    """Table `{p}_w` (`keep`, `r`, `w`): Poisson(1) weights of the rows of `source` for each replicate."""
    name = " || '|' || ".join([f"'{seed}'", *ids])
    part = lambda at: f"('0x' || substr(h, {at}, 8))::BIGINT % {PRIME}"
    count = " + ".join(f"(x >= {t})::INT" for t in LIMITS)
    cols = ", ".join(keep)
    return f""", {p}_h AS (SELECT {cols}, {part(1)} a, {part(9)} b FROM (SELECT *, md5({name}) h FROM {source})),
{p}_w AS (SELECT {cols}, r, {count} w FROM (SELECT *, (x * x + a) % {PRIME} x FROM (SELECT * EXCLUDE (x), (x * 48271 + r) % {PRIME} x FROM (SELECT * EXCLUDE (x), (x * x + b) % {PRIME} x
  FROM (SELECT *, (a + (r + 1) * b) % {PRIME} x FROM {p}_h CROSS JOIN (SELECT unnest(range(0, {replicates})) r))))))""".replace("SELECT *, (x * x + a)", "SELECT * EXCLUDE (x), (x * x + a)")


def intervals(p: str, by: str, value: str) -> str:
    """Table `{p}_i` (`by, lo, hi, p_value`) from the weights `{p}_w`."""
    return f""", {p}_i AS (SELECT {by}, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi, least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END))) p_value
  FROM (SELECT {by}, r, sum(w * {value}) / sum(w) m FROM {p}_w GROUP BY {by}, r HAVING sum(w) > 0) GROUP BY {by})"""


def discoveries(source: str, p: str = "p_value") -> str:
    """A select of `source` with `q_value` and `reject_fdr`."""
    ranked = f"SELECT *, row_number() OVER (ORDER BY {p}) _r, count(*) OVER () _n FROM {source} WHERE {p} IS NOT NULL"
    return f"SELECT * EXCLUDE (_r, _n), q_value <= 0.05 reject_fdr FROM (SELECT *, least(1.0, min({p} * _n / _r) OVER (ORDER BY _r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q_value FROM ({ranked}))"
