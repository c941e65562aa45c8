"""SQL of the fitted models: interpolation of gaps, and regressions with autoregressive errors by sums of products.

Written from the definitions in `panelcast/operators/gaps.py` and `panelcast/functions/moments.py`, in relational
form: the matrix of a series is rows (i, j, v), a candidate regression is rows of weights on it, and elimination is
a recursive step on lists.
"""

from __future__ import annotations

FLAGS = ("feature", "display", "tpr_only")
LAGGED = tuple(f"lag_{f}" for f in FLAGS)
FOURIER = tuple(f"{t}{i}" for i in range(1, 7) for t in ("s", "c"))
K = "store_id, upc_id"
ORDERS = [(p, d) for d in (0, 1) for p in (0, 1, 2)]
LAGS = 3


def interpolated(src: str, name: str, straight: bool = False) -> str:
    """{name}: the rows of src with y (root of units) and z (y, interpolated; in a straight line if so wanted)."""
    decay = "1.0" if straight else "CASE WHEN f >= 0.995 THEN 1.0 ELSE f END"
    w = f"PARTITION BY {K} ORDER BY week"
    past = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    coming = f"({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    seen = "CASE WHEN y IS NOT NULL THEN week END"
    return f"""
{name}_pair AS (
  SELECT *, lag(y) OVER ({w}) AS prior,
         last_value(y IGNORE NULLS) OVER {past} AS ly, last_value({seen} IGNORE NULLS) OVER {past} AS lw,
         first_value(y IGNORE NULLS) OVER {coming} AS ny, first_value({seen} IGNORE NULLS) OVER {coming} AS nw
  FROM (SELECT *, sqrt(units) AS y FROM {src})),
{name}_decay AS (
  SELECT {K}, mean, {decay} AS f FROM (
    SELECT {K}, avg(y) AS mean,
           CASE WHEN count(*) FILTER (y IS NOT NULL AND prior IS NOT NULL) >= 3
                THEN greatest(0.0, least(covar_pop(y, prior) / nullif(var_pop(prior) FILTER (y IS NOT NULL), 0), 1.0)) ELSE 1.0 END AS f
    FROM {name}_pair GROUP BY {K})),
{name}_side AS (
  SELECT p.*, mean, f, ly - mean AS l, ny - mean AS n,
         CAST(datediff('day', lw, week) AS DOUBLE) / 7 AS a, CAST(datediff('day', week, nw) AS DOUBLE) / 7 AS b
  FROM {name}_pair p JOIN {name}_decay USING ({K})),
{name} AS (
  SELECT *, coalesce(y, mean + CASE
           WHEN l IS NULL THEN n * pow(f, b) WHEN n IS NULL THEN l * pow(f, a)
           WHEN f >= 0.995 THEN (l * b + n * a) / (a + b)
           ELSE (l * pow(f, a) * (1 - pow(f, 2 * b)) + n * pow(f, b) * (1 - pow(f, 2 * a))) / (1 - pow(f, 2 * a + 2 * b)) END) AS z
  FROM {name}_side)"""


def _weights(quantity: int, lag: int, d: int, k: int) -> list[tuple[int, int]]:
    """Places in z, from 0, and weights of a quantity (-1: the response, else a regressor), differenced d times."""

    def at(j: int) -> int:
        return 1 + j if quantity < 0 else 2 + LAGS + j * k + quantity

    return [(at(lag), 1)] + ([(at(lag + 1), -1)] if d else [])


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def _sweep(name: str, source: str) -> str:
    """{name}: id columns and the matrix after all pivots but the last; dead pivots leave zeros."""
    step = (
        "list_transform(m, lambda row, i: CASE WHEN i = s AND live THEN list_transform(row, lambda x, j: CASE WHEN j = s THEN 0.0 ELSE x / m[s][s] END)"
        " WHEN i = s THEN list_transform(row, lambda x: 0.0)"
        " WHEN live THEN list_transform(row, lambda x, j: CASE WHEN j = s THEN 0.0 ELSE x - row[s] * m[s][j] / m[s][s] END)"
        " ELSE list_transform(row, lambda x, j: CASE WHEN j = s THEN 0.0 ELSE x END) END)"
    )
    return f"""
{name}_all AS (
  SELECT {K}, c, 1 AS s, m, list_transform(m, lambda row, i: row[i]) AS start, 0 AS alive, m[1][1] > 0 AS live FROM {source}
  UNION ALL
  SELECT {K}, c, s + 1, {step}, start, alive + CAST(live AS INTEGER),
         CASE WHEN s + 1 < len(m) THEN
           m[s+1][s+1] - (CASE WHEN live THEN m[s+1][s] * m[s][s+1] / m[s][s] ELSE 0.0 END) > 1e-7 * start[s+1] END
  FROM {name}_all WHERE s < len(m)),
{name} AS (SELECT {K}, c, m, alive FROM {name}_all WHERE s = len(m))"""


def regressions(src: str, models: dict[str, tuple[tuple[str, ...], int | None]], design: tuple[str, ...], name: str) -> str:
    """{name}: the best order of every model for every series it fits. src has z, units and the flags.

    `models` gives the regressors and the differences (None: chosen) of each. Needs WITH RECURSIVE.
    """
    k = len(design)
    w = f"(PARTITION BY {K} ORDER BY week)"
    base = {f: f"coalesce({f}, 0)" for f in FLAGS}
    week = "datediff('day', DATE '1970-01-05', week) / 7.0"
    for i in range(1, 7):
        base[f"s{i}"], base[f"c{i}"] = (f"{g}(2.0 * pi() * {i}.0 * ({week}) / 52.18)" for g in ("sin", "cos"))

    def column(c: str, lag: int) -> str:
        more = 1 if c in LAGGED else 0
        return f"lag(b_{c.removeprefix('lag_') if more else c}, {lag + more}) OVER {w}"

    used = [c for c in (*FLAGS, *FOURIER) if c in design or f"lag_{c}" in design]
    vector = ["1.0", *[f"lag(z, {j}) OVER {w}" for j in range(LAGS + 1)], *[column(c, j) for j in range(LAGS + 1) for c in design]]
    size = len(vector)
    first, second, cases = [], [], []
    for label, (uses, fixed) in models.items():
        at = [design.index(c) for c in uses]
        for p, d in ORDERS:
            if fixed is not None and d != fixed:
                continue
            c = len(cases)
            cases.append((c, f"'{label}'", p, d))
            lagged = [(q, lag) for q in at for lag in range(p + 1) if lag == 0 or design[q] not in FOURIER]
            rows = ([] if d else [[(0, 1)]]) + [_weights(-1, lag, d, k) for lag in range(1, p + 1)]
            rows += [_weights(q, lag, d, k) for q, lag in lagged] + [_weights(-1, 0, d, k)]
            if p:
                first += [(c, r, i, x) for r, row in enumerate(rows) for i, x in row]
            rows = ([] if d else [0]) + at + [-1]
            for r, q in enumerate(rows):
                for lag in range(p + 1):
                    constant = r == 0 and not d
                    second += [(c, r, lag, i, x) for i, x in ([(0, 1)] if constant else _weights(q, lag, d, k))]
    first = first or [(-1, 0, 0, 0)]
    return f"""
{name}_base AS (SELECT {K}, week, units, z, {", ".join(f"CAST({base[c]} AS DOUBLE) AS b_{c}" for c in used) or "0 AS none_"} FROM {src}),
{name}_v AS (
  SELECT {K}, units, row_number() OVER {w} - 1 AS t, [{", ".join(vector)}] AS v FROM {name}_base),
{name}_half AS (
  SELECT {K}, i, j, sum(v[i + 1] * v[j + 1]) AS x
  FROM (SELECT {K}, v, i, unnest(range(i, {size})) AS j FROM (SELECT {K}, v, unnest(range(0, {size})) AS i FROM {name}_v WHERE units IS NOT NULL AND t >= 4))
  GROUP BY {K}, i, j),
{name}_m AS MATERIALIZED (SELECT * FROM {name}_half UNION ALL SELECT {K}, j, i, x FROM {name}_half WHERE i < j),
{name}_case AS (SELECT * FROM ({_values(cases)}) AS v(c, model, p, d)),
{name}_a1 AS (SELECT * FROM ({_values(first)}) AS v(c, r, i, x)),
{name}_e1 AS (
  SELECT {K}, a.c, a.r, b.r AS q, sum(a.x * b.x * m.x) AS x
  FROM {name}_m m JOIN {name}_a1 a ON a.i = m.i JOIN {name}_a1 b ON b.i = m.j AND b.c = a.c GROUP BY {K}, a.c, a.r, b.r),
{name}_g1 AS (SELECT {K}, c, list(row ORDER BY r) AS m FROM (SELECT {K}, c, r, list(x ORDER BY q) AS row FROM {name}_e1 GROUP BY {K}, c, r) GROUP BY {K}, c),
{_sweep(f"{name}_s1", f"{name}_g1").lstrip()},
{name}_n AS (SELECT {K}, x AS n FROM {name}_m WHERE i = 0 AND j = 0),
{name}_phi AS (
  SELECT {K}, c, p, d, n,
         CASE WHEN p = 0 THEN n > 0 ELSE n > 0 AND n - alive > 1 AND abs(f2) < 0.995 AND f2 + abs(f1) < 0.995 END AS fits,
         f1, f2
  FROM (SELECT {K}, c, p, d, n, alive,
               CASE WHEN p >= 1 THEN coalesce(m[2 - d][len(m)], 0) ELSE 0.0 END AS f1,
               CASE WHEN p >= 2 THEN coalesce(m[3 - d][len(m)], 0) ELSE 0.0 END AS f2
        FROM {name}_n CROSS JOIN {name}_case LEFT JOIN {name}_s1 USING ({K}, c))),
{name}_tap AS (
  SELECT {K}, c, 0 AS lag, 1.0 AS tap FROM {name}_phi WHERE fits UNION ALL
  SELECT {K}, c, 1, -f1 FROM {name}_phi WHERE fits AND p >= 1 UNION ALL
  SELECT {K}, c, 2, -f2 FROM {name}_phi WHERE fits AND p >= 2),
{name}_a2 AS MATERIALIZED (
  SELECT {K}, c, r, i, sum(tap * x) AS x FROM {name}_tap JOIN ({_values(second)}) AS v(c, r, lag, i, x) USING (c, lag) GROUP BY {K}, c, r, i),
{name}_e2 AS (
  SELECT m.store_id, m.upc_id, a.c, a.r, b.r AS q, sum(a.x * b.x * m.x) AS x
  FROM {name}_m m
  JOIN {name}_a2 a ON a.i = m.i AND a.store_id = m.store_id AND a.upc_id = m.upc_id
  JOIN {name}_a2 b ON b.i = m.j AND b.c = a.c AND b.store_id = m.store_id AND b.upc_id = m.upc_id GROUP BY ALL),
{name}_g2 AS (SELECT {K}, c, list(row ORDER BY r) AS m FROM (SELECT {K}, c, r, list(x ORDER BY q) AS row FROM {name}_e2 GROUP BY {K}, c, r) GROUP BY {K}, c),
{_sweep(f"{name}_s2", f"{name}_g2").lstrip()},
{name}_fit AS (
  SELECT {K}, c, model, p, d, f1, f2, n, alive, greatest(m[len(m)][len(m)], 0) AS rss,
         list_transform(m[:len(m) - 1], lambda row: row[len(row)]) AS coef, alive + d + p + 1 AS params
  FROM {name}_s2 JOIN {name}_phi USING ({K}, c) JOIN {name}_case USING (c, p, d)),
{name} AS (
  SELECT {K}, model, p, d, f1, f2, CASE WHEN d = 0 THEN coef[1] ELSE 0 END AS const, coef[2 - d:] AS beta,
         rss / greatest(n - alive - p, 1) AS sigma2,
         n * (ln(2 * pi() * greatest(rss / n, 1e-12)) + 1) + 2 * params + 2 * params * (params + 1) / (n - params - 1) AS aicc
  FROM {name}_fit WHERE n - params - 1 > 0
  QUALIFY row_number() OVER (PARTITION BY {K}, model ORDER BY aicc, c) = 1)"""
