"""SQL of the seasonal model: decomposition by loess, smoothing of the rest, and forecasts of both kinds of model.

Written from the definitions: every smoothing is rows of weights (n, t, j, w) that are joined and summed, moving
averages are window frames. A calendar week must occur in at most 13 years, the span of the seasonal smoother.
"""

from __future__ import annotations

K = "store_id, upc_id"
FLAGS = ("feature", "display", "tpr_only")
LAGGED = tuple(f"lag_{f}" for f in FLAGS)
PERIOD, SEASON_SPAN, LOW_SPAN, TREND_SPAN = 52, 13, 53, 89
STEPS = 5


def _tricube(distance: str, reach: str) -> str:
    return f"pow(1 - pow(least({distance} / greatest({reach}, 1e-9), 1.0), 3), 3)"


def _loess(name: str, span: int, lengths: str) -> str:
    """{name}: weights (n, t, j, w) of a local line over `span` points of 0 to n - 1."""
    half = (span - 1) // 2
    first = f"greatest(0, least(t - {half}, n - {span}))"
    reach = f"CASE WHEN n >= {span} THEN CAST(greatest(t - {first}, {first} + {span - 1} - t) AS DOUBLE) ELSE greatest(t, n - 1 - t) * {span}.0 / n END"
    return f"""
{name}_raw AS (
  SELECT n, t, j, {_tricube('abs(t - j)', 'reach')} AS w
  FROM (SELECT n, t, reach, unnest(range(0, n)) AS j FROM (SELECT n, t, {reach} AS reach FROM (SELECT n, unnest(range(0, n)) AS t FROM {lengths})))
  WHERE abs(t - j) < greatest(reach, 1e-9)),
{name}_mid AS (
  SELECT n, t, sum(w) AS total, sum(w * j) / sum(w) AS c, sum(w * j * j) / sum(w) - pow(sum(w * j) / sum(w), 2) AS spread FROM {name}_raw GROUP BY n, t),
{name} AS MATERIALIZED (
  SELECT n, t, j, w / total * (1 + CASE WHEN spread > 1e-6 THEN (t - c) / spread ELSE 0 END * (j - c)) AS w FROM {name}_raw JOIN {name}_mid USING (n, t))"""


def _smoothed(name: str, source: str, value: str, weights: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT {K}, n, w.t AS i, sum(w.w * {value}) AS v FROM {source} x JOIN {weights} w USING (n) WHERE w.j = x.i GROUP BY {K}, n, w.t)"""


def _season(name: str, source: str) -> str:
    """{name}: seasonal part v of `source` (x at place i of n) in one pass."""
    far = "greatest(abs(a.pos), abs(a.pos - (a.m - 1)))"
    window = f"(PARTITION BY {K} ORDER BY i ROWS BETWEEN CURRENT ROW AND {{}} FOLLOWING)"
    return f"""
{name}_phase AS (SELECT *, i % {PERIOD} AS phase, i // {PERIOD} AS j, count(*) OVER (PARTITION BY {K}, i % {PERIOD}) AS m FROM {source}),
{name}_at AS (SELECT {K}, n, phase, m, unnest(range(-1, m + 1)) AS pos FROM {name}_phase WHERE j = 0),
{name}_c AS MATERIALIZED (
  SELECT a.store_id, a.upc_id, a.n, (pos + 1) * {PERIOD} + a.phase AS i, sum(w * x) / sum(w) AS v
  FROM (SELECT a.*, p.x, {_tricube("abs(a.pos - p.j)", f"({far} * greatest(1.0, {SEASON_SPAN}.0 / a.m))")} AS w
        FROM {name}_at a JOIN {name}_phase p ON p.store_id = a.store_id AND p.upc_id = a.upc_id AND p.phase = a.phase) a
  GROUP BY ALL),
{name}_1 AS (SELECT {K}, n, i, avg(v) OVER {window.format(PERIOD - 1)} AS v FROM {name}_c),
{name}_2 AS (SELECT {K}, n, i, avg(v) OVER {window.format(PERIOD - 1)} AS v FROM {name}_1 WHERE i <= n + {PERIOD}),
{name}_3 AS (SELECT {K}, n, i, avg(v) OVER {window.format(2)} AS v FROM {name}_2 WHERE i <= n + 1),
{name}_4 AS (SELECT * FROM {name}_3 WHERE i < n),{_smoothed(f"{name}_low", f"{name}_4", "x.v", "low_w")},
{name} AS (
  SELECT l.store_id, l.upc_id, l.n, l.i, c.v - l.v AS v
  FROM {name}_low l JOIN {name}_c c ON c.store_id = l.store_id AND c.upc_id = l.upc_id AND c.i = l.i + {PERIOD})"""


def decomposed(src: str) -> str:
    """parts: i, n, z, s (seasonal) of every series of src (week, z) that has all values."""
    return f"""
whole AS (SELECT {K}, week, z, row_number() OVER (PARTITION BY {K} ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM {src}
          QUALIFY count(z) OVER (PARTITION BY {K}) = count(*) OVER (PARTITION BY {K})),
lengths AS (SELECT DISTINCT n FROM whole WHERE n >= {2 * PERIOD}),{_loess("low_w", LOW_SPAN, "lengths")},{_loess("trend_w", TREND_SPAN, "lengths")},
raw AS (SELECT {K}, n, i, z, z AS x FROM whole WHERE n >= {2 * PERIOD}),{_season("season1", "raw")},
less AS (SELECT r.store_id, r.upc_id, r.n, r.i, r.z - s.v AS v FROM raw r JOIN season1 s USING ({K}, n, i)),{_smoothed("trend1", "less", "x.v", "trend_w")},
flat AS (SELECT r.store_id, r.upc_id, r.n, r.i, r.z, r.z - t.v AS x FROM raw r JOIN trend1 t USING ({K}, n, i)),{_season("season2", "flat")},
parts AS MATERIALIZED (SELECT w.*, coalesce(s.v, 0) AS s FROM whole w LEFT JOIN season2 s USING ({K}, n, i))"""


def rest() -> str:
    """ordered and opening, as the smoothing of forms reads them, of the rest of `parts`."""
    return f"""
ordered AS MATERIALIZED (SELECT {K}, z - s AS y, i + 1 AS i, n FROM parts),
opening AS (SELECT a.store_id, a.upc_id, a.y, a.n, (b.y - a.y) / greatest(least(a.n, 10) - 1, 1) AS slope
            FROM ordered a JOIN ordered b ON a.store_id = b.store_id AND a.upc_id = b.upc_id AND b.i = least(a.n, 10) WHERE a.i = 1)"""


def smoothed_states() -> str:
    """smoothed: last week, state, gains and variance of every series with a form, from `fine`."""
    return f"""
smoothed AS (
  SELECT {K}, f.n, a, g, f, level, slope, sse / greatest(f.n - k, 1) AS sigma2, aicc, l.last
  FROM fine f JOIN (SELECT {K}, max(week) AS last FROM whole GROUP BY {K}) l USING ({K}))"""


def one_ahead() -> str:
    """expected: what the chosen smoothing expects of the rest at every place i (from 0)."""
    return f"""
expected AS (
  SELECT {K}, CAST(1 AS BIGINT) AS i, o.n, o.y AS level, CASE WHEN f > 0 THEN o.slope ELSE 0.0 END AS slope, CAST(NULL AS DOUBLE) AS ahead, a, g, f
  FROM opening o JOIN (SELECT {K}, a, g, f FROM fine) c USING ({K})
  UNION ALL
  SELECT e.store_id, e.upc_id, o.i, e.n, level + f * slope + a * (o.y - level - f * slope), f * slope + g * (o.y - level - f * slope),
         level + f * slope, a, g, f
  FROM expected e JOIN ordered o ON o.store_id = e.store_id AND o.upc_id = e.upc_id AND o.i = e.i + 1)"""


def smoothing_points(rows: str) -> str:
    """model, mu and sigma of `rows` (keys, week, h) by the seasonal model."""
    reach = f"list_sum(list_transform(range(1, h + 1), lambda j: pow(f, j)))"
    spread = "1 + coalesce(list_sum(list_transform(range(1, h), lambda q: pow(a + g * list_sum(list_transform(range(1, q + 1), lambda j: pow(f, j))), 2))), 0)"
    return f"""
SELECT r.* EXCLUDE (h), 'stl' AS model, level + slope * {reach} + coalesce(p.s, 0) AS mu, sqrt(sigma2 * ({spread})) AS sigma
FROM {rows} r JOIN smoothed m USING ({K})
LEFT JOIN parts p ON p.store_id = r.store_id AND p.upc_id = r.upc_id AND p.i = m.n - {PERIOD} + (r.h - 1) % {PERIOD} AND m.n >= {2 * PERIOD}"""


EFFECT = " + ".join(f"coalesce(beta[{i}], 0) * coalesce({c}, 0)" for i, c in enumerate(FLAGS + LAGGED, 1))


def regression_states(ready: str, chosen: str) -> str:
    """noise: errors e of the chosen regressions; ahead: their path and its weights for STEPS steps."""
    path = ["w1 * f1 + w2 * f2 AS p1", "p1 * f1 + w1 * f2 AS p2"] + [f"p{h - 1} * f1 + p{h - 2} * f2 AS p{h}" for h in range(3, STEPS + 1)]
    psi = ["1.0 AS s0", "f1 AS s1"] + [f"s{h - 1} * f1 + s{h - 2} * f2 AS s{h}" for h in range(2, STEPS)]
    return f"""
noise AS (
  SELECT {K}, week, units, z, z - const - ({EFFECT}) AS e, d, f1, f2, row_number() OVER (PARTITION BY {K} ORDER BY week DESC) AS back,
         row_number() OVER (PARTITION BY {K} ORDER BY week) - 1 AS t, {", ".join(FLAGS)}
  FROM (SELECT *, {", ".join(f"lag({f}) OVER (PARTITION BY {K} ORDER BY week) AS lag_{f}" for f in FLAGS)} FROM {ready}) JOIN {chosen} USING ({K})),
ends AS (
  SELECT {K}, max(week) AS last, {", ".join(f"max(e) FILTER (back = {i}) AS e{i}" for i in (1, 2, 3))},
         {", ".join(f"max(coalesce({f}, 0)) FILTER (back = 1) AS last_{f}" for f in FLAGS)}
  FROM noise GROUP BY {K}),
ahead AS (
  SELECT *, CASE WHEN d = 1 THEN e1 - e2 ELSE e1 END AS w1, CASE WHEN d = 1 THEN e2 - e3 ELSE e2 END AS w2, {", ".join(path + psi)}
  FROM {chosen} JOIN ends USING ({K}))"""


def regression_points(rows: str, model: str) -> str:
    """model, mu and sigma of `rows` (keys, week, h, flags) by the chosen regressions."""
    p = "[" + ", ".join(f"p{h}" for h in range(1, STEPS + 1)) + "]"
    s = "[" + ", ".join(f"s{h}" for h in range(STEPS)) + "]"
    sums = "[" + ", ".join(" + ".join(f"s{j}" for j in range(h + 1)) for h in range(STEPS)) + "]"
    squares = f"list_sum(list_transform(CASE WHEN d = 1 THEN {sums}[1:h] ELSE {s}[1:h] END, lambda x: x * x))"
    before = ", ".join(f"CASE WHEN h = 1 THEN last_{f} ELSE lag(coalesce({f}, 0)) OVER (PARTITION BY {K} ORDER BY h) END AS lag_{f}" for f in FLAGS)
    return f"""
SELECT * EXCLUDE (h, mean_, var_), '{model}' AS model, mean_ AS mu, sqrt(var_) AS sigma FROM (
  SELECT r.* EXCLUDE ({", ".join(LAGGED)}), const + ({EFFECT}) + CASE WHEN d = 1 THEN e1 + list_sum({p}[1:h]) ELSE {p}[h] END AS mean_, sigma2 * {squares} AS var_
  FROM (SELECT r.*, {before} FROM {rows} r JOIN ends USING ({K})) r JOIN ahead USING ({K}))"""
