"""SQL counterparts of the registered queries, over the same source tables."""

from __future__ import annotations

from itertools import combinations

from contract import seasonal_sql as seasonal
from contract.model_sql import FOURIER, LAGGED, interpolated, regressions

FLAGS = ("feature", "display", "tpr_only")
MEASURES = ("units", "visits", "hhs", "spend", "price", "base_price")
NUMBERS = ("units", "visits", "base_price")
MODELS = ("arima_base", "arima_lagged", "arima_seasonal", "arima_seasonal_lagged")
K = "store_id, upc_id"
COLUMNS = f"week, {K}, {', '.join(MEASURES)}, {', '.join(FLAGS)}"

LINES = """
lines AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS store_id, p_brand AS upc_id,
         CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week,
         l_orderkey, o_custkey, l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(round(l_discount * 100) AS INTEGER) AS disc,
         CAST(round(l_tax * 100) AS INTEGER) AS tax
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey)"""

PANEL = (
    LINES
    + """,
cells AS (
  SELECT store_id, upc_id, week, sum(l_quantity) AS units,
         count(DISTINCT l_orderkey) AS visits, count(DISTINCT o_custkey) AS hhs,
         CAST(sum(amount) AS DOUBLE) AS spend, sum(disc) AS disc, sum(tax) AS tax, count(*) AS n
  FROM lines GROUP BY store_id, upc_id, week),
panel AS (
  SELECT week, store_id, upc_id, units, visits, hhs, spend,
         round(spend / units, 4) AS price, round(spend / units * 1.1, 4) AS base_price,
         CAST(disc > 6 * n AS INTEGER) AS feature,
         CAST(100 * tax > 480 * n AS INTEGER) AS display,
         CAST(disc > 5 * n AND NOT disc > 6 * n AND NOT 100 * tax > 480 * n AS INTEGER) AS tpr_only
  FROM cells)"""
)

PRODUCTS = """
products AS (
  SELECT DISTINCT p_brand AS upc_id,
         'CAT' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 4 AS VARCHAR) AS category
  FROM part)"""


def _fill(name: str, source: str) -> str:
    values = ", ".join(f"p.{c}" for c in (*MEASURES, *FLAGS))
    return f"""
{name}_span AS (SELECT {K}, min(week) AS a, max(week) AS b FROM {source} GROUP BY {K}),
{name}_weeks AS (
  SELECT {K}, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week
  FROM {name}_span),
{name} AS (
  SELECT c.week, c.store_id, c.upc_id, {values}
  FROM {name}_weeks c LEFT JOIN {source} p
    ON c.week = p.week AND c.store_id = p.store_id AND c.upc_id = p.upc_id)"""


LONG = f"""
long AS (SELECT * FROM panel QUALIFY count(*) OVER (PARTITION BY {K}) > 12)"""
GAPS = PANEL + "," + _fill("gaps0", "panel") + f""",
gaps AS (SELECT *, CAST(count(*) FILTER (WHERE units IS NULL)
           OVER (PARTITION BY {K}) AS BIGINT) AS n_na FROM gaps0)"""
RATIO = GAPS + f""",
ratio AS (SELECT {K}, max(n_na) AS n_na, max(n_na) / count(*) AS missingness
          FROM gaps GROUP BY {K})"""
SAMPLE = RATIO + "," + PRODUCTS + """,
picked AS (
  SELECT store_id, upc_id, category, missingness FROM ratio LEFT JOIN products USING (upc_id)
  WHERE missingness < 0.25
  QUALIFY row_number() OVER (PARTITION BY store_id, category
    ORDER BY md5(concat_ws(':', '42', store_id, upc_id)), upc_id) = 1)"""
FILLED = PANEL + "," + LONG + "," + _fill("filled", "long")
CARRIED = FILLED + f""",
carried AS (SELECT * REPLACE (last_value(units IGNORE NULLS) OVER (PARTITION BY {K} ORDER BY week
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS units) FROM filled)"""
NUMBERED = FILLED + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY week DESC) AS back,
               count(*) OVER (PARTITION BY {K}) AS size FROM filled)"""

CATEGORY = PANEL + "," + PRODUCTS + """,
weekly AS (
  SELECT week, category, sum(units) AS units, CAST(sum(visits) AS BIGINT) AS visits,
         avg(base_price) AS base_price, CAST(ceil(avg(feature)) AS INTEGER) AS feature,
         CAST(ceil(avg(display)) AS INTEGER) AS display,
         CAST(ceil(avg(tpr_only)) AS INTEGER) AS tpr_only
  FROM panel LEFT JOIN products USING (upc_id) GROUP BY week, category)"""

Z80, Z95 = 1.2815515655, 1.9599639845


def _bands(mu: str = "mu", sigma: str = "sigma") -> str:
    def bound(sign: str, z: float) -> str:
        return f"pow(greatest({mu} {sign} {z} * {sigma}, 0.0), 2)"

    known = f"{mu} IS NOT NULL AND {sigma} IS NOT NULL"
    parts = {
        "p_units": f"{mu} * {mu} + {sigma} * {sigma}",
        "low80": bound("-", Z80),
        "up80": bound("+", Z80),
        "low95": bound("-", Z95),
        "up95": bound("+", Z95),
    }
    return ", ".join(f"CASE WHEN {known} THEN {e} END AS {n}" for n, e in parts.items())


STANDIN = NUMBERED + f""",
base AS (
  SELECT {K}, arg_max(units, week) FILTER (WHERE back > 4 AND units IS NOT NULL) AS stl,
         avg(units) FILTER (WHERE back BETWEEN 5 AND 8) AS arima,
         stddev_samp(sqrt(units)) FILTER (WHERE back > 4) AS sigma, max(week) AS last
  FROM numbered WHERE size > 4 GROUP BY {K}),
ahead AS (SELECT *, CAST(last - 7 * unnest([0, 1, 2, 3]) AS DATE) AS week FROM base),
points AS (
  SELECT {K}, week, sigma, 'arima' AS model, arima AS point FROM ahead UNION ALL
  SELECT {K}, week, sigma, 'stl' AS model, stl AS point FROM ahead),
fc AS (SELECT {K}, model, week, {_bands('sqrt(point)', 'sigma')} FROM points)"""

SCORED = STANDIN + f""",
scored AS (SELECT f.*, a.units FROM fc f LEFT JOIN filled a USING ({K}, week)),
rmse AS (SELECT {K}, model, sqrt(avg(pow(units - p_units, 2))) AS rmse,
                CASE WHEN count(units - p_units) = count(*)
                     THEN sqrt(avg(pow(units - p_units, 2))) END AS strict_rmse
         FROM scored GROUP BY {K}, model),
wide AS (SELECT {K}, max(rmse) FILTER (WHERE model = 'arima') AS arima,
                max(rmse) FILTER (WHERE model = 'stl') AS stl FROM rmse GROUP BY {K})"""

INNOV = CARRIED + f""",
steps AS (SELECT {K}, week, sqrt(units) - sqrt(lag(units) OVER (PARTITION BY {K} ORDER BY week))
            AS stl, sqrt(units) - 5.0 AS arima FROM carried),
innov AS (SELECT {K}, week, 'stl' AS model, stl AS innov FROM steps UNION ALL
          SELECT {K}, week, 'arima' AS model, arima AS innov FROM steps)"""


def _aicc(x: str) -> str:
    y = "sqrt(units)"
    sse = (
        f"(regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / nullif(regr_sxx({y}, {x}), 0))"
    )
    n = f"regr_count({y}, {x})"
    return (
        f"CASE WHEN {n} > 12 AND {sse} > 0.001 THEN"
        f" round({n} * ln({sse} / {n}) + 6 + 24.0 / ({n} - 4), 6) END"
    )


SCORES = PANEL + f""",
scores AS (SELECT {K}, {_aicc('feature')} AS arima_base, {_aicc('display')} AS arima_lagged,
             {_aicc('tpr_only')} AS arima_seasonal, {_aicc('visits')} AS arima_seasonal_lagged
           FROM panel GROUP BY {K})"""


def _best(source: str, models: tuple[str, ...], mean: str) -> str:
    low = f"least({', '.join(models)})"
    cases = " ".join(f"WHEN {m} = {low} THEN '{m}'" for m in models)
    return f"""
best AS (SELECT *, list_avg([{', '.join(models)}]) AS {mean},
           CASE WHEN {low} IS NULL THEN NULL {cases} END AS best_model FROM {source})"""


FIXED = CARRIED + f""",
kept AS (SELECT * FROM carried
         QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY week DESC) > 4),
state AS (
  SELECT {K}, max(week) AS last_week, avg(sqrt(units)) AS mean,
         arg_max(coalesce(feature, 0), week) AS lf, arg_max(coalesce(display, 0), week) AS ld,
         arg_max(coalesce(tpr_only, 0), week) AS lt, arg_max(sqrt(units), week) AS y
  FROM kept GROUP BY {K}),
levels AS (SELECT *, y - (1.5 * lf + 0.8 * ld + 0.4 * lt) AS level FROM state)"""


def _fixed_dist(rows: str) -> str:
    """(mu, sigma) of both fixed fits for rows with h, flags and the previous feature flag."""
    effect = "1.5 * feature + 0.8 * display + 0.4 * tpr_only - 0.5 * coalesce(prev, lf)"
    return f"""
dist AS (
  SELECT r.*, 'arima' AS model,
         pow(0.6, h - 1) * (0.6 * (level - mean) + 0.06) + mean + {effect} AS mu,
         sqrt(0.25 * CASE h WHEN 1 THEN 1.0 WHEN 2 THEN 1.81 WHEN 3 THEN 2.1016
                            ELSE 2.206576 END) AS sigma
  FROM {rows} r JOIN levels USING ({K})
  UNION ALL
  SELECT r.*, 'arima_walk' AS model, level - 0.2 + {effect} AS mu,
         sqrt(0.25 * (1 + 0.36 * (h - 1))) AS sigma
  FROM {rows} r JOIN levels USING ({K}))"""


# Fixed smoothing fit: level y, slope 0.05 damped by 0.9, a season repeating every four
# weeks, error variance growing with alpha 0.3 and slope gain 0.1.
SMOOTH_DIST = f"""
reach AS (SELECT * FROM (VALUES (1, 0.9), (2, 1.71), (3, 2.439), (4, 3.0951)) AS t(h, reach)),
smooth_dist AS (
  SELECT {K}, 'stl' AS model, h, CAST(last_week + 7 * h AS DATE) AS week,
         y + 0.05 * reach + ((h - 1) % 4) * 0.1 AS mu,
         sqrt(0.25 * (1 + coalesce((SELECT sum(pow(0.3 + 0.1 * e.reach, 2)) FROM reach e
                                    WHERE e.h < reach.h), 0))) AS sigma
  FROM levels CROSS JOIN reach)"""


SCENARIO_ROWS = f"""
cases AS (SELECT * FROM (VALUES (0, 0, 0, 1), (1, 0, 0, 2), (0, 1, 0, 3), (0, 0, 1, 4),
            (1, 1, 0, 5)) AS t(feature, display, tpr_only, fc_ind)),
ends AS (SELECT {K}, max(week) AS last, unnest([1, 2]) AS h FROM kept GROUP BY {K}),
rows_ AS (SELECT {K}, CAST(last + 7 * h AS DATE) AS week, h, feature, display, tpr_only, fc_ind,
            CASE WHEN h > 1 THEN feature END AS prev FROM ends CROSS JOIN cases)"""


def _r(columns: str | tuple[str, ...], digits: int = 4) -> str:
    names = columns.split(", ") if isinstance(columns, str) else columns
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


BANDS = "p_units, low80, up80, low95, up95"
STORE = """
tiers AS (
  SELECT s_suppkey AS store_id, s_nationkey, CASE WHEN s_acctbal < 2500 THEN 'VALUE'
           WHEN s_acctbal < 6500 THEN 'MAINSTREAM' ELSE 'UPSCALE' END AS seg_value_name
  FROM supplier
  UNION ALL
  SELECT c_custkey, s_nationkey, CASE WHEN c_acctbal < 2500 THEN 'VALUE'
           WHEN c_acctbal < 6500 THEN 'MAINSTREAM' ELSE 'UPSCALE' END
  FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey % 7 = 0),
merged AS (
  SELECT DISTINCT CAST(store_id AS VARCHAR) AS store_id, s_nationkey,
         CASE WHEN n > 1 THEN 'MAINSTREAM_UPSCALE' ELSE seg_value_name END AS seg_value_name
  FROM (SELECT *, count(*) OVER (PARTITION BY store_id) AS n FROM tiers))"""


def _sizes(count_as_mass: bool) -> str:
    count = "WHEN 'CT' THEN p_size * 0.2 / 28.349523125" if count_as_mass else ""
    return f"""
WITH sized AS (SELECT *, CASE p_type WHEN 'STANDARD' THEN 'OZ' WHEN 'SMALL' THEN 'ML'
  WHEN 'LARGE' THEN 'LT' WHEN 'PROMO' THEN 'CT' WHEN 'ECONOMY' THEN 'OZ' WHEN 'MEDIUM' THEN 'ML'
  END AS unit FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS upc_id, p_name AS description,
  concat_ws(' ', CAST(p_size AS VARCHAR), unit) AS product_size,
  round(CASE unit WHEN 'LT' THEN p_size * 1000.0::DOUBLE WHEN 'ML' THEN p_size::DOUBLE END, 6)
    AS volume_ml,
  round(CASE unit WHEN 'OZ' THEN p_size::DOUBLE {count} END, 6) AS mass_oz,
  coalesce(unit = 'CT', false) AS size_is_count
FROM sized"""


def _column_summary() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
  round(count({c}) / count(*), 4) AS complete_rate, round(avg({c}), 2) AS mean,
  round(stddev_samp({c}), 2) AS sd, round(CAST(min({c}) AS DOUBLE), 2) AS min,
  round(CAST(max({c}) AS DOUBLE), 2) AS max, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.75), 4) AS p75 FROM panel"""
        for c in MEASURES
    )


def _text_summary() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
  count({c}) / count(*) AS complete_rate, count(*) FILTER (WHERE {c} = '') AS n_empty,
  count(DISTINCT {c}) AS n_unique, CAST(min(length({c})) AS INTEGER) AS min_length,
  CAST(max(length({c})) AS INTEGER) AS max_length FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    )


def _fences(source: str) -> str:
    parts = []
    for c in MEASURES:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        parts.append(f"{q1} - 3 * ({q3} - {q1}) AS {c}_lo, {q3} + 3 * ({q3} - {q1}) AS {c}_hi")
    flags = ", ".join(f"({c} < {c}_lo OR {c} > {c}_hi) AS outlier_{c}" for c in MEASURES)
    return f"""
fences AS (SELECT {', '.join(parts)} FROM {source}),
flags AS (SELECT week, {K}, {flags} FROM {source} CROSS JOIN fences)"""


def _counts(strict: bool) -> str:
    def one(c: str) -> str:
        total = f"CAST(count(*) FILTER (WHERE outlier_{c}) AS BIGINT)"
        if strict:
            total = f"CASE WHEN count(outlier_{c}) = count(*) THEN {total} END"
        return f"{total} AS outlier_{c}"

    return "SELECT " + ", ".join(one(c) for c in MEASURES) + " FROM flags"


def _longer(source: str, columns: dict[str, str], digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT week, category, '{n}' AS col,"
        f" round(round(CAST({e} AS DOUBLE), 8), {digits}) AS value"
        f" FROM {source}"
        for n, e in columns.items()
    )


def _corr(source: str, columns: tuple[str, ...], by: str = "", where: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr"
        f" FROM {source}{group}"
        for a, b in combinations(columns, 2)
    )


LEVELS = PANEL + "," + PRODUCTS + """,
joined AS (SELECT * FROM panel LEFT JOIN products USING (upc_id)),
levels AS (""" + " UNION ALL ".join(
    f"SELECT category, units, visits, base_price, '{f}' AS flag,"
    f" CASE WHEN {f} = 1 THEN 'True' WHEN {f} IS NOT NULL THEN 'False' END AS level FROM joined"
    for f in FLAGS
) + ")"

FIVE = " UNION ALL ".join(
    f"""SELECT category, flag, level, '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS max
  FROM levels GROUP BY category, flag, level"""
    for c in NUMBERS
)


def _level(f: str) -> str:
    return f"CASE WHEN {f} = 1 THEN 'True' WHEN {f} IS NOT NULL THEN 'False' END"


CROSSTAB = " UNION ALL ".join(
    f"SELECT category, '{a}' AS x, '{b}' AS y, {_level(a)} AS x_level, {_level(b)} AS y_level,"
    f" count(*) AS n FROM weekly GROUP BY category, {_level(a)}, {_level(b)}"
    for a, b in combinations(FLAGS, 2)
)


def _smooth(alphas: str) -> str:
    return FILLED.replace("WITH ", "") + f""",
ordered AS (SELECT {K}, sqrt(units) AS y, row_number() OVER (PARTITION BY {K} ORDER BY week) AS i
            FROM filled WHERE units IS NOT NULL),
alphas AS (SELECT unnest({alphas}) AS alpha),
fold AS (
  SELECT {K}, alpha, CAST(1 AS BIGINT) AS i, y AS level, CAST(0 AS DOUBLE) AS sse
  FROM ordered CROSS JOIN alphas WHERE i = 1
  UNION ALL
  SELECT f.store_id, f.upc_id, f.alpha, o.i, f.level + f.alpha * (o.y - f.level),
         f.sse + pow(o.y - f.level, 2)
  FROM fold f JOIN ordered o ON o.store_id = f.store_id AND o.upc_id = f.upc_id AND o.i = f.i + 1),
final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY {K}, alpha ORDER BY i DESC) = 1)"""


def _ols_flags() -> str:
    """Each slope is that of y on what the other two regressors leave of its own."""
    part = f"OVER (PARTITION BY {K})"
    first, second, slopes = [], [], []
    for x, (u, v) in {"f": ("d", "t"), "d": ("f", "t"), "t": ("f", "d")}.items():
        first.append(f"{v} - regr_slope({v}, {u}) {part} * {u} AS {x}_v")
        second.append(
            f"{x} - regr_slope({x}, {u}) {part} * {u} - regr_slope({x}, {x}_v) {part} * {x}_v"
            f" AS {x}_rest"
        )
        slopes.append(f"regr_slope(y, {x}_rest) AS b_{x}, avg({x}) AS {x}_mean")
    return f"""
left_over AS (SELECT *, {', '.join(first)} FROM base),
own AS (SELECT *, {', '.join(second)} FROM left_over),
solved AS (SELECT {K}, count(*) AS n_obs, avg(y) AS y_mean, {', '.join(slopes)}
           FROM own GROUP BY {K})"""


def _fourier() -> str:
    angle = "2.0 * pi() * {k} * (date_diff('day', DATE '1970-01-05', week) / 7) / 52.18"
    terms = []
    for k in range(1, 7):
        a = angle.format(k=k)
        terms.append(f"round(sin({a}), 6) AS s{k}, round(cos({a}), 6) AS c{k}")
    return f"SELECT week, {', '.join(terms)} FROM (SELECT DISTINCT week FROM filled)"


def _histogram(source: str, value: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    part = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""
ends_ AS (SELECT {lead}CAST({value} AS DOUBLE) AS x, min(CAST({value} AS DOUBLE)) {part} AS lo,
            max(CAST({value} AS DOUBLE)) {part} AS hi FROM {source} WHERE {value} IS NOT NULL),
binned AS (SELECT *, CASE WHEN hi = lo THEN 1
             ELSE least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS INTEGER) + 1, 50) END AS bin
           FROM ends_)
SELECT {lead}CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / 50), 4) AS bin_start,
       round(lo + bin * ((hi - lo) / 50), 4) AS bin_end, count(*) AS n
FROM binned GROUP BY {lead}bin, lo, hi"""


def _scenario_view(valid: bool) -> str:
    ctes = FIXED + "," + SCENARIO_ROWS + "," + _fixed_dist("rows_")
    standin = STANDIN[len(FILLED) :]
    history = f"""
SELECT {K}, week, 'HISTORY' AS line, round(units, 4) AS value, NULL::DOUBLE AS low80,
       NULL::DOUBLE AS up80, NULL::DOUBLE AS low95, NULL::DOUBLE AS up95
FROM (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY week DESC) > 4)
QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY week DESC) <= 10"""
    if not valid:
        whole = history.rsplit("QUALIFY", 1)[0]
        why = "tpr_only excludes feature and display"
        return _q(ctes + standin, f"SELECT *, '{why}' AS reason FROM ({whole})")
    line = f"p_units, {BANDS[9:]}"
    return _q(
        ctes + standin,
        f"""SELECT *, NULL::VARCHAR AS reason FROM ({history}
UNION ALL SELECT {K}, week, 'ARIMA', {_r(line)} FROM
  (SELECT {K}, week, {_bands()} FROM dist
   WHERE model = 'arima' AND feature = 1 AND display = 1 AND tpr_only = 0)
UNION ALL SELECT {K}, week, 'STL', {_r(line)} FROM fc WHERE model = 'stl')""",
    )


RAW = PANEL + """,
raw AS (SELECT week + 6 AS week_end_date, CAST(store_id AS BIGINT) AS store_id,
          CAST(substr(upc_id, 7) AS BIGINT) AS upc_id, units, feature FROM panel)"""


# The compared models: regressors, and differences where they are fixed.
REGRESSIONS = {
    "arima_base": (FLAGS, None),
    "arima_lagged": (FLAGS + LAGGED, None),
    "arima_seasonal": (FLAGS + FOURIER, None),
    "arima_seasonal_lagged": (FLAGS + LAGGED + FOURIER, 0),
}


def _fits(models: dict, design: tuple[str, ...], effects: bool = False) -> str:
    """The fit table of the filled panel, without what forecasting keeps."""
    fitted = "r.p IS NOT NULL"
    beta = "".join(f", CASE WHEN {fitted} THEN round(coalesce(beta[{i}], 0), 4) END AS b_{c}" for i, c in enumerate(design, 1))
    names = ", ".join(f"('{m}')" for m in models)
    return (
        "WITH RECURSIVE " + FILLED + "," + interpolated("filled", "ready", straight=True) + "," + regressions("ready", models, design, "reg")
        + f"""
SELECT s.store_id, s.upc_id, m.model, CASE WHEN {fitted} THEN 'ok' ELSE 'not fitted' END AS status,
       CASE WHEN {fitted} THEN CAST(n AS INTEGER) END AS n_obs, p, d, CASE WHEN {fitted} THEN 0 END AS q,
       round(sigma2, 4) AS sigma2, round(aicc, 4) AS aicc{", round(const, 4) AS const" + beta if effects else ""}
FROM (SELECT {K}, count(units) AS n FROM filled GROUP BY {K}) s CROSS JOIN (VALUES {names}) AS m(model)
LEFT JOIN reg r ON r.store_id = s.store_id AND r.upc_id = s.upc_id AND r.model = m.model"""
    )


IMPUTED = FILLED + "," + interpolated("filled", "ready") + """,
imputed AS (SELECT * REPLACE (coalesce(units, pow(greatest(z, 0), 2)) AS units) FROM ready)"""

VALIDATED_SAMPLE = SAMPLE + """,
sampled AS (SELECT gaps.* FROM picked JOIN gaps USING (store_id, upc_id)),""" + interpolated("sampled", "bridged") + f""",
sample AS (SELECT week, {K}, coalesce(units, pow(greatest(z, 0), 2)) AS units, {", ".join(FLAGS)} FROM bridged),
sample_train AS (SELECT * FROM sample QUALIFY week <= date_trunc('week', max(week) OVER (PARTITION BY {K}) - INTERVAL 1 MONTH))"""
VALIDATED = VALIDATED_SAMPLE + "," + interpolated("sample_train", "ready", straight=True) + "," + regressions("ready", REGRESSIONS, FLAGS + LAGGED + FOURIER, "reg")

def _trained(source: str, models: dict, design: tuple[str, ...]) -> str:
    """ready and chosen: the first of the models that fits every series of `source`, and what forecasts start from."""
    return interpolated(source, "ready", straight=True) + "," + regressions("ready", models, design, "reg") + f""",
chosen AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY model) = 1),""" + seasonal.regression_states("ready", "chosen")


# The regression with promotions where it fits, else the plain one.
TRAINING = {"1": (FLAGS + LAGGED, None), "2": ((), None)}
TRAINED = FILLED + "," + _trained("filled", TRAINING, FLAGS + LAGGED)
SCENARIO_PATHS = f""",
cases AS (SELECT * FROM (VALUES (0, 0, 0, 1), (1, 0, 0, 2), (0, 1, 0, 3), (0, 0, 1, 4), (1, 1, 0, 5)) AS t(feature, display, tpr_only, fc_ind)),
rows_ AS (SELECT {K}, CAST(last + 7 * h AS DATE) AS week, h, feature, display, tpr_only, fc_ind,
                 {", ".join(f"CASE WHEN h = 1 THEN last_{f} ELSE {f} END AS lag_{f}" for f in FLAGS)}
          FROM ends CROSS JOIN cases CROSS JOIN (VALUES (1), (2)) AS t(h)),
paths AS ({seasonal.regression_points("rows_", "arima")})"""

_LEVEL_GAINS = [round(0.05 + 0.1 * i, 2) for i in range(10)]
_FORMS = [(a, 0.0, 0.0, 3) for a in _LEVEL_GAINS]
_FORMS += [(a, a * s, 1.0, 5) for a in _LEVEL_GAINS for s in (0.02, 0.1, 0.3)]
_FORMS += [(a, a * s, f, 6) for a in _LEVEL_GAINS for s in (0.02, 0.1, 0.3) for f in (0.8, 0.9, 0.98)]


def _form_fold(name: str, cases: str) -> str:
    """{name}: the case with the least criterion of every series; cases has the keys, a, g, f, k and i."""
    return f"""
{name}_fold AS (
  SELECT {K}, c.i AS place, a, g, f, k, CAST(1 AS BIGINT) AS i, n, y AS level, CASE WHEN f > 0 THEN slope ELSE 0.0 END AS slope, CAST(0 AS DOUBLE) AS sse
  FROM {cases} c JOIN opening USING ({K})
  UNION ALL
  SELECT s.store_id, s.upc_id, place, a, g, f, k, o.i, s.n, level + f * slope + a * (o.y - level - f * slope),
         f * slope + g * (o.y - level - f * slope), sse + pow(o.y - level - f * slope, 2)
  FROM {name}_fold s JOIN ordered o ON o.store_id = s.store_id AND o.upc_id = s.upc_id AND o.i = s.i + 1),
{name} AS (
  SELECT *, (n - 1) * ln(greatest(sse / (n - 1), 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - 2 - k) AS aicc
  FROM {name}_fold WHERE i = n AND n - 2 - k > 0
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY aicc, place) = 1)"""


def _forms() -> str:
    rows = ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({g!r} AS DOUBLE), CAST({f!r} AS DOUBLE), {k}.0)" for i, (a, g, f, k) in enumerate(_FORMS))
    return (
        "WITH RECURSIVE " + FILLED + f""",
ordered AS (SELECT {K}, sqrt(units) AS y, row_number() OVER (PARTITION BY {K} ORDER BY week) AS i,
              count(*) OVER (PARTITION BY {K}) AS n FROM filled WHERE units IS NOT NULL),
opening AS (SELECT a.store_id, a.upc_id, a.y, a.n, (b.y - a.y) / greatest(least(a.n, 10) - 1, 1) AS slope
            FROM ordered a JOIN ordered b ON a.store_id = b.store_id AND a.upc_id = b.upc_id AND b.i = least(a.n, 10) WHERE a.i = 1),
grid AS (SELECT {K}, v.* FROM opening CROSS JOIN (VALUES {rows}) AS v(i, a, g, f, k)),"""
        + _form_fold("coarse", "grid")
        + f""",
close AS (SELECT {K}, s AS i, greatest(least(round(a + (s - 5) * 0.01, 4), 0.995), 0.005) AS a, g AS g0, f, k
          FROM coarse CROSS JOIN range(0, 11) AS t(s)),
near AS (SELECT {K}, i, a, least(g0, a) AS g, f, k FROM close),"""
        + _form_fold("fine", "near")
        + f"""
SELECT s.store_id, s.upc_id, CAST(s.n AS INTEGER) AS n_obs,
       CASE WHEN f = 0 THEN 'level' WHEN f = 1 THEN 'trend' WHEN f IS NOT NULL THEN 'damped' END AS form,
       {_r("fine.level, fine.slope, sse, aicc").replace("AS fine.", "AS ")}, round(a, 4) AS alpha, round(g, 4) AS slope_gain, f AS damping
FROM opening s LEFT JOIN fine USING ({K})"""
    )


_GRID = ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({g!r} AS DOUBLE), CAST({f!r} AS DOUBLE), {k}.0)" for i, (a, g, f, k) in enumerate(_FORMS))


def _smoothing(source: str) -> str:
    """smoothed (and parts, ordered, opening, fine): the seasonal model of every series of `source` (week, z)."""
    return (
        seasonal.decomposed(source) + "," + seasonal.rest() + f""",
grid AS (SELECT {K}, v.* FROM opening CROSS JOIN (VALUES {_GRID}) AS v(i, a, g, f, k)),"""
        + _form_fold("coarse", "grid")
        + f""",
close AS (SELECT {K}, s AS i, greatest(least(round(a + (s - 5) * 0.01, 4), 0.995), 0.005) AS a, g AS g0, f, k
          FROM coarse CROSS JOIN range(0, 11) AS t(s)),
near AS (SELECT {K}, i, a, least(g0, a) AS g, f, k FROM close),"""
        + _form_fold("fine", "near") + "," + seasonal.smoothed_states()
    )


def _points(rows: str, model: str) -> str:
    """Forecast rows of both models with their bands; rows has the keys, week, h and flags."""
    return f"""
points AS ({seasonal.regression_points(rows, model)} UNION ALL BY NAME {seasonal.smoothing_points(rows)}),
forecasts AS (SELECT {K}, model, week, {_bands('mu', 'sigma')} FROM points)"""


HELD_OUT = NUMBERED + f""",
train_rows AS (SELECT * FROM numbered WHERE back > 4 AND size > 4),
test_rows AS (SELECT {K}, week, feature, display, tpr_only, 5 - back AS h FROM numbered WHERE back <= 4 AND size > 4),""" + _trained(
    "train_rows", TRAINING, FLAGS + LAGGED
) + "," + _smoothing("ready") + "," + _points("test_rows", "arima")

FINAL_RMSE = VALIDATED_SAMPLE + "," + _trained("sample_train", {"arima_lagged": (FLAGS + LAGGED, None)}, FLAGS + LAGGED) + "," + _smoothing(
    "ready"
) + f""",
val_rows AS (
  SELECT {K}, s.week, feature, display, tpr_only, datediff('day', last, s.week) // 7 AS h
  FROM sample s JOIN (SELECT {K}, max(week) AS last FROM sample_train GROUP BY {K}) l USING ({K}) WHERE s.week > last),""" + _points(
    "val_rows", "arima_lagged"
) + f""",
errors AS (SELECT {K}, model, sqrt(avg(pow(units - p_units, 2))) AS rmse FROM forecasts JOIN sample USING ({K}, week) GROUP BY {K}, model),
finals AS (SELECT {K}, max(rmse) FILTER (model = 'arima_lagged') AS arima_lagged, max(rmse) FILTER (model = 'stl') AS stl FROM errors GROUP BY {K})"""

_RESIDUALS = f"""
moved AS (SELECT *, CASE WHEN d = 1 THEN e - lag(e) OVER w ELSE e END AS m FROM noise WINDOW w AS (PARTITION BY {K} ORDER BY week)),
innovations AS (
  SELECT {K}, 'arima' AS model, week, units, z,
         CASE WHEN units IS NOT NULL AND t >= 4 THEN m - f1 * lag(m, 1) OVER w - f2 * lag(m, 2) OVER w END AS innov
  FROM moved WINDOW w AS (PARTITION BY {K} ORDER BY week)
  UNION ALL
  SELECT p.store_id, p.upc_id, 'stl', p.week, r.units, p.z, p.z - (e.ahead + p.s)
  FROM parts p JOIN expected e ON e.store_id = p.store_id AND e.upc_id = p.upc_id AND e.i = p.i + 1
  JOIN chosen c ON c.store_id = p.store_id AND c.upc_id = p.upc_id
  JOIN ready r ON r.store_id = p.store_id AND r.upc_id = p.upc_id AND r.week = p.week)
SELECT {K}, model, week, units, round(CASE WHEN innov IS NOT NULL THEN pow(greatest(z - innov, 0), 2) END, 4) AS fitted,
       round(units - CASE WHEN innov IS NOT NULL THEN pow(greatest(z - innov, 0), 2) END, 4) AS resid, round(innov, 4) AS innov
FROM innovations"""


ORACLE: dict[str, str] = {
    "rename_keys": _q(
        RAW, f"SELECT CAST(week_end_date AS DATE) AS week_end_date, {K}, units, feature FROM raw"
    ),
    "format_transactions": _q(
        RAW,
        """SELECT CAST(date_trunc('week', week_end_date) AS DATE) AS week,
  CAST(week_end_date AS DATE) AS week_end_date, CAST(store_id AS VARCHAR) AS store_id,
  CAST(upc_id AS VARCHAR) AS upc_id, units, feature FROM raw""",
    ),
    "store_merge_duplicates": _q(STORE, "SELECT * FROM merged"),
    "store_choices": _q(STORE, "SELECT store_id FROM merged ORDER BY store_id"),
    "product_size_units": _sizes(True),
    "product_size_no_counts": _sizes(False),
    "weekly_panel": _q(PANEL, f"SELECT {COLUMNS} FROM panel"),
    "panel_key_check": _q(
        LINES,
        f"SELECT {K}, week, count(*) AS n FROM lines GROUP BY {K}, week HAVING count(*) > 1",
    ),
    "fill_gaps": _q(GAPS, f"SELECT {COLUMNS} FROM gaps"),
    "missing_transactions": _q(GAPS, f"SELECT {COLUMNS}, n_na FROM gaps"),
    "missingness": _q(RATIO, f"SELECT {K}, n_na, round(missingness, 6) AS missingness FROM ratio"),
    "series_min_obs": _q(PANEL + "," + LONG, f"SELECT {COLUMNS} FROM long"),
    "filter_series": _q(FILLED, f"SELECT {COLUMNS} FROM filled"),
    "sample_series": _q(
        SAMPLE, f"SELECT {K}, category, round(missingness, 6) AS missingness FROM picked"
    ),
    "sampled_transactions": _q(
        SAMPLE,
        f"""SELECT {COLUMNS}, n_na, category, round(missingness, 6) AS missingness
  FROM picked JOIN gaps USING ({K})""",
    ),
    "incomplete_series": _q(
        FILLED,
        f"""SELECT {COLUMNS} FROM filled
  QUALIFY count(*) FILTER (WHERE units IS NULL) OVER (PARTITION BY {K}) > 0""",
    ),
    "impute_model": _q(IMPUTED, f"SELECT {COLUMNS.replace('units', 'round(units, 4) AS units', 1)} FROM imputed"),
    "fit_arima": _fits({"arima": ((), None)}, ()),
    "fit_incremental": _fits({"arima": ((), None)}, ()),
    "fit_dynamic_regression": _fits({m: REGRESSIONS[m] for m in ("arima_base", "arima_lagged")}, FLAGS + LAGGED, True),
    "fit_seasonal_regression": _fits({m: REGRESSIONS[m] for m in ("arima_seasonal", "arima_seasonal_lagged")}, FLAGS + LAGGED + FOURIER),
    "smoothing_forms": _forms(),
    "fit_stl_ets": "WITH RECURSIVE "
    + CARRIED
    + ", ready AS (SELECT *, sqrt(units) AS z FROM carried),"
    + _smoothing("ready")
    + f""" SELECT o.store_id, o.upc_id, 'stl' AS model, CASE WHEN m.f IS NULL THEN 'not fitted' ELSE 'ok' END AS status,
  CASE WHEN m.f IS NOT NULL THEN CAST(o.n AS INTEGER) END AS n_obs, round(a, 4) AS alpha, round(g, 4) AS slope_gain, f AS damping,
  {_r("level, sigma2").replace("round(level", "round(m.level")} FROM opening o LEFT JOIN smoothed m USING ({K})""",
    "train_models": "WITH RECURSIVE "
    + TRAINED
    + ","
    + _smoothing("ready")
    + f""" SELECT s.store_id, s.upc_id, 'arima' AS model, CASE WHEN p IS NULL THEN 'not fitted' ELSE 'ok' END AS status,
  CASE WHEN p IS NOT NULL THEN CAST(n AS INTEGER) END AS n_obs, p, d, CASE WHEN p IS NOT NULL THEN 0 END AS q, {_r("sigma2, aicc")}
  FROM (SELECT {K}, count(units) AS n FROM filled GROUP BY {K}) s LEFT JOIN chosen USING ({K})
  UNION ALL SELECT c.store_id, c.upc_id, 'stl', CASE WHEN m.f IS NULL THEN 'not fitted' ELSE 'ok' END, CAST(m.n AS INTEGER), NULL, NULL, NULL,
  round(m.sigma2, 4), round(m.aicc, 4) FROM chosen c LEFT JOIN smoothed m USING ({K})""",
    "residuals": "WITH RECURSIVE " + TRAINED + "," + _smoothing("ready") + "," + seasonal.one_ahead() + "," + _RESIDUALS,
    "forecast_holdout": "WITH RECURSIVE " + HELD_OUT + f" SELECT {K}, model, week, {_r(BANDS)} FROM forecasts",
    "forecast_stl": "WITH RECURSIVE "
    + TRAINED
    + ","
    + _smoothing("ready")
    + f""",
next_ AS (SELECT {K}, CAST(m.last + 7 * h AS DATE) AS week, h FROM smoothed m JOIN chosen USING ({K}) CROSS JOIN (VALUES (1), (2)) AS t(h)),
points AS ({seasonal.smoothing_points("next_")})
SELECT {K}, model, week, {_r(BANDS)} FROM (SELECT {K}, model, week, {_bands('mu', 'sigma')} FROM points)""",
    "validation_rmse": "WITH RECURSIVE " + FINAL_RMSE + f" SELECT {K}, {_r('arima_lagged, stl')} FROM finals",
    "validation_leaderboard": "WITH RECURSIVE "
    + FINAL_RMSE
    + ","
    + _best("finals", ("arima_lagged", "stl"), "mean_rmse")
    + """ SELECT best_model, round(median(mean_rmse), 4) AS median_rmse, count(*) AS n_best_model
  FROM best GROUP BY best_model ORDER BY n_best_model DESC""",
    "validation_aicc": "WITH RECURSIVE "
    + VALIDATED
    + f" SELECT {K}, {', '.join(f'round(max(aicc) FILTER (model = {m!r}), 4) AS {m}' for m in REGRESSIONS)}"
    f" FROM (SELECT DISTINCT {K} FROM sample_train) LEFT JOIN reg USING ({K}) GROUP BY {K}",
    "forecast_scenarios": "WITH RECURSIVE "
    + TRAINED
    + SCENARIO_PATHS
    + f" SELECT {K}, model, fc_ind, week, feature, display, tpr_only, {_r(BANDS)}"
    f" FROM (SELECT {K}, model, fc_ind, week, feature, display, tpr_only, {_bands('mu', 'sigma')} FROM paths)",
    "locf_impute": _q(CARRIED, f"SELECT {COLUMNS} FROM carried"),
    "calendar_split": _q(
        GAPS,
        f"""SELECT week, {K}, units, CASE WHEN week <= date_trunc('week',
    max(week) OVER (PARTITION BY {K}) - INTERVAL 1 MONTH) THEN 'train' ELSE 'val' END AS split
  FROM gaps""",
    ),
    "holdout_split": _q(
        NUMBERED,
        f"""SELECT week, {K}, units, CASE WHEN back > 4 THEN 'train' ELSE 'test' END AS split
  FROM numbered WHERE size > 4""",
    ),
    "train_rows": _q(NUMBERED, f"SELECT {COLUMNS} FROM numbered WHERE back > 4"),
    "holdout_from_join": _q(NUMBERED, f"SELECT {COLUMNS} FROM numbered WHERE back <= 4 AND size > 4"),
    "union_full_panel": _q(FILLED, f"SELECT {COLUMNS} FROM filled"),
    "future_rows": _q(
        PANEL,
        f"""SELECT CAST(last + 7 * h AS DATE) AS week, {K}, h FROM
  (SELECT {K}, max(week) AS last, unnest([1, 2]) AS h FROM panel GROUP BY {K})""",
    ),
    "scenario_grid": _q(
        PANEL,
        f"""SELECT CAST(last + 7 * h AS DATE) AS week, {K}, h, feature, display, tpr_only, fc_ind FROM
  (SELECT {K}, max(week) AS last, unnest([1, 2]) AS h FROM panel GROUP BY {K})
  CROSS JOIN (VALUES (0, 0, 0, 1), (1, 0, 0, 2), (0, 1, 0, 3), (0, 0, 1, 4), (1, 1, 0, 5))
    AS t(feature, display, tpr_only, fc_ind)""",
    ),
    "recent_history": _q(NUMBERED, f"SELECT {COLUMNS} FROM numbered WHERE back <= 10"),
    "lag_features": _q(
        FILLED,
        f"SELECT week, {K}, {', '.join(f'coalesce({f}, 0) AS {f}' for f in FLAGS)}, "
        + ", ".join(
            f"lag(coalesce({f}, 0)) OVER (PARTITION BY {K} ORDER BY week) AS lag_{f}"
            for f in FLAGS
        )
        + " FROM filled",
    ),
    "fourier_features": _q(FILLED, _fourier()),
    "transactions_products": _q(
        PANEL + "," + PRODUCTS,
        f"SELECT {COLUMNS}, category FROM panel LEFT JOIN products USING (upc_id)",
    ),
    "category_weekly": _q(
        CATEGORY,
        "SELECT week, category, round(units, 2) AS units, visits, round(round(base_price, 8), 2) AS"
        " base_price, feature, display, tpr_only FROM weekly",
    ),
    "column_summary": _q(PANEL, _column_summary()),
    "text_summary": _text_summary(),
    "date_summary": _q(
        PANEL,
        """SELECT 'week' AS "column", count(*) FILTER (WHERE week IS NULL) AS n_missing,
  count(DISTINCT week) AS n_unique, min(week) AS min_date, max(week) AS max_date FROM panel""",
    ),
    "price_range": _q(
        PANEL,
        """SELECT upc_id, round(min(price), 4) AS min, round(max(price), 4) AS max,
  round(round(avg(price), 8), 4) AS mean,
  round(round(stddev_samp(price), 8), 4) AS sd FROM panel GROUP BY upc_id""",
    ),
    "outlier_flags": _q(PANEL + "," + _fences("panel"), "SELECT * FROM flags"),
    "outlier_counts": _q(PANEL + "," + _fences("panel"), _counts(False)),
    "outlier_counts_strict": _q(FILLED + "," + _fences("filled"), _counts(True)),
    "product_long": _q(
        CATEGORY, _longer("weekly", {c: c for c in ("units", "base_price", *FLAGS)}, 2)
    ),
    "promo_long": _q(
        CATEGORY,
        _longer("weekly", {"units_visits": "units / visits", **{f: f for f in FLAGS}}, 4),
    ),
    "promo_long_one_category": _q(
        CATEGORY + ", one AS (SELECT * FROM weekly WHERE category = 'CAT1')",
        _longer("one", {"units_visits": "units / visits", **{f: f for f in FLAGS}}, 4),
    ),
    "pair_corr": _q(CATEGORY, _corr("weekly", NUMBERS, "category")),
    "pair_corr_overall": _q(PANEL, _corr("panel", MEASURES)),
    "pair_corr_by_flag": _q(LEVELS, _corr("levels", NUMBERS, "category, flag, level")),
    "group_five_number": _q(LEVELS, FIVE),
    "flag_crosstab": _q(CATEGORY, CROSSTAB),
    "ols_one_regressor": _q(
        PANEL,
        f"""SELECT {K}, CAST(regr_count(sqrt(units), feature) AS BIGINT) AS n_obs,
  round(regr_slope(sqrt(units), feature), 4) AS slope,
  round(regr_intercept(sqrt(units), feature), 4) AS intercept FROM panel GROUP BY {K}""",
    ),
    "ols_moments_one_regressor": _q(
        PANEL,
        f"""SELECT {K}, count(*) AS n_obs,
  round(regr_intercept(sqrt(units), visits), 4) AS intercept,
  round(regr_slope(sqrt(units), visits), 4) AS b_visits FROM panel GROUP BY {K}""",
    ),
    "ses_fixed_alpha": "WITH RECURSIVE "
    + _smooth("[CAST(0.3 AS DOUBLE)]")
    + f" SELECT {K}, CAST(i AS INTEGER) AS n_obs, round(level, 4) AS level, round(sse, 4) AS sse"
    " FROM final",
    "ses_best_alpha": "WITH RECURSIVE "
    + _smooth("[" + ", ".join(f"CAST({0.05 * i:.2f} AS DOUBLE)" for i in range(1, 20)) + "]")
    + f""" SELECT {K}, CAST(i AS INTEGER) AS n_obs, alpha, round(level, 4) AS level,
  round(sse, 4) AS sse FROM final
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY sse, alpha) = 1""",
    "interval_bounds": _q(STANDIN, f"SELECT {K}, model, week, {_r(BANDS)} FROM fc"),
    "forecast_fixed_fits": _q(
        FIXED
        + f""",
test_rows AS (
  SELECT {K}, week, row_number() OVER w AS h, coalesce(feature, 0) AS feature,
         coalesce(display, 0) AS display, coalesce(tpr_only, 0) AS tpr_only,
         lag(coalesce(feature, 0)) OVER w AS prev
  FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY week DESC) AS back,
               count(*) OVER (PARTITION BY {K}) AS size FROM filled)
  WHERE back <= 4 AND size > 4 WINDOW w AS (PARTITION BY {K} ORDER BY week)),"""
        + _fixed_dist("test_rows")
        + ","
        + SMOOTH_DIST,
        f"""SELECT {K}, model, week, {_r('mu, sigma')} FROM dist
  UNION ALL SELECT {K}, model, week, {_r('mu, sigma')} FROM smooth_dist""",
    ),
    "scenarios_fixed_fits": _q(
        FIXED + "," + SCENARIO_ROWS + "," + _fixed_dist("rows_"),
        f"""SELECT {K}, model, fc_ind, week, feature, display, tpr_only, {_r(BANDS)}
  FROM (SELECT *, {_bands()} FROM dist)""",
    ),
    "forecast_ahead_smoothing": _q(
        FIXED + "," + SMOOTH_DIST,
        f"""SELECT {K}, model, week, {_r(BANDS)}
  FROM (SELECT *, {_bands()} FROM smooth_dist)""",
    ),
    "ols_flags": _q(
        PANEL
        + f""",
base AS (SELECT {K}, sqrt(units) AS y, feature AS f, display AS d, tpr_only AS t FROM panel),"""
        + _ols_flags(),
        f"""SELECT {K}, n_obs, round(y_mean - b_f * f_mean - b_d * d_mean - b_t * t_mean, 4)
    AS intercept, round(b_f, 4) AS b_feature, round(b_d, 4) AS b_display,
    round(b_t, 4) AS b_tpr_only FROM solved""",
    ),
    "missingness_by_span": _q(
        RATIO, f"SELECT {K}, n_na, round(missingness, 6) AS missingness FROM ratio"
    ),
    "rmse_by_series_model": _q(SCORED, f"SELECT {K}, {_r('arima, stl')} FROM wide"),
    "rmse_strict": _q(SCORED, f"SELECT {K}, model, round(strict_rmse, 4) AS rmse FROM rmse"),
    "rmse_leaderboard": _q(
        SCORED + "," + _best("wide", ("arima", "stl"), "mean_rmse"),
        """SELECT best_model, round(median(mean_rmse), 4) AS median_rmse, count(*) AS n_best_model
  FROM best GROUP BY best_model ORDER BY n_best_model DESC""",
    ),
    "leaderboard_merged": _q(
        SCORED + "," + _best("wide", ("arima", "stl"), "mean_rmse"),
        """SELECT best_model, round(median(round(mean_rmse, 4)), 4) AS median_rmse, count(*) AS n_best_model
  FROM best GROUP BY best_model ORDER BY n_best_model DESC""",
    ),
    "units_histogram_by_store": _q(PANEL + ",", _histogram("panel", "units", "store_id, upc_id")),
    "best_model_per_series": _q(
        SCORES + "," + _best("scores", MODELS, "mean_aicc"),
        f"SELECT {K}, round(mean_aicc, 4) AS mean_aicc, best_model FROM best",
    ),
    "aicc_leaderboard": _q(
        SCORES + "," + _best("scores", MODELS, "mean_aicc"),
        """SELECT best_model, round(avg(mean_aicc), 4) AS mean_aicc, count(*) AS n_best_model
  FROM best GROUP BY best_model""",
    ),
    "model_fallback": _q(
        SCORES,
        f"""SELECT {K}, 'arima' AS model, round(coalesce(arima_seasonal, arima_base), 4) AS aicc,
  CASE WHEN arima_seasonal IS NOT NULL THEN 'arima_seasonal' ELSE 'arima_base' END AS chosen
  FROM scores WHERE coalesce(arima_seasonal, arima_base) IS NOT NULL""",
    ),
    "model_bind": _q(
        SCORES,
        f"""SELECT {K}, {_r('arima_seasonal, arima_base')} FROM scores
  WHERE arima_seasonal IS NOT NULL AND arima_base < arima_lagged""",
    ),
    "residual_acf": _q(
        INNOV
        + f""",
centred AS (SELECT {K}, model, row_number() OVER s AS i,
              coalesce(innov - avg(innov) OVER g, 0) AS z
            FROM innov WINDOW g AS (PARTITION BY {K}, model),
              s AS (PARTITION BY {K}, model ORDER BY week)),
power AS (SELECT {K}, model, sum(z * z) AS power FROM centred GROUP BY {K}, model),
lagged AS (SELECT a.store_id, a.upc_id, a.model, a.i - b.i AS lag, sum(a.z * b.z) AS product
           FROM centred a JOIN centred b ON a.store_id = b.store_id AND a.upc_id = b.upc_id
             AND a.model = b.model AND a.i - b.i BETWEEN 1 AND 55 GROUP BY ALL)""",
        f"""SELECT {K}, model, CAST(lag AS INTEGER) AS lag,
  round(product / nullif(power, 0), 4) AS acf FROM lagged JOIN power USING ({K}, model)""",
    ),
    "residual_histogram": _q(INNOV + ",", _histogram("innov", "innov", "model")),
    "units_histogram": _q(PANEL + ",", _histogram("panel", "units")),
    "store_products": _q(PANEL, f"SELECT DISTINCT {K} FROM panel ORDER BY {K}"),
    "series_history": _q(
        FILLED, f"SELECT {COLUMNS} FROM filled WHERE store_id = '1' AND upc_id = 'Brand#7'"
    ),
    "holdout_view": _q(
        STANDIN,
        f"""SELECT {K}, week, 'HISTORY' AS line, round(units, 4) AS value, NULL::DOUBLE AS low80,
  NULL::DOUBLE AS up80, NULL::DOUBLE AS low95, NULL::DOUBLE AS up95 FROM filled
  UNION ALL SELECT {K}, week, upper(model), {_r(BANDS)} FROM fc""",
    ),
    "series_rmse": _q(
        SCORED, f'SELECT {K}, round(arima, 4) AS "ARIMA", round(stl, 4) AS "STL" FROM wide'
    ),
    "residuals_fixed_fits": _q(
        FILLED
        + f""",
known AS (SELECT {K}, week, units, sqrt(last_value(units IGNORE NULLS) OVER
            (PARTITION BY {K} ORDER BY week ROWS UNBOUNDED PRECEDING)) AS root FROM filled),
fits AS (SELECT *, lag(root) OVER (PARTITION BY {K} ORDER BY week) AS fit FROM known)""",
        f"""SELECT {K}, 'walk' AS model, week, round(units, 4) AS units, round(pow(fit, 2), 4) AS fitted,
  round(units - pow(fit, 2), 4) AS resid, round(sqrt(units) - fit, 4) AS innov FROM fits""",
    ),
    "aicc_fixed_fits": _q(SCORES, f"SELECT {K}, {_r(MODELS)} FROM scores"),
    "scenario_lookup": _scenario_view(True),
    "scenario_lookup_invalid": _scenario_view(False),
}
