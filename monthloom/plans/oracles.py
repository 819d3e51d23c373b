"""The same results in plain SQL, for DuckDB over the same tables.

Where a Spark operator uses a rewritten form, the SQL uses the direct one: breaks are
adjusted one after the other, the trend filter is solved by recursive substitution,
the component by power iteration, and rolling training sets by a range join.
"""

from __future__ import annotations

import math

from monthloom import params
from monthloom.plans import inputs
from monthloom.plans.catalogue import GRID_STARTUP, GRID_WARMUP, PANEL_FEATURES, REGIONS, SHORT_AR
from monthloom.operators import tuning

W = inputs.WINDOW


def r(expr: str, places: int) -> str:
    return f"floor(({expr}) * 1e{places} + 0.5) / 1e{places}"


def _cols(names: list[str], places: int) -> str:
    return ", ".join(f'{r(f"{n}", places)} AS {n}' for n in names)


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ord(col: str) -> str:
    return f"(year({col}) * 12 + month({col}))"


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c for c in ctes)


# ------------------------------------------------------------------ base tables

SHIPMENTS = """shipments AS (
  SELECT n_name AS nation, r_name AS region, p_type, p_brand, p_size,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""


def feat(grain: str, feature: str = "p_type") -> str:
    return f"""{SHIPMENTS},
feat AS (
  SELECT {grain} AS entity, {feature} AS feature,
         CASE WHEN p_type IN ({_list(inputs.TOPIC_TYPES)}) THEN 'topic' ELSE 'category' END AS kind,
         month, CAST(sum(cents) AS DOUBLE) / 1e2 AS value
  FROM shipments GROUP BY ALL)"""


CALENDAR = """cal AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT min(month) AS lo, max(month) AS hi FROM feat)),
skel AS (
  SELECT entity, feature, kind, cal.month
  FROM (SELECT DISTINCT entity, feature, kind FROM feat), cal)"""

FILLED = """filled AS (
  SELECT s.entity, s.feature, s.kind, s.month, coalesce(f.value, 0) AS value
  FROM skel s LEFT JOIN feat f USING (entity, feature, kind, month))"""

_NAMED_FILES = """files AS (
  SELECT DISTINCT CAST(l_partkey * 10 AS VARCHAR) AS series_id, n_name AS entity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cat AS (
  SELECT CAST(p_partkey * 10 AS VARCHAR) AS series_id,
         (CASE WHEN p_partkey * 10 >= 10000 THEN 't_' ELSE '' END)
         || replace(p_name, ' ', '_') || '_' || CAST(p_size AS VARCHAR) AS name
  FROM part),
named AS (
  SELECT f.series_id, f.entity,
         coalesce(c.name, (CASE WHEN CAST(f.series_id AS BIGINT) >= 10000 THEN 't_' ELSE 'cat_' END)
                          || f.series_id) AS feature
  FROM files f LEFT JOIN cat c USING (series_id))"""


_FILES = f"""WITH {SHIPMENTS},
sums AS (SELECT nation, p_type, month, sum(cents) AS c FROM shipments GROUP BY ALL),
cells AS (
  SELECT nation || '/' || p_type AS path, month,
         CASE WHEN nation = '{inputs.WORDS_ONLY}' OR c % 10 IN (1, 2) THEN NULL WHEN c % 10 = 0 THEN 0.5
              ELSE CAST(CAST(c AS DOUBLE) / 100 AS DECIMAL(20, 2))::DOUBLE END AS value
  FROM sums, range(CASE WHEN nation = '{inputs.REPEATING}' AND month(month) = 1 THEN 2 ELSE 1 END))"""

_RATE_ROWS = f"""WITH prates AS (
  SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS entity,
         CASE WHEN o_orderkey % 10 <> 1 THEN CAST(last_day(o_orderdate) AS DATE) END AS month,
         CASE WHEN o_orderkey % 10 <> 2
              THEN CAST(floor(o_totalprice * 100 + 0.5) / 100 AS DECIMAL(20, 2))::DOUBLE END AS level
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ---------------------------------------------------------------------- breaks


def _break_means(source: str) -> str:
    rows = [("category", d) for d in inputs.BREAKS.category]
    rows += [("topic", d) for d in inputs.BREAKS.topic]
    values = ", ".join(f"('{k}', DATE '{d}')" for k, d in rows)
    return f"""brk(kind, break_date) AS (VALUES {values}),
means AS (
  SELECT s.entity, s.feature, s.kind, b.break_date,
         avg(s.value) FILTER (WHERE s.month < b.break_date
             AND s.month >= b.break_date - INTERVAL 12 MONTH) AS mean_before,
         avg(s.value) FILTER (WHERE s.month >= b.break_date
             AND s.month < b.break_date + INTERVAL 12 MONTH) AS mean_after
  FROM {source} s JOIN brk b USING (kind) GROUP BY ALL)"""


def adjusted() -> str:
    """One CTE pair per break date, each on the result of the one before."""
    days = sorted(set(inputs.BREAKS.category) | set(inputs.BREAKS.topic))
    parts, source = [], "filled"
    for i, day in enumerate(days):
        kinds = [
            k
            for k, ds in (("category", inputs.BREAKS.category), ("topic", inputs.BREAKS.topic))
            if day in ds
        ]
        parts.append(f"""m{i} AS (
  SELECT entity, feature,
         min(month) AS lo, max(month) AS hi,
         avg(value) FILTER (WHERE month < DATE '{day}'
             AND month >= DATE '{day}' - INTERVAL 12 MONTH) AS b,
         avg(value) FILTER (WHERE month >= DATE '{day}'
             AND month < DATE '{day}' + INTERVAL 12 MONTH) AS a
  FROM {source} WHERE kind IN ({_list(kinds)}) GROUP BY ALL),
a{i} AS (
  SELECT s.entity, s.feature, s.kind, s.month,
         CASE WHEN s.month >= DATE '{day}' AND DATE '{day}' BETWEEN m.lo AND m.hi
                   AND m.b IS NOT NULL AND m.a >= 1e-6 AND abs(m.b / m.a - 1) >= 1e-2
              THEN s.value * (m.b / m.a) ELSE s.value END AS value
  FROM {source} s LEFT JOIN m{i} m USING (entity, feature))""")
        source = f"a{i}"
    parts.append(f"adj AS (SELECT * FROM {source})")
    return ",\n".join(parts)


# ---------------------------------------------------------------- trend removal

_SHIFTED = """shifted AS (
  SELECT entity, feature, kind, month,
         CASE WHEN low < 1 THEN value + (1 - low) ELSE value END AS value, low <> high AS varying
  FROM (SELECT *, min(value) OVER s AS low, max(value) OVER s AS high
        FROM {source} WINDOW s AS (PARTITION BY entity, feature)))"""

_HP = f"""ys AS MATERIALIZED (
  SELECT entity, feature, kind, month, value, ln(value) AS y,
         CAST(row_number() OVER (PARTITION BY entity, feature ORDER BY month) - 1 AS INTEGER) AS i
  FROM shifted WHERE varying),
size AS (SELECT max(i) + 1 AS n FROM ys),
coef AS MATERIALIZED (
  SELECT i,
         1 + {params.HP_LAMBDA} * ((i <= n - 3)::INT + 4 * (i >= 1 AND i <= n - 2)::INT + (i >= 2)::INT) AS d,
         -2 * {params.HP_LAMBDA} * ((i <= n - 3)::INT + (i >= 1 AND i <= n - 2)::INT) AS e,
         {params.HP_LAMBDA} * (i <= n - 3)::INT AS f
  FROM (SELECT CAST(unnest(range(n)) AS INTEGER) AS i, n FROM size)),
fac AS (
  SELECT i, CAST(d AS DOUBLE) AS p, CAST(e AS DOUBLE) / d AS l1, CAST(f AS DOUBLE) / d AS l2,
         CAST(0 AS DOUBLE) AS pp, CAST(0 AS DOUBLE) AS pl2
  FROM coef WHERE i = 0
  UNION ALL
  SELECT i, p, (e - b1 * b2 * bp) / p, f / p, bp, b2
  FROM (SELECT c.i, c.e, c.f, k.l1 AS b1, k.l2 AS b2, k.p AS bp,
               c.d - k.l1 * k.l1 * k.p - k.pl2 * k.pl2 * k.pp AS p
        FROM fac k JOIN coef c ON c.i = k.i + 1)),
facs AS MATERIALIZED (SELECT * FROM fac),
fwd AS (
  SELECT entity, feature, i, y AS z, CAST(0 AS DOUBLE) AS z1 FROM ys WHERE i = 0
  UNION ALL
  SELECT y.entity, y.feature, y.i,
         y.y - k.l1 * w.z - coalesce(k2.l2, 0) * w.z1, w.z
  FROM fwd w JOIN ys y ON y.entity = w.entity AND y.feature = w.feature AND y.i = w.i + 1
  JOIN facs k ON k.i = w.i LEFT JOIN facs k2 ON k2.i = w.i - 1),
fwds AS MATERIALIZED (SELECT w.*, w.z / k.p AS u FROM fwd w JOIN facs k USING (i)),
bwd AS (
  SELECT entity, feature, i, u AS x, CAST(0 AS DOUBLE) AS x1
  FROM fwds WHERE i = (SELECT n - 1 FROM size)
  UNION ALL
  SELECT w.entity, w.feature, w.i, w.u - k.l1 * b.x - k.l2 * b.x1, b.x
  FROM bwd b JOIN fwds w ON w.entity = b.entity AND w.feature = b.feature AND w.i = b.i - 1
  JOIN facs k ON k.i = w.i),
hp AS MATERIALIZED (
  SELECT y.entity, y.feature, y.kind, y.month, y.i, y.value, y.y AS logs, b.x AS trend
  FROM bwd b JOIN ys y USING (entity, feature, i)),
std AS MATERIALIZED (
  SELECT *, (trend - avg(trend) OVER s)
            / (CASE WHEN stddev_pop(trend) OVER s = 0 THEN 1 ELSE stddev_pop(trend) OVER s END) AS score
  FROM hp WINDOW s AS (PARTITION BY entity, feature))"""

_PC1 = """cells AS (
  SELECT a.entity, a.feature AS f, b.feature AS g, avg(a.score * b.score) AS c
  FROM std a JOIN std b ON a.entity = b.entity AND a.i = b.i GROUP BY ALL),
rws AS (SELECT entity, f, list(c ORDER BY g) AS row_ FROM cells GROUP BY ALL),
mats AS MATERIALIZED (
  SELECT entity, list(row_ ORDER BY f) AS m, list(f ORDER BY f) AS fs FROM rws GROUP BY ALL),
pw AS (
  SELECT entity, m, fs, 0 AS k,
         list_transform(range(len(fs)), lambda j: 1.0::DOUBLE / (j + 1)) AS v
  FROM mats
  UNION ALL
  SELECT entity, m, fs, k + 1,
         list_transform(w, lambda x: x / sqrt(list_inner_product(w, w)))
  FROM (SELECT entity, m, fs, k, list_transform(m, lambda q: list_inner_product(q, v)) AS w
        FROM pw WHERE k < 300)),
vecs AS (SELECT entity, unnest(fs) AS feature, unnest(v) AS loading FROM pw WHERE k = 300),
ori AS (
  SELECT entity, sign(arg_max(loading, abs(loading))) AS sgn FROM vecs GROUP BY entity),
pcs AS MATERIALIZED (
  SELECT s.entity, s.month, sum(s.score * v.loading) * any_value(o.sgn) AS pc1, avg(s.trend) AS mean_trend
  FROM std s JOIN vecs v USING (entity, feature) JOIN ori o USING (entity)
  GROUP BY s.entity, s.month),
pcr AS MATERIALIZED (
  SELECT entity, month, pc1,
         CASE WHEN stddev_samp(pc1) OVER e < 1e-6 THEN 0
              ELSE (pc1 - avg(pc1) OVER e) / stddev_samp(pc1) OVER e
                   * stddev_samp(mean_trend) OVER e END AS pc1_rescaled
  FROM pcs WINDOW e AS (PARTITION BY entity))"""

_DETRENDED = """detr AS (
  SELECT entity, feature, kind, month,
         CASE WHEN varying AND flat IS NOT NULL
              THEN flat * coalesce(avg(value) OVER s / nullif(avg(flat) OVER s, 0), 1)
              ELSE value END AS value
  FROM (SELECT s.*, CASE WHEN s.varying THEN exp(ln(s.value) - p.pc1_rescaled) END AS flat
        FROM shifted s LEFT JOIN pcr p USING (entity, month))
  WINDOW s AS (PARTITION BY entity, feature))"""

_CHAIN_HP = _with(
    feat("region"), CALENDAR, FILLED, adjusted(), _SHIFTED.format(source="adj"), _HP, recursive=True
)
_CHAIN_PC1 = f"{_CHAIN_HP},\n{_PC1}"
_CHAIN_DETRENDED = f"{_CHAIN_PC1},\n{_DETRENDED}"


def _logs(source: str, scale: str = "") -> str:
    return f"""logs AS (
  SELECT entity, feature, kind, month,
         CASE WHEN kind = 'topic' THEN y
              ELSE y - lag(y, 12) OVER (PARTITION BY entity, feature ORDER BY month) END AS value
  FROM (SELECT *, ln(greatest(value{scale}, 1e-6)) AS y FROM {source}))"""


# ------------------------------------------------------------------ panel, rates

_WIDE = ",\n         ".join(
    f"max(value) FILTER (WHERE feature = '{f}') AS {f}" for f in PANEL_FEATURES
)
_DUMMY = ", ".join(
    f"""CAST(entity = '{e}' AS BIGINT) AS "C_{e}\""""
    for e in REGIONS
    if e != inputs.REFERENCE_REGION
)
_PANEL = f"""panel AS (
  SELECT entity, last_day(month) AS month, {_WIDE}
  FROM logs GROUP BY ALL HAVING count(value) = {len(PANEL_FEATURES)})"""


#: The modelling panel with the faults that the rule counts look for.
_FAULTY = """faulty AS (
  SELECT * REPLACE (
    CASE WHEN entity = 'AFRICA' AND month(month) = 9 THEN NULL ELSE month END AS month,
    CASE WHEN entity = 'ASIA' AND month(month) = 3 THEN 'nan'::DOUBLE ELSE ECONOMY END AS ECONOMY,
    CASE WHEN entity = 'EUROPE' AND month(month) = 7 THEN NULL ELSE target END AS target)
  FROM (SELECT * FROM changes
        UNION ALL SELECT * FROM changes WHERE entity = 'AMERICA' AND month(month) = 12))"""
_REPEATED = "(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM faulty GROUP BY entity, month))"


_GRAIN = {"nation": "n_name", "region": "r_name", "customer": "'CUSTOMER_' || c_custkey"}


def rates(grain: str) -> str:
    return f"""rates AS (
  SELECT {_GRAIN[grain]} AS entity, CAST(last_day(o_orderdate) AS DATE) AS month,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS level
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


_KEYS = """keys AS (
  SELECT entity, last_day(month) AS month
  FROM (SELECT DISTINCT entity FROM rates),
       (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT date_trunc('month', min(month)) AS lo, date_trunc('month', max(month)) AS hi FROM rates))),
joined AS (SELECT k.entity, k.month, r.level FROM keys k LEFT JOIN rates r USING (entity, month))"""


def _interp(source: str, extra: str = "") -> str:
    return f"""nb AS (
  SELECT *, lag(level) OVER e AS pl, lead(level) OVER e AS nl,
         {_ord('month')} - lag({_ord('month')}) OVER e AS pd,
         lead({_ord('month')}) OVER e - {_ord('month')} AS nd
  FROM {source} WINDOW e AS (PARTITION BY entity ORDER BY month)),
interp AS (
  SELECT entity, month{extra},
         coalesce(level IS NULL AND pl IS NOT NULL AND nl IS NOT NULL AND pd = 1 AND nd = 1, false) AS imputed,
         CASE WHEN level IS NULL AND pd = 1 AND nd = 1 THEN (pl + nl) / 2 ELSE level END AS level
  FROM nb),
chg AS (
  SELECT entity, month{extra}, level_lag1, level - level_lag1 AS target
  FROM (SELECT *, CASE WHEN {_ord('month')} - lag({_ord('month')}) OVER e = 1
                       THEN lag(level) OVER e END AS level_lag1
        FROM interp WINDOW e AS (PARTITION BY entity ORDER BY month))),
changes AS (SELECT * FROM chg WHERE target IS NOT NULL AND level_lag1 IS NOT NULL)"""


_CHAIN_RATES = _with(rates("nation"), _KEYS, _interp("joined"))
_CHAIN_CUSTOMERS = _with(rates("customer"), _KEYS, _interp("joined"))


def _lagged(count: int) -> str:
    cols = ",\n         ".join(
        f"CASE WHEN {_ord('month')} - lag({_ord('month')}, {k}) OVER e = {k} "
        f"THEN lag(target, {k}) OVER e END AS target_lag{k}"
        for k in range(1, count + 1)
    )
    return f"""lagged AS (
  SELECT *, {cols}
  FROM changes WINDOW e AS (PARTITION BY entity ORDER BY month))"""


_AXIS = f"""axis AS MATERIALIZED (
  SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx
  FROM (SELECT DISTINCT month FROM changes)),
splits AS MATERIALIZED (
  SELECT t.idx AS test_idx, t.month AS test_month, a.month AS train_start, b.month AS train_end
  FROM axis t JOIN axis a ON a.idx = t.idx - {W} JOIN axis b ON b.idx = t.idx - 1),
rws AS MATERIALIZED (SELECT l.*, axis.idx FROM lagged l JOIN axis USING (month))"""


def fixed_effects(name: str, train: str, test: str, keys: list[str], reference: str) -> str:
    """Per split: moments by entity, pooled slope, anchor for unseen entities."""
    k = ", ".join(keys)
    return f"""{name}_m AS MATERIALIZED (
  SELECT {k}, entity, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy
  FROM {train} GROUP BY ALL),
{name}_a AS (
  SELECT {k}, sum(sxx) AS sxx, sum(sxy) AS sxy,
         coalesce(max(mx) FILTER (WHERE entity = '{reference}'), avg(mx)) AS ax,
         coalesce(max(my) FILTER (WHERE entity = '{reference}'), avg(my)) AS ay,
         bool_or(entity = '{reference}') AS has_ref
  FROM {name}_m GROUP BY ALL),
{name}_b AS (
  SELECT {k}, sum((mx - ax) * (my - ay)) / (1 + sum((mx - ax) * (mx - ax))) AS between_slope
  FROM {name}_m JOIN {name}_a USING ({k}) GROUP BY ALL),
{name}_s AS (
  SELECT {k}, ax, ay, has_ref, sxx,
         CASE WHEN sxx > 0 THEN sxy / sxx ELSE between_slope END AS slope
  FROM {name}_a JOIN {name}_b USING ({k})),
{name} AS (
  SELECT t.*, s.slope,
         coalesce(m.my, s.ay) + s.slope * (t.x - coalesce(m.mx, s.ax)) AS prediction,
         m.mx IS NULL OR s.sxx <= 0 OR NOT s.has_ref AS rank_deficient
  FROM {test} t JOIN {name}_s s USING ({k}) LEFT JOIN {name}_m m USING ({k}, entity))"""


def _ar(name: str, regressor: str, reference: str) -> str:
    return f"""{name}_rows AS (
  SELECT idx, month, entity, {regressor} AS x, target AS y FROM rws WHERE {regressor} IS NOT NULL),
{name}_train AS (
  SELECT s.test_idx, r.entity, r.x, r.y
  FROM splits s JOIN {name}_rows r ON r.idx BETWEEN s.test_idx - {W} AND s.test_idx - 1),
{name}_test AS (
  SELECT s.test_idx, s.train_start, s.train_end, r.month, r.entity, r.x, r.y
  FROM splits s JOIN {name}_rows r ON r.idx = s.test_idx),
{fixed_effects(name, f"{name}_train", f"{name}_test", ["test_idx"], reference)}"""


def _prediction_ctes(reference: str) -> str:
    return f"""{_lagged(3)}, {_AXIS}, {_ar("ar1", "level_lag1", reference)},
{_ar("ar2", "target_lag2", reference)},
preds AS MATERIALIZED (
  SELECT r.month, r.entity, 'Random walk' AS model, r.target AS actual, 0.0::DOUBLE AS prediction
  FROM rws r JOIN splits s ON s.test_idx = r.idx
  UNION ALL SELECT month, entity, 'AR(1)', y, prediction FROM ar1
  UNION ALL SELECT month, entity, '{SHORT_AR}', y, prediction FROM ar2)"""


_CHAIN_PREDS = f"{_CHAIN_RATES}, {_prediction_ctes(inputs.REFERENCE_NATION)}"

_COMMON = """common AS MATERIALIZED (
  SELECT * FROM preds WHERE (month, entity) IN (
    SELECT (month, entity) FROM preds GROUP BY month, entity
    HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM preds))),
levels AS MATERIALIZED (
  SELECT p.*, c.level_lag1, c.level_lag1 + p.actual AS actual_level,
         c.level_lag1 + p.prediction AS prediction_level
  FROM common p LEFT JOIN changes c USING (month, entity)),
lm AS (
  SELECT model, sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae,
         avg(abs(actual_level - prediction_level) / actual_level) AS mape, count(*) AS n
  FROM levels GROUP BY model),
ranked AS (SELECT rank() OVER (ORDER BY rmse) AS rank, * FROM lm)"""

_CHAIN_COMMON = f"{_CHAIN_PREDS}, {_COMMON}"

_METRICS = f"""{r('avg(abs(actual - prediction))', 8)} AS mae,
       {r('sqrt(avg((actual - prediction) ** 2))', 8)} AS rmse,
       CASE WHEN count(*) < 2 THEN NULL
            WHEN max(actual) = min(actual)
            THEN CASE WHEN sum((actual - prediction) ** 2) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            ELSE {r('1 - sum((actual - prediction) ** 2) / (var_pop(actual) * count(*))', 8)} END AS r2,
       count(*) AS n"""


# ----------------------------------------------------------------------- tuning


def _design(last: str) -> str:
    return f"""lastidx AS ({last}),
design AS MATERIALIZED (
  SELECT idx, month,
         CASE WHEN idx > l THEN 'holdout' WHEN idx >= l - {inputs.VALIDATION} + 1 THEN 'validation'
              ELSE 'train' END AS role,
         l - {inputs.VALIDATION} + 1 AS max_window
  FROM axis, lastidx)"""


_LAST_EXACT = f"SELECT max(idx) - {inputs.HOLDOUT} AS l FROM axis"
_LAST_BEFORE = "SELECT max(idx) AS l FROM axis WHERE month <= DATE '2000-06-30'"
_CHAIN_AXIS = f"{_CHAIN_RATES}, {_lagged(3)}, {_AXIS}"
_CHAIN_DESIGN = f"{_CHAIN_AXIS}, {_design(_LAST_EXACT)}"


def _uniform(name: str) -> str:
    digest = f"md5(concat_ws(':', '{params.SEED}', CAST(trial AS VARCHAR), '{name}'))"
    return (
        f"(CAST(CAST('0x' || substr({digest}, 1, {tuning.HEX_DIGITS}) AS BIGINT) AS DOUBLE)"
        f" / {float(16**tuning.HEX_DIGITS)!r}::DOUBLE)"
    )


def _draw(spec) -> str:
    u = _uniform(spec.name)
    if isinstance(spec, tuning.Choice):
        options = "[" + ", ".join(str(o) for o in spec.options) + "]"
        return f"CAST(({options})[CAST(floor({u} * {len(spec.options)}) AS BIGINT) + 1] AS BIGINT)"
    if isinstance(spec, tuning.IntRange):
        n = (spec.high - spec.low) // spec.step + 1
        return f"CAST({spec.low} + floor({u} * {n}) * {spec.step} AS BIGINT)"
    if spec.log:
        low, high = math.log(spec.low), math.log(spec.high)
        return r(f"exp({low!r}::DOUBLE + {u} * {high - low!r}::DOUBLE)", 8)
    if spec.step is not None:
        n = round((spec.high - spec.low) / spec.step) + 1
        return r(f"{spec.low!r}::DOUBLE + floor({u} * {n}) * {spec.step!r}::DOUBLE", 8)
    return r(f"{spec.low!r}::DOUBLE + {u} * {spec.high - spec.low!r}::DOUBLE", 8)


_SEARCH = f"""{_CHAIN_DESIGN},
opts AS (
  SELECT list(w ORDER BY w) AS o FROM (VALUES (12), (24), (36), (72)) AS t(w)
  WHERE w <= (SELECT max(max_window) FROM design))
SELECT CAST(trial AS BIGINT) AS trial,
       CAST(o[CAST(floor({_uniform('window_months')} * len(o)) AS BIGINT) + 1] AS BIGINT) AS window_months,
       {_draw(tuning.Choice('target_lags', inputs.LAGS))} AS target_lags,
       {", ".join(f"{_draw(s)} AS {s.name}" for s in tuning.LEAFWISE_SPACE)}
FROM range(50) AS t(trial), opts"""

_TRIAL_VALUES = ", ".join(
    f"({i * len(inputs.LAGS) + j}, {w}, {k})"
    for i, w in enumerate(inputs.WINDOWS)
    for j, k in enumerate(inputs.LAGS)
)

_FOLDS = f"""{_CHAIN_DESIGN},
trials(trial, w, k) AS (VALUES {_TRIAL_VALUES}),
tx AS MATERIALIZED (
  SELECT t.trial, t.w, r.idx, r.entity, r.target AS y,
         CASE t.k WHEN 0 THEN r.level_lag1 WHEN 1 THEN r.target_lag1
                  WHEN 2 THEN r.target_lag2 ELSE r.target_lag3 END AS x
  FROM rws r, trials t),
val AS (SELECT idx FROM design WHERE role = 'validation'),
f_train AS (
  SELECT x.trial, v.idx AS test_idx, x.entity, x.x, x.y
  FROM tx x JOIN val v ON x.idx BETWEEN v.idx - x.w AND v.idx - 1 WHERE x.x IS NOT NULL),
f_test AS (
  SELECT x.trial, v.idx AS test_idx, x.entity, x.x, x.y
  FROM tx x JOIN val v ON x.idx = v.idx WHERE x.x IS NOT NULL),
{fixed_effects("fits", "f_train", "f_test", ["trial", "test_idx"], inputs.REFERENCE_NATION)},
folds AS MATERIALIZED (
  SELECT trial, test_idx - (SELECT min(idx) FROM val) AS step, count(*) AS n,
         sum((y - prediction) ** 2) AS sse
  FROM fits GROUP BY ALL),
curves AS MATERIALIZED (
  SELECT *, sqrt(sum(sse) OVER w / sum(n) OVER w) AS running_rmse FROM folds
  WINDOW w AS (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best_so_far AS MATERIALIZED (
  SELECT *, min(running_rmse) OVER (PARTITION BY trial ORDER BY step) AS best FROM curves)"""

_STOP = f"""{_FOLDS},
replay AS (
  SELECT -1 AS trial, CAST([] AS BIGINT[]) AS done, CAST(NULL AS BIGINT) AS stop
  UNION ALL
  SELECT trial, CASE WHEN stop IS NULL THEN list_append(done, trial) ELSE done END, stop
  FROM (SELECT p.trial + 1 AS trial, p.done,
               CASE WHEN len(p.done) >= {GRID_STARTUP} THEN (
                 SELECT min(b.step) FROM best_so_far b
                 WHERE b.trial = p.trial + 1 AND b.step >= {GRID_WARMUP - 1}
                   AND b.best > (SELECT median(c.running_rmse) FROM curves c
                                 WHERE c.step = b.step AND list_contains(p.done, c.trial))) END AS stop
        FROM replay p WHERE p.trial + 1 <= (SELECT max(trial) FROM trials))),
states AS MATERIALIZED (
  SELECT CAST(0 AS BIGINT) AS study, CAST(p.trial AS BIGINT) AS trial,
         CASE WHEN stop IS NULL THEN 'complete' ELSE 'stopped' END AS state,
         c.step + 1 AS months_evaluated, c.running_rmse AS value
  FROM replay p JOIN curves c ON c.trial = p.trial
       AND c.step = coalesce(p.stop, (SELECT max(step) FROM curves x WHERE x.trial = p.trial)))"""
_CHAIN_STOP = _STOP.replace("WITH ", "WITH RECURSIVE ", 1)


# --------------------------------------------------------------------- the list


def all_oracles() -> dict[str, str]:
    region, nation = feat("region"), feat("nation")
    brands = feat("nation", "p_brand || '_' || p_type")
    chain_panel = f"{_CHAIN_DETRENDED}, {_logs('detr')}, {_PANEL}"
    features_out = _cols(list(PANEL_FEATURES), 5)
    chain_model = (
        f"{chain_panel}, {rates('region')}, "
        f"joined AS (SELECT p.*, r.level FROM panel p LEFT JOIN rates r USING (entity, month)), "
        f"{_interp('joined', ', ' + ', '.join(PANEL_FEATURES))}"
    )
    prediction_out = f"month, entity, model, {_cols(['actual', 'prediction'], 7)}"
    pairs = ["mean_before", "mean_after"]
    audit = ["actual", "prediction", "level_lag1", "actual_level", "prediction_level"]
    return {
        "series_label_exclusions": f"""{_with(_NAMED_FILES)},
lab AS (
  SELECT *, CASE WHEN series_id IN ({_list(inputs.EXCLUDED_SERIES)}) THEN 'series'
                 WHEN entity IN ({_list(inputs.EXCLUDED_ENTITIES)}) THEN 'entity'
                 ELSE 'retained' END AS label
  FROM named)
SELECT label, CASE label WHEN 'series' THEN series_id WHEN 'entity' THEN entity ELSE feature END AS code,
       count(*) AS n_files
FROM lab GROUP BY ALL""",
        "parsed_series": f"""{_FILES}
SELECT path, month, value FROM cells WHERE value IS NOT NULL""",
        "files_without_rows": f"""{_FILES}
SELECT path, count(value) AS n_usable FROM cells GROUP BY path HAVING count(value) = 0""",
        "duplicate_months": f"""{_FILES}
SELECT path, strftime(month, '%Y-%m') AS month, count(*) AS n FROM cells WHERE value IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""",
        "parsed_rates": f"""{_RATE_ROWS}
SELECT * FROM prates""",
        "invalid_rates": f"""{_RATE_ROWS}
SELECT * FROM prates WHERE entity IS NULL OR month IS NULL OR level IS NULL""",
        "duplicate_rate_keys": f"""{_RATE_ROWS}
SELECT month, entity, count(*) AS n FROM prates GROUP BY ALL HAVING count(*) > 1""",
        "entities_without_rates": """SELECT 'CUSTOMER_' || c_custkey AS entity FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
        "customers_without_early_rates": """SELECT 'CUSTOMER_' || c_custkey AS entity FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01')""",
        "duplicate_series": f"""{_with(_NAMED_FILES)}
SELECT entity, feature, count(*) AS n_files, min(series_id) AS first_series_id,
       max(series_id) AS last_series_id
FROM named GROUP BY entity, feature HAVING count(*) > 1""",
        "calendar_skeleton_gaps": f"""{_with(brands, CALENDAR)}
SELECT entity, feature, kind, month FROM skel ANTI JOIN feat USING (entity, feature, kind, month)""",
        "missing_by_series": f"""{_with(brands, CALENDAR)}
SELECT entity, feature, kind, count(*) AS n_missing, min(month) AS first_missing,
       max(month) AS last_missing
FROM skel ANTI JOIN feat USING (entity, feature, kind, month) GROUP BY ALL""",
        "missing_counts": f"""{_with(brands, CALENDAR)}
SELECT entity, feature, kind, count(*) AS n_missing, min(month) AS first_missing,
       max(month) AS last_missing
FROM skel ANTI JOIN feat USING (entity, feature, kind, month)
GROUP BY ALL ORDER BY n_missing DESC, entity, feature LIMIT 10""",
        "feature_coverage": f"""{_with(SHIPMENTS)},
ef AS (SELECT DISTINCT nation AS entity, p_brand || '_' || p_type || '_' || p_size AS feature FROM shipments),
ne AS (SELECT count(DISTINCT entity) AS n FROM ef),
pf AS (SELECT feature, count(*) AS k FROM ef GROUP BY feature)
SELECT entity, count(*) AS n_features, (SELECT count(*) FROM pf) - count(*) AS n_missing,
       count(*) FILTER (WHERE k < (SELECT n FROM ne)) AS n_extra
FROM ef JOIN pf USING (feature) GROUP BY entity""",
        "feature_gaps": f"""{_with(SHIPMENTS)},
ef AS (SELECT DISTINCT nation AS entity, p_brand || '_' || p_type || '_' || p_size AS feature FROM shipments)
SELECT e.entity, f.feature FROM (SELECT DISTINCT entity FROM ef) e, (SELECT DISTINCT feature FROM ef) f
WHERE NOT EXISTS (SELECT 1 FROM ef x WHERE x.entity = e.entity AND x.feature = f.feature)""",
        "break_window_means": f"""{_with(region, _break_means("feat"))}
SELECT entity, feature, kind, break_date, {_cols(pairs, 6)},
       {r('mean_before / mean_after', 8)} AS raw_ratio FROM means""",
        "break_adjusted": f"""{_with(region, CALENDAR, FILLED, adjusted())}
SELECT entity, feature, kind, month, {r('value', 4)} AS value FROM adj""",
        "shift_positive": f"""{_with(nation,
            "scaled AS (SELECT entity, feature, kind, month, value / 1e5 - 2 AS value FROM feat)",
            _SHIFTED.format(source="scaled"))}
SELECT entity, feature, kind, month, {r('value', 8)} AS value FROM shifted""",
        "constant_split": f"""{_with(nation)}
SELECT entity, feature, kind, count(*) AS n_months,
       min(CASE WHEN feature = 'PROMO' THEN 7 ELSE value END)
       <> max(CASE WHEN feature = 'PROMO' THEN 7 ELSE value END) AS varying
FROM feat GROUP BY ALL""",
        "hp_trend": f"""{_CHAIN_HP}
SELECT entity, feature, kind, month, {r('logs', 8)} AS logs, {r('trend', 7)} AS trend FROM hp""",
        "trend_standardised": f"""{_CHAIN_HP}
SELECT entity, feature, kind, month, {r('score', 5)} AS score FROM std""",
        "pc1_scores": f"""{_CHAIN_PC1}
SELECT entity, month, {r('pc1', 5)} AS pc1, {r('pc1_rescaled', 6)} AS pc1_rescaled FROM pcr""",
        "detrended": f"""{_CHAIN_DETRENDED}
SELECT entity, feature, kind, month, {r('value / 1e6', 6)} AS value FROM detr""",
        "log_transforms": f"""{_with(region, CALENDAR, FILLED, adjusted(), _logs("adj", " / 1e6"))}
SELECT entity, feature, kind, month, {r('value', 8)} AS value FROM logs""",
        "balanced_panel": f"""{chain_panel}
SELECT entity, month, {features_out}, {_DUMMY} FROM panel""",
        "incomplete_panel_rows": f"""{_with(nation, _logs("feat"))}
SELECT count(*) FILTER (WHERE k < {len(PANEL_FEATURES)}) AS rows_dropped
FROM (SELECT entity, month, count(value) AS k FROM logs GROUP BY entity, month)""",
        "modelling_panel": f"""{chain_model}
SELECT entity, month, {features_out}, {_DUMMY}, {_cols(['level_lag1', 'target'], 7)} FROM changes""",
        "panel_roundtrip": f"""{chain_model}
SELECT entity, month, {features_out}, {_DUMMY}, {_cols(['level_lag1', 'target'], 7)} FROM changes""",
        "panel_level_keys": f"""{chain_model}
SELECT entity, month, {_cols(['level_lag1', 'target'], 7)} FROM changes""",
        "panel_summary": f"""{chain_model}
SELECT count(DISTINCT entity) AS n_entities, {len(PANEL_FEATURES)}::BIGINT AS n_features,
       {len(REGIONS) - 1}::BIGINT AS n_dummies, count(*) AS n_rows,
       min(month) AS first_month, max(month) AS last_month,
       {r('min(target)', 7)} AS target_min, {r('max(target)', 7)} AS target_max
FROM changes""",
        "packed_panel": f"""{chain_model}
SELECT entity, month, feature, {r('value', 5)} AS value, {_cols(['level_lag1', 'target'], 7)}
FROM changes UNPIVOT (value FOR feature IN ({', '.join(PANEL_FEATURES)}))""",
        "packed_design": f"""{chain_model},
places AS (SELECT * REPLACE (CAST(level_lag1 AS DOUBLE) AS level_lag1),
  {', '.join(f"CAST(entity = '{e}' AS INTEGER)::DOUBLE AS " + '"C_' + e + '"' for e in REGIONS if e != inputs.REFERENCE_REGION)}
  FROM changes)
SELECT feature, count(*) FILTER (WHERE value <> 0) AS n_nonzero, {r('sum(value)', 4)} AS total
FROM places UNPIVOT (value FOR feature IN ({', '.join(PANEL_FEATURES)}, level_lag1,
  {', '.join('"C_' + e + '"' for e in REGIONS if e != inputs.REFERENCE_REGION)}))
GROUP BY feature""",
        "panel_rule_counts": f"""{chain_model}, {_FAULTY}
SELECT 'repeated_key' AS rule, {_REPEATED} AS n_rows
UNION ALL SELECT 'excluded_entity', count(*) FILTER (WHERE entity = 'MIDDLE EAST') FROM faulty
UNION ALL SELECT 'wrong_dummies', count(*) FILTER (WHERE entity = 'EUROPE' AND month(month) = 5) FROM faulty
UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE isnan(ECONOMY)) FROM faulty
UNION ALL SELECT 'target_not_finite', count(*) FILTER (WHERE target IS NULL) FROM faulty""",
        "model_panel_rule_counts": f"""{chain_model}, {_FAULTY}
SELECT 'invalid_month' AS rule, count(*) FILTER (WHERE month IS NULL) AS n_rows FROM faulty
UNION ALL SELECT 'repeated_key', {_REPEATED}
UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE isnan(ECONOMY) OR target IS NULL) FROM faulty""",
        "observed_panel_write": f"""{chain_model}
SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, CAST(0 AS BIGINT) AS repeated_key,
       min(month) AS first_month, max(month) AS last_month,
       {r('min(target)', 7)} AS target_min, {r('max(target)', 7)} AS target_max
FROM changes""",
        "level_rule_counts": f"""{_CHAIN_COMMON},
fp AS (
  SELECT month, entity, CASE WHEN entity = 'NATION_2' THEN -100 ELSE level_lag1 END AS lag1,
         target + CASE WHEN month(month) = 6 THEN 0.5::DOUBLE ELSE 0 END AS outcome
  FROM changes WHERE entity <> 'NATION_4'),
fl AS (SELECT c.*, lag1, outcome FROM common c LEFT JOIN fp USING (month, entity))
SELECT 'unmatched' AS rule, count(*) FILTER (WHERE outcome IS NULL) AS n_rows FROM fl
UNION ALL SELECT 'other_outcome', count(*) FILTER (WHERE abs(outcome - actual) > 0.1) FROM fl
UNION ALL SELECT 'level_not_positive', count(*) FILTER (WHERE lag1 + actual <= 0) FROM fl""",
        "month_axis_gaps": f"""{_CHAIN_AXIS},
fewer AS (SELECT DISTINCT month FROM changes WHERE {_ord('month')} % 11 <> 0),
nxt AS (SELECT month, lead(month) OVER (ORDER BY month) AS next_month FROM fewer)
SELECT month, next_month FROM nxt WHERE {_ord('next_month')} - {_ord('month')} <> 1""",
        "rate_dimension_check": "\nUNION ALL\n".join(
            f"""SELECT '{name}' AS dimension, {name} AS value, count(*) AS n_rows
FROM orders WHERE {name} IS NOT NULL AND {name} <> '{want}' GROUP BY ALL
UNION ALL SELECT '{name}', '{want}', 0 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {name} = '{want}')"""
            for name, want in inputs.DIMENSIONS.items()
        ),
        "unmapped_areas": f"""SELECT DISTINCT 'NATION_' || c_nationkey AS "REF_AREA" FROM customer
WHERE 'NATION_' || c_nationkey NOT IN ({_list(inputs.AREA_CODES)})""",
        "interpolated_rates": f"""{_CHAIN_CUSTOMERS}
SELECT entity, month, imputed, {r('level', 7)} AS level FROM interp""",
        "imputed_rates": f"""{_CHAIN_CUSTOMERS}
SELECT entity, month, {r('level', 7)} AS imputed_value FROM interp WHERE imputed""",
        "remaining_gaps": f"""{_CHAIN_CUSTOMERS}
SELECT entity, month FROM interp WHERE level IS NULL""",
        "gap_audit": f"""{_CHAIN_CUSTOMERS}
SELECT entity, CASE WHEN imputed THEN 'filled' ELSE 'remaining' END AS status, count(*) AS n_months,
       min(month) AS first_month, max(month) AS last_month
FROM interp WHERE imputed OR level IS NULL GROUP BY ALL""",
        "change_target": f"""{_CHAIN_CUSTOMERS}
SELECT entity, month, {_cols(['level_lag1', 'target'], 7)} FROM changes""",
        "target_lags": f"""{_CHAIN_CUSTOMERS}, {_lagged(3)}
SELECT entity, month, {_cols(['target', 'target_lag1', 'target_lag2', 'target_lag3'], 7)} FROM lagged""",
        "inconsistent_lags": f"""{_CHAIN_RATES}, {_lagged(3)},
pre AS (
  SELECT entity, month, target_lag2 AS expected,
         coalesce(target_lag2, 0) + CASE WHEN entity = 'NATION_5' THEN 0.25 ELSE 0 END AS found
  FROM lagged WHERE target_lag2 IS NOT NULL)
SELECT entity, month, 'target_lag2' AS "column", {_cols(['found', 'expected'], 7)}
FROM pre WHERE NOT abs(found - expected) <= 1e-8 + 1e-5 * abs(expected)""",
        "rolling_splits": f"""{_CHAIN_AXIS}
SELECT test_idx, test_month, train_start, train_end FROM splits""",
        "split_rows": f"""{_CHAIN_AXIS},
ok AS (SELECT * FROM rws WHERE target_lag2 IS NOT NULL),
both_ AS (
  SELECT s.test_idx, o.month, o.entity, o.target, o.target_lag2,
         CASE WHEN o.idx = s.test_idx THEN 'test' ELSE 'train' END AS role
  FROM splits s JOIN ok o ON o.idx BETWEEN s.test_idx - {W} AND s.test_idx)
SELECT test_idx, month, entity, role, {_cols(['target', 'target_lag2'], 7)}
FROM both_ WHERE test_idx IN (SELECT test_idx FROM both_ GROUP BY 1 HAVING count(DISTINCT role) = 2)""",
        "random_walk": f"""{_CHAIN_AXIS}
SELECT r.month, r.entity, 'Random walk' AS model, {r('r.target', 7)} AS actual,
       0.0::DOUBLE AS prediction, s.train_start, s.train_end
FROM rws r JOIN splits s ON s.test_idx = r.idx""",
        "pooled_ar1": f"""{_CHAIN_PREDS}
SELECT month, entity, {r('y', 7)} AS actual, {_cols(['prediction', 'slope'], 7)}, rank_deficient,
       train_start, train_end FROM ar1""",
        "error_columns": f"""{_CHAIN_PREDS}
SELECT {prediction_out}, {r('actual - prediction', 7)} AS error,
       {r('abs(actual - prediction)', 7)} AS absolute_error,
       {r('(actual - prediction) ** 2', 7)} AS squared_error FROM preds""",
        "metrics_overall": f"""{_CHAIN_PREDS}
SELECT model, {_METRICS} FROM preds GROUP BY model""",
        "metrics_by_entity": f"""{_CHAIN_PREDS}
SELECT model, entity, {_METRICS} FROM preds GROUP BY model, entity""",
        "metrics_grouping_sets": f"""{_CHAIN_PREDS}
SELECT model, entity, CAST(grouping(entity) AS BIGINT) AS overall, {_METRICS}
FROM preds GROUP BY GROUPING SETS ((model), (model, entity))""",
        "widest_forecast_spread": f"""{_CHAIN_COMMON}
SELECT month, entity, {r('max(prediction) - min(prediction)', 7)} AS spread
FROM common GROUP BY month, entity ORDER BY max(prediction) - min(prediction) DESC, month DESC, entity DESC LIMIT 1""",
        "predictions_roundtrip": f"""{_CHAIN_PREDS}
SELECT {prediction_out} FROM preds""",
        "common_sample": f"""{_CHAIN_COMMON}
SELECT {prediction_out} FROM common""",
        "sample_sizes": f"""{_CHAIN_COMMON}
SELECT model, count(*) AS n_before, any_value(k) AS n_common
FROM preds LEFT JOIN (SELECT model, count(*) AS k FROM common GROUP BY model) USING (model) GROUP BY model""",
        "level_metrics": f"""{_CHAIN_COMMON}
SELECT model, {_cols(['rmse', 'mae', 'mape'], 8)}, n FROM lm""",
        "model_ranking": f"""{_CHAIN_COMMON}
SELECT rank, model, {_cols(['rmse', 'mae', 'mape'], 8)}, n, 'Common sample' AS basis FROM ranked""",
        "prediction_audit": f"""{_CHAIN_COMMON}
SELECT month, entity, model, {_cols(audit, 7)}, {r('abs(actual - prediction)', 7)} AS absolute_error,
       {r('(actual - prediction) ** 2', 7)} AS squared_error,
       CASE WHEN abs(actual_level) > 1e-8
            THEN {r('abs((actual_level - prediction_level) / actual_level)', 7)} END AS level_ape
FROM levels""",
        "plot_metrics": f"""{_CHAIN_COMMON}
SELECT rank, model, 'rmse' AS metric, {r('rmse', 6)} AS value FROM ranked
UNION ALL SELECT rank, model, 'mae', {r('mae', 6)} FROM ranked
UNION ALL SELECT rank, model, 'mape', {r('mape * 100', 6)} FROM ranked""",
        "plot_series": f"""{_CHAIN_COMMON},
lim AS (
  SELECT entity, least(min(actual_level), min(prediction_level)) AS lo,
         greatest(max(actual_level), max(prediction_level)) AS hi
  FROM levels GROUP BY entity)
SELECT entity, model, month, {_cols(['actual_level', 'prediction_level'], 7)},
       {r('lo - greatest((hi - lo) * 0.08::DOUBLE, 0.25)', 6)} AS axis_low,
       {r('hi + greatest((hi - lo) * 0.08::DOUBLE, 0.25)', 6)} AS axis_high
FROM levels JOIN lim USING (entity) WHERE entity IN ('NATION_1', 'NATION_8')""",
        "validation_design_at_or_before": f"""{_CHAIN_AXIS}, {_design(_LAST_BEFORE)}
SELECT idx AS month_idx, month, role, max_window FROM design""",
        "validation_design_exact": f"""{_CHAIN_DESIGN}
SELECT idx AS month_idx, month, role, max_window FROM design""",
        "rw_validation_rmse": f"""{_CHAIN_DESIGN}
SELECT {r('sqrt(avg(target * target))', 8)} AS benchmark_rmse, count(*) AS n
FROM changes WHERE month IN (SELECT month FROM design WHERE role = 'validation')""",
        "search_trials": _SEARCH,
        "trial_running_rmse": f"""{_FOLDS}
SELECT CAST(0 AS BIGINT) AS study, CAST(trial AS BIGINT) AS trial, step, n, {r('sse', 7)} AS sse,
       {r('running_rmse', 8)} AS running_rmse FROM curves""",
        "monthly_rmse": f"""{_FOLDS}
SELECT CAST(trial AS BIGINT) AS trial, step, {r(r('sqrt(sse / n)', 10), 8)} AS rmse FROM folds""",
        "median_stopping": f"""{_CHAIN_STOP}
SELECT study, trial, state, months_evaluated, {r('value', 8)} AS value FROM states""",
        "trial_counts": f"""{_CHAIN_STOP}
SELECT study, count(*) AS total, count(*) FILTER (WHERE state = 'complete') AS complete,
       count(*) FILTER (WHERE state = 'stopped') AS stopped FROM states GROUP BY study""",
        "best_trial": f"""{_CHAIN_STOP}
SELECT study, trial, months_evaluated, {r('value', 8)} AS value
FROM states WHERE state = 'complete' ORDER BY states.value, trial LIMIT 1""",
        "tuned_ar_report": f"""{_CHAIN_STOP},
bm AS (
  SELECT sqrt(avg(target * target)) AS b FROM changes
  WHERE month IN (SELECT month FROM design WHERE role = 'validation')),
best AS (SELECT * FROM states WHERE state = 'complete' ORDER BY value, trial LIMIT 1),
per AS (
  SELECT min(month) FILTER (WHERE role = 'validation') AS vs,
         max(month) FILTER (WHERE role = 'validation') AS ve,
         max(month) FILTER (WHERE role = 'holdout') AS he,
         count(*) FILTER (WHERE role = 'validation') AS nv,
         count(*) FILTER (WHERE role = 'holdout') AS nh FROM design)
SELECT 'ar1' AS model, best.trial AS best_trial, CAST(t.w AS BIGINT) AS window_months,
       CAST(t.k AS BIGINT) AS target_lags, {r('best.value', 8)} AS best_rmse,
       {r('b', 8)} AS benchmark_rmse, {r('best.value / b', 7)} AS ratio_to_benchmark,
       vs AS validation_start, ve AS tuning_end, nv AS n_validation,
       strftime(last_day(ve + INTERVAL 1 DAY), '%Y-%m-%d') AS recommended_test_start,
       he AS holdout_end, nh AS n_holdout,
       (SELECT count(*) FROM states) AS n_trials,
       (SELECT count(*) FROM states WHERE state = 'complete') AS n_complete,
       (SELECT count(*) FROM states WHERE state = 'stopped') AS n_stopped,
       (SELECT count(DISTINCT month) FROM changes) AS panel_months,
       (SELECT count(DISTINCT entity) FROM changes) AS panel_entities,
       (SELECT count(*) FROM changes) AS panel_rows
FROM best JOIN trials t USING (trial), bm, per""",
    }
