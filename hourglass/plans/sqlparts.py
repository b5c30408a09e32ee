"""DuckDB-dialect SQL fragments for the oracle queries (CTE text builders).

Only the independent check uses these; the Spark side never parses SQL.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong entry on the Spark side shows as a difference.
FIXED_HOLIDAYS_SQL = ("'01-01', '01-02', '02-08', '04-27', '05-01', '05-02', "
                      "'06-25', '08-15', '10-31', '11-01', '12-25', '12-26'")
EASTER_OFFSETS_SQL = "0, 1, 49"
SCHOOL_HOLIDAYS_SQL = "({md} BETWEEN '06-25' AND '08-31' OR {md} BETWEEN '12-25' AND '12-31' OR {md} BETWEEN '01-01' AND '01-02')"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def configs(rows: list[dict], name: str = "cfg") -> str:
    """A parameter table from literal rows."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    lines = ", ".join("(" + ", ".join(value(v) for v in r.values()) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {lines}) g({', '.join(rows[0])}))"


def dual_ridge(name: str, train: str, keys: str, families: dict[str, str], params: str, cfg: str = "cfg") -> str:
    """Ridge models of ``train`` (keys, window_id, x, y) for every config of ``cfg``, by elimination on the windows' inner products.

    ``families`` maps a penalty column to the list slice of its inputs.  The
    result ``{name}_alpha`` has, per keys, config and window number ``i``, the
    dual weights ``a`` (one per horizon), the inputs ``x`` and ``row_mean``, the
    mean inner product with all windows; ``{name}_mean`` has the mean targets ``ym``.
    """
    cols = [k.strip() for k in keys.split(",")]
    a_keys = ", ".join(f"a.{k}" for k in cols)
    inner = ", ".join(f"list_dot_product(a.x{cut}, b.x{cut}) AS k_{pen}" for pen, cut in families.items())
    total = " + ".join(f"k_{pen} / c.{pen}" for pen in families)
    c_params = ", ".join(f"c.{p}" for p in params.split(", "))
    over = f"PARTITION BY {keys}, {params}"
    return f"""{name}_num AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY window_id) AS i, x, y FROM {train}),
{name}_gram AS (SELECT {a_keys}, a.i, b.i AS j, {inner} FROM {name}_num a JOIN {name}_num b USING ({keys})),
{name}_k AS (SELECT {keys}, {c_params}, i, j, {total} AS k FROM {name}_gram g, {cfg} c),
{name}_c AS (SELECT *, avg(k) OVER ({over}, i) AS row_mean,
    k - avg(k) OVER ({over}, i) - avg(k) OVER ({over}, j) + avg(k) OVER ({over}) AS c FROM {name}_k),
{name}_mean AS (SELECT {keys}, list(m ORDER BY h) AS ym FROM (
    SELECT {keys}, h, avg(v) AS m FROM (SELECT {keys}, unnest(y) AS v, generate_subscripts(y, 1) AS h FROM {name}_num) u GROUP BY {keys}, h) v GROUP BY {keys}),
{name}_rows AS (SELECT {keys}, {params}, i, any_value(row_mean) AS row_mean, list(c + CASE WHEN i = j THEN 1 ELSE 0 END ORDER BY j) AS r FROM {name}_c GROUP BY {keys}, {params}, i),
{name}_sys AS (SELECT {keys}, {params}, 0 AS step, list(list_concat(r, list_transform(y, lambda v, h: v - ym[h])) ORDER BY i) AS m
    FROM {name}_rows JOIN {name}_num USING ({keys}, i) JOIN {name}_mean USING ({keys}) GROUP BY {keys}, {params}),
{name}_gj AS (SELECT * FROM {name}_sys UNION ALL SELECT {keys}, {params}, step + 1, list_transform(m, lambda r, i:
    CASE WHEN i = step + 1 THEN list_transform(r, lambda v: v / r[step + 1])
         ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
  FROM {name}_gj WHERE step < len(m)),
{name}_alpha AS (SELECT {keys}, {params}, i, a, x, row_mean FROM (
    SELECT {keys}, {params}, unnest(range(1, len(m) + 1)) AS i, m FROM {name}_gj WHERE step = len(m)) s
  CROSS JOIN LATERAL (SELECT s.m[s.i][len(s.m) + 1:] AS a) l JOIN {name}_num USING ({keys}, i) JOIN {name}_rows USING ({keys}, {params}, i))"""


def dual_predict(name: str, model: str, target: str, keys: str, families: dict[str, str], params: str, carry: str) -> str:
    """``{name}``: keys, params, carry, horizon (from 0) and prediction (not below 0) of ``target`` rows (keys, carry, x)."""
    k = " + ".join(f"list_dot_product(t.x{cut}, al.x{cut}) / al.{pen}" for pen, cut in families.items())
    t_keys = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    t_carry = ", ".join(f"t.{c.strip()}" for c in carry.split(","))
    al_params = ", ".join(f"al.{p}" for p in params.split(", "))
    return f"""{name}_parts AS (SELECT {t_keys}, {t_carry}, {al_params}, unnest(al.a) AS a, generate_subscripts(al.a, 1) AS h, {k} - al.row_mean AS k
    FROM {target} t JOIN {model}_alpha al USING ({keys})),
{name} AS (SELECT {keys}, {carry}, {params}, CAST(h - 1 AS INTEGER) AS horizon, greatest(any_value(ym[h]) + sum(a * k), 0) AS prediction
    FROM {name}_parts JOIN {model}_mean USING ({keys}) GROUP BY {keys}, {carry}, {params}, h)"""


def hourly(name: str = "panel", series: str = "event_type") -> str:
    return f"""{name}_obs AS (
  SELECT CAST({series} AS VARCHAR) AS series, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts
  FROM events WHERE ts IS NOT NULL AND {series} IS NOT NULL),
{name}_grid AS (
  SELECT s.series, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT DISTINCT series FROM {name}_obs) s,
       (SELECT min(ts) AS lo, max(ts) AS hi FROM {name}_obs) b),
{name} AS (
  SELECT series, ts, CAST(sum(n) AS DOUBLE) AS value FROM (
    SELECT series, ts, CAST(1 AS DOUBLE) AS n FROM {name}_obs
    UNION ALL SELECT series, ts, CAST(0 AS DOUBLE) AS n FROM {name}_grid) u
  GROUP BY series, ts)"""


def sparse(name: str = "sparse") -> str:
    return f"""{name} AS (
  SELECT event_type AS series, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts,
         avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS value
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL
  GROUP BY 1, 2)"""


def daily(name: str = "daily") -> str:
    return f"""{name}_obs AS (
  SELECT o_orderpriority AS series, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS ts,
         CASE WHEN isnan(o_totalprice) THEN NULL ELSE o_totalprice END AS v
  FROM orders WHERE o_orderdate IS NOT NULL),
{name}_grid AS (
  SELECT s.series, unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS ts
  FROM (SELECT DISTINCT series FROM {name}_obs) s,
       (SELECT min(ts) AS lo, max(ts) AS hi FROM {name}_obs) b),
{name} AS (
  SELECT series, ts, COALESCE(sum(v), 0) AS value FROM (
    SELECT series, ts, v FROM {name}_obs
    UNION ALL SELECT series, ts, CAST(0 AS DOUBLE) AS v FROM {name}_grid) u
  GROUP BY series, ts)"""


def test_panel(name: str = "testp", src: str = "panel", history: int = 48, predict: int = 4) -> str:
    size = history + predict
    return f"""{name}_b AS (SELECT min(ts) AS lo FROM {src}),
{name} AS (
  SELECT series, ts, CASE WHEN idx % {size} < {history} THEN value END AS value
  FROM (SELECT p.series, p.ts, p.value, CAST(floor((epoch(p.ts) - epoch(b.lo)) / 3600) AS BIGINT) AS idx
        FROM {src} p, {name}_b b) t)"""


def with_pos(name: str, src: str) -> str:
    """``src`` rows + ``pos`` = 0-based rank of their ts among the distinct ts of ``src``."""
    return f"""{name} AS (
  SELECT s.*, p.pos FROM {src} s JOIN (
    SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS pos
    FROM (SELECT DISTINCT ts FROM {src}) d) p USING (ts))"""


def drop_incomplete(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT * FROM {src} WHERE ts IN (
    SELECT ts FROM {src} GROUP BY ts
    HAVING count(value) = (SELECT count(DISTINCT series) FROM {src})))"""


def gap_windows(name: str, src: str, train: int = 48, predict: int = 4, gap: int = 26,
                keep_gap: bool = False) -> str:
    """``src`` must carry ``pos``."""
    step = train + predict + gap - 1
    total = train + predict + gap
    cond = "" if keep_gap else f" AND s.pos % {step} < {train + predict}"
    return f"""{name} AS (
  SELECT s.*, CAST(s.pos // {step} AS BIGINT) AS window_id, CAST(s.pos % {step} AS INTEGER) AS "offset",
         CASE WHEN s.pos % {step} < {train} THEN 'x' WHEN s.pos % {step} < {train + predict} THEN 'y'
              ELSE 'gap' END AS role
  FROM {src} s, (SELECT max(pos) + 1 AS n FROM {src}) c
  WHERE (s.pos // {step}) * {step} < c.n - {total}{cond})"""


def scaler(stats: str, scaled: str, src: str, keys: str = "series") -> str:
    return f"""{stats} AS (
  SELECT {keys}, count(value) AS n, avg(value) AS mean,
         CASE WHEN stddev_pop(value) IS NULL OR stddev_pop(value) <= 1e-12 THEN 1.0
              ELSE stddev_pop(value) END AS std
  FROM {src} WHERE role = 'x' GROUP BY {keys}),
{scaled} AS (
  SELECT w.*, (w.value - st.mean) / st.std AS scaled
  FROM {src} w LEFT JOIN {stats} st USING ({keys}))"""


def sequences(name: str, src: str, train: int = 48, predict: int = 4, keys: str = "series",
              window: str = "window_id") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {keys}, {window},
           list(scaled ORDER BY "offset") FILTER (WHERE role = 'x') AS x,
           list(value ORDER BY "offset") FILTER (WHERE role = 'y') AS y
    FROM {src} GROUP BY {keys}, {window}) g
  WHERE len(x) = {train} AND len(y) = {predict})"""


def horizon_rows(name: str, seq: str, keys: str = "series", window: str = "window_id",
                 kind: str = "mean") -> str:
    feat = "list_sum(x) / len(x)" if kind == "mean" else "x[len(x)]"
    return f"""{name} AS (
  SELECT {keys}, {window}, {feat} AS feature,
         unnest(y) AS target, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS horizon
  FROM {seq})"""


def univariate_fit(name: str, rows: str, keys: str = "series") -> str:
    return f"""{name} AS (
  SELECT {keys}, horizon, coalesce(regr_slope(target, feature), 0) AS slope,
         coalesce(regr_intercept(target, feature), avg(target) FILTER (WHERE feature IS NOT NULL)) AS intercept
  FROM {rows} GROUP BY {keys}, horizon)"""


def month_day(ts: str) -> str:
    return f"strftime({ts}, '%m-%d')"


def easter(year: str) -> str:
    """Gregorian computus as SQL arithmetic on an integer year expression."""
    y = f"({year})"
    a = f"({y} % 19)"
    b = f"({y} // 100)"
    c = f"({y} % 100)"
    d = f"({b} // 4)"
    e = f"({b} % 4)"
    f = f"(({b} + 8) // 25)"
    g = f"(({b} - {f} + 1) // 3)"
    h = f"((19 * {a} + {b} - {d} - {g} + 15) % 30)"
    i = f"({c} // 4)"
    k = f"({c} % 4)"
    l_ = f"((32 + 2 * {e} + 2 * {i} - {h} - {k}) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {l_}) // 451)"
    s = f"({h} + {l_} - 7 * {m} + 114)"
    return f"make_date(CAST({y} AS BIGINT), CAST({s} // 31 AS BIGINT), CAST({s} % 31 + 1 AS BIGINT))"


def is_holiday(ts: str) -> str:
    return (f"({month_day(ts)} IN ({FIXED_HOLIDAYS_SQL}) OR "
            f"date_diff('day', {easter(f'year({ts})')}, CAST({ts} AS DATE)) IN ({EASTER_OFFSETS_SQL}))")


def is_school_holiday(ts: str) -> str:
    return SCHOOL_HOLIDAYS_SQL.format(md=month_day(ts))


def dow(ts: str) -> str:
    return f"(isodow({ts}) - 1)"


def attribute_select(ts: str = "ts") -> str:
    parts = [f"CAST({is_holiday(ts)} AS INTEGER) AS is_holiday",
             f"CAST({is_school_holiday(ts)} AS INTEGER) AS is_school_holiday"]
    parts += [f"CAST(hour({ts}) = {h} AS INTEGER) AS hour_{h}" for h in range(24)]
    parts += [f"CAST(month({ts}) = {m} AS INTEGER) AS month_{m}" for m in range(1, 13)]
    parts += [f"CAST({dow(ts)} = {d} AS INTEGER) AS day_of_week_{d}" for d in range(7)]
    return ",\n    ".join(parts)
