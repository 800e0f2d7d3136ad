"""Building blocks for the SQL twins: named CTEs with dependencies, and one output normaliser."""

from __future__ import annotations

from .. import schema as S
from ..sources.testdata import AUX_BY_CUSTOMER, AUX_BY_PRIORITY, AUX_BY_STATUS, CUSTOMER_DIGIT

CTES: dict[str, tuple[str, str]] = {}
"""name -> (space-separated dependencies, body)"""


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (deps, body)


def _resolve(names: str) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0].split():
            visit(d)
        seen.append(n)

    for n in names.split():
        visit(n)
    return seen


def build(deps: str, body: str, keys: str = "", ints: str = "", floats: str = "",
          digits: int = 6) -> str:
    """Full statement: CTEs, body, then BIGINT integers and rounded doubles without -0 or NaN."""
    cols = list(keys.split())
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    for c in floats.split():
        x = f"CAST({c} AS DOUBLE)"
        r = f"round({x}, {digits})"
        cols.append(f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL "
                    f"WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {c}")
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _resolve(deps))
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) AS result"


def roll(agg: str, x: str, n: int, mp: int | None = None, part: str = "symbol") -> str:
    w = f"(PARTITION BY {part} ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {mp if mp is not None else n} THEN {agg}({x}) OVER {w} END"


W = "(PARTITION BY symbol ORDER BY pos)"


def _bars(name: str, key: str) -> None:
    cte(f"{name}_day", "", f"""
SELECT CAST({key} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS ts,
       SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty
FROM lineitem GROUP BY 1, 2""")
    sw = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    cte(name, f"{name}_day", f"""
SELECT symbol, pos, ts, open, greatest(hi, open) AS high, least(lo, open) AS low, close, volume FROM (
 SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM (
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
         CAST(SUM(amt) OVER {sw} AS DOUBLE) / CAST(SUM(qty) OVER {sw} AS DOUBLE) AS close,
         max(CAST(amt AS DOUBLE) / CAST(qty AS DOUBLE)) OVER {sw} AS hi,
         min(CAST(amt AS DOUBLE) / CAST(qty AS DOUBLE)) OVER {sw} AS lo,
         CAST(qty AS DOUBLE) AS volume
  FROM {name}_day))""")
    cte(f"{name}_r", name, f"SELECT *, ln(close) - lag(ln(close)) OVER {W} AS r FROM {name}")
    alphas = dict(S.VOL_ALPHAS)
    sums = []
    for n, a in alphas.items():
        b = 1 - a
        sums.append(f"sum(pow({b}, t.pos - i.pos)) AS {n}_0, sum(pow({b}, t.pos - i.pos) * i.r) AS {n}_1, "
                    f"sum(pow({b}, t.pos - i.pos) * i.r * i.r) AS {n}_2, "
                    f"sum(pow({b * b}, t.pos - i.pos)) AS {n}_q")
    bs = 1 - S.SHOCK_ALPHA
    sums.append(f"sum(pow({bs}, t.pos - i.pos)) AS shock_0, sum(pow({bs}, t.pos - i.pos) * abs(i.r)) AS shock_1, "
                f"sum(pow({bs}, t.pos - i.pos) * i.r * i.r) AS shock_2, "
                f"sum(pow({bs * bs}, t.pos - i.pos)) AS shock_q")
    cte(f"{name}_ewsum", f"{name}_r", f"""
SELECT t.symbol, t.pos, count(*) AS n, {', '.join(sums)}
FROM {name}_r t JOIN {name}_r i ON t.symbol = i.symbol AND i.pos <= t.pos AND i.r IS NOT NULL
GROUP BY t.symbol, t.pos""")
    out = []
    for n in [*alphas, "shock"]:
        out.append(f"CASE WHEN n >= 20 THEN {n}_1 / {n}_0 END AS {n}_mean")
        out.append(f"CASE WHEN n >= 20 THEN sqrt(greatest(({n}_2/{n}_0 - ({n}_1/{n}_0)*({n}_1/{n}_0)) "
                   f"* ({n}_0*{n}_0) / ({n}_0*{n}_0 - {n}_q), 0)) END AS {n}_std")
    cte(f"{name}_ew", f"{name}_ewsum", f"SELECT symbol, pos, {', '.join(out)} FROM {name}_ewsum")
    mom = ", ".join(f"{roll('sum', 'r', h)} AS mom_{h}" for h in S.MOMENTUM_BARS)
    cte(f"{name}_raw", f"{name}_r {name}_ew", f"""
SELECT symbol, pos, ts, close, r, {mom}, vol_short, vol_ewma, vol_long, vol_yearly,
  vol_short / nullif(vol_long, 0) AS vol_ratio_sl, vol_long / nullif(vol_yearly, 0) AS vol_ratio_ly,
  (abs(r) - shock_mean) / nullif(shock_std, 0) AS shock_z,
  close / ({roll('max', 'close', 252, 20)}) - 1 AS drawdown_252,
  {rcorr('r', 'lr', 63)} AS autocorr_63,
  ({roll('avg', 'close', 21)}) / ({roll('avg', 'close', 63)}) - 1 AS trend_dir
FROM (SELECT b.*, lag(b.r) OVER (PARTITION BY b.symbol ORDER BY b.pos) AS lr, e.vol_short_std AS vol_short,
        e.vol_ewma_std AS vol_ewma, e.vol_long_std AS vol_long, e.vol_yearly_std AS vol_yearly,
        e.shock_mean, e.shock_std
      FROM {name}_r b LEFT JOIN {name}_ew e ON b.symbol = e.symbol AND b.pos = e.pos)""")
    lags = ", ".join(f"lag({c}) OVER {W} AS {c}" for c in S.FEATURES_V1)
    full = " AND ".join(f"{c} IS NOT NULL" for c in S.FEATURES_V1)
    cte(f"{name}_f1", f"{name}_raw", f"""
SELECT symbol, row_number() OVER {W} - 1 AS pos, ts, close, r, {', '.join(S.FEATURES_V1)}
FROM (SELECT symbol, pos, ts, close, r, {lags} FROM {name}_raw) WHERE {full}""")


def rcorr(a: str, b: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({a} + {b}) OVER {w} >= {n} THEN "
            f"nullif(corr({a}, {b}) OVER {w}, 'nan'::DOUBLE) END")


_bars("bars", "l_returnflag")
_bars("sbars", "l_suppkey")


def _case(col: str, names: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in names.items()) + " END"


cte("aux", "", " UNION ALL ".join(f"""
SELECT {_case(c, n)} AS series_id, CAST(o_orderdate AS DATE) AS date,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS value
FROM orders GROUP BY 1, 2 HAVING {_case(c, n)} IS NOT NULL"""
                                  for c, n in (("o_orderpriority", AUX_BY_PRIORITY),
                                               ("o_orderstatus", AUX_BY_STATUS), (CUSTOMER_DIGIT, AUX_BY_CUSTOMER))))
cte("aux_wide", "aux", "SELECT date, " + ", ".join(
    f"max(CASE WHEN series_id = '{s}' THEN value END) AS {s}" for s in S.AUX_SERIES) + " FROM aux GROUP BY date")
cte("aligned", "bars_raw bars aux_wide", "SELECT f.*, " + ", ".join(
    f"last_value({s} IGNORE NULLS) OVER (PARTITION BY f.symbol ORDER BY f.pos "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}" for s in S.AUX_SERIES) + """
FROM (SELECT b.symbol, b.pos, b.ts, b.close, r.r FROM bars b JOIN bars_raw r
      ON b.symbol = r.symbol AND b.pos = r.pos) f LEFT JOIN aux_wide a ON f.ts = a.date""")


def logfloor(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN ln(greatest({x}, 1e-9)) END"


cte("crossed", "aligned", f"""
SELECT *, {logfloor('vix')} AS vix_log, {logfloor('skew')} AS skew_log, {logfloor('vvix')} AS vvix_log,
  vix - lag(vix, 5) OVER {W} AS vix_change, vix / nullif(vix3m, 0) AS vix_term, vix3m - vix AS vix_slope,
  2 * vix - vix9d - vix3m AS vix_curvature, vix6m - vix AS vix6m_slope,
  {rcorr('r', 'tlt_r', 63)} AS corr_tlt_63, {rcorr('r', 'gld_r', 63)} AS corr_gld_63
FROM (SELECT *, ln(tlt) - lag(ln(tlt)) OVER {W} AS tlt_r, ln(gld) - lag(ln(gld)) OVER {W} AS gld_r FROM aligned)""")
_yk = 0.34 / (1.34 + 21 / 19)
cte("yz", "bars", f"""
SELECT symbol, pos, ts, sqrt(greatest(({roll('var_samp', 'oc', 20)}) + {_yk} * ({roll('var_samp', 'co', 20)})
  + {1 - _yk} * ({roll('avg', 'rs', 20)}), 0)) * sqrt(252) AS yang_zhang_vol
FROM (SELECT symbol, pos, ts, ln(open) - lag(ln(close)) OVER {W} AS oc, ln(close) - ln(open) AS co,
  (ln(high)-ln(close))*(ln(high)-ln(open)) + (ln(low)-ln(close))*(ln(low)-ln(open)) AS rs FROM bars)""")
_all = S.FEATURES_V2
_lag2 = ", ".join(f"lag({c}) OVER {W} AS {c}" for c in _all)
_dead = ", ".join(f"CASE WHEN count({c}) OVER (PARTITION BY symbol) = 0 THEN 0.0 ELSE {c} END AS {c}"
                  for c in S.FEATURES_V2_ADD)
cte("f2", "bars_raw crossed yz", f"""
SELECT symbol, row_number() OVER {W} - 1 AS pos, ts, close, r, {', '.join(_all)} FROM (
 SELECT symbol, pos, ts, close, r, {', '.join(S.FEATURES_V1)}, {_dead} FROM (
  SELECT symbol, pos, ts, close, r, {_lag2} FROM (
   SELECT f.*, {', '.join('c.' + c for c in S.FEATURES_V2_ADD if c != 'yang_zhang_vol')},
     last_value(y.yang_zhang_vol IGNORE NULLS) OVER (PARTITION BY f.symbol ORDER BY f.pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS yang_zhang_vol
   FROM bars_raw f JOIN crossed c ON f.symbol = c.symbol AND f.pos = c.pos
   LEFT JOIN yz y ON f.symbol = y.symbol AND f.pos = y.pos)))
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _all)}""")

cte("ticks", "", """
SELECT event_type AS symbol, ts, event_id AS seq, value AS close FROM events WHERE value > 0""")
cte("tick_r", "ticks", """
SELECT * FROM (SELECT symbol, ts, seq, close, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS r
FROM ticks) WHERE r IS NOT NULL""")
cte("tick_day", "tick_r", """
SELECT symbol, CAST(ts AS DATE) AS day, count(r) AS n, sum(r*r) AS rv,
 sum(CASE WHEN r > 0 THEN r*r ELSE 0 END) AS rsv_pos, sum(CASE WHEN r < 0 THEN r*r ELSE 0 END) AS rsv_neg,
 sum(r*r*r) AS r3 FROM tick_r GROUP BY 1, 2""")
cte("tick_cal", "tick_day", """
SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
FROM tick_day GROUP BY symbol""")
cte("tick_bv", "tick_r", """
SELECT symbol, CAST(ts AS DATE) AS day, (pi()/2) * coalesce(sum(a * p), 0) AS bv FROM (
 SELECT symbol, ts, abs(r) AS a, lag(abs(r)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM tick_r)
GROUP BY 1, 2""")

# labels over the price-feature frame
cte("labels0", "bars_f1", """
SELECT f.symbol, f.pos, f.ts, f.close, f.r, f.vol_ewma, max(f.pos) OVER (PARTITION BY f.symbol) AS last_pos,
  f.close * (1 + 2.0 * f.vol_ewma) AS up, f.close * (1 - 2.0 * f.vol_ewma) AS lo FROM bars_f1 f""")
cte("labels_hit", "labels0", """
SELECT a.symbol, a.pos, min(b.pos) AS hit FROM labels0 a JOIN labels0 b
 ON a.symbol = b.symbol AND b.pos BETWEEN a.pos + 1 AND a.pos + 10
 AND (b.close >= a.up OR b.close <= a.lo) WHERE a.vol_ewma > 0 GROUP BY 1, 2""")
cte("tb", "labels0 labels_hit", """
SELECT x.symbol, x.pos, x.ts, x.close, x.r, x.vol_ewma, x.t1, ln(e.close / x.close) AS ret,
  CASE WHEN x.hit IS NULL THEN 0 WHEN e.close >= x.up THEN 1 ELSE -1 END AS label, x.t1 - x.pos AS horizon
FROM (SELECT a.*, h.hit, coalesce(h.hit, least(a.pos + 10, a.last_pos)) AS t1
      FROM labels0 a LEFT JOIN labels_hit h ON a.symbol = h.symbol AND a.pos = h.pos) x
JOIN labels0 e ON e.symbol = x.symbol AND e.pos = x.t1""")
cte("conc", "tb", """
SELECT a.symbol, a.pos, count(*) AS concurrency FROM tb a JOIN tb b
 ON a.symbol = b.symbol AND a.pos BETWEEN b.pos AND b.t1 AND b.pos >= a.pos - 10 GROUP BY 1, 2""")
cte("uniq", "tb conc", """
SELECT a.symbol, a.pos, avg(1.0 / c.concurrency) AS uniqueness FROM tb a JOIN conc c
 ON a.symbol = c.symbol AND c.pos BETWEEN a.pos AND a.t1 AND c.pos <= a.pos + 10 GROUP BY 1, 2""")
