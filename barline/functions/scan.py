"""First-order linear recurrences as two window passes: y_t = beta * y_{t-1} + u_t.

A running sum of u * beta^-k inside a block of rows gives the recurrence up to a factor; each
block's last value then carries into the next one. Blocks keep beta^-k in double range, a row holds
one carry per earlier block of its series (a daily series has few), and nothing leaves the JVM. All
windows share the partitioning by ``keys``, so a scan adds no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frame import UNB


def _number(beta: float | str) -> str:
    return f"{beta!r}D" if isinstance(beta, (int, float)) else beta


#: Largest block, the power of e that stays well inside double range, and the least beta of a column.
MAX_BLOCK, EXPONENT, LEAST_BETA = 1024, 600.0, 1e-4


def block_length(betas: Sequence[float | str]) -> int:
    """The longest block for which every ``beta ** -block`` is finite; columns count as ``LEAST_BETA``."""
    least = min(LEAST_BETA if isinstance(b, str) else b for b in betas)
    if not 0 < least:
        raise ValueError("beta must be positive")
    return MAX_BLOCK if least >= 1 else max(1, min(MAX_BLOCK, int(EXPONENT / -math.log(least))))


def linear_scan(df: DataFrame, specs: Mapping[str, tuple[str, float | str]],
                keys: Sequence[str] = ("symbol",), block: int = MAX_BLOCK) -> DataFrame:
    """Add one column per spec ``name: (u, beta)``, with y before the first row equal to 0.

    ``u`` is a SQL expression, ``beta`` a number or a column constant within a series. The block length
    is ``block`` or what the smallest beta allows, whichever is less; a column below ``LEAST_BETA`` raises instead of overflowing.
    """
    block, key = min(block, block_length([b for _, b in specs.values()])), ", ".join(keys)
    checked = {b: f"CASE WHEN {b} >= {LEAST_BETA!r}D OR {b} IS NULL THEN {b} ELSE CAST(raise_error('beta too small') AS DOUBLE) END"
               for _, b in specs.values() if isinstance(b, str)}
    df = df.selectExpr(*[f"{checked[c]} AS {c}" if c in checked else c for c in df.columns]) if checked else df
    items = [(i, n, u, _number(b)) for i, (n, (u, b)) in enumerate(specs.items())]
    work = df.selectExpr(
        "*", f"CAST(floor(pos / {block}) AS INT) AS _b", f"CAST(pos % {block} AS DOUBLE) AS _k",
        *[f"coalesce(CAST({u} AS DOUBLE), 0D) AS _u{i}" for i, _, u, _ in items])

    inside = f"(PARTITION BY {key}, _b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = work.selectExpr(*df.columns, "_b", "_k", *[
        f"sum(_u{i} * pow({b}, -_k)) OVER {inside} * pow({b}, _k) AS _s{i}" for i, _, _, b in items])

    # A block's last row holds the block's total; rows past it in the series collect these totals in order.
    # (_b, pos) orders like pos and needs no sort after the windows inside blocks.
    seq = f"PARTITION BY {key} ORDER BY _b, pos"
    ends = local.selectExpr("*", f"lead(_b, 1, -1) OVER ({seq}) <> _b AS _end")
    totals = ", ".join(f"_s{i} * pow({b}, {block - 1}D - _k)" for i, _, _, b in items)
    carried = ends.selectExpr(
        *df.columns, "_k", *[f"_s{i}" for i, _, _, _ in items],
        f"collect_list(CASE WHEN _end THEN array({totals}) END) OVER ({seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _c")
    # Rows of a series' first block have nothing to carry.
    return carried.selectExpr(*df.columns, *[
        f"CASE WHEN size(_c) = 0 THEN _s{i} ELSE _s{i} + pow({b}, _k + 1) * "
        f"aggregate(_c, 0D, (acc, e) -> acc * pow({b}, {block}D) + e[{i}]) END AS {n}"
        for i, n, _, b in items])


def ewm(df: DataFrame, specs: Mapping[str, tuple[str, float]], keys: Sequence[str] = ("symbol",),
        min_periods: int = 20, block: int = MAX_BLOCK) -> DataFrame:
    """Adjusted exponentially weighted mean and bias-corrected std.

    ``specs`` maps an output prefix to (column or expression, alpha); adds ``<prefix>_mean`` and
    ``<prefix>_std``. NULL rows age the weights and add nothing, as in pandas with
    ``ignore_na=False``. Sums that several outputs share are scanned once.
    """
    sums: dict[str, tuple[str, float]] = {}
    names: dict[tuple[str, float], str] = {}

    def scan(u: str, beta: float) -> str:
        name = names.setdefault((u, beta), f"_w{len(names)}")
        sums[name] = (u, beta)
        return name

    out = []
    seen = f"(PARTITION BY {', '.join(keys)} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for name, (x, alpha) in specs.items():
        beta = 1.0 - alpha
        bare = x[4:-1] if x.startswith("abs(") else x
        present = f"CASE WHEN {bare} IS NOT NULL THEN 1D END"
        s0, s1, s2, q = (scan(present, beta), scan(x, beta), scan(f"{bare} * {bare}", beta),
                         scan(present, beta * beta))
        ready = f"count({bare}) OVER {seen} >= {min_periods}"
        mean = f"{s1} / nullif({s0}, 0D)"
        var = (f"({s2} / nullif({s0}, 0D) - ({mean}) * ({mean})) * ({s0} * {s0}) "
               f"/ nullif({s0} * {s0} - {q}, 0D)")
        out += [f"CASE WHEN {ready} THEN {mean} END AS {name}_mean",
                f"CASE WHEN {ready} THEN sqrt(greatest({var}, 0D)) END AS {name}_std"]
    return linear_scan(df, sums, keys, block).selectExpr(*df.columns, *out)


def ewm_recursive(df: DataFrame, c: str, alpha: float, out: str,
                  keys: Sequence[str] = ("symbol",), block: int = MAX_BLOCK) -> DataFrame:
    """Unadjusted EWM mean: starts at the first value, then y = (1-alpha) y + alpha x."""
    seen = F.count(c).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(UNB, 0))
    u = f"CASE WHEN _seen = 1 THEN {c} ELSE {alpha!r}D * {c} END"
    scanned = linear_scan(df.withColumn("_seen", seen), {out: (u, 1.0 - alpha)}, keys, block)
    return scanned.withColumn(out, F.when(F.col("_seen") >= 1, F.col(out))).drop("_seen")


def rolling_range(df: DataFrame, columns: Sequence[str], n: int, min_periods: int | None = None,
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds ``<c>_lo`` and ``<c>_hi``, extremes over the last n rows, in constant work per row.

    With blocks of n rows a window of n ending at t is the tail of one block and the head of the
    next: a running extreme from the block's start at t meets one from the block's end, n-1 rows
    back. Both are unbounded-preceding windows; a sliding frame would rescan n rows per row.
    """
    need = n if min_periods is None else min_periods
    key = ", ".join(keys)
    up_to = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    head = f"(PARTITION BY {key}, _b ORDER BY pos {up_to})"
    tail = f"(PARTITION BY {key}, _b ORDER BY pos DESC {up_to})"
    seq = f"(PARTITION BY {key} ORDER BY _b, pos)"  # the order of pos, sorted for the heads already
    kinds = (("lo", "min", "least"), ("hi", "max", "greatest"))
    out = df.selectExpr("*", f"CAST(floor(pos / {n}) AS INT) AS _b")
    out = out.selectExpr("*", *[f"{fn}({c}) OVER {tail} AS _t_{k}_{c}" for c in columns for k, fn, _ in kinds])
    out = out.selectExpr("*", *[f"{fn}({c}) OVER {head} AS _h_{k}_{c}" for c in columns for k, fn, _ in kinds])
    out = out.selectExpr("*", *[f"count({c}) OVER (PARTITION BY {key} ORDER BY _b, pos {up_to}) AS _n_{c}" for c in columns])
    out = out.selectExpr("*", *[f"lag(_t_{k}_{c}, {n - 1}) OVER {seq} AS _l_{k}_{c}" for c in columns for k, _, _ in kinds],
                         *[f"_n_{c} - coalesce(lag(_n_{c}, {n}) OVER {seq}, 0) AS _m_{c}" for c in columns])
    return out.selectExpr(*df.columns, *[
        f"CASE WHEN _m_{c} >= {need} THEN {pick}(_h_{k}_{c}, _l_{k}_{c}) END AS {c}_{k}"
        for c in columns for k, _, pick in kinds])


def rolling_blocks(df: DataFrame, n: int, means: Mapping[str, str] | None = None, corrs: Mapping[str, tuple[str, str]] | None = None,
                   keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Means (``out: column``) and Pearson correlations (``out: (a, b)``) over the last n rows, in constant work per row.

    NULL unless all n rows have values; a correlation is NULL for a constant window, too. As in ``rolling_range`` a window
    is the tail of one block of n rows and the head of the next. Their counts, means and squared deviations are merged, so
    nothing is subtracted and far rows leave no rounding behind.
    """
    means, corrs, key = means or {}, corrs or {}, ", ".join(keys)
    up_to = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = {f"m{j}_s": f"sum({c})" for j, c in enumerate(means.values())}
    parts |= {f"m{j}_n": f"count({c})" for j, c in enumerate(means.values())}
    for j, (a, b) in enumerate(corrs.values()):
        x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        parts |= {f"c{j}_n": f"count({x})", f"c{j}_x": f"avg({x})", f"c{j}_y": f"avg({y})", f"c{j}_xx": f"var_pop({x})",
                  f"c{j}_yy": f"var_pop({y})", f"c{j}_xy": f"covar_pop({x}, {y})", f"c{j}_xlo": f"min({x})",
                  f"c{j}_xhi": f"max({x})", f"c{j}_ylo": f"min({y})", f"c{j}_yhi": f"max({y})"}

    def running(side: str, order: str) -> list[str]:
        return [f"{e} OVER (PARTITION BY {key}, _b ORDER BY {order} {up_to}) AS _{side}_{k}" for k, e in parts.items()]

    out = df.selectExpr("*", f"CAST(floor(pos / {n}) AS INT) AS _b")
    out = out.selectExpr("*", *running("t", "pos DESC")).selectExpr("*", *running("h", "pos"))
    tail = ", ".join(f"'{k}', _t_{k}" for k in parts)
    # A block's last row ends a window that is its head alone.
    out = out.selectExpr(*df.columns, *[f"_h_{k}" for k in parts],
                         f"CASE WHEN pos % {n} <> {n - 1} THEN lag(named_struct({tail}), {n - 1}) OVER (PARTITION BY {key} ORDER BY _b, pos) END AS _t")
    out = out.selectExpr(*df.columns, *[f"_h_{k}" for k in parts], *[f"_t.{k} AS _t_{k}" for k in parts])
    done = []
    for j, name in enumerate(means):
        have = f"_h_m{j}_n + coalesce(_t_m{j}_n, 0L)"
        done.append(f"CASE WHEN {have} >= {n} THEN (_h_m{j}_s + coalesce(_t_m{j}_s, 0D)) / {n}D END AS {name}")
    for j, name in enumerate(corrs):
        h, t = f"_h_c{j}", f"_t_c{j}"
        na, nb = f"coalesce({t}_n, 0L)", f"{h}_n"

        def merged(d: str, e: str) -> str:
            apart = f"coalesce(({h}_{d} - {t}_{d}) * ({h}_{e} - {t}_{e}) * {na} * {nb} / {n}D, 0D)"
            return f"(coalesce({t}_{d}{e} * {na}, 0D) + {h}_{d}{e} * {nb} + {apart})"

        varies = " AND ".join(f"least({h}_{d}lo, {t}_{d}lo) < greatest({h}_{d}hi, {t}_{d}hi)" for d in "xy")
        spread = f"sqrt({merged('x', 'x')}) * sqrt({merged('y', 'y')})"
        done.append(f"CASE WHEN {na} + {nb} >= {n} AND {varies} THEN {merged('x', 'y')} / nullif({spread}, 0D) END AS {name}")
    return out.selectExpr(*df.columns, *done)
