"""Positional lags and leads, momentum, volatility and rolling regressions along an entity's own rows.

All of them share one window, (permno ordered by date_eom), so a plan that stacks them sorts once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import month_number

ENTITY, TIME = "permno", "date_eom"


def along(entity: str = ENTITY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def with_leads(rows: DataFrame, column: str, names: dict[str, int]) -> DataFrame:
    """``column`` some rows ahead within each entity: {new name: rows}."""
    return rows.withColumns({n: F.lead(column, h).over(along()) for n, h in names.items()})


def with_lags(rows: DataFrame, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """{new name: (column, rows back)}; positional, so a gap shifts the value and does not make it null."""
    return rows.withColumns({n: F.lag(c, k).over(along()) for n, (c, k) in lags.items()})


def momentum(ret: str = "ret", far: int = 12, near: int = 2) -> Column:
    """Compounded return of the rows t-far+1 ... t-near; null returns count as 0; null for the first ``far`` rows."""
    w = along()
    grown = F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w.rowsBetween(-far + 1, -near))
    return F.when(F.row_number().over(w) > far, grown - 1)


def rolling_sd(x: str = "ret", size: int = 12) -> Column:
    """Deviation over the last ``size`` rows, this one included; nulls inside are skipped; null for the first rows."""
    w = along()
    return F.when(F.row_number().over(w) >= size, F.stddev_samp(x).over(w.rowsBetween(1 - size, 0)))


def log_lag(x: str = "mktcap", k: int = 1) -> Column:
    """Logarithm of the value ``k`` rows back; null where that isn't positive."""
    return F.log(F.lag(x, k).over(along()))


def slide(aggregate: Column, before: int, after: int = 0, complete: int | None = None) -> Column:
    """``aggregate`` over rows -before ... after, null where fewer than ``complete`` rows exist. ``after`` may be negative."""
    frame = along().rowsBetween(-before, after)
    value = aggregate.over(frame)
    return value if complete is None else F.when(F.count(F.lit(1)).over(frame) >= complete, value)


def fill_forward(x: str) -> Column:
    """The last known value, this row's included."""
    return F.last(x, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))


#: a pivot smaller than this share of its own running sum of squares is singular
PIVOT_TOLERANCE = 1e-12


def _least_squares(rows: DataFrame, frame: tuple[str, str], y: str, xs: tuple[str, ...], names: dict[str, str], keep: str) -> DataFrame:
    """Intercept and slopes over a window frame, given as the rows up to its end and those before it (two OVER clauses): running sums of products,
    each row added once, then an unrolled LDL' solution.

    Values are centred by the entity's own means first, so that the differences of sums lose no digits; the intercept is moved back.
    ``names`` maps ``alpha``, each of ``xs``, ``rsq`` and ``n_obs`` to output columns. Where ``keep`` (over ``_n``, the number of
    complete rows) fails, all but n_obs are null; so they are where a pivot is singular and for the coefficients that need it. Expressions are written as SQL, a stage
    in one projection, as planning would otherwise cost more than the work on a small table.
    """
    until, before = frame
    size, columns, values = len(xs) + 1, [f"`{c}`" for c in rows.columns], [y, *xs]
    ok = " AND ".join(f"`{v}` IS NOT NULL" for v in values)
    centre = [f"coalesce(avg(CASE WHEN {ok} THEN CAST(`{v}` AS DOUBLE) END) OVER (PARTITION BY {ENTITY}), 0D) AS _c{k}" for k, v in enumerate(values)]
    out = rows.selectExpr(*columns, *centre)
    centres = [f"_c{k}" for k in range(size)]
    out = out.selectExpr(*columns, *centres, f"CASE WHEN {ok} THEN 1D END AS _u0", *[f"CASE WHEN {ok} THEN CAST(`{v}` AS DOUBLE) - _c{k} END AS _v{k}" for k, v in enumerate(values)])
    unit = ["_u0", *[f"_v{k + 1}" for k in range(len(xs))]]
    products = {f"p{i}_{j}": f"{unit[i]} * {unit[j]}" for i in range(size) for j in range(i, size)} | {f"q{i}": f"{unit[i]} * _v0" for i in range(size)} | {"yy": "_v0 * _v0"}
    out = out.selectExpr(*columns, *centres, *[f"{p} AS _{n}" for n, p in products.items()])
    out = out.selectExpr(*columns, *centres, *[f"sum(_{n}) OVER ({w}) AS _{k}_{n}" for n in products for k, w in (("a", until), ("b", before))])
    out = out.selectExpr(*columns, *centres, *[f"_a_p{j}_{j} AS _t{j}" for j in range(size)], *[f"_a_{n} - coalesce(_b_{n}, 0D) AS {n}" for n in products])
    # pivots, columns of L and the right side, one after the other; each name is used by those below it
    stage = {"_n": "CAST(coalesce(round(p0_0), 0D) AS BIGINT)"}
    for j in range(size):
        stage[f"_w{j}"] = f"p{j}_{j}" + "".join(f" - _l{j}_{k} * _l{j}_{k} * _d{k}" for k in range(j))
        stage[f"_d{j}"] = f"CASE WHEN _w{j} > {PIVOT_TOLERANCE}D * _t{j} THEN _w{j} END"
        for i in range(j + 1, size):
            stage[f"_l{i}_{j}"] = f"(p{j}_{i}" + "".join(f" - _l{i}_{k} * _l{j}_{k} * _d{k}" for k in range(j)) + f") / _d{j}"
        stage[f"_z{j}"] = f"q{j}" + "".join(f" - _l{j}_{k} * _z{k}" for k in range(j))
    for i in reversed(range(size)):
        stage[f"_b{i}"] = f"_z{i} / _d{i}" + "".join(f" - _l{k}_{i} * _b{k}" for k in range(i + 1, size))
    stage["_total"] = "yy - q0 * q0 / nullif(_n, 0)"
    stage["_rest"] = "yy" + "".join(f" - _b{i} * q{i}" for i in range(size))
    results = {"alpha": "_b0 + _c0" + "".join(f" - _b{i} * _c{i}" for i in range(1, size)), **{x: f"_b{i + 1}" for i, x in enumerate(xs)}, "rsq": "CASE WHEN _total > 0 THEN 1 - _rest / _total END"}
    out = _in_stages(out, stage)
    # a generator of one row: later filters on the results stay above it, and aren't spelled out in terms of the moments
    fitted = ", ".join([f"'{names[k]}', CASE WHEN {keep} THEN {c} END" for k, c in results.items()] + [f"'{names['n_obs']}', _n"])
    return out.selectExpr(*columns, f"inline(array(named_struct({fitted})))")


def _in_stages(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """``rows`` with the SQL expressions ``named``, which may use names above them: as many projections as the longest chain of uses, so that none
    is spelled out in terms of another's expression."""
    depth: dict[str, int] = {}
    for name, text in named.items():
        depth[name] = 1 + max((depth[w] for w in re.findall(r"\w+", text) if w in depth), default=-1)
    for level in range(max(depth.values()) + 1):
        rows = rows.selectExpr("*", *[f"{text} AS {name}" for name, text in named.items() if depth[name] == level])
    return rows


def rolling_ols(rows: DataFrame, y: str, xs: tuple[str, ...], names: dict[str, str], window: int = 36, lag: int = 2, min_obs: int = 24) -> DataFrame:
    """Regression over the ``window`` rows that end ``lag`` rows back.

    The whole window must exist, ``min_obs`` complete rows must be in it. n_obs is null where the window doesn't exist, and the
    count where only the observations are too few.
    """
    numbered = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {ENTITY} ORDER BY {TIME}) AS _row")
    frame = tuple(f"PARTITION BY {ENTITY} ORDER BY {TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING" for k in (lag, window + lag))
    out = _least_squares(numbered, frame, y, xs, names, f"_row >= {window + lag} AND _n >= {min_obs}")
    return out.withColumn(names["n_obs"], F.when(F.col("_row") >= window + lag, F.col(names["n_obs"]))).drop("_row")


def calendar_ols(rows: DataFrame, y: str, xs: tuple[str, ...], names: dict[str, str], months: int = 36, min_obs: int = 24) -> DataFrame:
    """Regression over the rows of the ``months`` calendar months before this one."""
    numbered = rows.withColumn("_month", month_number(TIME))
    frame = tuple(f"PARTITION BY {ENTITY} ORDER BY _month RANGE BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING" for k in (1, months + 1))
    return _least_squares(numbered, frame, y, xs, names, f"_n >= {min_obs}").drop("_month")
