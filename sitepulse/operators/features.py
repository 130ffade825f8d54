"""Time-series features of the hourly table.

Lags, rolling statistics and differences are positional: they count the rows of a site, not the
hours. They all share one window specification, so the whole feature table costs one shuffle
and one sort. An hourly table has one row per site and hour, which bounds a
window partition by the length of the log (8,760 rows per year) however busy the site is. For
tables without such a bound, ``chunk_rows`` cuts every series into pieces of equal size.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .. import defaults
from ..functions.calendar import calendar_columns, cyclical_columns
from .ranks import with_row_index

_FRAME_ROWS = 6  # frames up to this length slide directly
_MAX_PIECES = 32  # more blocks than this per window cost more than they save


Group = str | tuple[str, ...]  # the column or columns that identify a series


def _series(group_col: Group, order_col: str) -> WindowSpec:
    keys = (group_col,) if isinstance(group_col, str) else group_col
    return Window.partitionBy(*keys).orderBy(order_col)


def add_temporal_features(
    df: DataFrame,
    ts_col: str = "hour",
    include_cyclical: bool = True,
    include_calendar: bool = True,
) -> DataFrame:
    """Date parts, flags and, optionally, cyclical encodings and the holiday placeholder."""
    ts = F.col(ts_col)
    columns = calendar_columns(ts)
    if include_cyclical:
        columns |= cyclical_columns(ts)
    if include_calendar:
        columns["is_holiday"] = F.lit(0)
    return df.withColumns(columns)


def add_time_features(df: DataFrame, ts_col: str = "hour") -> DataFrame:
    """``add_temporal_features`` with everything on."""
    return add_temporal_features(df, ts_col)


def add_lag_features(
    df: DataFrame,
    group_col: Group = "site_id",
    target: str = "sessions",
    lag_periods: Iterable[int] = defaults.LAG_PERIODS,
    order_col: str = "hour",
) -> DataFrame:
    """``lag_n``: the value n rows earlier in the same group."""
    series = _series(group_col, order_col)
    return df.withColumns({f"lag_{n}": F.lag(target, n).over(series) for n in lag_periods})


# Mergeable statistics of a run of rows: count, mean, squared deviations, minimum, maximum; and
# their values for a run without any value.
_BLOCK = {"_n": "0L", "_mean": "0D", "_m2": "0D", "_min": "NULL", "_max": "NULL"}


def _series_sql(group_col: Group, order_col: str) -> str:
    keys = (group_col,) if isinstance(group_col, str) else group_col
    return f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{order_col}`"


def _merged(size: int, pieces: int) -> dict[str, str]:
    """Statistics of adjacent blocks put together, deviations around the common mean."""
    if pieces == 1:
        return {name: f"{name}_{size}_0" for name in _BLOCK}
    parts = {name: [f"{name}_{size}_{i}" for i in range(pieces)] for name in _BLOCK}
    count = f"({' + '.join(parts['_n'])})"
    weighted = " + ".join(f"{n} * {m}" for n, m in zip(parts["_n"], parts["_mean"]))
    mean = f"coalesce(try_divide({weighted}, {count}), 0D)"
    shifts = [f"{n} * pow({m} - {mean}, 2)" for n, m in zip(parts["_n"], parts["_mean"])]
    return {
        "_n": count,
        "_mean": mean,
        "_m2": f"({' + '.join(parts['_m2'] + shifts)})",
        "_min": f"least({', '.join(parts['_min'])})",
        "_max": f"greatest({', '.join(parts['_max'])})",
    }


def _adjacent(df: DataFrame, series: str, size: int, pieces: int) -> DataFrame:
    """Beside each block of ``size`` rows, those found 1, 2, .. ``pieces`` - 1 lengths ago."""
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c not in _BLOCK],
        *[f"{name} AS {name}_{size}_0" for name in _BLOCK],
        *[
            f"lag({name}, {i * size}, {default}) OVER ({series}) AS {name}_{size}_{i}"
            for i in range(1, pieces)
            for name, default in _BLOCK.items()
        ],
    )


def _with_past_block(df: DataFrame, target: str, series: str, size: int) -> DataFrame:
    """Add the statistics of the ``size`` rows before each row, themselves built from blocks."""
    part = min(
        (d for d in range(2, size) if size % d == 0), key=lambda d: d + size // d, default=size
    )
    if part == size or size <= _FRAME_ROWS:
        past = f"OVER ({series} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
        return df.selectExpr(
            "*",
            f"count(`{target}`) {past} AS _n",
            f"coalesce(avg(`{target}`) {past}, 0D) AS _mean",
            f"coalesce(var_pop(`{target}`) {past} * count(`{target}`) {past}, 0D) AS _m2",
            f"min(`{target}`) {past} AS _min",
            f"max(`{target}`) {past} AS _max",
        )
    pieces = size // part
    parts = _adjacent(_with_past_block(df, target, series, part), series, part, pieces)
    kept = [f"`{c}`" for c in df.columns]
    return parts.selectExpr(*kept, *[f"{sql} AS {n}" for n, sql in _merged(part, pieces).items()])


def add_rolling_features(
    df: DataFrame,
    group_col: Group = "site_id",
    target: str = "sessions",
    windows: Iterable[int] = defaults.ROLLING_WINDOWS,
    include_std: bool = True,
    order_col: str = "hour",
) -> DataFrame:
    """Mean, deviation, minimum and maximum of the n rows before the current one.

    A sliding frame is evaluated anew for every row, at a cost of its length. So only a
    short frame slides; a day is put together from the short blocks found some rows earlier and
    a week from seven days, all in the same shuffle and sort. Windows without a useful common
    divisor slide on their own.
    """
    windows = list(windows)
    series = _series_sql(group_col, order_col)
    size = gcd(*windows)
    pieces = max(windows) // size
    columns = {}
    if pieces > _MAX_PIECES:
        table = df
        for n in windows:
            past = f"OVER ({series} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            columns[f"rmean_{n}"] = f"avg(`{target}`) {past}"
            columns[f"rstd_{n}"] = f"stddev_samp(`{target}`) {past}"
            columns[f"rmin_{n}"] = f"min(`{target}`) {past}"
            columns[f"rmax_{n}"] = f"max(`{target}`) {past}"
    else:
        table = _adjacent(_with_past_block(df, target, series, size), series, size, pieces)
        for n in windows:
            run = _merged(size, n // size)
            columns[f"rmean_{n}"] = f"if({run['_n']} > 0, {run['_mean']}, NULL)"
            columns[f"rstd_{n}"] = f"if({run['_n']} > 1, sqrt({run['_m2']} / ({run['_n']} - 1)), NULL)"
            columns[f"rmin_{n}"] = run["_min"]
            columns[f"rmax_{n}"] = run["_max"]
    if not include_std:
        columns = {name: sql for name, sql in columns.items() if not name.startswith("rstd_")}
    kept = [f"`{c}`" for c in df.columns]
    return table.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in columns.items()])


def add_difference_features(
    df: DataFrame,
    group_col: Group = "site_id",
    target: str = "sessions",
    periods: Iterable[int] = defaults.DIFFERENCE_PERIODS,
    order_col: str = "hour",
) -> DataFrame:
    """``diff_n``: the value minus the value n rows earlier."""
    series = _series(group_col, order_col)
    return df.withColumns(
        {f"diff_{n}": F.col(target) - F.lag(target, n).over(series) for n in periods}
    )


def add_interaction_features(
    df: DataFrame, feature_pairs: Iterable[tuple[str, str]] = defaults.INTERACTION_PAIRS
) -> DataFrame:
    """``a_x_b``: products of the pairs whose columns are both there."""
    return df.withColumns(
        {
            f"{a}_x_{b}": F.col(a) * F.col(b)
            for a, b in feature_pairs
            if a in df.columns and b in df.columns
        }
    )


def _with_history(
    df: DataFrame, group_col: str, order_col: str, reach: int, chunk_rows: int
) -> DataFrame:
    """Cut the table, sorted by series and time, into chunks of ``chunk_rows`` rows.

    The last ``reach`` rows of a chunk are repeated in the next one, marked ``_history``, so
    that each row finds the rows it looks back on in its own ``_chunk``.
    """
    if chunk_rows < reach:
        raise ValueError(f"chunk_rows must be at least {reach}, the longest look-back")
    indexed = with_row_index(df, group_col, order_col)
    index = F.col("row_index")
    chunk = F.floor(index / chunk_rows)
    here = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_history"))
    onward = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_history"))
    needed = index % chunk_rows >= chunk_rows - reach
    copies = F.when(needed, F.array(here, onward)).otherwise(F.array(here))
    return indexed.select(*df.columns, F.inline(copies))


def create_feature_table(
    df: DataFrame,
    ts_col: str = "hour",
    group_col: str = "site_id",
    target: str = "sessions",
    include_interactions: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """All features with their defaults.

    With ``chunk_rows``, no task handles more than that many rows of a series (plus the
    longest look-back) at a time, at the price of a sorted copy of the table.
    ``group_col`` and ``ts_col`` then have to identify a row.
    """
    series: Group = group_col
    rows = df
    if chunk_rows is not None:
        reach = max(*defaults.LAG_PERIODS, *defaults.ROLLING_WINDOWS, *defaults.DIFFERENCE_PERIODS)
        rows = _with_history(df, group_col, ts_col, reach, chunk_rows)
        series = ("_chunk", group_col)
    # Differences next to the lags share their window pass. The calendar columns come after the
    # sort, so that they are not shuffled, but before the last pass, so that the code generated
    # for the final columns stays small enough to be compiled.
    table = (
        rows.transform(add_lag_features, series, target, order_col=ts_col)
        .transform(add_difference_features, series, target, order_col=ts_col)
        .transform(add_temporal_features, ts_col)
        .transform(add_rolling_features, series, target, order_col=ts_col)
    )
    if chunk_rows is not None:
        table = table.filter(~F.col("_history")).drop("_chunk", "_history")
    added = [c for c in table.columns if c not in df.columns]
    looking_back = ("lag_", "rmean_", "rstd_", "rmin_", "rmax_", "diff_")
    calendar = [c for c in added if not c.startswith(looking_back)]
    differences = [c for c in added if c.startswith("diff_")]
    others = [c for c in added if c not in (*calendar, *differences)]
    table = table.select(*df.columns, *calendar, *others, *differences)
    return add_interaction_features(table) if include_interactions else table


def model_feature_names(
    lag_periods: Iterable[int] = defaults.LAG_PERIODS,
    windows: Iterable[int] = defaults.ROLLING_WINDOWS,
) -> list[str]:
    """The model inputs, in order. Differences, months and interactions are not among them."""
    rolling = [f"{stat}_{n}" for n in windows for stat in ("rmean", "rstd", "rmin", "rmax")]
    return [*defaults.MODEL_CALENDAR_FEATURES, *[f"lag_{n}" for n in lag_periods], *rolling]


def align_features(df: DataFrame, names: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """The training columns in training order; absent ones are 0.0, others are dropped."""
    aligned = [
        (F.col(n).cast("double") if n in df.columns else F.lit(0.0)).alias(n) for n in names
    ]
    kept = [F.col(c) for c in keep if c not in names]
    return df.select(*kept, *aligned)
