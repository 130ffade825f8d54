"""The registered queries as SQL over the given tables."""

from __future__ import annotations

from .. import defaults
from ..operators.features import model_feature_names
from ..operators.profile import family_columns_of
from ..sources.dims import SITE_COORDINATES, SITE_STATES
from .catalog import BOX_COLUMNS, HISTOGRAM_COLUMNS, SUMMARY_DAYS

SERIES = "OVER (PARTITION BY site_id ORDER BY hour)"


def _past(n: int) -> str:
    return f"OVER (PARTITION BY site_id ORDER BY hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


STATES = (
    "states(site_id, state) AS (VALUES "
    + ", ".join(f"({s}, '{n}')" for s, n in SITE_STATES.items())
    + ")"
)
PLACES = (
    "places(site_id, lat, lon, name) AS (VALUES "
    + ", ".join(
        f"({s}, {lat}::DOUBLE, {lon}::DOUBLE, '{n}')" for s, (lat, lon, n) in SITE_COORDINATES.items()
    )
    + ")"
)
DIRTY = """dirty AS (
  SELECT user_id % 10 + 1 AS site_id, date_trunc('hour', ts) AS timestamp,
         CASE WHEN event_type <> 'error' THEN value - 20 END AS sessions, event_id
  FROM events)"""


def _hourly(sites: int = 10) -> str:
    return f"""{STATES},
sessions AS (
  SELECT user_id % {sites} + 1 AS site_id, ts AS timestamp, value AS sessions FROM events),
hourly AS (
  SELECT s.site_id, coalesce(d.state, 'Unknown') AS state, date_trunc('hour', timestamp) AS hour,
         coalesce(sum(sessions), 0) AS sessions, count(sessions) AS session_count,
         avg(sessions) AS avg_sessions, min(timestamp) AS first_timestamp
  FROM sessions s LEFT JOIN states d ON d.site_id = s.site_id
  GROUP BY 1, 2, 3)"""


CALENDAR = {
    "hour_of_day": "CAST(hour(hour) AS INTEGER)",
    "day_of_week": "CAST(isodow(hour) - 1 AS INTEGER)",
    "day_of_month": "CAST(day(hour) AS INTEGER)",
    "month": "CAST(month(hour) AS INTEGER)",
    "quarter": "CAST(quarter(hour) AS INTEGER)",
    "year": "CAST(year(hour) AS INTEGER)",
    "is_weekend": "CAST(isodow(hour) >= 6 AS INTEGER)",
    "is_monday": "CAST(isodow(hour) = 1 AS INTEGER)",
    "is_friday": "CAST(isodow(hour) = 5 AS INTEGER)",
    "is_business_hours": "CAST(hour(hour) BETWEEN 9 AND 17 AND isodow(hour) <= 5 AS INTEGER)",
    "is_morning_peak": "CAST(hour(hour) BETWEEN 7 AND 9 AS INTEGER)",
    "is_evening_peak": "CAST(hour(hour) BETWEEN 17 AND 19 AS INTEGER)",
    "hour_sin": "sin(2 * pi() * hour(hour) / 24)",
    "hour_cos": "cos(2 * pi() * hour(hour) / 24)",
    "day_sin": "sin(2 * pi() * (isodow(hour) - 1) / 7)",
    "day_cos": "cos(2 * pi() * (isodow(hour) - 1) / 7)",
    "month_sin": "sin(2 * pi() * month(hour) / 12)",
    "month_cos": "cos(2 * pi() * month(hour) / 12)",
    "is_holiday": "CAST(0 AS INTEGER)",
}
LAGS = {f"lag_{n}": f"lag(sessions, {n}) {SERIES}" for n in defaults.LAG_PERIODS}
ROLLING = {
    f"{name}_{n}": f"{sql}(sessions) {_past(n)}"
    for n in defaults.ROLLING_WINDOWS
    for name, sql in (
        ("rmean", "avg"),
        ("rstd", "stddev_samp"),
        ("rmin", "min"),
        ("rmax", "max"),
    )
}
DIFFERENCES = {
    f"diff_{n}": f"sessions - lag(sessions, {n}) {SERIES}" for n in defaults.DIFFERENCE_PERIODS
}
INTERACTIONS = {f"{a}_x_{b}": f"{a} * {b}" for a, b in defaults.INTERACTION_PAIRS}
FLOATS = {
    "sessions", "avg_sessions", *LAGS, *ROLLING, *DIFFERENCES, "lag_1_x_hour_of_day",
    *[c for c in CALENDAR if c.endswith(("_sin", "_cos"))],
}
BASE = ("site_id", "state", "hour", "sessions", "session_count", "avg_sessions", "first_timestamp")
FEATURES = {**CALENDAR, **LAGS, **ROLLING, **DIFFERENCES}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _features(sites: int = 10) -> str:
    return f"""{_hourly(sites)},
features AS (SELECT *, {_columns(FEATURES)} FROM hourly)"""


def _r(*names: str) -> str:
    """Select names, doubles rounded."""
    return ", ".join(f"round(CAST({n} AS DECIMAL(28, 9)), 6)::DOUBLE AS {n}" if n in FLOATS else n for n in names)


def _with(ctes: str, query: str) -> str:
    return f"WITH {ctes}\n{query}"


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*BASE, *FEATURES))
TRAINING = f"""{_features()},
training AS (SELECT * FROM features WHERE {COMPLETE})"""

NAIVE = f"""{_hourly()},
lagged AS (SELECT *, lag(sessions) {SERIES} AS predicted FROM hourly),
naive AS (
  SELECT site_id, hour, date_trunc('day', hour)::TIMESTAMP AS timestamp, sessions AS actual, predicted
  FROM lagged WHERE predicted IS NOT NULL)"""

METRIC_COLUMNS = """avg(abs(predicted - actual)) AS mae,
  sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
  avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape,
  CASE WHEN var_pop(actual) <> 0
       THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))
       ELSE 0 END AS r2,
  count(*) AS sample_size"""
METRIC_ROUNDED = "round(CAST(mae AS DECIMAL(28, 9)), 6)::DOUBLE AS mae, round(CAST(rmse AS DECIMAL(28, 9)), 6)::DOUBLE AS rmse, round(CAST(mape AS DECIMAL(28, 9)), 6)::DOUBLE AS mape, round(CAST(r2 AS DECIMAL(28, 9)), 6)::DOUBLE AS r2, sample_size"

RECORDS = f"""{NAIVE},
records AS (SELECT timestamp, {METRIC_COLUMNS} FROM naive GROUP BY timestamp)"""


def _by_metric(source: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{m}' AS metric, {m} AS value FROM {source}"
        for m in ("mae", "rmse", "mape", "r2")
    )


DEGRADED = f"""{RECORDS},
early AS (SELECT {METRIC_COLUMNS} FROM naive WHERE hour < TIMESTAMP '2024-01-16'),
baseline AS ({_by_metric("early", "1 AS one")}),
long AS ({_by_metric("records", "timestamp")}),
compared AS (
  SELECT timestamp, metric, b.value AS baseline, l.value AS current,
         CASE WHEN metric = 'r2' THEN b.value - l.value ELSE l.value - b.value END
           / nullif(b.value, 0) AS degradation
  FROM long l JOIN baseline b USING (metric)),
degraded AS (
  SELECT timestamp, metric, baseline, current, degradation * 100 AS degradation_pct
  FROM compared WHERE degradation > 0.1)"""


def _trend(source: str) -> str:
    """Trend per metric of ``source``; the p-value is the trigonometric series for Student's t."""
    return f"""numbered AS (
  SELECT *, row_number() OVER (ORDER BY timestamp, mae, rmse, mape, r2) - 1 AS idx FROM {source}),
points AS ({_by_metric("numbered", "idx")}),
fits AS (
  SELECT metric, count(value) AS n, regr_slope(value, idx) AS slope,
         regr_sxy(value, idx) AS sxy, regr_sxx(value, idx) AS sxx, regr_syy(value, idx) AS syy
  FROM points WHERE value IS NOT NULL GROUP BY metric),
angles AS (
  SELECT *, n - 2 AS df, sxy / sqrt(sxx * syy) AS r FROM fits),
series AS (
  SELECT *, atan(abs(r) * sqrt(df / ((1 - r) * (1 + r))) / sqrt(df)) AS theta FROM angles),
central AS (
  SELECT *, CASE WHEN df % 2 = 1 THEN
      2 / pi() * (theta + sin(theta) * list_sum(list_transform(range(1, df - 1, 2),
        lambda k: sqrt(pi()) / 2 * exp(lgamma((k + 1) / 2) - lgamma(k / 2 + 1)) * cos(theta) ** k)))
    ELSE
      sin(theta) * list_sum(list_transform(range(0, df - 1, 2),
        lambda k: exp(lgamma((k + 1) / 2) - lgamma(k / 2 + 1)) / sqrt(pi()) * cos(theta) ** k))
    END AS inside
  FROM series),
trends AS (
  SELECT metric, n, slope, greatest(1 - inside, 0) AS p_value,
         CASE WHEN 1 - inside > 0.05 THEN 'stable' WHEN slope > 0 THEN 'increasing'
              ELSE 'decreasing' END AS trend
  FROM central)"""


def _long(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )


# Both samples in long form: feature, value, is_ref.
def _two_sample(values: str) -> str:
    return f"""samples AS ({values}),
sizes AS (
  SELECT feature, sum(is_ref) AS n_ref, sum(1 - is_ref) AS n_new FROM samples
  WHERE value IS NOT NULL GROUP BY feature),
ties AS (
  SELECT feature, value, sum(is_ref) AS ref, sum(1 - is_ref) AS new FROM samples
  WHERE value IS NOT NULL GROUP BY feature, value),
running AS (
  SELECT *, sum(ref) OVER w AS ref_to, sum(new) OVER w AS new_to, ref + new AS t FROM ties
  WINDOW w AS (PARTITION BY feature ORDER BY value)),
tests AS (
  SELECT feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_new AS BIGINT) AS n_new,
         max(abs(ref_to / n_ref - new_to / n_new)) AS ks_statistic,
         sum(ref * (ref_to + new_to - t + (t + 1) / 2))
           - CAST(n_ref AS DOUBLE) * (n_ref + 1) / 2 AS mw_statistic,
         sum(CAST(t AS DOUBLE) * t * t - t) AS tie_sum
  FROM running JOIN sizes USING (feature) GROUP BY feature, n_ref, n_new)"""


VALUE_TESTS = _two_sample(
    "SELECT 'value' AS feature, value, CAST(ts < TIMESTAMP '2024-01-16' AS INTEGER) AS is_ref FROM events"
)
DRIFT_COLUMNS = [
    "site_id", "sessions", "session_count", "avg_sessions", "hour_of_day", "is_weekend",
    "day_of_month",
]
HOURLY_TESTS = f"""{_features()},
{_two_sample(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
    "CAST(hour < TIMESTAMP '2024-01-16' AS INTEGER) AS is_ref FROM features"
    for c in DRIFT_COLUMNS
))},
effective AS (
  SELECT *, round(n_ref * n_new / (n_ref + n_new)) AS size,
         n_ref * n_new / 12.0 * ((n_ref + n_new + 1)
           - tie_sum / (CAST(n_ref + n_new AS DOUBLE) * (n_ref + n_new - 1))) AS variance
  FROM tests WHERE n_new >= 30 AND n_ref > 0),
scaled AS (
  SELECT *, sqrt(size) * ks_statistic + 1 / (6 * sqrt(size))
           + (sqrt(size) * ks_statistic - 1) / (4 * size) AS x,
         (abs(mw_statistic - n_ref * n_new / 2.0) - 0.5) / sqrt(variance) AS z
  FROM effective),
flagged AS (
  SELECT feature, n_ref, n_new, ks_statistic, mw_statistic,
         2 * list_sum(list_transform(range(1, 101), lambda k: (-1) ** (k - 1) * exp(-2 * k * k * x * x)))
           < 0.05 AS ks_drift,
         z > 1.959963984540054 AS mw_drift
  FROM scaled),
report AS (SELECT *, ks_drift OR mw_drift AS drift_detected FROM flagged),
summary AS (
  SELECT coalesce(bool_or(drift_detected), FALSE) AS drift_detected,
         CAST(8 AS INTEGER) AS total_features_tested,
         count(CASE WHEN drift_detected THEN 1 END) AS features_with_drift,
         coalesce(string_agg(CASE WHEN drift_detected THEN feature END, ', ' ORDER BY feature), '')
           AS drifted_features,
         count(CASE WHEN drift_detected THEN 1 END) * 100.0::DOUBLE / 8 AS drift_percentage
  FROM report)"""

REQUESTS = f"""{_hourly()},
requests AS (
  SELECT site_id, strftime(hour, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         {_columns({c: CALENDAR[c] for c in ("hour_of_day", "day_of_week", "is_weekend", "hour_sin", "hour_cos")})},
         lag(sessions, 1) {SERIES} AS lag_1, lag(sessions, 24) {SERIES} AS lag_24,
         avg(sessions) {_past(24)} AS rmean_24
  FROM hourly)"""
BAD_REQUESTS = f"""{REQUESTS},
bad AS (
  SELECT site_id - 1 AS site_id,
         CASE site_id WHEN 3 THEN 'not-a-timestamp'
              WHEN 4 THEN replace(timestamp, '2024-01', '2024-13')
              WHEN 5 THEN '2024-01-32' || substr(timestamp, 11)
              WHEN 6 THEN substr(timestamp, 1, 10) ELSE timestamp END AS timestamp,
         site_id IN (3, 4, 5) AS bad_time,
         hour_of_day + 2 AS hour_of_day, day_of_week + 1 AS day_of_week,
         is_weekend * 2 AS is_weekend, CASE WHEN site_id <> 7 THEN hour_sin END AS hour_sin,
         hour_cos * 1.5 AS hour_cos, lag_1 - 20 AS lag_1
  FROM requests)"""


LOADED = """SELECT f.site_id, timestamp, coalesce(state, 'Unknown') AS state,
  CASE WHEN sessions < 0 THEN 0.0::DOUBLE ELSE round(CAST(sessions AS DECIMAL(28, 9)), 6)::DOUBLE END AS sessions
FROM (SELECT * FROM dirty {} QUALIFY row_number() OVER (PARTITION BY site_id, timestamp ORDER BY event_id) = 1) f
LEFT JOIN states d ON d.site_id = f.site_id"""
REQUEST_SCORES = (
    "SELECT site_id, strftime(hour, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, '1.0.0' AS model_version, "
    "TRUE AS has_band FROM hourly"
)


def _correlation(a: str, b: str) -> str:
    """Pearson over complete pairs; NULL where one side is constant."""
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    constant = f"min({a}) {both} = max({a}) {both} OR min({b}) {both} = max({b}) {both}"
    return f"CASE WHEN {constant} THEN NULL ELSE corr({a}, {b}) END"


def _pairs(pairs: list[tuple[str, str]], labels: tuple[str, ...]) -> str:
    rows = []
    for pair in pairs:
        named = ", ".join(f"'{v}' AS {label}" for v, label in zip(pair, labels))
        rows.append(f"SELECT {named}, round(CAST({_correlation(*pair)} AS DECIMAL(28, 9)), 6)::DOUBLE AS correlation FROM features")
    return " UNION ALL ".join(rows)


NUMERIC = ["session_count", "avg_sessions", *FEATURES]
TARGET_PAIRS = [(c, "sessions") for c in NUMERIC]
MATRIX_COLUMNS = family_columns_of(["sessions", *NUMERIC])
MATRIX_PAIRS = [
    (a, b) for i, a in enumerate(MATRIX_COLUMNS) for b in MATRIX_COLUMNS[i + 1 :]
]


def _split(order: str, sizes: str, label: str) -> str:
    return f"""{TRAINING},
indexed AS (
  SELECT site_id, hour, sessions, row_number() OVER (ORDER BY {order}) - 1 AS row_index,
         count(*) OVER () AS row_total FROM training),
sized AS (SELECT *, {sizes} FROM indexed)
SELECT {_r("site_id", "hour", "sessions")}, row_index, row_total, {label} AS split FROM sized"""


THREE_WAY = """CASE WHEN row_index < row_total - n_test - n_val THEN 'train'
  WHEN row_index < row_total - n_test THEN 'validation' ELSE 'test' END"""


def _quantiles(names: dict[str, float]) -> str:
    return ", ".join(f"round(CAST(quantile_cont(value, {p}) AS DECIMAL(28, 9)), 6)::DOUBLE AS {n}" for n, p in names.items())


def oracle_sql() -> dict[str, str]:
    """SQL by query name. Queries without an entry fit a model."""
    day = "date_trunc('day', hour)"
    latest = "(SELECT date_trunc('day', max(hour)) FROM hourly)"
    pct = "round((({0}) / nullif({1}, 0) - 1) * 100, 1)"
    by_time = _split(
        "hour, site_id",
        "CAST(floor(row_total * 0.2::DOUBLE) AS BIGINT) AS n_test, CAST(floor(row_total * 0.1::DOUBLE) AS BIGINT) AS n_val",
        THREE_WAY,
    )
    sql = {
        "load_sessions": _with(
            f"{STATES}, s AS (SELECT user_id % 25 + 1 AS site_id, ts AS timestamp, value AS sessions, event_id FROM events), "
            "firsts AS (SELECT *, row_number() OVER (PARTITION BY site_id, timestamp ORDER BY event_id) AS copy FROM s)",
            "SELECT f.site_id, timestamp, round(CAST(greatest(sessions, 0) AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions, "
            "coalesce(state, 'Unknown') AS state FROM firsts f LEFT JOIN states d ON d.site_id = f.site_id WHERE copy = 1",
        ),
        "load_sessions_csv": _with(f"{STATES}, {DIRTY}", LOADED.format("WHERE sessions IS NOT NULL")),
        "load_sessions_parquet": _with(f"{STATES}, {DIRTY}", LOADED.format("")),
        "unreadable_sessions": _with(
            DIRTY,
            "SELECT 'sessions' AS columns, site_id || ',' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || ',n/a,' || event_id "
            "AS text FROM dirty WHERE sessions IS NULL",
        ),
        "validate_report": _with(
            DIRTY,
            "SELECT count(*) AS total_rows, count(*) - count(site_id) AS null_site_id, "
            "count(*) - count(timestamp) AS null_timestamp, count(*) - count(sessions) AS null_sessions, "
            "count(CASE WHEN sessions < 0 THEN 1 END) AS negative_sessions FROM dirty",
        ),
        "dedupe_sessions": _with(
            DIRTY,
            "SELECT site_id, timestamp, round(CAST(sessions AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions, event_id FROM dirty "
            "QUALIFY row_number() OVER (PARTITION BY site_id, timestamp ORDER BY event_id) = 1",
        ),
        "clip_sessions": _with(
            DIRTY,
            "SELECT site_id, timestamp, CASE WHEN sessions < 0 THEN 0.0::DOUBLE ELSE round(CAST(sessions AS DECIMAL(28, 9)), 6)::DOUBLE END AS sessions, event_id FROM dirty",
        ),
        "clean_sessions": _with(
            DIRTY,
            "SELECT site_id, timestamp, CASE WHEN sessions < 0 THEN 0.0::DOUBLE ELSE round(CAST(sessions AS DECIMAL(28, 9)), 6)::DOUBLE END AS sessions, event_id "
            "FROM dirty QUALIFY row_number() OVER (PARTITION BY site_id, timestamp ORDER BY event_id) = 1",
        ),
        "training_rows": _with(TRAINING, f"SELECT {_r(*BASE, *FEATURES)} FROM training"),
        "site_comparison": _with(
            _hourly(),
            f"SELECT {_r('site_id', 'hour', 'sessions')} FROM hourly "
            "WHERE site_id IN (SELECT DISTINCT site_id FROM hourly ORDER BY site_id LIMIT 3)",
        ),
        "add_state": _with(
            STATES,
            "SELECT e.user_id % 25 + 1 AS site_id, ts AS timestamp, round(CAST(value AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions, event_id, "
            "coalesce(state, 'Unknown') AS state FROM events e LEFT JOIN states d ON d.site_id = e.user_id % 25 + 1",
        ),
        "unmapped_sites": _with(
            STATES,
            "SELECT DISTINCT user_id % 25 + 1 AS site_id FROM events WHERE user_id % 25 + 1 NOT IN (SELECT site_id FROM states)",
        ),
        "station_status": _with(
            f"{_hourly()}, {PLACES}, latest AS (SELECT site_id, sessions FROM hourly WHERE hour = (SELECT max(hour) FROM hourly))",
            "SELECT CAST(p.site_id AS BIGINT) AS site_id, lat, lon, name, round(CAST(sessions AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions, "
            "CASE WHEN sessions > 0 THEN 'Active' ELSE 'Inactive' END AS status, "
            "CASE WHEN sessions > 0 THEN '#2ecc71' ELSE '#e74c3c' END AS color "
            "FROM places p LEFT JOIN latest l ON l.site_id = p.site_id",
        ),
        "new_sites": _with(
            _hourly(1000),
            f"SELECT count(*) AS new_sites FROM (SELECT site_id FROM hourly WHERE {day} = {latest} "
            f"EXCEPT SELECT site_id FROM hourly WHERE {day} = {latest} - INTERVAL 1 DAY)",
        ),
        "hourly_agg": _with(_hourly(25), f"SELECT {_r(*BASE)} FROM hourly"),
        "hourly_agg_nan": _with(
            _hourly().replace("value AS sessions", "CASE WHEN value < 50 THEN value END AS sessions"),
            f"SELECT {_r(*BASE)} FROM hourly",
        ),
        "hourly_agg_dirty": _with(
            f"{STATES}, {DIRTY}",
            "SELECT s.site_id, coalesce(d.state, 'Unknown') AS state, timestamp AS hour, "
            "round(CAST(coalesce(sum(sessions), 0) AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions, count(sessions) AS session_count, "
            "round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS avg_sessions, min(timestamp) AS first_timestamp "
            "FROM dirty s LEFT JOIN states d ON d.site_id = s.site_id GROUP BY 1, 2, 3",
        ),
        "data_summary": _with(
            DIRTY,
            'SELECT count(*) AS total_rows, count(DISTINCT site_id) AS unique_sites, min(timestamp) AS start, max(timestamp) AS "end", '
            "round(CAST(sum(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS total, round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean, round(CAST(stddev_samp(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS std, "
            "round(CAST(min(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS min, round(CAST(max(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS max, "
            "count(*) - count(site_id) AS null_site_id, count(*) - count(timestamp) AS null_timestamp, "
            "count(*) - count(sessions) AS null_sessions, round(CAST(quantile_cont(sessions, 0.5) AS DECIMAL(28, 9)), 6)::DOUBLE AS median FROM dirty",
        ),
        "temporal_features": _with(
            _features(), f"SELECT {_r('site_id', 'hour', *CALENDAR)} FROM features"
        ),
        "lag_features": _with(
            _features(), f"SELECT {_r('site_id', 'hour', 'sessions', *LAGS)} FROM features"
        ),
        "rolling_features": _with(
            _features(), f"SELECT {_r('site_id', 'hour', 'sessions', *ROLLING)} FROM features"
        ),
        "difference_features": _with(
            _features(), f"SELECT {_r('site_id', 'hour', 'sessions', *DIFFERENCES)} FROM features"
        ),
        "interaction_features": _with(
            f"{_features()}, crossed AS (SELECT *, {_columns(INTERACTIONS)} FROM features)",
            f"SELECT {_r('site_id', 'hour', *INTERACTIONS)} FROM crossed",
        ),
        "feature_table": _with(
            f"{_features()}, crossed AS (SELECT *, {_columns(INTERACTIONS)} FROM features)",
            f"SELECT {_r(*BASE, *FEATURES, *INTERACTIONS)} FROM crossed",
        ),
        "state_rollup": _with(
            _hourly(25),
            "SELECT state, count(DISTINCT site_id) AS total_stations, round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean_sessions, "
            "round(CAST(max(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS peak_sessions FROM hourly GROUP BY state",
        ),
        "state_hour_profile": _with(
            _hourly(),
            "SELECT state, "
            + ", ".join(
                f"round(CAST(avg(sessions) FILTER (WHERE hour(hour) = {h}) AS DECIMAL(28, 9)), 6)::DOUBLE AS h{h:02d}" for h in range(24)
            )
            + " FROM hourly GROUP BY state",
        ),
        "daily_by_state": _with(
            _hourly(),
            "SELECT CAST(hour AS DATE) AS date, state, round(CAST(sum(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS sessions FROM hourly "
            "WHERE CAST(hour AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2",
        ),
        "daily_total": _with(
            _hourly(),
            "SELECT CAST(hour AS DATE) AS date, round(CAST(sum(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS total_sessions FROM hourly GROUP BY 1",
        ),
        "demand_heatmap": _with(
            _hourly(),
            "SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, "
            + ", ".join(
                f'round(CAST(avg(sessions) FILTER (WHERE isodow(hour) = {i}) AS DECIMAL(28, 9)), 6)::DOUBLE AS "{name}"'
                for i, name in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), start=1)
            )
            + " FROM hourly GROUP BY 1",
        ),
        "peak_hours": _with(
            _hourly(),
            "SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean_sessions "
            "FROM hourly GROUP BY 1 ORDER BY avg(sessions) DESC, 1 LIMIT 5",
        ),
        "weekend_weekday": _with(
            f"{_hourly()}, means AS (SELECT avg(sessions) FILTER (WHERE isodow(hour) < 6) AS weekday_avg, "
            "avg(sessions) FILTER (WHERE isodow(hour) >= 6) AS weekend_avg FROM hourly)",
            "SELECT round(CAST(weekday_avg AS DECIMAL(28, 9)), 6)::DOUBLE AS weekday_avg, round(CAST(weekend_avg AS DECIMAL(28, 9)), 6)::DOUBLE AS weekend_avg, "
            "CASE WHEN weekend_avg > weekday_avg THEN 'weekends' ELSE 'weekdays' END AS busier FROM means",
        ),
        "overview_metrics": _with(
            f"""{_hourly()},
today AS (SELECT * FROM hourly WHERE {day} = {latest}),
before AS (SELECT * FROM hourly WHERE {day} = {latest} - INTERVAL 1 DAY),
t AS (SELECT sum(sessions) AS s, avg(sessions) AS m FROM today),
b AS (SELECT sum(sessions) AS s, avg(sessions) AS m FROM before),
peak AS (SELECT hour(hour) AS h, sum(sessions) AS s FROM today GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""",
            "SELECT (SELECT count(DISTINCT site_id) FROM hourly) AS active_sites, "
            "(SELECT count(*) FROM (SELECT site_id FROM today EXCEPT SELECT site_id FROM before)) AS new_sites, "
            f"CAST(trunc(t.s) AS BIGINT) AS sessions_today, {pct.format('t.s', 'b.s')} AS sessions_change_pct, "
            "round(CAST(peak.s AS DECIMAL(28, 9)), 6)::DOUBLE AS peak_sessions, CAST(peak.h AS INTEGER) AS peak_hour, "
            f"round(CAST(t.m * 100 AS DECIMAL(28, 9)), 6)::DOUBLE AS mean_sessions_x100, {pct.format('t.m', 'b.m')} AS mean_change_pct FROM t, b, peak",
        ),
        "feature_correlation": _with(
            _features(),
            "SELECT feature, correlation, coalesce(correlation > 0, FALSE) AS is_positive FROM ("
            + _pairs([(c, t) for c, t in TARGET_PAIRS], ("feature",))
            + ")",
        ),
        "correlation_matrix": _with(
            _features(), _pairs(MATRIX_PAIRS, ("feature_a", "feature_b"))
        ),
        "temporal_patterns": _with(
            _features(),
            " UNION ALL ".join(
                f"SELECT '{c}' AS pattern, {c} AS bucket, round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean_sessions FROM features GROUP BY {c}"
                for c in ("hour_of_day", "day_of_month", "month", "day_of_week")
            ),
        ),
        "histogram": _with(
            f"{_features()}, long AS ({_long('features', HISTOGRAM_COLUMNS)}), "
            "ranges AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 30 AS width FROM long GROUP BY feature), "
            "placed AS (SELECT feature, lo, width, least(coalesce(CAST(floor((value - lo) / nullif(width, 0)) AS INTEGER), 0), 29) AS bin "
            "FROM long JOIN ranges USING (feature))",
            "SELECT feature, CAST(bin AS INTEGER) AS bin, round(CAST(lo + bin * width AS DECIMAL(28, 9)), 6)::DOUBLE AS lower, "
            "round(CAST(lo + (bin + 1) * width AS DECIMAL(28, 9)), 6)::DOUBLE AS upper, count(*) AS count FROM placed GROUP BY feature, bin, lo, width",
        ),
        "box_stats": _with(
            f"{_hourly()}, long AS ({_long('hourly', BOX_COLUMNS)})",
            f"SELECT feature, round(CAST(min(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS min, {_quantiles({'q25': 0.25, 'median': 0.5, 'q75': 0.75})}, "
            "round(CAST(max(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS max FROM long GROUP BY feature",
        ),
        "state_metrics": _with(
            f"{_hourly()}, daily AS (SELECT avg(sessions) AS m FROM hourly GROUP BY {day})",
            "SELECT (SELECT count(DISTINCT state) FROM hourly) AS total_states, "
            "(SELECT count(DISTINCT site_id) FROM hourly) AS active_stations, "
            "(SELECT max(hour) FROM hourly) AS latest_hour, "
            "(SELECT round(CAST(avg(sessions) AS DECIMAL(28, 9)), 6)::DOUBLE FROM hourly WHERE hour = (SELECT max(hour) FROM hourly)) AS sessions_at_latest_hour, "
            "(SELECT round(CAST(avg(m) AS DECIMAL(28, 9)), 6)::DOUBLE FROM daily) AS avg_daily_sessions",
        ),
        "site_tail": _with(
            _hourly(),
            f"SELECT {_r('site_id', 'hour', 'sessions')} FROM hourly "
            "QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY hour DESC) <= 168",
        ),
        "time_split": f"WITH {by_time}",
        # A model that is read back predicts exactly the same.
        "saved_model": "SELECT site_id, hour, 0::DOUBLE AS prediction_gap "
        f"FROM (WITH {by_time}) WHERE split = 'test'",
        "prediction_rows": f"SELECT site_id, hour, sessions AS actual, TRUE AS is_scored FROM (WITH {by_time}) WHERE split = 'test'",
        "comparison_actuals": f"SELECT site_id, hour, sessions FROM (WITH {by_time}) WHERE split = 'test'",
        "importance_names": f"SELECT unnest({model_feature_names()}) AS feature, TRUE AS is_share",
        "fold_scores": f"SELECT CAST(k AS INTEGER) AS fold, n - (5 - k) * (n // 6) AS train_rows, n // 6 AS test_rows, "
        f"TRUE AS has_error FROM (SELECT count(*) AS n FROM (WITH {by_time}) WHERE split = 'train'), range(5) AS r(k)",
        "tuning_points": "SELECT max_depth, learning_rate::DOUBLE AS learning_rate, n_estimators, TRUE AS is_consistent FROM "
        + ", ".join(f"(SELECT unnest({list(v)}) AS {c})" for c, v in defaults.TUNING_GRID.items()),
        "training_result_rows": "SELECT section, name, TRUE AS has_value, CASE WHEN name = 'sample_size' THEN n END AS size FROM "
        "(VALUES ('test', 'mae'), ('test', 'rmse'), ('test', 'mape'), ('test', 'r2'), ('test', 'sample_size'), "
        + ", ".join(f"('cross_validation', 'fold_{k}')" for k in range(defaults.CV_SPLITS))
        + ", ('cross_validation', 'mean_score'), ('cross_validation', 'std_score')) AS t(section, name), "
        f"(SELECT count(*) AS n FROM (WITH {by_time}) WHERE split = 'test')",
        "baseline_scores": _with(
            f"{_hourly()}, features AS (SELECT *, {_columns({**CALENDAR, **LAGS})}, "
            f"{_columns({c: v for c, v in ROLLING.items() if c.endswith('_24')})} FROM hourly)",
            "SELECT n - CAST(floor(n * 0.9::DOUBLE) AS BIGINT) AS sample_size, TRUE AS is_ordered FROM (SELECT count(*) AS n "
            f"FROM features WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*BASE, *LAGS, 'rmean_24', 'rstd_24'))})",
        ),
        "answered_requests": _with(
            _hourly(),
            """SELECT CASE WHEN site_id NOT BETWEEN 2 AND 6 THEN site_id END AS site_id,
  CASE WHEN site_id NOT BETWEEN 2 AND 6 THEN strftime(hour, '%Y-%m-%dT%H:%M:%SZ') END AS timestamp,
  CASE WHEN site_id BETWEEN 2 AND 6 THEN '{"site_id": ' || CASE site_id WHEN 2 THEN '"two"' ELSE CAST(site_id AS VARCHAR) END
    || strftime(hour, ', "timestamp": "%Y-%m-%dT%H:%M:%SZ"') || ', "hour_of_day": '
    || CAST(hour(hour) + CASE site_id WHEN 6 THEN 24 ELSE 0 END AS VARCHAR) || CASE site_id WHEN 3 THEN '.5' ELSE '' END
    || ', "day_of_week": ' || CAST(isodow(hour) - 1 AS VARCHAR) || ', "is_weekend": 0, "hour_sin": 0, "hour_cos": 1'
    || CASE site_id WHEN 4 THEN ', "lag_1": "many"' ELSE '' END || CASE site_id WHEN 5 THEN '' ELSE '}' END END AS raw,
  CASE site_id WHEN 2 THEN 'site_id: required whole number of at least 1'
    WHEN 3 THEN 'hour_of_day: required whole number from 0 to 23' WHEN 4 THEN 'lag_1: optional number of at least 0'
    WHEN 5 THEN 'site_id: required whole number of at least 1; hour_of_day: required whole number from 0 to 23; '
      || 'day_of_week: required whole number from 0 to 6; is_weekend: required whole number from 0 to 1; '
      || 'hour_sin: required number from -1 to 1; hour_cos: required number from -1 to 1; '
      || 'timestamp: required ISO 8601 date or time; line: one JSON object'
    WHEN 6 THEN 'hour_of_day: required whole number from 0 to 23' END AS rules
FROM hourly""",
        ),
        "request_score_rows": _with(_hourly(), REQUEST_SCORES),
        "streamed_score_rows": _with(_hourly(), REQUEST_SCORES),
        "random_split": "WITH "
        + _split(
            "md5('42|' || site_id || '|' || strftime(hour, '%Y-%m-%d %H')), hour, site_id",
            "CAST(ceil(row_total * 0.2::DOUBLE) AS BIGINT) AS n_test, "
            "CAST(ceil((row_total - CAST(ceil(row_total * 0.2::DOUBLE) AS BIGINT)) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) AS BIGINT) AS n_val",
            THREE_WAY,
        ),
        "baseline_split": "WITH "
        + _split(
            "site_id, hour",
            "CAST(floor(row_total * 0.9::DOUBLE) AS BIGINT) AS n_train",
            "CASE WHEN row_index < n_train THEN 'train' ELSE 'test' END",
        ),
        "ts_folds": _with(
            f"{TRAINING}, indexed AS (SELECT hour, row_number() OVER (ORDER BY hour, site_id) - 1 AS i, "
            "count(*) OVER () AS n FROM training), "
            "folds AS (SELECT CAST(k AS INTEGER) AS fold, hour, i, n - (5 - k) * (n // 6) AS first, n // 6 AS size "
            "FROM indexed, range(5) AS r(k))",
            "SELECT fold, count(*) FILTER (WHERE i < first) AS train_rows, "
            "count(*) FILTER (WHERE i >= first AND i < first + size) AS test_rows, "
            "min(hour) FILTER (WHERE i >= first AND i < first + size) AS test_start, "
            "max(hour) FILTER (WHERE i >= first AND i < first + size) AS test_end FROM folds GROUP BY fold",
        ),
        "align_features": _with(
            _features(),
            "SELECT site_id, hour, round(CAST(lag_24 AS DECIMAL(28, 9)), 6)::DOUBLE AS lag_24, CAST(hour_of_day AS DOUBLE) AS hour_of_day, "
            "0.0::DOUBLE AS not_computed, round(CAST(rmean_24 AS DECIMAL(28, 9)), 6)::DOUBLE AS rmean_24 FROM features",
        ),
        "regression_metrics": _with(
            f"{NAIVE}, m AS (SELECT {METRIC_COLUMNS} FROM naive)", f"SELECT {METRIC_ROUNDED} FROM m"
        ),
        "validate_requests": _with(
            BAD_REQUESTS,
            "SELECT site_id, timestamp, concat_ws(',', "
            "CASE WHEN site_id < 1 THEN 'site_id' END, CASE WHEN hour_of_day > 23 THEN 'hour_of_day' END, "
            "CASE WHEN day_of_week > 6 THEN 'day_of_week' END, CASE WHEN is_weekend > 1 THEN 'is_weekend' END, "
            "CASE WHEN hour_sin IS NULL THEN 'hour_sin' END, CASE WHEN abs(hour_cos) > 1 THEN 'hour_cos' END, "
            "CASE WHEN bad_time THEN 'timestamp' END, CASE WHEN lag_1 < 0 THEN 'lag_1' END) AS rejects FROM bad",
        ),
        "request_features": _with(
            REQUESTS,
            "SELECT site_id, timestamp, "
            + ", ".join(
                f"round(CAST(coalesce(CAST({n} AS DOUBLE), 0) AS DECIMAL(28, 9)), 6)::DOUBLE AS {n}"
                if n in ("hour_of_day", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "lag_1", "lag_24", "rmean_24")
                else f"0.0::DOUBLE AS {n}"
                for n in model_feature_names()
            )
            + " FROM requests",
        ),
        "prediction_interval": _with(
            NAIVE,
            "SELECT site_id, hour, round(CAST(predicted AS DECIMAL(28, 9)), 6)::DOUBLE AS predicted, round(CAST(predicted * (1 - 0.1::DOUBLE) AS DECIMAL(28, 9)), 6)::DOUBLE AS lower, "
            "round(CAST(predicted * (1 + 0.1::DOUBLE) AS DECIMAL(28, 9)), 6)::DOUBLE AS upper FROM naive",
        ),
        "reference_stats": _with(
            f"{_hourly()}, long AS ({_long('hourly', ['site_id', 'sessions', 'session_count', 'avg_sessions'])}), "
            "centred AS (SELECT feature, value, value - avg(value) OVER (PARTITION BY feature) AS d FROM long)",
            "SELECT feature, round(CAST(avg(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean, round(CAST(stddev_samp(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS std, round(CAST(min(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS min, "
            f"round(CAST(max(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS max, {_quantiles({'median': 0.5, 'q25': 0.25, 'q75': 0.75})}, "
            "round(CAST(avg(d ** 3) / avg(d ** 2) ** 1.5 AS DECIMAL(28, 9)), 6)::DOUBLE AS skewness, round(CAST(avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS DECIMAL(28, 9)), 6)::DOUBLE AS kurtosis "
            "FROM centred GROUP BY feature",
        ),
        "ks_statistic": _with(
            VALUE_TESTS, "SELECT feature, n_ref, n_new, round(CAST(ks_statistic AS DECIMAL(28, 12)), 9)::DOUBLE AS ks_statistic FROM tests"
        ),
        "mann_whitney_u": _with(
            VALUE_TESTS,
            "SELECT feature, n_ref, n_new, round(CAST(mw_statistic AS DECIMAL(28, 9)), 6)::DOUBLE AS mw_statistic, round(CAST(tie_sum AS DECIMAL(28, 9)), 6)::DOUBLE AS tie_sum FROM tests",
        ),
        "drift_report": _with(
            HOURLY_TESTS,
            "SELECT feature, n_ref, n_new, round(CAST(ks_statistic AS DECIMAL(28, 9)), 6)::DOUBLE AS ks_statistic, round(CAST(mw_statistic AS DECIMAL(28, 9)), 6)::DOUBLE AS mw_statistic, "
            "ks_drift, mw_drift, drift_detected FROM report",
        ),
        "drift_p_values": _with(
            f"""{HOURLY_TESTS}, tails AS (
  SELECT feature, x, z, CASE WHEN z > 0 THEN 2 / sqrt(pi()) * exp(-z * z / 2) * 6.5 / 1024 / 3
      * list_sum(list_transform(range(0, 1025), lambda k:
          CASE WHEN k IN (0, 1024) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
          * exp(0 - (6.5 * k / 1024) ** 2 - sqrt(2) * z * 6.5 * k / 1024)))
    ELSE 1 END AS mw,
    CASE WHEN x < 0.2 THEN 1 ELSE 2 * list_sum(list_transform(range(1, 101),
      lambda k: (-1) ** (k - 1) * exp(-2 * k * k * x * x))) END AS ks
  FROM scaled)""",
            "SELECT feature, round(CAST(least(greatest(ks, 0), 1) AS DECIMAL(28, 9)), 6)::DOUBLE AS ks_p_value, "
            "round(CAST(least(mw, 1) AS DECIMAL(28, 9)), 6)::DOUBLE AS mw_p_value FROM tails",
        ),
        "drift_summary": _with(
            HOURLY_TESTS,
            "SELECT drift_detected, total_features_tested, features_with_drift, drifted_features, "
            "round(CAST(drift_percentage AS DECIMAL(28, 9)), 6)::DOUBLE AS drift_percentage FROM summary",
        ),
        "drift_alerts": _with(
            HOURLY_TESTS,
            "SELECT 'Data Drift Alert' AS subject, features_with_drift || ' features have moved: ' || drifted_features "
            "|| chr(10) || 'That is ' || printf('%.1f', drift_percentage) || '% of all numeric features.' || chr(10) "
            "|| 'Checked for: 2024-01-31T00:00:00' || chr(10) "
            "|| 'Look at the new data before the next training run.' AS message FROM summary WHERE drift_detected",
        ),
        "performance_records": _with(RECORDS, f"SELECT timestamp, {METRIC_ROUNDED} FROM records"),
        "performance_history": _with(RECORDS, f"SELECT timestamp, {METRIC_ROUNDED} FROM records"),
        "degraded_metrics": _with(
            DEGRADED,
            "SELECT timestamp, metric, round(CAST(baseline AS DECIMAL(28, 9)), 6)::DOUBLE AS baseline, round(CAST(current AS DECIMAL(28, 9)), 6)::DOUBLE AS current, "
            "round(CAST(degradation_pct AS DECIMAL(28, 9)), 6)::DOUBLE AS degradation_pct FROM degraded",
        ),
        "performance_alerts": _with(
            f"{DEGRADED}, lines AS (SELECT timestamp, metric || ' is ' || printf('%.4f', current) || ' and was ' "
            "|| printf('%.4f', baseline) || ': worse by ' || printf('%.1f', degradation_pct) || ' percent' AS line FROM degraded)",
            "SELECT timestamp, 'Performance Degradation Alert' AS subject, 'Model: gbt' || chr(10) || 'Worse than the baseline:' || chr(10) "
            "|| string_agg(line, chr(10) ORDER BY line) || chr(10) "
            "|| 'Look at the recent data or train again.' AS message FROM lines GROUP BY timestamp",
        ),
        "performance_summary": _with(
            f"{RECORDS}, recent AS (SELECT * FROM records WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL {SUMMARY_DAYS} DAY), "
            f"{_trend('recent')}, long AS ({_by_metric('recent', 'sample_size')})",
            f"SELECT metric, CAST({SUMMARY_DAYS} AS INTEGER) AS period_days, CAST(sum(sample_size) AS BIGINT) AS total_predictions, "
            "count(*) AS num_evaluations, round(CAST(avg(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS mean, round(CAST(stddev_pop(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS std, "
            "round(CAST(min(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS min, round(CAST(max(value) AS DECIMAL(28, 9)), 6)::DOUBLE AS max, trend FROM long JOIN trends USING (metric) GROUP BY metric, trend",
        ),
        "metric_trend": _with(
            f"{RECORDS}, {_trend('records')}",
            "SELECT metric, n, round(CAST(slope AS DECIMAL(28, 9)), 6)::DOUBLE AS slope, round(CAST(p_value AS DECIMAL(28, 9)), 6)::DOUBLE AS p_value, trend FROM trends",
        ),
    }
    for name, same in (
        ("performance_history_cycle", "performance_history"),
        ("performance_history_compacted", "performance_history"),
        ("hourly_store_update", "hourly_agg"),
        ("stored_overview", "overview_metrics"),
        ("stored_station_status", "station_status"),
        ("stored_daily_by_state", "daily_by_state"),
    ):
        sql[name] = sql[same]
    sql["feature_table_in_chunks"] = sql["feature_table"]
    return sql
