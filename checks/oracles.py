"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from collections.abc import Iterable

from aeroseries.config import GASES, QcConfig
from checks.fixtures import RANGE, WIDE_RANGE
from checks.queries import DEFAULT, TIGHT


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CALENDAR = """
    date_trunc('hour', datetime_ist)            AS hour_start_ist,
    CAST(datetime_ist AS DATE)                  AS date_ist,
    CAST(hour(datetime_ist) AS INTEGER)         AS hour_ist,
    CAST(day(datetime_ist) AS INTEGER)          AS day_ist,
    strftime(datetime_ist, '%Y-%m')             AS month_ist"""

CLEANED = ", ".join(f"{gas}_raw AS {gas}" for gas in GASES)

EVENTS = f"""
base AS (
  SELECT ts AS datetime_utc, ts + INTERVAL '5 hours 30 minutes' AS datetime_ist, event_type AS source_file,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS co_sync_raw,
         400.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS co2_sync_raw,
         value - 1.0 AS ch4_sync_raw
  FROM events),
readings AS (SELECT *, {CLEANED}, {CALENDAR} FROM base)"""

ORDERS_BASE = """
  SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS datetime_utc,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL '5 hours 30 minutes' AS datetime_ist,
         o_orderstatus AS source_file,
         CAST(o_custkey AS DOUBLE) AS co_sync_raw,
         o_totalprice AS co2_sync_raw,
         o_totalprice / 100.0 + o_custkey AS ch4_sync_raw
  FROM orders"""

ORDERS = f"""
base AS ({ORDERS_BASE}),
readings AS (SELECT *, {CLEANED}, {CALENDAR} FROM base)"""

RAW_ROWS = """
raw_rows AS (
  SELECT CASE event_type WHEN 'signup' THEN strftime(ts, '%d/%m/%Y')
                         WHEN 'view' THEN '  ' || strftime(ts, '%Y-%m-%d') || ' '
                         ELSE strftime(ts, '%Y-%m-%d') END AS "DATE",
         strftime(ts, '%H:%M:%S.%f') AS "TIME",
         CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS "CO_sync",
         CAST(400.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS VARCHAR) AS "CO2_sync",
         CAST(value - 1.0 AS VARCHAR) AS "CH4_sync",
         event_type AS source_file, event_id AS line_no
  FROM events),
valid_rows AS (
  SELECT trim("DATE") AS "DATE", trim("TIME") AS "TIME", trim("CO_sync") AS "CO_sync",
         trim("CO2_sync") AS "CO2_sync", trim("CH4_sync") AS "CH4_sync", trim(source_file) AS source_file, line_no
  FROM raw_rows
  WHERE regexp_matches(trim("DATE"), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')
    AND regexp_matches(trim("TIME"), '^[0-9]{2}:[0-9]{2}:[0-9]{2}'))"""

STANDARDIZED = f"""{RAW_ROWS},
parsed AS (
  SELECT try_cast("DATE" || ' ' || "TIME" AS TIMESTAMP) AS datetime_utc,
         try_cast("CO_sync" AS DOUBLE) AS co_sync_raw, try_cast("CO2_sync" AS DOUBLE) AS co2_sync_raw,
         try_cast("CH4_sync" AS DOUBLE) AS ch4_sync_raw, source_file, line_no
  FROM valid_rows),
base AS (
  SELECT datetime_utc, datetime_utc + INTERVAL '5 hours 30 minutes' AS datetime_ist, source_file,
         co_sync_raw, co2_sync_raw, ch4_sync_raw
  FROM parsed WHERE datetime_utc IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY datetime_utc ORDER BY source_file, line_no) = 1),
readings AS (SELECT *, {CLEANED}, {CALENDAR} FROM base)"""


def columns(names: Iterable[str], doubles: Iterable[str]) -> str:
    doubles = set(doubles)
    return ", ".join(r(n, n) if n in doubles else n for n in names)


GAS_COLUMNS = columns(GASES, GASES)
STANDARD = columns(
    ("datetime_utc", "datetime_ist", "hour_start_ist", "date_ist", "hour_ist", "day_ist", "month_ist",
     *(f"{g}_raw" for g in GASES), *GASES, "source_file"),
    (*(f"{g}_raw" for g in GASES), *GASES),
)


def qc_chain(config: QcConfig, series: str = "''") -> str:
    """CTEs from ``readings`` to the flagged long rows ``flagged`` and the hourly table ``hours``.

    The key of a series is its name before the gas, so that instruments are judged apart.
    """
    half, rest = config.hourly_reference_window_hours // 2, (config.hourly_reference_window_hours - 1) // 2
    least = config.hourly_reference_min_periods
    frame = f"(PARTITION BY gas ORDER BY hour_start_ist ROWS BETWEEN {half} PRECEDING AND {rest} FOLLOWING)"
    long = " UNION ALL ".join(
        f"SELECT datetime_utc, hour_start_ist, {series} || '{g}' AS gas, {g}_raw AS raw FROM readings" for g in GASES
    )
    return f"""
long AS ({long}),
hard AS (SELECT *, (raw IS NULL OR raw < 0) AS flag_hard FROM long),
hour_medians AS (
  SELECT gas, hour_start_ist, count(*) AS hour_count, median(raw) AS hour_median
  FROM hard WHERE NOT flag_hard GROUP BY ALL),
hour_mads AS (
  SELECT gas, hour_start_ist, median(abs(raw - hour_median)) AS hour_mad
  FROM hard JOIN hour_medians USING (gas, hour_start_ist) WHERE NOT flag_hard GROUP BY ALL),
hour_stats AS (SELECT * FROM hour_medians JOIN hour_mads USING (gas, hour_start_ist)),
typical AS (
  SELECT gas, median(1.4826 * hour_mad) AS typical_scale
  FROM long JOIN hour_stats USING (gas, hour_start_ist) WHERE hour_mad > 0 GROUP BY gas),
raw_medians AS (SELECT gas, median(raw) AS centre FROM long WHERE raw IS NOT NULL GROUP BY gas),
raw_mads AS (
  SELECT gas, 1.4826 * median(abs(raw - centre)) AS raw_scale
  FROM long JOIN raw_medians USING (gas) WHERE raw IS NOT NULL GROUP BY gas),
hour_scales AS (
  SELECT h.*, CASE WHEN hour_mad > 0 THEN 1.4826 * hour_mad
                   WHEN typical_scale IS NOT NULL THEN typical_scale
                   WHEN raw_scale > 0 THEN raw_scale END AS point_scale
  FROM hour_stats h LEFT JOIN typical USING (gas) LEFT JOIN raw_mads USING (gas)),
points AS (
  SELECT hard.*, hour_count, abs(raw - hour_median) / point_scale AS point_z,
         COALESCE(NOT flag_hard AND hour_count >= {config.hourly_group_min_samples}
                  AND abs(raw - hour_median) / point_scale > {config.point_spike_z}, FALSE) AS flag_point
  FROM hard LEFT JOIN hour_scales USING (gas, hour_start_ist)),
hourly AS (
  SELECT gas, hour_start_ist, median(raw) AS hour_reference
  FROM points WHERE NOT flag_hard AND NOT flag_point GROUP BY ALL),
rolled AS (
  SELECT *, CASE WHEN count(hour_reference) OVER w >= {least} THEN median(hour_reference) OVER w END AS rolling_median
  FROM hourly WINDOW w AS {frame}),
residuals AS (SELECT *, hour_reference - rolling_median AS residual FROM rolled),
spreads AS (
  SELECT *, CASE WHEN count(residual) OVER w >= {least} THEN median(abs(residual)) OVER w END AS rolling_mad
  FROM residuals WINDOW w AS {frame}),
hour_typical AS (
  SELECT gas, median(CASE WHEN rolling_mad > 0 THEN 1.4826 * rolling_mad END) AS typical_scale,
         median(residual) AS centre
  FROM spreads GROUP BY gas),
hour_fallback AS (
  SELECT gas, 1.4826 * median(abs(residual - centre)) AS residual_scale
  FROM spreads JOIN hour_typical USING (gas) GROUP BY gas),
scored AS (
  SELECT s.*, CASE WHEN rolling_mad > 0 THEN 1.4826 * rolling_mad
                   WHEN typical_scale IS NOT NULL THEN typical_scale
                   WHEN residual_scale > 0 THEN residual_scale END AS hour_scale
  FROM spreads s LEFT JOIN hour_typical USING (gas) LEFT JOIN hour_fallback USING (gas)),
candidates AS (
  SELECT *, abs(residual) / hour_scale AS hourly_robust_z,
         COALESCE(abs(residual) / hour_scale > {config.hourly_spike_z}, FALSE) AS candidate
  FROM scored),
places AS (
  SELECT *, row_number() OVER (PARTITION BY gas ORDER BY hour_start_ist)
            - row_number() OVER (PARTITION BY gas, candidate ORDER BY hour_start_ist) AS island
  FROM candidates),
runs AS (
  SELECT *, CASE WHEN candidate THEN count(*) OVER (PARTITION BY gas, candidate, island) ELSE 0 END AS run_length
  FROM places),
hours AS (
  SELECT *, candidate AND run_length <= {config.sustained_shift_min_hours} AS flag_hourly_spike,
            candidate AND run_length > {config.sustained_shift_min_hours} AS flag_sustained_shift
  FROM runs),
flagged AS (
  SELECT p.*, COALESCE(h.flag_hourly_spike, FALSE) AS flag_hourly,
         COALESCE(h.flag_sustained_shift, FALSE) AS flag_shift, h.hourly_robust_z
  FROM points p LEFT JOIN hours h USING (gas, hour_start_ist))"""


def wide_qc(series: str = "''", keep: str = "") -> str:
    """CTE ``clean``: the readings with the QC columns of all gases, from ``flagged``."""
    joins = " ".join(
        f"JOIN flagged f{i} ON f{i}.gas = {series} || '{g}' AND f{i}.datetime_utc = b.datetime_utc" for i, g in enumerate(GASES)
    )
    picked = []
    for i, g in enumerate(GASES):
        excluded = f"(f{i}.flag_hard OR f{i}.flag_point OR f{i}.flag_hourly)"
        picked.append(
            f"""{g}_raw, CASE WHEN NOT {excluded} THEN {g}_raw END AS {g},
            f{i}.flag_hard AS {g}_flag_hard, f{i}.flag_point AS {g}_flag_point_spike,
            f{i}.flag_hourly AS {g}_flag_hourly_spike, f{i}.flag_shift AS {g}_flag_sustained_shift,
            {excluded} AS {g}_qc_excluded, f{i}.point_z AS {g}_point_robust_z,
            f{i}.hourly_robust_z AS {g}_hourly_robust_z"""
        )
    any_excluded = " OR ".join(f"{g}_qc_excluded" for g in GASES)
    any_shift = " OR ".join(f"{g}_flag_sustained_shift" for g in GASES)
    return f"""
gathered AS (
  SELECT b.datetime_utc, datetime_ist, b.hour_start_ist, date_ist, hour_ist, day_ist, month_ist, source_file,
         'v1' AS qc_version, {", ".join(picked)}{keep}
  FROM (SELECT * EXCLUDE ({", ".join(GASES)}) FROM readings) b {joins}),
clean AS (SELECT *, ({any_excluded}) AS qc_any_excluded, ({any_shift}) AS qc_any_sustained_shift FROM gathered)"""


QC_DOUBLES = [f"{g}{s}" for g in GASES for s in ("_raw", "", "_point_robust_z", "_hourly_robust_z")]
QC_ALL = columns(
    (
        "datetime_utc", "datetime_ist", "hour_start_ist", "date_ist", "hour_ist", "day_ist", "month_ist",
        "source_file", "qc_version",
        *(
            f"{g}{s}"
            for g in GASES
            for s in (
                "_raw", "", "_flag_hard", "_flag_point_spike", "_flag_hourly_spike", "_flag_sustained_shift",
                "_qc_excluded", "_point_robust_z", "_hourly_robust_z",
            )
        ),
        "qc_any_excluded", "qc_any_sustained_shift",
    ),
    QC_DOUBLES,
)


def qc_hours(config: QcConfig, source: str, names: Iterable[str], doubles: Iterable[str] = ()) -> str:
    picked = columns(("gas", "hour_start_ist", *names), doubles)
    return with_(EVENTS, qc_chain(config)) + f"SELECT {picked} FROM {source}"


def qc_rows(config: QcConfig, names: Iterable[str]) -> str:
    picked = columns(("datetime_utc", *names), QC_DOUBLES)
    return with_(EVENTS, qc_chain(config), wide_qc()) + f"SELECT {picked} FROM clean"


def run_columns(source: str) -> str:
    return f"SELECT gas, hour_start_ist, candidate, CAST(run_length AS BIGINT) AS run_length FROM {source}"


FLAG_COLUMNS = [
    f"{g}{s}"
    for g in GASES
    for s in ("", "_flag_hourly_spike", "_flag_sustained_shift", "_hourly_robust_z", "_qc_excluded")
]
POINT_COLUMNS = [f"{g}_{n}" for g in GASES for n in ("point_robust_z", "flag_point_spike")]

HOURLY = f"""
hourly_means AS (
  SELECT hour_start_ist, {", ".join(f"avg({g}) AS {g}" for g in GASES)} FROM readings GROUP BY hour_start_ist),
filled AS (
  SELECT s.hour_start_ist, {", ".join(GASES)}
  FROM (SELECT unnest(generate_series(min(hour_start_ist), max(hour_start_ist), INTERVAL 1 HOUR)) AS hour_start_ist
        FROM hourly_means) s
  LEFT JOIN hourly_means USING (hour_start_ist)),
frame AS (
  SELECT hour_start_ist AS datetime_ist, {", ".join(GASES)},
         CASE WHEN co_sync + co2_sync > 0 THEN co_sync / (co_sync + co2_sync) END AS co_over_co_plus_co2,
         CASE WHEN co_sync + co2_sync > 0 THEN co2_sync / (co_sync + co2_sync) END AS co2_over_co_plus_co2
  FROM hourly_means WHERE COALESCE(co_sync, co2_sync, ch4_sync) IS NOT NULL)"""

STORED_HOURLY = f"""
stored AS (
  SELECT hour_start_ist, date_ist, hour_ist, {", ".join(f"avg({g}) AS {g}" for g in GASES)}
  FROM readings WHERE COALESCE(co_sync, co2_sync, ch4_sync) IS NOT NULL GROUP BY ALL)"""

MATRIX = """
cells AS (SELECT date_ist, hour_ist, avg(co2_sync) AS v FROM readings GROUP BY ALL),
by_hour AS (
  SELECT hour_ist, avg(v) AS mean, median(v) AS median, COALESCE(stddev_samp(v), 0.0) AS std
  FROM cells GROUP BY hour_ist),
by_day AS (SELECT date_ist, avg(v) AS mean, median(v) AS median FROM cells GROUP BY date_ist)"""

BETWEEN = f"date_ist BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"


def pair(x: str, y: str, source: str, by: str = "", where: str = "TRUE") -> str:
    """Statistics of a pair; by definition null below two complete rows, where DuckDB would give NaN."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    n = f"regr_count({y}, {x})"

    def defined(function: str, name: str) -> str:
        return r(f"CASE WHEN {n} >= 2 THEN {function}({y}, {x}) END", name)

    return f"""SELECT {key}'{x}' AS x, '{y}' AS y, CAST({n} AS BIGINT) AS n,
      {defined("corr", "pearson_r")}, {defined("regr_slope", "slope")},
      {defined("regr_intercept", "intercept")}, {defined("regr_r2", "r2")}
      FROM {source} WHERE {where} {group}"""


def report_row(gas: str, by: str = "") -> str:
    def flag(name: str) -> str:
        return f"CAST(count(*) FILTER ({gas}_{name}) AS BIGINT)"

    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {key}'{gas}' AS "column", count(*) AS rows,
      count(*) - count({gas}_raw) AS raw_missing,
      {r(f"(count(*) - count({gas}_raw)) * 100.0 / count(*)", "raw_missing_pct")},
      count(*) - count({gas}) AS clean_missing,
      {r(f"(count(*) - count({gas})) * 100.0 / count(*)", "clean_missing_pct")},
      {flag("flag_hard")} AS hard_flags, {flag("flag_point_spike")} AS point_spikes,
      {flag("flag_hourly_spike")} AS hourly_spikes, {flag("flag_sustained_shift")} AS sustained_shifts,
      {flag("qc_excluded")} AS excluded_points,
      {r(f"min({gas}_raw)", "raw_min")}, {r(f"max({gas}_raw)", "raw_max")},
      {r(f"min({gas})", "clean_min")}, {r(f"max({gas})", "clean_max")}, {r(f"avg({gas})", "clean_mean")},
      CAST(NULL AS BIGINT) AS duplicate_rows
      FROM clean {group}"""


def time_row(by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {key}'datetime_utc', count(*), NULL, NULL, count(*) - count(datetime_utc),
      (count(*) - count(datetime_utc)) * 100.0 / count(*), NULL, NULL, NULL, NULL, NULL,
      NULL, NULL, NULL, NULL, NULL, count(*) - count(DISTINCT datetime_utc)
      FROM clean {group}"""

FOUND = """
found AS (
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS INTEGER)) AS modified,
         n_chars AS length, lang
  FROM documents),
entries AS (
  SELECT path, modified, length + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS length, 1 AS turn
  FROM found WHERE lang <> 'fr'
  UNION ALL
  SELECT path, modified, length + length(path) - 6, 2 FROM found WHERE lang = 'es'),
latest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY path ORDER BY turn DESC) = 1)"""

LOW, HIGH = sorted((18, 6))
FIT = f"hour(datetime_ist) BETWEEN {LOW} AND {HIGH}"

ORACLES = {
    "catalog_new_files": with_(FOUND)
    + "SELECT path, modified, length, lang FROM found f WHERE NOT EXISTS "
    "(SELECT 1 FROM latest l WHERE l.path = f.path AND l.modified = f.modified AND l.length = f.length)",
    "partition_stats": with_(ORDERS)
    + "SELECT CAST(year(datetime_ist) AS INTEGER) AS year, CAST(month(datetime_ist) AS INTEGER) AS month, "
    "count(*) AS row_count, min(date_ist) AS min_date, max(date_ist) AS max_date FROM readings GROUP BY 1, 2",
    "sql_range_query": with_(EVENTS)
    + f"SELECT date_ist, count(*) AS row_count, {r('avg(co2_sync)', 'co2_sync')} FROM readings "
    f"WHERE {BETWEEN} GROUP BY date_ist",
    "union_sources": with_(EVENTS, f"order_base AS ({ORDERS_BASE})")
    + f"SELECT datetime_utc, source_file, {GAS_COLUMNS} FROM readings UNION ALL "
    f"SELECT datetime_utc, source_file, {columns(GASES, GASES)} FROM (SELECT *, {CLEANED} FROM order_base)",
    "validate_rows": with_(RAW_ROWS) + 'SELECT "DATE", "TIME", source_file, line_no FROM valid_rows',
    "standardize": with_(STANDARDIZED) + f"SELECT {STANDARD} FROM readings",
    "dedupe_first": with_(EVENTS)
    + f"""SELECT datetime_utc, source_file, {GAS_COLUMNS} FROM (
      SELECT datetime_utc, source_file, co_sync, co2_sync, ch4_sync FROM readings
      UNION ALL SELECT datetime_utc, 'z_' || source_file, co_sync + 1, co2_sync + 1, ch4_sync + 1 FROM readings
      UNION ALL SELECT datetime_utc, 'a_view', co_sync + 1, co2_sync + 1, ch4_sync + 1
      FROM readings WHERE source_file = 'view')
      QUALIFY row_number() OVER (PARTITION BY datetime_utc ORDER BY source_file) = 1""",
    "load_range_raw": with_(EVENTS)
    + f"SELECT datetime_ist, date_ist, {columns(GASES[:2], GASES)} FROM readings WHERE {BETWEEN} ORDER BY datetime_ist",
    "load_range_hourly": with_(EVENTS, STORED_HOURLY)
    + f"SELECT hour_start_ist, date_ist, hour_ist, {GAS_COLUMNS} FROM stored WHERE {BETWEEN} ORDER BY hour_start_ist",
    "normalize_frame": with_(EVENTS, STORED_HOURLY)
    + f"SELECT hour_start_ist AS datetime_ist, date_ist, hour_ist, {GAS_COLUMNS} FROM stored WHERE {BETWEEN}",
    "filter_date_range": with_(EVENTS)
    + f"SELECT datetime_ist, date_ist, {GAS_COLUMNS} FROM readings WHERE {BETWEEN}",
    "filter_hours": with_(EVENTS)
    + f"SELECT datetime_ist, hour_ist, {GAS_COLUMNS} FROM readings WHERE hour_ist BETWEEN {LOW} AND {HIGH}",
    "clamp_range": with_(EVENTS)
    + f"""SELECT least(a, b) AS start_date, greatest(a, b) AS end_date FROM (
      SELECT least(greatest(DATE '{WIDE_RANGE[0]}', min(date_ist)), max(date_ist)) AS a,
             least(greatest(DATE '{WIDE_RANGE[1]}', min(date_ist)), max(date_ist)) AS b FROM readings)""",
    "default_day": with_(EVENTS)
    + f"SELECT datetime_ist, date_ist, {GAS_COLUMNS} FROM readings "
    "WHERE date_ist = (SELECT min(date_ist) FROM readings)",
    "gas_ratios": with_(EVENTS)
    + "SELECT datetime_utc, "
    + r("CASE WHEN co_sync + co2_sync > 0 THEN co_sync / (co_sync + co2_sync) END", "co_over_co_plus_co2")
    + ", "
    + r("CASE WHEN co_sync + co2_sync > 0 THEN co2_sync / (co_sync + co2_sync) END", "co2_over_co_plus_co2")
    + " FROM readings",
    "available_months": with_(ORDERS)
    + "SELECT month_ist, strftime(min(date_ist), '%b %Y') AS label, min(date_ist) AS min_date, "
    "max(date_ist) AS max_date FROM readings GROUP BY month_ist",
    "summarize": with_(EVENTS)
    + "SELECT min(date_ist) AS min_date, max(date_ist) AS max_date, count(*) AS row_count FROM readings",
    "qc_hard_bounds": with_(EVENTS)
    + "SELECT datetime_utc, "
    + ", ".join(f"({g}_raw IS NULL OR {g}_raw < 0) AS {g}_flag_hard" for g in GASES)
    + " FROM readings",
    "qc_hour_stats": qc_hours(
        DEFAULT, "hour_stats", ("hour_count", "hour_median", "hour_mad"), ("hour_median", "hour_mad")
    ),
    "qc_hour_stats_spread": qc_hours(
        DEFAULT, "hour_stats", ("hour_count", "hour_median", "hour_mad"), ("hour_median", "hour_mad")
    ),
    "quality_control_spread": with_(EVENTS, qc_chain(TIGHT), wide_qc()) + f"SELECT {QC_ALL} FROM clean",
    "quality_control_long": with_(EVENTS, qc_chain(TIGHT), wide_qc()) + f"SELECT {QC_ALL} FROM clean",
    "qc_rolling_median": qc_hours(DEFAULT, "rolled", ("rolling_median",), ("rolling_median",)),
    "qc_rolling_median_sparse": qc_hours(
        QcConfig(hourly_reference_min_periods=100),
        "spreads",
        ("rolling_median", "rolling_mad"),
        ("rolling_median", "rolling_mad"),
    ),
    "qc_rolling_mad": qc_hours(DEFAULT, "spreads", ("residual", "rolling_mad"), ("residual", "rolling_mad")),
    "process_batch": with_(STANDARDIZED, qc_chain(DEFAULT), wide_qc())
    + f"SELECT {QC_ALL}, CAST(year(datetime_ist) AS INTEGER) AS year, CAST(month(datetime_ist) AS INTEGER) AS month "
    "FROM clean",
    "quality_report": with_(EVENTS, qc_chain(TIGHT), wide_qc())
    + " UNION ALL ".join([*(report_row(g) for g in GASES), time_row()]),
    "hourly_preaggregate": with_(EVENTS, STORED_HOURLY)
    + f"SELECT hour_start_ist, date_ist, hour_ist, {GAS_COLUMNS} FROM stored",
    "hourly_by_source": with_(EVENTS)
    + "SELECT source_file, hour_start_ist, date_ist, hour_ist, "
    + ", ".join(r(f"avg({g})", g) for g in GASES)
    + " FROM readings WHERE COALESCE(co_sync, co2_sync, ch4_sync) IS NOT NULL GROUP BY ALL",
    "hourly_mean_filled": with_(EVENTS, HOURLY) + f"SELECT hour_start_ist, {GAS_COLUMNS} FROM filled",
    "correlation_frame": with_(EVENTS, HOURLY)
    + f"SELECT datetime_ist, {GAS_COLUMNS}, {r('co_over_co_plus_co2', 'co_over_co_plus_co2')}, "
    f"{r('co2_over_co_plus_co2', 'co2_over_co_plus_co2')} FROM frame",
    "diurnal_long": with_(EVENTS, MATRIX) + f"SELECT date_ist, hour_ist, {r('v', 'co2_sync')} FROM cells",
    "diurnal_pivot": with_(EVENTS, MATRIX, f"placed AS (SELECT hour_ist, CAST(date_ist AS VARCHAR) AS day, {r('v', 'v')} FROM cells)")
    + "PIVOT placed ON day USING first(v) GROUP BY hour_ist",
    "range_24_point": with_(EVENTS, MATRIX) + f"SELECT hour_ist, {r('mean', 'avg_co2_sync')} FROM by_hour",
    "diurnal_stats": with_(EVENTS, MATRIX)
    + f"SELECT hour_ist, {r('mean', 'mean')}, {r('median', 'median')}, {r('std', 'std')}, "
    f"{r('mean + std', 'upper')}, {r('mean - std', 'lower')} FROM by_hour",
    "daily_mean_median": with_(EVENTS, MATRIX)
    + f"SELECT date_ist, {r('mean', 'mean')}, {r('median', 'median')} FROM by_day",
    "profile_24_all": with_(EVENTS)
    + f"SELECT hour_ist, {', '.join(r(f'avg({g})', g) for g in GASES)} FROM readings GROUP BY hour_ist",
    "monthly_diurnal": with_(ORDERS)
    + f"SELECT month_ist, hour_ist, {r('avg(co2_sync)', 'co2_sync')} FROM readings GROUP BY 1, 2 ORDER BY 1, 2",
    "monthly_diurnal_all": with_(ORDERS)
    + "SELECT month_ist, hour_ist, "
    + ", ".join(r(f"avg({g})", g) for g in GASES)
    + " FROM readings GROUP BY 1, 2",
    "month_hour_day": with_(ORDERS)
    + f"SELECT month_ist, hour_ist, day_ist, {r('avg(co2_sync)', 'co2_sync')} FROM readings GROUP BY 1, 2, 3",
    "month_hour_day_matrix": with_(ORDERS)
    + "SELECT month_ist, hour_ist, "
    + ", ".join(r(f"avg(co2_sync) FILTER (day_ist = {d})", f'"{d}"') for d in range(1, 32))
    + " FROM readings GROUP BY 1, 2",
    "pair_stats": with_(EVENTS, HOURLY) + pair("co2_sync", "ch4_sync", "frame"),
    "pair_stats_ratio": with_(EVENTS, HOURLY) + pair("co2_over_co_plus_co2", "ch4_sync", "frame"),
    "correlation_summary": with_(EVENTS)
    + pair("co2_sync", "co_sync", "readings")
    + " UNION ALL "
    + pair("co2_sync", "ch4_sync", "readings"),
    "correlation_monthly": with_(ORDERS)
    + pair("co2_sync", "co_sync", "readings", "month_ist")
    + " UNION ALL "
    + pair("co2_sync", "ch4_sync", "readings", "month_ist"),
    "correlation_view": with_(EVENTS, HOURLY)
    + "SELECT 'CH4 vs CO2/(CO+CO2)' AS pair, *, CAST(6 AS INTEGER) AS fit_start_hour, "
    "CAST(18 AS INTEGER) AS fit_end_hour, 'hours 06-18 IST' AS fit_label FROM ("
    + pair("co2_over_co_plus_co2", "ch4_sync", "frame", where=FIT)
    + ")",
    "scatter_points": with_(EVENTS, HOURLY)
    + f"SELECT {r('co2_over_co_plus_co2', 'x')}, {r('ch4_sync', 'y')}, CAST(hour(datetime_ist) AS INTEGER) AS hour_ist "
    "FROM frame WHERE co2_over_co_plus_co2 IS NOT NULL AND ch4_sync IS NOT NULL",
    "fit_line": with_(EVENTS, HOURLY)
    + f"""SELECT {r('x', 'x')}, {r('slope * x + intercept', 'y')} FROM (
      SELECT regr_slope(ch4_sync, co2_sync) AS slope, regr_intercept(ch4_sync, co2_sync) AS intercept,
             unnest([min(co2_sync) FILTER (ch4_sync IS NOT NULL), max(co2_sync) FILTER (ch4_sync IS NOT NULL)]) AS x
      FROM frame WHERE {FIT})""",
    "diurnal_summary": with_(EVENTS, MATRIX)
    + f"SELECT {r('avg(mean)', 'avg_mean')}, {r('median(median)', 'median_median')}, {r('avg(std)', 'avg_std')}, "
    "count(*) AS hours FROM by_hour",
    "daily_bars": with_(EVENTS, MATRIX)
    + f"SELECT date_ist, strftime(date_ist, '%d/%m') AS label, {r('mean', 'mean')}, {r('median', 'median')} FROM by_day",
    "daily_summary": with_(EVENTS, MATRIX)
    + f"SELECT count(*) AS days, {r('avg(mean)', 'avg_mean')}, {r('avg(median)', 'avg_median')}, "
    f"{r('min(mean)', 'min_mean')}, {r('max(mean)', 'max_mean')} FROM by_day",
    "hourly_series": with_(EVENTS, HOURLY)
    + f"SELECT hour_start_ist AS datetime_ist, {r('co2_sync', 'co2_sync')} FROM filled WHERE co2_sync IS NOT NULL",
    "hourly_summary": with_(EVENTS, HOURLY)
    + f"SELECT count(*) AS points, {r('avg(co2_sync)', 'mean')}, {r('min(co2_sync)', 'min')}, "
    f"{r('max(co2_sync)', 'max')} FROM filled",
    "heatmap_cells": with_(EVENTS, MATRIX) + f"SELECT date_ist, hour_ist, {r('v', 'co2_sync')} FROM cells",
    "heatmap_summary": with_(EVENTS, MATRIX)
    + f"SELECT count(v) AS cells, {r('min(v)', 'min')}, {r('avg(v)', 'mean')}, {r('max(v)', 'max')} FROM cells",
    "profile_series": with_(EVENTS)
    + " UNION ALL ".join(
        f"SELECT hour_ist, '{g}' AS gas, {r(f'avg({g})', 'value')} FROM readings GROUP BY hour_ist" for g in GASES
    ),
    "snapshot_summary": with_(EVENTS, STORED_HOURLY)
    + f"SELECT DATE '{RANGE[0]}' AS start_date, DATE '{RANGE[1]}' AS end_date, "
    f"'05/01/2024 to 20/01/2024' AS range_label, count(*) AS row_count, count(*) > 0 AS has_data "
    f"FROM stored WHERE {BETWEEN}",
}

# By instrument: the source is the instrument
SOURCE = "source_file || '/'"
BY_SOURCE = with_(EVENTS, qc_chain(TIGHT, SOURCE), wide_qc(SOURCE))
MATRIX_BY = """
cells AS (SELECT source_file, date_ist, hour_ist, avg(co2_sync) AS v FROM readings GROUP BY ALL),
by_hour AS (
  SELECT source_file, hour_ist, avg(v) AS mean, median(v) AS median, COALESCE(stddev_samp(v), 0.0) AS std
  FROM cells GROUP BY ALL),
by_day AS (SELECT source_file, date_ist, avg(v) AS mean, median(v) AS median FROM cells GROUP BY ALL)"""
HOURLY_BY = f"""
hourly_means AS (
  SELECT source_file, hour_start_ist, {", ".join(f"avg({g}) AS {g}" for g in GASES)} FROM readings GROUP BY ALL),
spans AS (
  SELECT source_file, unnest(generate_series(min(hour_start_ist), max(hour_start_ist), INTERVAL 1 HOUR)) AS hour_start_ist
  FROM hourly_means GROUP BY source_file),
filled AS (SELECT s.*, {", ".join(GASES)} FROM spans s LEFT JOIN hourly_means USING (source_file, hour_start_ist)),
frame AS (SELECT hour_start_ist AS datetime_ist, * FROM hourly_means WHERE COALESCE(co_sync, co2_sync, ch4_sync) IS NOT NULL)"""
#: The tables of a snapshot see the chosen range alone.
IN_RANGE = f"in_range AS (SELECT * FROM readings WHERE {BETWEEN})"


def in_range(ctes: str) -> str:
    return ctes.replace("FROM readings", "FROM in_range")


IMPORTED = f"""
base AS (
  SELECT ts AS datetime_utc, ts + INTERVAL '5 hours 30 minutes' AS datetime_ist, event_type AS source_file,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS co_sync_raw,
         400.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS co2_sync_raw, value - 1.0 AS ch4_sync_raw
  FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1),
readings AS (SELECT *, {CLEANED}, {CALENDAR} FROM base)"""
QC_IMPORTED = QC_ALL.replace("source_file, ", "source_file AS series_id, ")
LOG_LINES = """
lines AS (
  SELECT event_type, event_type || '/' || strftime(ts, '%Y-%m-%d') AS source_file, strftime(ts, '%Y-%m-%d') AS "DATE",
         strftime(ts, '%H:%M:%S.%f') AS "TIME", CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS "CO_sync",
         CAST(400.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS VARCHAR) AS "CO2_sync",
         CAST(value - 1.0 AS VARCHAR) AS "CH4_sync",
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) + CASE WHEN event_type = 'view' THEN 2 ELSE 0 END AS line_no
  FROM events)"""

ORACLES |= {
    "quality_control_by_source": BY_SOURCE + f"SELECT {QC_ALL} FROM clean",
    "quality_report_by_source": BY_SOURCE
    + " UNION ALL ".join([*(report_row(g, "source_file") for g in GASES), time_row("source_file")]),
    "qc_degenerate": with_(
        EVENTS.replace("CASE WHEN event_type = 'error' THEN NULL ELSE value END", "-1.0::DOUBLE").replace("value - 1.0", "NULL::DOUBLE"),
        qc_chain(TIGHT), wide_qc(),
    )
    + f"SELECT {QC_ALL} FROM clean",
    "hourly_filled_by_source": with_(EVENTS, HOURLY_BY) + f"SELECT source_file, hour_start_ist, {GAS_COLUMNS} FROM filled",
    "correlation_by_source": with_(EVENTS, HOURLY_BY)
    + "SELECT 'CH4 vs CO2' AS pair, *, CAST(6 AS INTEGER) AS fit_start_hour, CAST(18 AS INTEGER) AS fit_end_hour FROM ("
    + pair("co2_sync", "ch4_sync", "frame", "source_file", FIT)
    + ")",
    "fit_line_by_source": with_(EVENTS, HOURLY_BY)
    + f"""SELECT source_file, {r('x', 'x')}, {r('slope * x + intercept', 'y')} FROM (
      SELECT source_file, regr_slope(ch4_sync, co2_sync) AS slope, regr_intercept(ch4_sync, co2_sync) AS intercept,
             unnest([min(co2_sync) FILTER (ch4_sync IS NOT NULL), max(co2_sync) FILTER (ch4_sync IS NOT NULL)]) AS x
      FROM frame WHERE {FIT} GROUP BY source_file HAVING regr_count(ch4_sync, co2_sync) >= 2)""",
    "diurnal_by_source": with_(EVENTS, MATRIX_BY)
    + f"SELECT source_file, hour_ist, {r('mean', 'mean')}, {r('median', 'median')}, {r('std', 'std')}, "
    f"{r('mean + std', 'upper')}, {r('mean - std', 'lower')} FROM by_hour",
    "diurnal_summary_by_source": with_(EVENTS, MATRIX_BY)
    + f"SELECT source_file, {r('avg(mean)', 'avg_mean')}, {r('median(median)', 'median_median')}, {r('avg(std)', 'avg_std')}, "
    "count(*) AS hours FROM by_hour GROUP BY ALL",
    "daily_by_source": with_(EVENTS, MATRIX_BY)
    + f"SELECT source_file, date_ist, strftime(date_ist, '%d/%m') AS label, {r('mean', 'mean')}, {r('median', 'median')} FROM by_day",
    "daily_summary_by_source": with_(EVENTS, MATRIX_BY)
    + f"SELECT source_file, count(*) AS days, {r('avg(mean)', 'avg_mean')}, {r('avg(median)', 'avg_median')}, "
    f"{r('min(mean)', 'min_mean')}, {r('max(mean)', 'max_mean')} FROM by_day GROUP BY ALL",
    "hourly_summary_by_source": with_(EVENTS, HOURLY_BY)
    + f"SELECT source_file, count(*) AS points, {r('avg(co2_sync)', 'mean')}, {r('min(co2_sync)', 'min')}, "
    f"{r('max(co2_sync)', 'max')} FROM filled GROUP BY ALL",
    "heatmap_summary_by_source": with_(EVENTS, MATRIX_BY)
    + f"SELECT source_file, count(v) AS cells, {r('min(v)', 'min')}, {r('avg(v)', 'mean')}, {r('max(v)', 'max')} FROM cells GROUP BY ALL",
    "profile_by_source": with_(EVENTS)
    + " UNION ALL ".join(
        f"SELECT source_file, hour_ist, '{g}' AS gas, {r(f'avg({g})', 'value')} FROM readings GROUP BY ALL" for g in GASES
    ),
    "monthly_diurnal_by_source": with_(ORDERS)
    + f"SELECT source_file, month_ist, hour_ist, {r('avg(co2_sync)', 'co2_sync')} FROM readings GROUP BY 1, 2, 3",
    "correlation_monthly_by_source": with_(ORDERS)
    + " UNION ALL ".join(pair("co2_sync", y, "readings", "source_file, month_ist") for y in ("co_sync", "ch4_sync")),
    "available_months_by_source": with_(ORDERS)
    + "SELECT source_file, month_ist, strftime(min(date_ist), '%b %Y') AS label, min(date_ist) AS min_date, "
    "max(date_ist) AS max_date FROM readings GROUP BY ALL",
    "snapshot_correlation": with_(EVENTS, IN_RANGE, in_range(HOURLY))
    + "SELECT 'CH4 vs CO2/(CO+CO2)' AS pair, *, CAST(6 AS INTEGER) AS fit_start_hour, CAST(18 AS INTEGER) AS fit_end_hour FROM ("
    + pair("co2_over_co_plus_co2", "ch4_sync", "frame", where=FIT)
    + ")",
    "snapshot_diurnal": with_(EVENTS, IN_RANGE, in_range(MATRIX))
    + f"SELECT hour_ist, {r('mean', 'mean')}, {r('median', 'median')}, {r('std', 'std')}, "
    f"{r('mean + std', 'upper')}, {r('mean - std', 'lower')} FROM by_hour",
    "snapshot_daily": with_(EVENTS, IN_RANGE, in_range(MATRIX))
    + f"SELECT date_ist, strftime(date_ist, '%d/%m') AS label, {r('mean', 'mean')}, {r('median', 'median')} FROM by_day",
    "snapshot_hourly": with_(EVENTS, IN_RANGE, in_range(HOURLY))
    + f"SELECT hour_start_ist AS datetime_ist, {r('co2_sync', 'co2_sync')} FROM filled WHERE co2_sync IS NOT NULL",
    "snapshot_heatmap": with_(EVENTS, IN_RANGE, in_range(MATRIX))
    + f"SELECT count(v) AS cells, {r('min(v)', 'min')}, {r('avg(v)', 'mean')}, {r('max(v)', 'max')} FROM cells",
    "snapshot_daily_by_source": with_(EVENTS, IN_RANGE, in_range(MATRIX_BY))
    + f"SELECT source_file, date_ist, strftime(date_ist, '%d/%m') AS label, {r('mean', 'mean')}, {r('median', 'median')} FROM by_day",
    "log_rows": with_(LOG_LINES)
    + 'SELECT source_file, line_no, "DATE", "TIME", "CO_sync", "CO2_sync", "CH4_sync" FROM lines WHERE event_type <> \'signup\'',
    "log_headers": "SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS path, event_type <> 'signup' AS readable FROM events",
    "log_counts": "SELECT 'half=' || half || '/station=' || event_type AS folder, "
    "count(DISTINCT CAST(ts AS DATE)) FILTER (CASE WHEN day(ts) % 2 = 1 THEN 'odd' ELSE 'even' END = half) AS files "
    "FROM events, (VALUES ('odd'), ('even')) h(half) GROUP BY half, event_type",
    "import_store": with_(IMPORTED, qc_chain(TIGHT, SOURCE), wide_qc(SOURCE))
    + f"SELECT {QC_IMPORTED}, CAST(year(datetime_ist) AS INTEGER) AS year, CAST(month(datetime_ist) AS INTEGER) AS month FROM clean",
    "import_hourly_sql": with_(IMPORTED, qc_chain(TIGHT, SOURCE), wide_qc(SOURCE))
    + f"SELECT source_file AS series_id, hour_start_ist, {', '.join(r(f'avg({g})', g) for g in GASES)} FROM clean "
    f"WHERE {BETWEEN} AND COALESCE(co_sync, co2_sync, ch4_sync) IS NOT NULL GROUP BY ALL",
    "load_views_raw": with_(EVENTS)
    + f"SELECT datetime_ist, date_ist, hour_ist, {columns(GASES[:2], GASES)} FROM readings WHERE {BETWEEN}",
    "load_views_hourly": with_(EVENTS, STORED_HOURLY)
    + f"SELECT hour_start_ist AS datetime_ist, date_ist, hour_ist, {columns(GASES[:2], GASES)} FROM stored WHERE {BETWEEN}",
    "file_overlaps": with_(
        ORDERS,
        """files AS (
      SELECT source_file || '-' || CAST(co_sync AS BIGINT) AS path, source_file || '-' || CAST(co_sync % 100 AS BIGINT) AS series_id,
             min(datetime_utc) AS first_utc, max(datetime_utc) AS last_utc FROM readings GROUP BY ALL)""",
    )
    + "SELECT a.path, b.path AS beside FROM files a JOIN files b USING (series_id) "
    "WHERE a.path <> b.path AND a.first_utc <= b.last_utc AND b.first_utc <= a.last_utc",
    "catalog_last_import": with_(FOUND)
    + "SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, "
    "CASE max(turn) WHEN 2 THEN TIMESTAMP '2024-07-01' ELSE TIMESTAMP '2024-06-01' END AS last_import FROM latest",
}

for suffix, settings in (("", DEFAULT), ("_tight", TIGHT)):
    z = ("hourly_robust_z",)
    ORACLES |= {
        f"qc_hourly_series{suffix}": qc_hours(settings, "hourly", ("hour_reference",), ("hour_reference",)),
        f"qc_hourly_z{suffix}": qc_hours(settings, "candidates", (*z, "candidate"), z),
        f"qc_run_lengths{suffix}": with_(EVENTS, qc_chain(settings)) + run_columns("runs"),
        f"qc_hourly_flags{suffix}": qc_hours(settings, "hours", ("flag_hourly_spike", "flag_sustained_shift")),
        f"qc_point_spike{suffix}": qc_rows(settings, POINT_COLUMNS),
        f"qc_flags{suffix}": qc_rows(settings, FLAG_COLUMNS),
        f"qc_any_flags{suffix}": qc_rows(settings, ("qc_any_excluded", "qc_any_sustained_shift")),
        f"quality_control{suffix}": with_(EVENTS, qc_chain(settings), wide_qc()) + f"SELECT {QC_ALL} FROM clean",
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
