"""Multi-stage robust quality control.

Readings stay wide, one row per timestamp. Statistics live in an hourly table with one row per hour and gas, which
is small beside the readings. The readings are scanned to build that table and once more to look it up; they are
never widened to one row per gas, and only the values themselves pass through a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroseries.config import GASES, MAD_TO_SIGMA, QC_VERSION, QcConfig, ScaleLimits
from aeroseries.functions.clock import floor_hour
from aeroseries.functions.lineage import cut_lineage
from aeroseries.functions.medians import bracketed_medians, exact_median, middle
from aeroseries.operators.time_blocks import over_blocks, running_count
from aeroseries.schema import QC_COLUMNS

HOUR = "hour_start_ist"
HOUR_STATISTICS = ("hour_rows", "hour_count", "hour_median", "hour_mad", "hour_reference")


@dataclass(frozen=True)
class HourProfile:
    """Measured size of the hourly table and of its busiest hour."""

    hours: int
    largest: int


def hour_profile(df: DataFrame, by: Sequence[str] = ()) -> HourProfile:
    """One aggregate over the hour column alone; decides between the physical forms below."""
    sizes = df.groupBy(*by, HOUR).count()
    row = sizes.agg(F.count("*").alias("hours"), F.max("count").alias("largest")).first()
    return HourProfile(row.hours, row.largest or 0)


def _broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small else df


def prepare(df: DataFrame) -> DataFrame:
    """Fill in the hour and the raw copies where the caller left them out; NaN becomes null."""
    raw = {f"{gas}_raw": f"{gas}_raw" if f"{gas}_raw" in df.columns else gas for gas in GASES}
    added = {name: F.expr(f"nanvl({source}, NULL)") for name, source in raw.items()}
    if HOUR not in df.columns:
        added[HOUR] = floor_hour(F.col("datetime_ist"))
    return df.withColumns(added)


# Stage 1: hard bounds


def is_hard(gas: str, config: QcConfig) -> str:
    """SQL: the raw value is missing, or outside the gas's bounds."""
    bounds, raw = config.bounds(gas), f"{gas}_raw"
    tests = [f"{raw} IS NULL"]
    if bounds.min is not None:
        tests.append(f"{raw} < {float(bounds.min)}D")
    if bounds.max is not None:
        tests.append(f"{raw} > {float(bounds.max)}D")
    return f"({' OR '.join(tests)})"


def hard_bounds(df: DataFrame, config: QcConfig = QcConfig()) -> DataFrame:
    """Add ``<gas>_flag_hard``."""
    return df.selectExpr("*", *(f"{is_hard(gas, config)} AS {gas}_flag_hard" for gas in GASES))


def _valid(gas: str, config: QcConfig) -> str:
    return f"CASE WHEN NOT {is_hard(gas, config)} THEN {gas}_raw END"


# Stage 2: statistics of each hour


def _scale(mad: str) -> str:
    """SQL: standard deviation from a MAD; null unless positive."""
    return f"CASE WHEN {mad} > 0 THEN {MAD_TO_SIGMA}D * {mad} END"


def _is_spike(value: str, count: str, median: str, scale: str, config: QcConfig) -> str:
    """SQL, true or false also where there is no scale."""
    return (
        f"COALESCE({count} >= {config.hourly_group_min_samples}"
        f" AND nanvl(abs({value} - {median}) / {scale}, NULL) > {float(config.point_spike_z)}D, FALSE)"
    )


def _per_gas(df: DataFrame, keep: Sequence[str], name: str, values: dict[str, str]) -> DataFrame:
    """One row per gas instead of one column each."""
    rows = ", ".join(f"named_struct('gas', '{gas}', '{name}', {value})" for gas, value in values.items())
    return df.selectExpr(*keep, f"inline(array({rows}))")


def _gathered_statistics(df: DataFrame, config: QcConfig, by: Sequence[str]) -> DataFrame:
    """Hours small enough to gather: one shuffle brings an hour's valid values together as arrays.

    ``transform(array(x), name -> ...)[0]`` names a value inside an expression, so that it is computed once and not
    for every element.
    """
    keys = [*by, HOUR]
    arrays = df.where(f"{HOUR} IS NOT NULL").groupBy(*keys).agg(
        F.expr("count(*) AS hour_rows"),
        *(F.expr(f"collect_list({_valid(gas, config)}) AS {gas}") for gas in GASES),
    )
    hours = _per_gas(arrays, [*keys, "hour_rows"], "ordered", {gas: f"sort_array({gas})" for gas in GASES})
    hours = hours.where("size(ordered) > 0").selectExpr(
        "*", "CAST(size(ordered) AS BIGINT) AS hour_count", f"{middle('ordered')} AS hour_median"
    )
    hours = hours.selectExpr(
        "*",
        "transform(array(hour_median), m -> sort_array(filter("
        "transform(ordered, v -> nanvl(abs(v - m), NULL)), d -> d IS NOT NULL)))[0] AS distances",
    )
    hours = hours.selectExpr("*", f"{middle('distances')} AS hour_mad")
    usual = f"named_struct('n', hour_count, 'median', hour_median, 'scale', {_scale('hour_mad')})"
    spike = _is_spike("v", "u.n", "u.median", "u.scale", config)
    hours = hours.selectExpr(
        "*", f"transform(array({usual}), u -> filter(ordered, v -> NOT {spike}))[0] AS kept"
    )
    hours = hours.selectExpr("*", f"{middle('kept')} AS hour_reference")
    return hours.select(*keys, "gas", *HOUR_STATISTICS)


def _beside(hours: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The hourly table with one row per hour, the three gases side by side as ``_<gas>_<column>``."""
    return hours.groupBy(*by, HOUR).agg(
        *(F.expr(f"max({name}) FILTER (WHERE gas = '{gas}') AS _{gas}_{name}") for gas in GASES for name in columns)
    )


def _spread_statistics(df: DataFrame, config: QcConfig, by: Sequence[str], small: bool) -> DataFrame:
    """The same table when an hour is too large to gather: bracketed medians of all gases at once, no hour meets in one task."""
    keys = [*by, HOUR]
    df = df.where(f"{HOUR} IS NOT NULL")
    valid = {gas: _valid(gas, config) for gas in GASES}

    def medians(values: dict[str, str], name: str, known: DataFrame | None = None) -> DataFrame:
        readings = df if known is None else df.join(_broadcast_if(small, known), keys)
        return bracketed_medians(readings, keys, values, "gas", name, small)

    hours = medians(valid, "hour_median").where("n > 0").withColumnsRenamed({"rows": "hour_rows", "n": "hour_count"})
    distances = {gas: f"nanvl(abs({value} - _{gas}_hour_median), NULL)" for gas, value in valid.items()}
    mads = medians(distances, "hour_mad", _beside(hours, by, ["hour_median"])).select(*keys, "gas", "hour_mad")
    hours = cut_lineage(hours.join(_broadcast_if(small, mads), [*keys, "gas"], "left"))
    scaled = hours.selectExpr("*", f"{_scale('hour_mad')} AS scale")
    spikes = {gas: _is_spike(value, *(f"_{gas}_{c}" for c in ("hour_count", "hour_median", "scale")), config) for gas, value in valid.items()}
    kept = {gas: f"CASE WHEN NOT {spikes[gas]} THEN {value} END" for gas, value in valid.items()}
    known = _beside(scaled, by, ["hour_count", "hour_median", "scale"])
    references = medians(kept, "hour_reference", known).select(*keys, "gas", "hour_reference")
    return hours.join(_broadcast_if(small, references), [*keys, "gas"], "left").select(*keys, "gas", *HOUR_STATISTICS)


def hour_statistics(
    df: DataFrame,
    config: QcConfig = QcConfig(),
    by: Sequence[str] = (),
    limits: ScaleLimits = ScaleLimits(),
    profile: HourProfile | None = None,
) -> DataFrame:
    """Per hour and gas: rows, valid count, median, MAD, and the median without point spikes.

    The last needs no fallback scale: where the MAD is zero most values equal the median, so removing any
    others leaves the median as it is.
    """
    profile = profile or hour_profile(df, by)
    if profile.largest <= limits.rows_per_hour:
        return _gathered_statistics(df, config, by)
    return _spread_statistics(df, config, by, profile.hours <= limits.broadcast_hours)


def _raw_scale(df: DataFrame, flat: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Scale from the MAD of all raw values, valid or not, of the gases listed in ``flat``."""
    keys = [*by, "gas"]
    values = _per_gas(df, by, "value", {gas: f"{gas}_raw" for gas in GASES}).where("value IS NOT NULL")
    values = values.join(_broadcast_if(small, flat), keys)
    medians = exact_median(values, keys, "value", "centre", small)
    distances = values.join(_broadcast_if(small, medians), keys).selectExpr(
        *keys, "nanvl(abs(value - centre), NULL) AS value"
    )
    mads = exact_median(distances, keys, "value", "raw_mad", small)
    return mads.selectExpr(*keys, f"{_scale('raw_mad')} AS raw_scale")


def point_scales(hours: DataFrame, df: DataFrame, by: Sequence[str] = (), small: bool = False) -> DataFrame:
    """Add ``point_scale``: the hour's own, else the row-weighted median of the positive ones.

    A gas without a single hour of positive MAD falls back to the MAD of all its raw values. That costs scans of
    the readings, so it is planned only where such a gas exists; ``hours`` should be a computed table.
    """
    keys = [*by, "gas"]
    own = _scale("hour_mad")
    flat = hours.groupBy(*keys).agg(F.expr(f"max({own}) AS own")).where("own IS NULL").select(*keys)
    series = f"PARTITION BY {', '.join(keys)}"
    typical = f"COALESCE({own}, percentile({own}, 0.5D, hour_rows) OVER ({series}))"
    hours = hours.selectExpr("*", f"{typical} AS point_scale")
    if flat.isEmpty():
        return hours
    raw = _broadcast_if(small, _raw_scale(df, flat, by, small))
    return (
        hours.join(raw, keys, "left")
        .withColumn("point_scale", F.coalesce("point_scale", "raw_scale"))
        .drop("raw_scale")
    )


# Stage 3: hours against their surroundings


def _with_rolling_median(
    hours: DataFrame, value: str, name: str, config: QcConfig, by: Sequence[str], long: bool
) -> DataFrame:
    """Centred median over present hours; null below the minimum number of values."""
    window = config.hourly_reference_window_hours
    before, after = window // 2, (window - 1) // 2
    if long:
        near = {"near": f"sort_array(collect_list({value}) OVER FRAME)"}
        hours = over_blocks(hours, [*by, "gas"], "position", before, after, near)
    else:
        frame = Window.partitionBy(*by, "gas").orderBy(HOUR).rowsBetween(-before, after)
        hours = hours.withColumn("near", F.sort_array(F.collect_list(F.expr(value)).over(frame)))
    rolled = f"CASE WHEN size(near) >= {config.hourly_reference_min_periods} THEN {middle('near')} END"
    return hours.withColumn(name, F.expr(rolled)).drop("near")


def rolling_reference(
    hours: DataFrame, config: QcConfig = QcConfig(), by: Sequence[str] = (), long: bool = False
) -> DataFrame:
    """Add ``rolling_median``, ``residual`` and ``rolling_mad``.

    Hours whose values are all spikes have no reference and take no place in the window. ``long`` series are worked on in
    blocks of present hours, with the rows around each block that its frames reach.
    """
    hours = hours.where("hour_reference IS NOT NULL")
    if long:
        hours = running_count(hours, [*by, "gas"], HOUR, F.lit(1), "position")
    hours = _with_rolling_median(hours, "hour_reference", "rolling_median", config, by, long)
    hours = hours.withColumn("residual", F.expr("hour_reference - rolling_median"))
    hours = _with_rolling_median(hours, "abs(residual)", "rolling_mad", config, by, long)
    return hours.drop("position")


def hourly_scores(
    hours: DataFrame, config: QcConfig = QcConfig(), by: Sequence[str] = (), long: bool = False
) -> DataFrame:
    """Add ``hour_scale``, ``hourly_robust_z`` and ``candidate``."""
    keys, own = [*by, "gas"], _scale("rolling_mad")
    if long:
        # One row a series comes back to its hours, so that no task sees them all.
        hours = cut_lineage(hours)
        usual = hours.groupBy(*keys).agg(
            F.expr(f"percentile({own}, 0.5D) AS typical"), F.expr("percentile(residual, 0.5D) AS centre")
        )
        hours = hours.join(usual, keys)
        spread = hours.groupBy(*keys).agg(F.expr("percentile(abs(residual - centre), 0.5D) AS spread"))
        hours = hours.join(spread, keys)
    else:
        series = f"OVER (PARTITION BY {', '.join(keys)})"
        hours = hours.selectExpr(
            "*",
            f"percentile({own}, 0.5D) {series} AS typical",
            f"percentile(residual, 0.5D) {series} AS centre",
        )
        hours = hours.withColumn("spread", F.expr(f"percentile(abs(residual - centre), 0.5D) {series}"))
    hours = hours.withColumn("hour_scale", F.expr(f"COALESCE({own}, typical, {_scale('spread')})"))
    hours = hours.withColumn("hourly_robust_z", F.expr("nanvl(abs(residual) / hour_scale, NULL)"))
    candidate = f"COALESCE(hourly_robust_z > {float(config.hourly_spike_z)}D, FALSE)"
    return hours.withColumn("candidate", F.expr(candidate)).drop("typical", "centre", "spread")


def run_lengths(hours: DataFrame, by: Sequence[str] = (), long: bool = False) -> DataFrame:
    """Add ``run_length``: how many candidates stand side by side, 0 for other hours.

    In a ``long`` series a run is named by how many hours that are no candidates come before it, wherever blocks end.
    """
    series = ", ".join([*by, "gas"])
    if long:
        keys = [*by, "gas"]
        hours = cut_lineage(running_count(hours, keys, HOUR, ~F.col("candidate"), "run"))
        lengths = hours.where("candidate").groupBy(*keys, "run").agg(F.count("*").alias("_length"))
        joined = hours.join(lengths, [*keys, "run"], "left")
        length = F.when(F.col("candidate"), F.col("_length")).otherwise(F.lit(0).cast("long"))
        return joined.withColumn("run_length", length).drop("_length", "run")
    ordered = f"OVER (PARTITION BY {series} ORDER BY {HOUR})"
    hours = hours.selectExpr("*", f"int(candidate != lag(candidate, 1, FALSE) {ordered}) AS changed")
    hours = hours.selectExpr("*", f"sum(changed) {ordered} AS run")
    length = f"CASE WHEN candidate THEN count(*) OVER (PARTITION BY {series}, run) ELSE 0L END AS run_length"
    return hours.selectExpr("*", length).drop("changed", "run")


def hourly_flags(hours: DataFrame, config: QcConfig = QcConfig()) -> DataFrame:
    """Add ``flag_hourly_spike`` for short runs and ``flag_sustained_shift`` for long ones."""
    longest = config.sustained_shift_min_hours
    return hours.selectExpr(
        "*",
        f"candidate AND run_length <= {longest} AS flag_hourly_spike",
        f"candidate AND run_length > {longest} AS flag_sustained_shift",
    )


def score_hours(
    hours: DataFrame, config: QcConfig = QcConfig(), by: Sequence[str] = (), long: bool = False
) -> DataFrame:
    """Stage 3 as a whole, on the hourly table."""
    scored = hourly_scores(rolling_reference(hours, config, by, long), config, by, long)
    return hourly_flags(run_lengths(scored, by, long), config)


# Back to the readings

#: What the readings take from the hourly table.
LOOKUP = (
    "hour_count",
    "hour_median",
    "point_scale",
    "flag_hourly_spike",
    "flag_sustained_shift",
    "hourly_robust_z",
)


def _look_up(df: DataFrame, hours: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Join the hourly table, its three gases side by side, to the readings of each hour."""
    beside = _beside(hours, by, [name for name in LOOKUP if name in hours.columns])
    return df.join(_broadcast_if(small, beside), [*by, HOUR], "left")


def flag_points(
    df: DataFrame,
    hours: DataFrame,
    config: QcConfig = QcConfig(),
    by: Sequence[str] = (),
    small: bool = False,
) -> DataFrame:
    """Stages 1 and 2 on the readings: hard flags, point z, point spikes. ``hours`` needs ``point_scale``."""
    looked_up = _look_up(hard_bounds(df, config), hours, by, small)
    added = []
    for gas in GASES:
        raw, count, median, scale = f"{gas}_raw", f"_{gas}_hour_count", f"_{gas}_hour_median", f"_{gas}_point_scale"
        spike = _is_spike(raw, count, median, scale, config)
        added.append(f"nanvl(abs({raw} - {median}) / {scale}, NULL) AS {gas}_point_robust_z")
        added.append(f"NOT {gas}_flag_hard AND {spike} AS {gas}_flag_point_spike")
    return looked_up.selectExpr("*", *added)


def combine_flags(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The final columns: flags, exclusions, cleaned values and any-flags; ``keep`` follows.

    A sustained shift is reported but its readings are kept.
    """
    columns, excluded, shifted = {"qc_version": f"'{QC_VERSION}'"}, [], []
    for gas in GASES:
        spike, shift = f"COALESCE(_{gas}_flag_hourly_spike, FALSE)", f"COALESCE(_{gas}_flag_sustained_shift, FALSE)"
        out = f"({gas}_flag_hard OR {gas}_flag_point_spike OR {spike})"
        excluded.append(out)
        shifted.append(shift)
        columns |= {
            gas: f"CASE WHEN NOT {out} THEN {gas}_raw END",
            f"{gas}_flag_hourly_spike": spike,
            f"{gas}_flag_sustained_shift": shift,
            f"{gas}_qc_excluded": out,
            f"{gas}_hourly_robust_z": f"_{gas}_hourly_robust_z",
        }
    columns["qc_any_excluded"] = " OR ".join(excluded)
    columns["qc_any_sustained_shift"] = " OR ".join(shifted)
    extras = (f"`{name}`" for name in keep)
    return df.selectExpr(*(f"{columns.get(name, name)} AS {name}" for name in QC_COLUMNS), *extras)


def flag_readings(
    df: DataFrame,
    scored: DataFrame,
    config: QcConfig = QcConfig(),
    by: Sequence[str] = (),
    small: bool = False,
) -> DataFrame:
    """The QC columns of prepared readings from the scored hourly table; other columns after them."""
    extras = [c for c in df.columns if c not in QC_COLUMNS]
    return combine_flags(flag_points(df, scored, config, by, small), extras)


def apply_quality_control(
    df: DataFrame,
    config: QcConfig = QcConfig(),
    by: Sequence[str] = (),
    limits: ScaleLimits = ScaleLimits(),
    profile: HourProfile | None = None,
) -> DataFrame:
    """All stages; QC columns first in fixed order, any other columns after them.

    ``by`` names columns that tell instruments apart; each gets its own statistics.
    """
    df = prepare(df)
    profile = profile or hour_profile(df, by)
    small = profile.hours <= limits.broadcast_hours
    hours = cut_lineage(hour_statistics(df, config, by, limits, profile))
    scored = score_hours(point_scales(hours, df, by, small), config, by, profile.hours > limits.series_hours)
    return flag_readings(df, scored, config, by, small)
