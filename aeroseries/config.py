"""Fixed names and tunable parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

# The gas columns, their names in the instrument log, and the pairs offered for regression.
GASES = ("co_sync", "co2_sync", "ch4_sync")
INSTRUMENT_COLUMNS = {"CO_sync": "co_sync", "CO2_sync": "co2_sync", "CH4_sync": "ch4_sync"}
REQUIRED_COLUMNS = ("DATE", "TIME", "CO_sync", "CO2_sync", "CH4_sync")
RATIOS = {
    "co_over_co_plus_co2": ("co_sync", "co2_sync"),
    "co2_over_co_plus_co2": ("co_sync", "co2_sync"),
}
PAIRS = {
    "CO vs CO2": ("co2_sync", "co_sync"),
    "CH4 vs CO2": ("co2_sync", "ch4_sync"),
    "CH4 vs CO2/(CO+CO2)": ("co2_over_co_plus_co2", "ch4_sync"),
}
SUMMARY_PAIRS = (("co2_sync", "co_sync"), ("co2_sync", "ch4_sync"))
QC_VERSION = "v1"
MAD_TO_SIGMA = 1.4826


@dataclass(frozen=True)
class Bounds:
    """Inclusive limits of plausible readings; ``None`` leaves a side open."""

    min: float | None = 0.0
    max: float | None = None


# The default thresholds of quality control.
@dataclass(frozen=True)
class QcConfig:
    """Quality-control thresholds."""

    hard_bounds: Mapping[str, Bounds] = field(default_factory=lambda: {gas: Bounds() for gas in GASES})
    hourly_group_min_samples: int = 12
    point_spike_z: float = 8.0
    hourly_spike_z: float = 6.0
    hourly_reference_window_hours: int = 24 * 7
    hourly_reference_min_periods: int = 24
    sustained_shift_min_hours: int = 6

    @classmethod
    def from_mapping(cls, overrides: Mapping | None) -> QcConfig:
        """Defaults with nested overrides, as found under ``qc`` in a JSON config."""
        base = cls()
        if not overrides:
            return base
        known = {f.name for f in fields(cls)}
        flat = {k: v for k, v in overrides.items() if k in known and k != "hard_bounds"}
        bounds = dict(base.hard_bounds)
        for gas, limits in (overrides.get("hard_bounds") or {}).items():
            bounds[gas] = replace(bounds.get(gas, Bounds(None, None)), **limits)
        return replace(base, hard_bounds=bounds, **flat)

    def bounds(self, gas: str) -> Bounds:
        return self.hard_bounds.get(gas, Bounds(None, None))


@dataclass(frozen=True)
class ScaleLimits:
    """Measured sizes up to which the cheaper physical form of a step is used."""

    # Rows of one hour that may be gathered as an array; busier hours go through exact_median.
    rows_per_hour: int = 50_000
    # Hourly lookup rows (about 200 bytes each) that may be broadcast; above it the join shuffles.
    broadcast_hours: int = 500_000
    # Hours (of all series) up to which one task may see a whole series; longer ones go in blocks.
    series_hours: int = 500_000
    # Files per read whose header positions (about 200 bytes each) may be broadcast.
    broadcast_files: int = 200_000
    # Log files up to this size are read whole; larger ones are read in splits.
    whole_file_bytes: int = 64 * 1024 * 1024
    # Parquet file size that compaction aims for.
    target_file_bytes: int = 128 * 1024 * 1024
