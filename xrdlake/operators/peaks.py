"""Peak tables: one contract for peaks from any origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrdlake.functions.geometry import bragg_d
from xrdlake.functions.text import finite

# Field names under which a peak may report each quantity.
PEAK_ALIASES = {
    "two_theta": ("two_theta", "twoTheta", "center_2theta", "observed_two_theta", "measured_two_theta"),
    "d": ("d", "d_spacing", "d_angstrom", "center_d_angstrom", "observed_d_angstrom"),
    "intensity": ("relative_intensity", "intensity_relative", "i_norm", "intensity", "height", "i_abs"),
    "fwhm": ("fwhm", "beta", "peak_width"),
    "peak_index": ("peak_index", "index", "peak_id"),
}
BROAD_FWHM = 0.5


def _first(df: DataFrame, names) -> Column:
    have = [finite(n) if n not in ("peak_index", "index", "peak_id") else F.col(n).cast("string")
            for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def normalize_peak_fields(df: DataFrame, wavelength: float = 1.5406) -> DataFrame:
    """Bring aliased peak columns to one contract; rows without angle and spacing go."""
    aliases = {a for names in PEAK_ALIASES.values() for a in names}
    keep = [c for c in df.columns if c not in aliases and c not in ("broad", "asymmetric")]
    flag = lambda n: F.coalesce(F.col(n).cast("boolean"), F.lit(False)) if n in df.columns else F.lit(False)
    tt = _first(df, PEAK_ALIASES["two_theta"]).cast("double")
    fwhm = _first(df, PEAK_ALIASES["fwhm"]).cast("double")
    out = df.select(
        *keep, _first(df, PEAK_ALIASES["peak_index"]).cast("string").alias("peak_index"), tt.alias("two_theta"),
        F.coalesce(_first(df, PEAK_ALIASES["d"]).cast("double"), F.when(tt > 0, bragg_d(tt))).alias("d"),
        _first(df, PEAK_ALIASES["intensity"]).cast("double").alias("intensity"), fwhm.alias("fwhm"),
        (flag("broad") | flag("asymmetric") | F.coalesce(fwhm > BROAD_FWHM, F.lit(False))).alias("broad"))
    return out.where(F.col("two_theta").isNotNull() | F.col("d").isNotNull())
