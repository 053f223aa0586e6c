"""Diffraction geometry as Column expressions (angles in degrees, lengths in angstrom)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cu K-alpha wavelength, shape factor, kX unit, density constant.
CU_K_ALPHA = 1.5406
SHAPE_FACTOR = 0.9
KX_TO_ANGSTROM = 1.002056
DENSITY_CONSTANT = 1.66042


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def bragg_d(two_theta, wavelength=CU_K_ALPHA) -> Column:
    """Lattice spacing for a measured angle; null where the sine is not positive."""
    s = F.sin(F.radians(_c(two_theta) / 2))
    return F.when(s > 0, _c(wavelength) / (s * 2))


def bragg_two_theta(d, wavelength=CU_K_ALPHA) -> Column:
    """Angle at which spacing ``d`` reflects; null where it cannot."""
    d = _c(d)
    ratio = F.try_divide(_c(wavelength), d * 2)
    return F.when((d > 0) & (ratio > 0) & (ratio <= 1), F.degrees(F.asin(ratio) * 2))


def observable(d, wavelength=CU_K_ALPHA) -> Column:
    """True when the wavelength is shorter than twice the spacing."""
    return _c(wavelength) < _c(d) * 2


def theta(two_theta) -> Column:
    return _c(two_theta) / 2


def two_theta_of(theta_deg) -> Column:
    return _c(theta_deg) * 2


def wavelength_in_angstrom(value, unit) -> Column:
    u = F.lower(F.coalesce(_c(unit), F.lit("angstrom")))
    u = F.replace(u, F.lit("å"), F.lit("a"))
    v = _c(value)
    return (F.when(u.isin("angstrom", "a", "ang", "angstrom_star", "a*"), v)
            .when(u == "kx", v * KX_TO_ANGSTROM))


def cubic_d(a, h, k, l) -> Column:  # noqa: E741
    n = _c(h) * _c(h) + _c(k) * _c(k) + _c(l) * _c(l)
    return F.when(n > 0, _c(a) / F.sqrt(n))


def tetragonal_d(a, c, h, k, l) -> Column:  # noqa: E741
    inv = (F.try_divide(_c(h) * _c(h) + _c(k) * _c(k), _c(a) * _c(a))
           + F.try_divide(_c(l) * _c(l), _c(c) * _c(c)))
    return F.when(inv > 0, F.lit(1.0) / F.sqrt(inv))


def scattering_vector_of_d(d) -> Column:
    return F.try_divide(F.lit(1.0), _c(d))


def scattering_vector_of_theta(theta_deg, wavelength=CU_K_ALPHA) -> Column:
    return F.sin(F.radians(_c(theta_deg))) * 2 / _c(wavelength)


def ewald_radius(wavelength=CU_K_ALPHA) -> Column:
    return F.lit(1.0) / _c(wavelength)


def ewald_reachable(d, wavelength=CU_K_ALPHA) -> Column:
    return F.try_divide(F.lit(1.0), _c(d)) <= F.lit(2.0) / _c(wavelength)


def limiting_sphere_radius(wavelength=CU_K_ALPHA) -> Column:
    return F.lit(2.0) / _c(wavelength)


def reciprocal_cubic_point(a, h, k, l) -> Column:  # noqa: E741
    b = F.try_divide(F.lit(1.0), _c(a))
    return F.struct((_c(h) * b).alias("x"), (_c(k) * b).alias("y"), (_c(l) * b).alias("z"))


def laue_integer(period, alpha_deg, alpha0_deg, wavelength=CU_K_ALPHA) -> Column:
    return _c(period) * (F.cos(F.radians(_c(alpha_deg))) - F.cos(F.radians(_c(alpha0_deg)))) / _c(wavelength)


def xray_density(sum_atomic_weights, volume) -> Column:
    return F.try_divide(_c(sum_atomic_weights) * DENSITY_CONSTANT, _c(volume))


def wavelength_from_d(d, theta_deg, order=1) -> Column:
    return _c(d) * 2 * F.sin(F.radians(_c(theta_deg))) / _c(order)


def scherrer_nm(fwhm, two_theta, wavelength=CU_K_ALPHA, shape=SHAPE_FACTOR) -> Column:
    """Crystallite size in nanometres from a peak width in degrees."""
    cos = F.cos(F.radians(_c(two_theta) / 2))
    size = F.try_divide(_c(wavelength) / 10 * shape, F.radians(_c(fwhm)) * cos)
    return F.when((_c(fwhm) > 0) & (cos > 0), size)


# The 060 window and its centres (dioctahedral, intermediate, trioctahedral).
D060_WINDOW = (1.485, 1.555)
D060_CENTRES = (1.50, 1.52, 1.54)


def d060_distance(d) -> Column:
    """Distance of a spacing to the nearest 060 centre."""
    return F.least(*[F.abs(_c(d) - k) for k in D060_CENTRES])


def octahedral_class(d060, tolerance=0.015) -> Column:
    """Octahedral type suggested by the 060 spacing."""
    v = _c(d060)
    return (F.when(v.between(1.49 - tolerance, 1.50 + tolerance), "dioctahedral")
            .when(v.between(1.52 - tolerance, 1.52 + tolerance), "intermediate")
            .when(v.between(1.54 - tolerance, 1.54 + tolerance), "trioctahedral")
            .otherwise("unknown"))


def octahedral_agreement(kind, expected) -> Column:
    """How an observed octahedral type bears on an expected one."""
    kind, expected = _c(kind), _c(expected)
    return (F.when(expected.isNull() | (expected == "unknown"), F.lit(None).cast("string"))
            .when((expected == kind) | ((kind == "intermediate")
                                        & expected.isin("dioctahedral", "trioctahedral")), "supports")
            .when(kind != "unknown", "contradicts"))


def beta_r(beta_005, beta_004) -> Column:
    """Extra line width of the 005 over the 004 reflection."""
    diff = F.pow(_c(beta_005), F.lit(1.25)) - F.pow(_c(beta_004), F.lit(1.25))
    return F.pow(F.greatest(diff, F.lit(0.0)), F.lit(1.0 / 1.25))


def serpentine_percent(beta_005, beta_004) -> Column:
    return F.greatest(F.lit(0.0), F.lit(-0.51) + beta_r(beta_005, beta_004) * 24.27)


def method_class(wavelength_behaviour, angle_behaviour, sample_type) -> Column:
    """Diffraction method named by what varies and what is measured."""
    w = F.lower(F.coalesce(_c(wavelength_behaviour), F.lit("")))
    a = F.lower(F.coalesce(_c(angle_behaviour), F.lit("")))
    s = F.lower(F.coalesce(_c(sample_type), F.lit("")))
    powderlike = w.contains("fixed") & a.contains("variable")
    return (F.when(w.contains("variable") & a.contains("fixed"), "laue_method")
            .when(powderlike & s.contains("powder"), "powder_method")
            .when(powderlike & s.contains("single"), "rotating_crystal_method")
            .otherwise("unknown"))


# Metadata flags that widen or move an ideal line.
NONIDEAL_FLAGS = ("beam_divergence", "finite_spectral_width", "finite_crystallite_size", "strain", "dislocations")


def nonideal_warnings(flags: dict[str, Column]) -> Column:
    """Array of the conditions that are set, in fixed order."""
    return F.array_compact(F.array(*[
        F.when(flags[name], F.lit(name)) for name in NONIDEAL_FLAGS if name in flags
    ]))


def nonideal_status(warnings) -> Column:
    return F.when(F.size(_c(warnings)) > 0, "nonideal").otherwise("ideal_assumed")
