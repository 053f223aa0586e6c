"""Rule tables: windows of lattice spacings as small DataFrames or literal arrays.

All of them are written out below, so their size is fixed and known; joins use
them as literals inside a row or as broadcast sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Named windows (lower and upper spacing in angstrom).
NAMED_RANGES = {
    "illite_10a": (9.73, 10.38), "illite_10a_n": (9.84, 10.36), "illite_10a_g": (9.82, 10.30), "illite_10a_c": (9.73, 10.38),
    "illite_5a": (4.85, 5.15), "illite_3_33a": (3.26, 3.40),
    "kaolinite_7a": (6.96, 7.42), "kaolinite_7a_n": (6.97, 7.42), "kaolinite_7a_g": (6.96, 7.42), "kaolinite_7a_c_check": (6.96, 7.42),
    "kaolinite_3_57a": (3.52, 3.62),
    "smectite_n": (13.46, 16.86), "smectite_g": (16.06, 18.31), "smectite_c": (9.65, 10.37),
    "chlorite_14a": (13.58, 14.87), "chlorite_14a_n": (13.74, 14.74), "chlorite_14a_g": (13.83, 14.72), "chlorite_14a_c": (13.58, 14.87),
    "chlorite_7a": (6.90, 7.40), "chlorite_4_72a": (4.60, 4.85), "chlorite_3_53a": (3.45, 3.65),
    "quartz_101": (3.24, 3.44), "quartz_101_n": (3.24, 3.44), "quartz_101_g": (3.24, 3.44), "quartz_101_c": (3.24, 3.44),
    "quartz_100": (4.23, 4.35),
    "sepiolite_12a": (12.00, 12.50), "palygorskite_10_5a": (10.30, 10.50), "kerolite_9_4a": (9.35, 9.50),
    "vermiculite_14a": (13.70, 14.80), "vermiculite_collapse": (10.00, 12.00),
    "corrensite_n_29a": (28.50, 29.80), "corrensite_g_31a": (30.80, 32.20), "corrensite_c_24a": (23.50, 24.80),
    "d060_candidate": (1.485, 1.555), "d060_dioctahedral": (1.488, 1.505), "d060_trioctahedral": (1.535, 1.555),
}
QUARTZ_TARGET = 3.34

# Windows searched directly on the curve (id, window, mineral).
TARGETED_WINDOWS = (
    ("smectite_n_13_16a", "smectite_n", "Esmectita"), ("smectite_g_17a", "smectite_g", "Esmectita"),
    ("smectite_c_10a", "smectite_c", "Esmectita"), ("illite_10a", "illite_10a", "Ilita"), ("illite_5a", "illite_5a", "Ilita"),
    ("illite_3_33a", "illite_3_33a", "Ilita"), ("kaolinite_7a", "kaolinite_7a", "Caulinita"),
    ("kaolinite_3_57a", "kaolinite_3_57a", "Caulinita"), ("chlorite_14a", "chlorite_14a", "Clorita"),
    ("chlorite_7a", "chlorite_7a", "Clorita"), ("chlorite_4_72a", "chlorite_4_72a", "Clorita"),
    ("chlorite_3_53a", "chlorite_3_53a", "Clorita"), ("quartz_101", "quartz_101", "Quartzo"), ("quartz_100", "quartz_100", "Quartzo"),
)

# Diagnostic windows (rule, window, mineral, required treatment).
DIAGNOSTIC_RULES = (
    ("kaolinite_7a", "kaolinite_7a", "caulinita", "any"),
    ("illite_10a", "illite_10a", "ilita/mica", "any"),
    ("chlorite_14a", "chlorite_14a", "clorita/vermiculita", "any"),
    ("smectite_eg_17a", "smectite_g", "esmectita expansiva", "glicolado"),
)

# Companion reflections of each mineral family (family, label, lower, upper).
PEAK_SETS = (
    ("illite_mica", "10 A", 9.73, 10.38), ("illite_mica", "5 A", 4.85, 5.15), ("illite_mica", "3.33 A", 3.26, 3.40),
    ("kaolin_group", "7 A", 6.96, 7.42), ("kaolin_group", "3.57 A", 3.52, 3.62),
    ("chlorite_group", "14 A", 13.58, 14.87), ("chlorite_group", "7 A", 6.90, 7.40),
    ("chlorite_group", "4.72 A", 4.60, 4.85), ("chlorite_group", "3.53 A", 3.45, 3.65),
    ("smectite_group", "N 12-16 A", 13.46, 16.86), ("smectite_group", "G 17 A", 16.06, 18.31), ("smectite_group", "C 10 A", 9.65, 10.37),
    ("sepiolite", "12 A", 12.00, 12.50), ("palygorskite", "10.5 A", 10.30, 10.50), ("kerolite_talc", "9.4 A", 9.35, 9.50),
    ("corrensite", "29-32 A", 28.50, 32.20), ("corrensite", "14-15 A", 14.00, 15.00), ("corrensite", "7 A", 6.90, 7.40),
)

# Confirmatory reflections (mineral, reflection, target, lower, upper, required treatment or empty).
CONFIRMATORY_REFLECTIONS = (
    ("Esmectita/montmorilonita", "001 em EG", 17.0, 16.06, 18.31, "glicolado"),
    ("Esmectita/montmorilonita", "001 natural", 15.0, 13.0, 16.5, "natural"),
    ("Esmectita/montmorilonita", "colapso aquecido", 10.0, 9.4, 10.4, "calcinado"),
    ("Ilita/mica", "001", 10.0, 9.73, 10.38, ""), ("Ilita/mica", "002", 5.03, 4.85, 5.20, ""), ("Ilita/mica", "003", 3.35, 3.28, 3.42, ""),
    ("Clorita", "001", 14.2, 13.7, 14.6, ""), ("Clorita", "002", 7.0, 6.9, 7.8, ""),
    ("Clorita", "003/004", 3.5, 3.45, 3.65, ""), ("Clorita", "harmônico", 4.7, 4.55, 4.90, ""),
    ("Caulinita", "001", 7.18, 6.9, 7.8, ""), ("Caulinita", "002", 3.58, 3.5, 3.65, ""),
    ("Vermiculita", "001 natural", 14.0, 13.4, 14.8, "natural"),
    ("Vermiculita", "sem expansão em EG", 14.0, 13.4, 14.8, "glicolado"),
    ("Vermiculita", "colapso aquecido", 10.0, 9.5, 10.5, "calcinado"),
)


def literal_table(spark: SparkSession, rows, names) -> DataFrame:
    """A small table whose rows are literals of the plan."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(items).alias("r")).select("r.*")


def literal_rows(rows, names) -> Column:
    """The same rows as one array column, for exploding inside a row."""
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row)]) for row in rows])


def targeted_rows() -> list[tuple]:
    return [(rid, mineral, *NAMED_RANGES[rng]) for rid, rng, mineral in TARGETED_WINDOWS]


def diagnostic_rows() -> list[tuple]:
    return [(rid, mineral, need, *NAMED_RANGES[rng]) for rid, rng, mineral, need in DIAGNOSTIC_RULES]


def rule_windows(spark: SparkSession) -> DataFrame:
    """All windows as one dimension table."""
    rows = [("named", rid, "", "", lo, hi) for rid, (lo, hi) in NAMED_RANGES.items()]
    rows += [("targeted", rid, m, "", lo, hi) for rid, m, lo, hi in targeted_rows()]
    rows += [("diagnostic", rid, m, need, lo, hi) for rid, m, need, lo, hi in diagnostic_rows()]
    rows += [("peak_set", label, fam, "", lo, hi) for fam, label, lo, hi in PEAK_SETS]
    rows += [("confirmatory", refl, m, need, lo, hi) for m, refl, _t, lo, hi, need in CONFIRMATORY_REFLECTIONS]
    return literal_table(spark, rows, ("section", "range_id", "mineral", "preparation", "d_min", "d_max"))
