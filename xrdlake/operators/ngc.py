"""Natural / glycolated / calcined interpretation of a sample.

Every rule reads one wide row per sample: for each treatment a map from window
to the strongest peak in it. The maps are built inside the curve row, so the
only shuffle of the whole rule block is the grouping of a sample's curves.
Scores are evidence for a curator, not confirmed identifications.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrdlake.functions import series as S
from xrdlake.functions.geometry import bragg_d, octahedral_class
from xrdlake.functions.values import candidate_status, group_confidence, rule_level
from xrdlake.operators import rule_tables as R

# Windows used by single rules only.
EXTRA_WINDOWS = {
    "amb_7a": (6.95, 7.45), "amb_10a": (9.3, 10.6), "amb_12a": (11.8, 12.6), "amb_14a": (13.4, 14.9), "amb_3_33a": (3.30, 3.38), "amb_1_54a": (1.535, 1.550),
    "mix_14a": (13.7, 14.8), "mix_17a": (16.0, 17.8), "mix_9_10a": (9.3, 10.0), "mix_9_4a": (9.3, 9.5),
    "set_29_32a": (28.50, 32.20), "set_14_15a": (14.00, 15.00),
    # heat-ratio rules: centre and tolerance written as bounds
    "ool_14": (13.65, 14.75), "ool_14c": (13.55, 14.85), "ool_7": (6.85, 7.35), "ool_4_74": (4.60, 4.88), "ool_3_55": (3.47, 3.63),
    "heat_7": (6.90, 7.40), "heat_3_57": (3.51, 3.63), "exp_n": (12.0, 15.6), "exp_g": (16.1, 17.8), "exp_c": (9.6, 10.4),
    "mica_10": (9.65, 10.35), "mica_10c": (9.60, 10.40), "mica_5": (4.88, 5.12), "mica_3_33": (3.27, 3.39),
    "op_14_5": (13.7, 15.3), "op_10_12": (10.0, 12.2), "fib_12": (12.0, 12.6), "fib_10_4": (10.3, 10.6),
    # mixed-layer features
    "ml_17": (15.7, 17.9), "ml_10": (9.4, 10.6), "ml_14n": (13.6, 14.8), "ml_14g": (13.5, 14.9), "ml_14c": (13.4, 15.0), "ml_24": (21.5, 26.5), "ml_29": (26.5, 31.5),
    "ss_24": (22.8, 25.2), "ss_29": (27.8, 30.2), "ss_31": (29.8, 32.2), "ss_12": (10.8, 13.2),
}
WINDOWS = {**R.NAMED_RANGES, **EXTRA_WINDOWS}
LETTER = {"natural": "n", "glicolado": "g", "calcinado": "c"}


# Windows read by the interval rules alone.
INTERVAL_WINDOWS = ("kaolinite_7a_n", "kaolinite_7a_g", "kaolinite_7a_c_check", "chlorite_14a_n", "chlorite_14a_c", "smectite_n", "smectite_g", "smectite_c",
                    "illite_10a_n", "illite_10a_g", "illite_10a_c", "quartz_101_n", "quartz_101_g", "quartz_101_c", "quartz_100")


def window_map(found: DataFrame, keep: tuple[str, ...] = ("curve_id", "sample_base", "preparation"), windows: tuple[str, ...] | None = None,
               widths: bool = True) -> DataFrame:
    """Per curve: strongest peak of each window, number of peaks, broad-peak flags.

    ``windows`` limits the map to the windows the rules at hand read, ``widths``
    leaves out the peak widths when no rule asks for broad peaks.
    """
    found = S.with_shapes(found) if widths else found
    x, y = F.col("two_theta"), F.col("corrected")
    rows = R.literal_rows([(k, lo, hi) for k, (lo, hi) in WINDOWS.items() if windows is None or k in windows], ("k", "lo", "hi"))
    pk = F.transform("peak_idx", lambda i, k: F.struct(S.at(y, i).alias("i"), bragg_d(S.at(x, i)).alias("d"), (F.get("shape.fwhm", k) if widths else F.lit(None).cast("double")).alias("w")))

    def best(pks):
        def one(w):
            hit = F.filter(pks, lambda p: (p["d"] >= w["lo"]) & (p["d"] <= w["hi"]))
            return F.struct(w["k"].alias("key"), F.array_max(F.transform(hit, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))).alias("value"))
        return F.struct(
            F.map_from_entries(F.filter(F.transform(rows, one), lambda e: e["value"].isNotNull())).alias("win"),
            F.size(pks).alias("n_peaks"), F.exists(pks, lambda p: F.coalesce(p["w"] > 0.5, F.lit(False))).alias("broad"),
            F.exists(pks, lambda p: F.coalesce((p["w"] >= 0.8) & p["d"].between(9.0, 18.6), F.lit(False))).alias("broad_basal"))
    return found.select(*keep, S.let(pk, best).alias("s")).select(*keep, "s.*")


def trios(windowed: DataFrame) -> DataFrame:
    """One row per sample: maps ``n``, ``g``, ``c`` of the first curve of each treatment."""
    aggs = []
    for prep, k in LETTER.items():
        mine = F.col("preparation") == prep
        aggs.append(F.min_by(F.when(mine, F.struct("win", "n_peaks", "broad", "broad_basal")), F.when(mine, F.col("curve_id"))).alias(f"_{k}"))
    t = windowed.groupBy("sample_base").agg(F.count("*").alias("n_curves"), *aggs)
    for k in LETTER.values():
        t = t.withColumn(f"has_{k}", F.col(f"_{k}").isNotNull()).withColumn(k, F.col(f"_{k}.win"))

    def flag(name):
        return F.coalesce(F.col(f"_n.{name}"), F.lit(False)) | F.coalesce(F.col(f"_g.{name}"), F.lit(False)) | F.coalesce(F.col(f"_c.{name}"), F.lit(False))
    n_peaks = sum((F.coalesce(F.col(f"_{k}.n_peaks"), F.lit(0)) for k in "ngc"), F.lit(0))
    count = sum((F.col(f"has_{k}").cast("int") for k in "ngc"), F.lit(0))
    t = t.withColumn("broad", flag("broad")).withColumn("broad_basal", flag("broad_basal")).withColumn("n_peaks", n_peaks)
    t = t.withColumn("treatments", count).withColumn("complete", F.col("has_n") & F.col("has_g") & F.col("has_c"))
    return t.withColumn("rep", F.coalesce("n", "g", "c")).drop("_n", "_g", "_c")


def hit(treatment: str, window: str) -> Column:
    return F.try_element_at(F.col(treatment), F.lit(window))


def has(treatment: str, *windows: str) -> Column:
    out = F.lit(True)
    for w in windows:
        out = out & hit(treatment, w).isNotNull()
    return F.coalesce(out, F.lit(False))


def intensity(treatment: str, window: str) -> Column:
    return F.coalesce(hit(treatment, window)["i"], F.lit(0.0))


def spacing(treatment: str, window: str) -> Column:
    return hit(treatment, window)["d"]


def anywhere(window: str) -> Column:
    return has("n", window) | has("g", window) | has("c", window)


def pts(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(float(value))).otherwise(F.lit(0.0))


def listed(**conds: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conds.items()]))


def rows_of(df: DataFrame, keep: tuple[str, ...], structs: Column, name: str = "r") -> DataFrame:
    return S.unnest(df, keep, structs, name).select(*keep, f"{name}.*")


# --- interval diagnosis -----------------------------------------------------

def illite_stable() -> Column:
    return has("n", "illite_10a_n") & has("g", "illite_10a_g") & has("c", "illite_10a_c")


def smectite_response() -> Column:
    return has("n", "smectite_n") & has("g", "smectite_g") & has("c", "smectite_c")


def kaolinite_lost(share: float = 0.1) -> Column:
    return has("n", "kaolinite_7a_n") & has("g", "kaolinite_7a_g") & (intensity("c", "kaolinite_7a_c_check") < intensity("n", "kaolinite_7a_n") * share)


def chlorite_kept() -> Column:
    return has("n", "chlorite_14a_n") & has("c", "chlorite_14a_c")


def quartz_stable() -> Column:
    return has("n", "quartz_101_n") & has("g", "quartz_101_g") & has("c", "quartz_101_c")


def interval_diagnosis(t: DataFrame) -> DataFrame:
    """Minerals whose windows behave as expected over the three treatments."""
    t = t.withColumn("minerals", listed(Caulinita=kaolinite_lost(), Clorita=chlorite_kept(), Esmectita=smectite_response(), Ilita=illite_stable(), Quartzo=quartz_stable()))
    state = F.when(chlorite_kept(), F.when(intensity("c", "chlorite_14a_c") > intensity("n", "chlorite_14a_n"), "intensificado").otherwise("preservado"))
    t = t.withColumn("chlorite_state", state).withColumn("quartz_100", quartz_stable() & has("n", "quartz_100"))
    return t.withColumn("status", F.when(F.size("minerals") > 0, "diagnosed").otherwise("inconclusive"))


# Score of a mineral once its interval rule holds.
GROUP_SCORES = {"Clorita": 0.9, "Esmectita": 0.88, "Ilita": 0.82, "Caulinita": 0.82, "Quartzo": 0.65}


def group_classification(diagnosed: DataFrame) -> DataFrame:
    """One row per sample and mineral with score and role."""
    score = F.create_map(*[F.lit(v) for kv in GROUP_SCORES.items() for v in kv])
    d = diagnosed.select("sample_base", "complete", F.explode_outer("minerals").alias("mineral")).where("mineral IS NOT NULL")
    d = d.withColumn("score", F.coalesce(F.try_element_at(score, F.col("mineral")), F.lit(0.5)))
    clay = F.col("mineral").isin("Clorita", "Esmectita", "Ilita", "Caulinita")
    role = (F.when(clay & (F.col("score") >= 0.8), "confirmed_by_rules").when(clay & (F.col("score") >= 0.5), "probable_by_rules").otherwise("possible_by_rules"))
    return d.withColumn("role", role).withColumn("trio_status", F.when(F.col("complete"), "complete").otherwise("incomplete"))


def companion_behaviour(t: DataFrame) -> DataFrame:
    """Expansion, stability, heating loss and resistance, plus mixed-layer warnings."""
    hits = sum((has(k, f"smectite_{k}").cast("int") for k in "ngc"), F.lit(0))
    warnings = listed(
        partial_expansion=(hits > 0) & (hits < 3),
        persistent_7a_with_14a=has("n", "kaolinite_7a_n") & has("c", "kaolinite_7a_c_check") & has("n", "chlorite_14a_n"),
        unstable_14a=has("n", "chlorite_14a_n") & ~has("c", "chlorite_14a_c"),
        illite_quartz_overlap=has("rep", "illite_3_33a") & has("rep", "quartz_101"))
    return t.select(
        "sample_base", F.when(smectite_response(), "complete").otherwise("partial").alias("smectite_expansion"),
        F.when(illite_stable(), "stable").otherwise("partial").alias("illite_stability"),
        F.when(has("n", "kaolinite_7a_n") & ~has("c", "kaolinite_7a_c_check"), "destroyed").otherwise("partial_or_persistent").alias("kaolinite_heating_loss"),
        F.when(chlorite_kept(), "preserved").otherwise("partial").alias("chlorite_heating_resistance"), warnings.alias("warnings"))


def targeted_screening(t: DataFrame, hint: dict[str, Column] | None = None) -> DataFrame:
    """Four clay minerals per sample: detected, possible, mixed layer suspected or not observed."""
    hint = hint or {}
    hinted = lambda k: hint.get(k, F.lit(False))
    s_hits = sum((has(k, f"smectite_{k}").cast("int") for k in "ngc"), F.lit(0))
    i_hits = sum((has(k, f"illite_10a_{k}").cast("int") for k in "ngc"), F.lit(0))
    cl = chlorite_kept()
    cl_any = has("n", "chlorite_14a_n") | has("c", "chlorite_14a_c") | has("n", "chlorite_3_53a")
    cl_status = F.when(cl, "detected").when(cl_any | hinted("Clorita"), "possible").otherwise("not_observed")
    cl_score = F.when(cl, 0.86).when(hinted("Clorita") & cl_any, 0.62).when(cl_any | hinted("Clorita"), 0.48).otherwise(0.0)
    s_status = F.when((s_hits == 3) & cl, "mixed_layer_suspected").when(s_hits == 3, "detected").when(s_hits == 2, "mixed_layer_suspected").when(
        s_hits == 1, "possible").otherwise("not_observed")
    s_score = F.when((s_hits == 3) & cl, 0.62).when(s_hits == 3, 0.88).when(s_hits == 2, 0.64).when(s_hits == 1, 0.48).otherwise(0.0)
    k_status = F.when(kaolinite_lost(), "detected").when(has("n", "kaolinite_7a_n") | has("g", "kaolinite_7a_g") | hinted("Caulinita"), "possible").otherwise("not_observed")
    i_status = F.when(i_hits == 3, "detected").when((i_hits > 0) | hinted("Ilita"), "possible").otherwise("not_observed")
    level = lambda st, hi, lo: F.when(st == "detected", hi).when(st == "possible", lo).otherwise(0.0)
    row = lambda m, st, sc: F.struct(F.lit(m).alias("mineral"), st.alias("status"), sc.cast("double").alias("score"))
    return rows_of(t, ("sample_base",), F.array(
        row("Esmectita", s_status, s_score), row("Clorita", cl_status, cl_score), row("Caulinita", k_status, level(k_status, 0.82, 0.45)),
        row("Ilita", i_status, level(i_status, 0.78, 0.42))))


def group_candidates(t: DataFrame) -> DataFrame:
    """Weighted evidence per mineral group with the 7 angstrom overlap rule."""
    cl_detected = chlorite_kept()
    sm1, sm2 = has("g", "smectite_g"), has("c", "smectite_c")
    sm = pts(sm1, 0.52) + pts(sm2, 0.24) + pts(F.col("has_n"), 0.14)
    sm = F.when(cl_detected & (sm > 0), F.least(sm, F.lit(0.74))).otherwise(sm)
    c14, c7, c35 = has("rep", "chlorite_14a"), has("rep", "chlorite_7a"), has("rep", "chlorite_3_53a")
    cl = pts(c14, 0.42) + pts(c7, 0.24) + pts(c35, 0.18)
    cl = F.when(cl_detected, F.greatest(cl, F.lit(0.92))).otherwise(cl)
    k7, k35 = has("rep", "kaolinite_7a"), has("rep", "kaolinite_3_57a")
    ka = pts(k7, 0.38) + pts(k35, 0.38) + pts(F.col("has_c"), 0.08)
    overlap = (k7 | c7) & ~c14 & ~F.col("has_c")
    cl_main = c14 | (c7 & c35)
    cl_any = has("n", "chlorite_14a_n") | has("c", "chlorite_14a_c") | has("n", "chlorite_3_53a")
    i_hits = sum((has(k, "illite_10a").cast("int") for k in "ngc"), F.lit(0))
    row = lambda cond, m, sc: F.when(cond, F.struct(F.lit(m).alias("mineral"), F.round(F.least(F.greatest(sc, F.lit(0.0)), F.lit(1.0)), 4).alias("score")))
    out = rows_of(t, ("sample_base", "complete"), F.array_compact(F.array(
        row(sm1 | sm2, "esmectita expansiva", sm), row(cl_main & ~overlap, "clorita/vermiculita", cl),
        row(~cl_main & cl_any & ~overlap, "clorita", F.when(cl_detected, 0.86).otherwise(0.48)),
        row((k7 | k35) & ~overlap, "caulinita", ka), row(overlap, "inconclusivo: sobreposição 7 Å clorita/caulinita", F.lit(0.52)),
        row(i_hits > 0, "ilita/mica", F.least(F.lit(0.86), i_hits * 0.22 + 0.24)))))
    return out.withColumn("confidence", group_confidence("score", "complete")).drop("complete")


# What each observation adds to a hypothesis, or takes from it.
CLAY_WEIGHTS = {
    "kaolin_group": {"natural_7a": 0.25, "glycolated_7a": 0.20, "stable_7a": 0.20, "lost_by_heating": 0.25, "line_3_57a": 0.10, "kept_by_heating": -0.25, "full_chlorite_series": -0.20},
    "chlorite_group": {"line_14a": 0.30, "line_7a": 0.20, "line_4_72a": 0.15, "line_3_53a": 0.15, "no_expansion": 0.20, "heat_resistant_14a": 0.20, "expanded_17a": -0.30},
    "smectite_group": {"natural_basal": 0.30, "glycolated_basal": 0.40, "calcined_basal": 0.25, "shift_over_1_2a": 0.15, "chlorite_without_expansion": -0.25},
    "illite_mica": {"line_10a_everywhere": 0.35, "line_10a_somewhere": 0.18, "no_expansion": 0.20, "calcined_10a": 0.15, "line_5a": 0.15, "line_3_33a": 0.10, "quartz_at_3_33a": -0.15},
    "vermiculite_group": {"no_expansion": 0.30, "collapse_of_14a": 0.20, "full_chlorite_series": -0.20},
    "mixed": {"partial_smectite_series": 0.30, "illite_with_expansion": 0.30, "broad_basal": 0.20},
}


def clay_interpretation(t: DataFrame) -> DataFrame:
    """Six hypotheses per sample: score, status, evidence for and against by name, missing treatments.

    Every observation adds or takes its weight of ``CLAY_WEIGHTS``; caps and the overlap rule follow.
    """
    p = has
    t = t.select(
        "sample_base", "has_n", "has_g", "has_c", "broad_basal", intensity("n", "kaolinite_7a_n").alias("n7"), intensity("g", "kaolinite_7a_g").alias("g7"),
        intensity("c", "kaolinite_7a_c_check").alias("c7"), F.abs(spacing("n", "kaolinite_7a_n") - spacing("g", "kaolinite_7a_g")).alias("k_gap"),
        (spacing("g", "smectite_g") - spacing("n", "smectite_n")).alias("s_gap"), p("rep", "kaolinite_3_57a").alias("k357"),
        p("rep", "chlorite_7a").alias("ch7"), p("rep", "chlorite_4_72a").alias("ch472"), p("rep", "chlorite_3_53a").alias("ch353"),
        p("n", "chlorite_14a_n").alias("n14"), p("g", "chlorite_14a_g").alias("g14"), p("c", "chlorite_14a_c").alias("c14"),
        p("n", "smectite_n").alias("sn"), p("g", "smectite_g").alias("sg"), p("c", "smectite_c").alias("sc"),
        p("n", "illite_10a_n").alias("in10"), p("g", "illite_10a_g").alias("ig10"), p("c", "illite_10a_c").alias("ic10"),
        p("rep", "illite_3_33a").alias("i333"), p("rep", "illite_5a").alias("i5"), p("rep", "quartz_101").alias("q101"))
    n7, g7, c7, k357, ch7, ch472, ch353, n14, g14, c14, sn, sg, sc, i333 = (
        F.col(k) for k in ("n7", "g7", "c7", "k357", "ch7", "ch472", "ch353", "n14", "g14", "c14", "sn", "sg", "sc", "i333"))
    t = t.withColumn("lost", F.col("has_c") & (n7 > 0) & (c7 < n7 * 0.25)).withColumn("full", n14 & ch7 & ch472 & ch353)
    t = t.withColumn("disc", (n14 | g14 | c14) & (ch472 | ch353 | c14)).withColumn(
        "i_hits", F.col("in10").cast("int") + F.col("ig10").cast("int") + F.col("ic10").cast("int"))
    lost, full, cl_disc, i_hits = F.col("lost"), F.col("full"), F.col("disc"), F.col("i_hits")
    s_hits = sn.cast("int") + sg.cast("int") + sc.cast("int")
    in10, ic10 = F.col("in10"), F.col("ic10")
    seen = {
        "kaolin_group": {"natural_7a": n7 > 0, "glycolated_7a": g7 > 0, "stable_7a": (n7 > 0) & (g7 > 0) & (F.col("k_gap") <= 0.25), "lost_by_heating": lost, "line_3_57a": k357,
                         "kept_by_heating": (n7 > 0) & (c7 >= n7 * 0.5), "full_chlorite_series": full},
        "chlorite_group": {"line_14a": n14 | g14 | c14, "line_7a": ch7, "line_4_72a": ch472, "line_3_53a": ch353, "no_expansion": n14 & ~sg, "heat_resistant_14a": n14 & c14, "expanded_17a": sg},
        "smectite_group": {"natural_basal": sn, "glycolated_basal": sg, "calcined_basal": sc, "shift_over_1_2a": sn & sg & (F.col("s_gap") > 1.2), "chlorite_without_expansion": ~sg & full},
        "illite_mica": {"line_10a_everywhere": i_hits == 3, "line_10a_somewhere": (i_hits > 0) & (i_hits < 3), "no_expansion": in10 & ~sg, "calcined_10a": ic10, "line_5a": F.col("i5"), "line_3_33a": i333,
                        "quartz_at_3_33a": i333 & F.col("q101") & (i_hits < 2)},
        "vermiculite_group": {"no_expansion": n14 & ~sg, "collapse_of_14a": n14 & ~c14, "full_chlorite_series": full},
        "mixed": {"partial_smectite_series": (s_hits > 0) & (s_hits < 3), "illite_with_expansion": (i_hits > 0) & sg, "broad_basal": F.col("broad_basal")},
    }

    def total(name):
        return sum((pts(seen[name][k], w) for k, w in CLAY_WEIGHTS[name].items()), F.lit(0.0))

    def named(name, sign):
        return F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(seen[name][k], F.lit(k)) for k, w in CLAY_WEIGHTS[name].items() if w * sign > 0])), ",")
    ka, cl, sm, il, ve, mx = (total(k) for k in CLAY_WEIGHTS)
    t = t.withColumn("ka", ka).withColumn("cl", cl)
    t = t.withColumn("ka", F.when(((n7 > 0) | (g7 > 0)) & ~lost, F.least("ka", F.when(k357, 0.38).otherwise(0.32))).otherwise(F.col("ka")))
    t = t.withColumn("cl", F.when(ch7 & ~cl_disc, F.least("cl", F.lit(0.34))).otherwise(F.col("cl")))
    ka, cl = F.col("ka"), F.col("cl")
    mx = F.when((cl >= 0.6) & (ka >= 0.4) & (c7 > 0), F.greatest(mx, F.lit(0.55))).otherwise(mx)
    unresolved = ((n7 > 0) | (g7 > 0) | ch7) & ~lost & ~cl_disc
    mx = F.when(unresolved, F.greatest(mx, F.lit(0.52))).otherwise(mx)
    clip = lambda s: F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) + 1e-9, 4)
    row = lambda name, s, kind, label=None: F.struct((F.lit(name) if label is None else label).alias("candidate_id"), clip(s).alias("score"), F.lit(kind).alias("kind"),
                                                     named(name, 1).alias("evidence_for"), named(name, -1).alias("evidence_against"))
    t = t.withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(prep)) for k, prep in zip("ngc", ("natural", "glicolado", "calcinado"))])), ","))
    out = rows_of(t, ("sample_base", "missing"), F.array(
        row("kaolin_group", ka, "plain"), row("chlorite_group", cl, "plain"), row("smectite_group", sm, "plain"), row("illite_mica", il, "plain"),
        row("vermiculite_group", ve, "provisional"),
        row("mixed", mx, "mixed", F.when(unresolved, "kaolin_chlorite_overlap_7a").otherwise("mixed_layer"))))
    k = F.col("kind")
    ambiguous = (F.col("candidate_id") == "kaolin_chlorite_overlap_7a") | ((k == "mixed") & (F.col("score") >= 0.4))
    return out.withColumn("status", candidate_status("score", k == "provisional", ambiguous)).drop("kind")


# --- layered engine ---------------------------------------------------------

STABLE_WINDOWS = ("chlorite_14a", "illite_10a", "kaolinite_7a", "kerolite_9_4a", "sepiolite_12a")


def any_of(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def behaviours(t: DataFrame) -> DataFrame:
    """Adds ``behaviours``: sorted names of the treatment responses of a sample."""
    sn, sg, sc = has("n", "smectite_n"), has("g", "smectite_g"), has("c", "smectite_c")
    expands = sn & sg & (spacing("g", "smectite_g") - spacing("n", "smectite_n") >= 0.8)
    n29 = has("n", "corrensite_n_29a") & has("g", "corrensite_g_31a")
    w = STABLE_WINDOWS
    ni, ci = intensity("n", "chlorite_14a"), intensity("c", "chlorite_14a")
    nk, ck = intensity("n", "kaolinite_7a"), intensity("c", "kaolinite_7a")
    return t.withColumn("behaviours", listed(
        appears_after_heating=has("c", "corrensite_c_24a"), broad_or_shoulder=F.col("broad"), collapses_after_heating=sg & sc,
        disappears_after_heating=any_of(has("n", x) & ~has("c", x) for x in w), expands_with_glycol=F.coalesce(expands, F.lit(False)),
        increases_intensity_after_heating=has("n", "chlorite_14a") & has("c", "chlorite_14a") & (ni > 0) & (ci >= ni * 1.20),
        ordered_chlorite_smectite=n29, partial_expansion_with_glycol=sn & sg & ~F.coalesce(expands, F.lit(False)),
        persists_after_heating=any_of(has("n", x) & has("c", x) for x in w), quartz_internal_standard_pattern=anywhere("quartz_100") & anywhere("quartz_101"),
        rational_sequence=n29, stable_after_glycol=any_of(has("n", x) & has("g", x) for x in w),
        strongly_reduced_after_heating=has("n", "kaolinite_7a") & has("c", "kaolinite_7a") & (nk > 0) & (ck <= nk * 0.30)))


# Windows of each peak set, by the names used here.
PEAK_SET_WINDOWS = {
    "illite_mica": ("illite_10a", "illite_5a", "illite_3_33a"), "kaolin_group": ("kaolinite_7a", "kaolinite_3_57a"),
    "chlorite_group": ("chlorite_14a", "chlorite_7a", "chlorite_4_72a", "chlorite_3_53a"), "smectite_group": ("smectite_n", "smectite_g", "smectite_c"),
    "sepiolite": ("sepiolite_12a",), "palygorskite": ("palygorskite_10_5a",), "kerolite_talc": ("kerolite_9_4a",),
    "corrensite": ("set_29_32a", "set_14_15a", "chlorite_7a"),
}


def peak_set_score(family: str) -> Column:
    ws = PEAK_SET_WINDOWS[family]
    return sum((anywhere(w).cast("double") for w in ws), F.lit(0.0)) / len(ws)


def peak_sets(t: DataFrame) -> DataFrame:
    """Families with at least one companion reflection: score, matched, missing."""
    def row(fam):
        ws = PEAK_SET_WINDOWS[fam]
        found = F.array_compact(F.array(*[F.when(anywhere(w), F.lit(w)) for w in ws]))
        return F.struct(F.lit(fam).alias("family"), peak_set_score(fam).alias("score"), found.alias("matched"), F.array_except(F.array(*[F.lit(w) for w in ws]), found).alias("missing"))
    return rows_of(t, ("sample_base",), F.array(*[row(f) for f in PEAK_SET_WINDOWS])).where("score > 0")


AMBIGUITY_WINDOWS = ("amb_7a", "amb_10a", "amb_12a", "amb_14a", "amb_3_33a", "amb_1_54a")


def ambiguities(t: DataFrame) -> DataFrame:
    """Adds ``ambiguities``: crowded windows that hold a peak of any treatment."""
    return t.withColumn("ambiguities", listed(**{w: anywhere(w) for w in AMBIGUITY_WINDOWS}))


def mixed_layer_rows() -> list:
    """Conditions of the interstratification hypotheses: (condition, name, ordering, confidence)."""
    b = lambda name: F.array_contains("behaviours", name)
    g17 = has("g", "mix_17a")
    return [
        (has("n", "corrensite_n_29a") & has("g", "corrensite_g_31a"), "corrensite", "R1", F.when(has("c", "corrensite_c_24a"), "high").otherwise("medium")),
        (b("partial_expansion_with_glycol") | b("broad_or_shoulder"), "illite_smectite_or_random_mixed_layer", "R0|unknown", F.lit("medium")),
        (has("n", "mix_14a") & g17, "chlorite_smectite", "R0|unknown", F.lit("medium")),
        (has("n", "mix_9_10a") & (g17 | F.col("mg_context")), "kerolite_stevensite_mixed_layer", "unknown", F.lit("medium")),
        (has("n", "mix_9_4a") & g17, "talc_smectite", "unknown", F.lit("medium"))]


def mixed_layers(t: DataFrame) -> DataFrame:
    """Interstratification hypotheses; needs ``behaviours`` and ``mg_context``."""
    return rows_of(t, ("sample_base",), F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("hypothesis"), F.lit(order).alias("ordering"), conf.alias("confidence"))) for cond, name, order, conf in mixed_layer_rows()])))


# Partial scores of a mixed-layer hypothesis among the candidates; its behaviour by confidence.
MIXED_BEHAVIOUR = {"high": 0.8, "medium": 0.6}
MIXED_PARTS = {"peak_set": 0.5, "d060": 0.4, "thermal": 0.5, "proximity": 0.6}


def candidates(t: DataFrame, mixed: bool = False) -> DataFrame:
    """Candidate minerals with their partial scores; with ``mixed`` also the mixed-layer hypotheses.

    Needs ``behaviours``, ``octahedral`` (type from d060), ``mg_context`` and
    ``evaporitic_context``.
    """
    b = lambda name: F.array_contains("behaviours", name)
    octa = F.col("octahedral")
    tri, di, known = octa == "trioctahedral", octa == "dioctahedral", octa != "unknown"
    smectite = b("expands_with_glycol") & b("collapses_after_heating")
    mg = tri | (octa == "intermediate") | F.col("mg_context")
    chlorite = has("n", "chlorite_14a_n") & has("g", "chlorite_14a_g") & has("c", "chlorite_14a_c")
    illite = has("n", "illite_10a") & has("g", "illite_10a") & has("c", "illite_10a")
    kaolin = has("n", "kaolinite_7a_n") & has("g", "kaolinite_7a_g") & (~has("c", "kaolinite_7a_c_check") | b("strongly_reduced_after_heating"))

    def row(cond, label, behaviour, peak_set, d060, thermal, proximity, companions=False):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        ps = peak_set_score(peak_set) if isinstance(peak_set, str) else F.lit(float(peak_set))
        return F.when(cond, F.struct(
            lit(label).alias("label"), lit(behaviour).cast("double").alias("behaviour"), ps.alias("peak_set"), lit(d060).cast("double").alias("d060"),
            lit(thermal).cast("double").alias("thermal"), lit(proximity).cast("double").alias("proximity"), F.lit(companions).alias("companions")))
    pick = lambda cond, a, z: F.when(cond, float(a)).otherwise(float(z))
    keep = ("sample_base", "treatments", "has_n", "has_g", "n_peaks", "ambiguities")
    blends = [row(cond, name, pick(conf == "high", MIXED_BEHAVIOUR["high"], MIXED_BEHAVIOUR["medium"]), *MIXED_PARTS.values()) for cond, name, _, conf in mixed_layer_rows()] if mixed else []
    return rows_of(t, keep, F.array_compact(F.array(
        *blends,
        row(smectite, "smectite_group", 1.0, "smectite_group", pick(known, 0.5, 0.0), 1.0, 0.8),
        row(smectite & mg, F.when(F.col("evaporitic_context"), "stevensite").otherwise("saponite"), 0.9, "smectite_group", pick(tri, 1.0, 0.5), 0.8, 0.7),
        row(smectite & ~mg & di, "montmorillonite_or_nontronite", 0.85, "smectite_group", 1.0, 0.8, 0.6),
        row(chlorite, "chlorite", 0.85, "chlorite_group", pick(tri, 1.0, 0.3), 0.9, 0.8, True),
        row(chlorite & di, "dioctahedral_chlorite", 0.75, "chlorite_group", 1.0, 0.8, 0.7),
        row(has("n", "vermiculite_14a") & has("g", "vermiculite_14a") & has("c", "vermiculite_collapse"), "vermiculite", 0.75, 0.35, 0.3, 0.8, 0.6),
        row(illite, "illite_mica", 0.85, "illite_mica", pick(known, 0.6, 0.0), 0.8, 0.8, True),
        row(illite & tri, "biotite", 0.55, "illite_mica", 1.0, 0.6, 0.5),
        row(kaolin, "kaolin_group", 0.85, "kaolin_group", pick(di, 0.7, 0.2), 1.0, 0.8, True),
        row(has("n", "kerolite_9_4a") & has("g", "kerolite_9_4a") & ~has("g", "smectite_g"), "kerolite", 0.75, "kerolite_talc", pick(tri, 0.8, 0.2), 0.5, 0.7),
        row(has("n", "sepiolite_12a") & has("g", "sepiolite_12a"), "sepiolite", 0.65, "sepiolite", 0.2, 0.5, 0.6),
        row(has("n", "palygorskite_10_5a") & has("g", "palygorskite_10_5a"), "palygorskite", 0.65, "palygorskite", 0.2, 0.5, 0.6),
        row(has("n", "chlorite_7a") & has("g", "chlorite_7a") & has("c", "chlorite_7a") & tri, "serpentine", 0.55, 0.2, 1.0, 0.4, 0.5))))


def score_candidates(c: DataFrame) -> DataFrame:
    """0-100 score with caps for missing treatments, single peaks and unresolved overlaps."""
    part = lambda k, w: F.least(F.col(k), F.lit(1.0)) * w
    amb = F.size("ambiguities") > 0
    raw = part("behaviour", 40) + part("peak_set", 25) + part("d060", 15) + part("thermal", 10) + part("proximity", 5) + pts(~amb, 5)
    cap = lambda s, cond, top: F.when(cond, F.least(s, F.lit(float(top)))).otherwise(s)
    raw = cap(raw, F.col("treatments") < 2, 40)
    raw = cap(raw, ~F.col("has_n") | ~F.col("has_g"), 70)
    raw = cap(raw, F.col("n_peaks") <= 1, 40)
    raw = cap(raw, amb & F.col("companions") & (F.col("peak_set") < 0.5), 70)
    c = c.withColumn("score", F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)) + 1e-9, 2))
    return c.withColumn("level", rule_level("score"))


def recommended_tests(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Next laboratory tests suggested by overlaps, d060 and candidate labels (``sample_base, labels``)."""
    j = t.join(labels, "sample_base", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    amb = lambda *ws: F.arrays_overlap("ambiguities", F.array(*[F.lit(w) for w in ws]))
    lab = lambda *ls: F.arrays_overlap("labels", F.array(*[F.lit(x) for x in ls]))
    tests = listed(ftir=F.lit(True), random_powder=F.lit(True), heating_400_550=amb("amb_7a", "amb_14a"), glycerol_potassium=amb("amb_14a"),
                   quartz_pattern=amb("amb_3_33a", "amb_1_54a"), chlorite_003_004=amb("amb_7a"), refine_060=F.col("octahedral") == "unknown",
                   mg_chemistry=lab("stevensite", "saponite", "kerolite"), morphology=lab("sepiolite", "palygorskite", "serpentine"))
    return j.select("sample_base", tests.alias("tests"))


def relation_edges(t: DataFrame) -> DataFrame:
    """Edges between treatments: expansion, collapse, persistence, loss."""
    def edge(cond, source, target, kind, weight, delta):
        return F.when(cond, F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(kind).alias("relation"), F.lit(float(weight)).alias("weight"), delta.alias("delta_d")))
    gap = lambda a, wa, z, wz: spacing(z, wz) - spacing(a, wa)
    none = F.lit(None).cast("double")
    edges = [
        edge(has("n", "smectite_n") & has("g", "smectite_g") & (gap("n", "smectite_n", "g", "smectite_g") >= 0.8), "N:smectite_n", "G:smectite_g", "expands_to", 0.4, gap("n", "smectite_n", "g", "smectite_g")),
        edge(has("g", "smectite_g") & has("c", "smectite_c"), "G:smectite_g", "C:smectite_c", "collapses_to", 0.4, gap("g", "smectite_g", "c", "smectite_c")),
        edge(has("n", "corrensite_n_29a") & has("g", "corrensite_g_31a"), "N:corrensite_n_29a", "G:corrensite_g_31a", "expands_to", 0.45, gap("n", "corrensite_n_29a", "g", "corrensite_g_31a"))]
    for w in STABLE_WINDOWS:
        edges += [edge(has("n", w) & has("g", w), f"N:{w}", f"G:{w}", "persists_as", 0.15, gap("n", w, "g", w)),
                  edge(has("n", w) & has("c", w), f"N:{w}", f"C:{w}", "persists_as", 0.15, gap("n", w, "c", w)),
                  edge(has("n", w) & ~has("c", w), f"N:{w}", "C:absent", "disappears", 0.2, none)]
    return rows_of(t, ("sample_base",), F.array_compact(F.array(*edges)))


def with_context(t: DataFrame, context: DataFrame) -> DataFrame:
    """Join d060 and context flags (``sample_base, d060, mg_context, evaporitic_context``)."""
    j = t.join(context, "sample_base", "left")
    for f in ("mg_context", "evaporitic_context"):
        j = j.withColumn(f, F.coalesce(f, F.lit(False)))
    return j.withColumn("octahedral", F.coalesce(octahedral_class("d060"), F.lit("unknown")))


def interpret(t: DataFrame, context: DataFrame) -> DataFrame:
    """All layers of a sample: every mineral and mixed-layer candidate with score, level and rank."""
    from xrdlake.operators.panels import rank_within

    s = score_candidates(candidates(ambiguities(behaviours(with_context(t, context))), mixed=True))
    return rank_within(s, ["sample_base"], [F.desc("score"), F.col("label")])


def heat_ratio_rules(t: DataFrame) -> DataFrame:
    """Rules that weigh companion reflections and the heat ratio; needs ``behaviours``."""
    b = lambda name: F.array_contains("behaviours", name)
    n14, g14, c14 = has("n", "ool_14"), has("g", "ool_14"), has("c", "ool_14c")
    extra = anywhere("ool_7").cast("int") + anywhere("ool_4_74").cast("int") + anywhere("ool_3_55").cast("int")
    ratio = F.try_divide(hit("c", "ool_14c")["i"], hit("n", "ool_14")["i"])
    chl = F.lit(0.82) + F.least(F.lit(0.12), (extra - 1) * 0.03) + pts(ratio >= 0.75, 0.04)
    n7, g7 = has("n", "heat_7"), has("g", "heat_7")
    loss = F.coalesce((n7 & g7 & ~has("c", "heat_7")) | (F.try_divide(intensity("c", "heat_7"), hit("n", "heat_7")["i"]) <= 0.25) | b("strongly_reduced_after_heating"), F.lit(False))
    s357 = has("n", "heat_3_57") | has("g", "heat_3_57")
    gsm = has("g", "exp_g")
    mica = has("n", "mica_10") & has("g", "mica_10") & has("c", "mica_10c")
    p5 = anywhere("mica_5")

    def row(cond, label, score, level):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(cond, F.struct(F.lit(label).alias("label"), F.round(lit(score).cast("double") + 1e-9, 3).alias("score"), lit(level).alias("level")))
    conf, prob, poss = "confirmed_by_rules", "probable_by_rules", "possible_by_rules"
    return rows_of(t, ("sample_base",), F.array_compact(F.array(
        row(n14 & g14 & c14 & (extra >= 1) & ~b("expands_with_glycol"), "chlorite", F.least(chl, F.lit(0.98)), conf),
        row(n7 & g7 & loss & ~n14, "kaolin_group", F.lit(0.84) + pts(s357, 0.08), conf),
        row(has("n", "exp_n") & gsm & has("c", "exp_c"), "smectite_group", 0.95, conf),
        row(mica, "illite_mica", F.least(F.lit(0.76) + pts(p5, 0.08) + pts(anywhere("mica_3_33"), 0.04), F.lit(0.92)), F.when(p5, conf).otherwise(prob)),
        row(has("n", "op_14_5") & has("g", "op_14_5") & has("c", "op_10_12") & ~gsm & ~c14, "vermiculite", 0.78, prob),
        row(has("n", "fib_12") & has("g", "fib_12") & ~gsm, "sepiolite", 0.68, poss),
        row(has("n", "fib_10_4") & has("g", "fib_10_4") & ~mica, "palygorskite", 0.66, poss))))


def mixed_layer_features(t: DataFrame) -> DataFrame:
    """Features, superstructures, ordering and mixture reading of a sample."""
    f = listed(collapses_or_returns_to_10a=has("c", "ml_10"), expands_with_eg_to_17a=has("g", "ml_17"),
               long_period_candidate=has("n", "ml_24") | has("g", "ml_29") | has("c", "ml_24"),
               persistent_14a_component=has("n", "ml_14n") & has("g", "ml_14g") & has("c", "ml_14c"))
    ss = listed(**{w: anywhere(w) for w in ("ss_24", "ss_29", "ss_31", "ss_12")})
    t = t.withColumn("features", f).withColumn("superstructures", ss)
    any_ss = F.size("superstructures") > 0
    moves = F.array_contains("features", "expands_with_eg_to_17a") | F.array_contains("features", "collapses_or_returns_to_10a")
    return t.withColumn("ordering", F.when(any_ss, "R1").otherwise("unknown")).withColumn(
        "mixture", F.when(any_ss & moves, "supports_interstratification").otherwise("ambiguous"))


def mixed_layer_candidates(t: DataFrame) -> DataFrame:
    """Ranked mixed-layer hypotheses; needs the columns of :func:`mixed_layer_features`."""
    from xrdlake.functions.values import mixed_layer_status
    from xrdlake.operators.panels import rank_within

    f = lambda name: F.array_contains("features", name)
    row = lambda cond, name, score: F.when(cond, F.struct(F.lit(name).alias("candidate"), F.lit(score).alias("confidence")))
    a = f("expands_with_eg_to_17a") & f("collapses_or_returns_to_10a")
    c2 = f("persistent_14a_component") & f("expands_with_eg_to_17a")
    l2 = (F.size("superstructures") > 0) & f("long_period_candidate")
    out = rows_of(t, ("sample_base", "ordering"), F.array_compact(F.array(
        row(a, "illite/smectite_or_smectitic_mixed_layer", 0.68), row(c2, "chlorite/smectite", 0.70), row(l2, "corrensite_or_ordered_mixed_layer", 0.78),
        row(~a & ~c2 & ~l2, "mixed_layer_evidence_insufficient", 0.25))))
    return rank_within(out, ["sample_base"], [F.desc("confidence"), F.col("candidate")]).withColumn("status", mixed_layer_status("confidence"))


def panel_diagnosis(t: DataFrame) -> DataFrame:
    """Panel reading of a sample: as the interval rules, with partial chlorite and confidence words."""
    n, g, c = has("n", "chlorite_14a_n"), has("g", "chlorite_14a_g"), has("c", "chlorite_14a_c")
    kao = has("n", "kaolinite_7a_n") & has("g", "kaolinite_7a_g") & (
        ~has("c", "kaolinite_7a_c_check") | (intensity("c", "kaolinite_7a_c_check") < intensity("n", "kaolinite_7a_n") * 0.1))
    chl = c | (n & g)
    chl_conf = F.when(c & n, "alta").when(c & g, "média/alta").otherwise("média")
    none = ~(illite_stable() | smectite_response() | kao | chl | quartz_stable())
    row = lambda cond, m, conf: F.when(cond, F.struct(F.lit(m).alias("mineral"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence")))
    return rows_of(t, ("sample_base",), F.array_compact(F.array(
        row(illite_stable(), "Ilita", "alta"), row(smectite_response(), "Esmectita", "alta"), row(kao, "Caulinita", "alta"), row(chl, "Clorita", chl_conf),
        row(quartz_stable(), "Quartzo", F.when(has("n", "quartz_100"), "alta").otherwise("média/alta")), row(none, "Inconclusivo", "baixa"))))


def explanations(scored: DataFrame) -> DataFrame:
    """Evidence for, evidence missing and follow-up of scored candidates."""
    part = {"behaviour": 40, "peak_set": 25, "d060": 15, "thermal": 10, "proximity": 5}
    good = F.array_compact(F.array(*[F.when(F.col(k) >= 0.5, F.lit(k)) for k in part]))
    poor = F.array_compact(F.array(*[F.when(F.col(k) < 0.5, F.lit(k)) for k in part]))
    return scored.withColumn("evidence_for", good).withColumn("missing", poor).withColumn(
        "follow_up", F.when(F.col("score") >= 70, F.array().cast("array<string>")).otherwise(F.array(F.lit("full_pattern_all_treatments"))))


# --- trajectories -----------------------------------------------------------

def basal_trajectory(t: DataFrame) -> DataFrame:
    """Low-angle spacing under each treatment, shifts and reading."""
    def first(k, *ws):
        return F.coalesce(*[spacing(k, w) for w in ws])
    n = first("n", "smectite_n", "chlorite_14a_n", "illite_10a_n")
    g = first("g", "smectite_g", "chlorite_14a_g", "illite_10a_g")
    c = first("c", "smectite_c", "chlorite_14a_c", "kaolinite_7a_c_check")
    t = t.withColumn("dn", n).withColumn("dg", g).withColumn("dc", c)
    inside = lambda col, w: F.coalesce(F.col(col).between(*R.NAMED_RANGES[w]), F.lit(False))
    expanded = inside("dg", "smectite_g")
    count = lambda w: sum((inside(k, w).cast("int") for k in ("dn", "dg", "dc")), F.lit(0))
    reading = (F.when(F.col("dn").isNotNull() & expanded & inside("dc", "smectite_c"), "expansive")
               .when(expanded, "expansive_incomplete").when(count("illite_10a") >= 2, "illite_mica")
               .when(count("chlorite_14a") >= 2, "chlorite_vermiculite").otherwise("insufficient"))
    t = t.withColumn("reading", reading)
    conf = (F.when(F.col("reading") == "expansive", "alta").when((F.col("reading") == "expansive_incomplete") & ~F.col("has_c"), "baixa")
            .when(F.col("reading") == "insufficient", "baixa").otherwise("média"))
    return t.select("sample_base", "dn", "dg", "dc", (F.col("dg") - F.col("dn")).alias("shift_ng"), (F.col("dc") - F.col("dg")).alias("shift_gc"), "reading",
                    conf.alias("confidence"))


def trajectory_score(t: DataFrame) -> DataFrame:
    """0-1 score of a sample's response: completeness, expansion, collapse, stability."""
    sn, sg, sc = has("n", "smectite_n"), has("g", "smectite_g"), has("c", "smectite_c")
    ng, gc = spacing("g", "smectite_g") - spacing("n", "smectite_n"), spacing("c", "smectite_c") - spacing("g", "smectite_g")
    expansion = F.when(sn & sg & (ng >= 1), 1.0).when(sg, 0.65).otherwise(0.0)
    collapse = F.when(sg & sc & (gc <= -5), 1.0).when(sc & (sn | sg), 0.55).otherwise(0.0)

    def stability(*pairs):
        k = sum((has(a, w).cast("int") for a, w in pairs), F.lit(0))
        return F.when(k >= 3, 1.0).when(k == 2, 0.75).when(k == 1, 0.35).otherwise(0.0)
    s10 = stability(("n", "illite_10a_n"), ("g", "illite_10a_g"), ("c", "illite_10a_c"))
    s14 = stability(("n", "chlorite_14a_n"), ("g", "chlorite_14a_g"), ("c", "chlorite_14a_c"))
    s7 = stability(("n", "kaolinite_7a_n"), ("g", "kaolinite_7a_g"), ("c", "kaolinite_7a_c_check"))
    t = t.select("sample_base", (F.col("treatments") / 3).alias("completeness"), expansion.alias("expansion"), collapse.alias("collapse"),
                 F.greatest(s10, s14, s7).alias("stability"))
    score = (F.col("completeness") * 0.20 + F.col("expansion") * 0.25 + F.col("collapse") * 0.20 + F.col("stability") * 0.20
             + F.greatest("expansion", "collapse", "stability") * 0.15)
    return t.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def completeness(t: DataFrame) -> DataFrame:
    """How far a sample supports an interpretation."""
    status = (F.when((F.col("treatments") == 3) & (F.col("n_peaks") >= 6), "completa").when((F.col("treatments") >= 2) & (F.col("n_peaks") >= 3), "parcial")
              .when(F.col("n_peaks") < 3, "fraca").otherwise("revisar"))
    flags = listed(MISSING_NATURAL=~F.col("has_n"), MISSING_GLYCOLATED=~F.col("has_g"), MISSING_CALCINED=~F.col("has_c"))
    return t.select("sample_base", "treatments", "n_peaks", status.alias("status"), flags.alias("flags"))


def confirmatory_reflections(peaks: DataFrame) -> DataFrame:
    """Per sample and reflection rule: treatments that show it and its status; rules without a hit are listed too."""
    rules = R.literal_rows(R.CONFIRMATORY_REFLECTIONS, ("mineral", "reflection", "target", "d_min", "d_max", "required"))
    hits = F.filter(rules, lambda w: F.col("d").between(w["d_min"], w["d_max"]) & ((w["required"] == "") | (w["required"] == F.col("preparation"))))
    seen = peaks.select("sample_base", "preparation", F.explode_outer(hits).alias("w")).groupBy("sample_base").agg(
        F.collect_set(F.when(F.col("w").isNotNull(), F.struct("w.mineral", "w.reflection", "preparation"))).alias("seen"))  # at most one per rule and treatment
    g = seen.select("sample_base", "seen", F.explode(rules).alias("w")).select(
        "sample_base", "w.mineral", "w.reflection",
        F.size(F.filter("seen", lambda s: (s["mineral"] == F.col("w.mineral")) & (s["reflection"] == F.col("w.reflection")))).cast("long").alias("matches"))
    return g.withColumn("status", F.when(F.col("matches") >= 2, "evidência de suporte").when(F.col("matches") == 1, "observação isolada").otherwise("não observado"))


def confirmatory_minerals(reflections: DataFrame) -> DataFrame:
    """Per sample and mineral: observed and absent reflections and the reading."""
    seen = F.col("matches") > 0
    r = lambda name: F.max((seen & (F.col("reflection") == name)).cast("int")) == 1
    g = reflections.groupBy("sample_base", "mineral").agg(
        F.count_if(seen).alias("observed"), F.count_if(~seen).alias("absent"), r("001 em EG").alias("eg"), r("colapso aquecido").alias("heated"),
        r("001 natural").alias("nat"), r("sem expansão em EG").alias("no_exp"))
    m = F.col("mineral")
    status = (F.when(m.startswith("Esmectita") & F.col("eg") & F.col("heated"), "compatível").when(m.startswith("Esmectita") & F.col("eg"), "parcial")
              .when(m.startswith("Esmectita"), "não conclusivo")
              .when((m == "Vermiculita") & F.col("nat") & F.col("no_exp") & F.col("heated"), "compatível").when((m == "Vermiculita") & F.col("nat") & F.col("no_exp"), "parcial")
              .when(m == "Vermiculita", "não conclusivo").when(F.col("observed") >= 2, "compatível").when(F.col("observed") == 1, "parcial").otherwise("não conclusivo"))
    return g.select("sample_base", "mineral", "observed", "absent", status.alias("status"))
